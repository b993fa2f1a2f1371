"""Pseudonyms against a plain Python twin, and the properties that a permutation within a format has."""

import datetime
import hashlib
import random
from collections import Counter

import pytest
import regex

from fieldspark.llm import pii

KEY = "a key of the test"
SCHEMA = "doc_id bigint, text string, hits string, made int, gaps int"


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def permuted(symbols, radices, tweak):
    half = len(symbols) // 2
    a, ra, b, rb = symbols[:half], radices[:half], symbols[half:], radices[half:]
    for turn in range(1, pii.ROUNDS + 1):
        seed = sha(KEY, tweak, turn, ",".join(map(str, b)))
        bits = [int((seed if i < 8 else sha(seed, i // 8))[i % 8 * 8:i % 8 * 8 + 8], 16) for i in range(len(a))]
        a, ra, b, rb = b, rb, [(x + s) % r for x, s, r in zip(a, bits, ra)], ra
    return a + b


def refilled(value, digits):
    digits = iter(digits)
    return "".join(str(next(digits)) if c in "0123456789" else c for c in value)


def luhn(digits, doubled):
    return sum((2 * d - 9 if d > 4 else 2 * d) if k % 2 == doubled else d for k, d in enumerate(reversed(digits)))


def leap(y):
    return y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)


def one(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "card":
        if luhn(digits, 1) % 10:
            return None
        body = permuted(digits[:-1], [10] * (len(digits) - 1), f"card{len(digits)}")
        return refilled(value, [*body, -luhn(body, 0) % 10])
    if kind == "phone":
        if not 8 <= len(digits) <= 15:
            return None
        last, large = digits[-10:], digits[-10:][0] >= 2
        moved = permuted([last[0] - 2 * large, *last[1:]], [8 if large else 2, *[10] * (len(last) - 1)], f"phone|{len(digits)}|{str(large).lower()}")
        return refilled(value, [*digits[:-10], moved[0] + 2 * large, *moved[1:]])
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, g, s = permuted([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], "ssn")
        return f"{a + 1 + (a >= 665):03}-{g + 1:02}-{s + 1:04}"
    if kind == "ip":
        return ".".join(map(str, permuted([int(x) for x in value.split(".")], [256] * 4, "ip")))
    if kind == "email":
        local, host = value.split("@")
        runs = [next(((b, n) for b, n in pii.RUNS if b <= ord(c) < b + n), (ord(c), 1)) for c in local]
        moved = permuted([ord(c) - b for c, (b, _) in zip(local, runs)], [n for _, n in runs], "email" + ",".join(f"{b}:{n}" for b, n in runs))
        return "".join(chr(b + m) for (b, _), m in zip(runs, moved)) + "@" + host
    iso, dotted = "-" in value, "." in value
    a, b, c = regex.split("[./-]", value)
    late = not iso and not dotted and int(a) > 12
    day_first = dotted or late
    y, m, d = (a, b, c) if iso else (c, b, a) if day_first else (c, a, b)
    year, block = int(y), (int(y) + 100) // 200
    first, end = max(1, block * 200 - 100), min(9999, block * 200 + 99)
    form = f"date|{iso}|{day_first}|{late}|{len(m)}|{len(d)}|{block}".lower()
    if year < 1:
        return None
    if leap(year) and (int(m), int(d)) == (2, 29):
        leaps = [k for k in range(first, end + 1) if leap(k)]
        year, month, day = leaps[permuted([leaps.index(year)], [len(leaps)], form + "|leap")[0]], 2, 29
    else:
        days = pii._month_days(len(m), len(d), late)
        if 100 * int(m) + int(d) not in days:
            return None
        moved = permuted([year - first, days.index(100 * int(m) + int(d))], [end - first + 1, len(days)], form)
        year, (month, day) = first + moved[0], divmod(days[moved[1]], 100)
    y, m, d = f"{year:04}", str(month).zfill(len(m)), str(day).zfill(len(d))
    return "-".join((y, m, d)) if iso else ".".join((d, m, y)) if dotted else "/".join((d, m, y) if day_first else (m, d, y))


def twin(text):
    counts = Counter()

    def replaced(hit):
        kind = next(k for k in pii.KINDS if regex.fullmatch(pii.FORMS[k], hit[0], regex.A if k != "email" else 0))
        new = one(kind, hit[0])
        if new is None or new == hit[0]:
            return hit[0]
        counts[kind] += 1
        return new

    return regex.sub(pii.ANY, replaced, text) if text is not None else None, [counts[k] for k in pii.KINDS]


def awkward():
    draw = random.Random(11)
    digit = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    card = lambda body: body + str(-luhn([int(c) for c in body], 0) % 10)
    texts = [None, "", "nothing here 1234", "___@b.com жук@пример.рф ЖУК@b.com 中文x@b.com ab@c a@b.c first.last+tag@mail-5.example.co.uk. é.ß@b.de",
             "10.0.0.1 255.255.255.255 256.1.1.1 01.2.3.4 1.2.3.4.5", "3/14/2001 03/4/2001 3/4/2001 15/09/2001 15/9/2001 09/15/2001 31.12.1999 1.2.1999 2024-02-29 2023-02-29 29.02.2000 0000-01-01 9999-12-31 13/13/2000"]
    for _ in range(60):
        texts.append(" ".join([card("4" + digit(draw.choice((11, 14, 15, 17)))), digit(16), f"{digit(3)}-{digit(2)}-{digit(4)}", f"+{draw.randint(1, 99)} {digit(3)} {digit(3)} {digit(4)}",
                               f"({digit(3)}) {digit(3)}-{digit(4)}", f"{draw.choice('abcxyz')}{digit(2)}.{draw.choice(['Ann', 'bob', 'Zoë'])}@host{digit(1)}.org",
                               f"{draw.randint(1800, 2200)}-{draw.randint(1, 13):02}-{draw.randint(1, 31):02}", f"{draw.randint(0, 256)}.{draw.randint(0, 99)}.0.{draw.randint(0, 255)}"]))
    return texts


def test_equals_the_twin(spark):
    texts = awkward()
    rows = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, texts[3], "x", 1, 2), (3, texts[4], "x", 1, 2)], SCHEMA)
    got = pii.pseudonymise(rows, KEY).collect()
    assert len(got) == len(texts) + 2
    assert Counter((r["doc_id"], r["text"], *(r[f"n_{k}"] for k in pii.KINDS)) for r in got) == Counter(
        (i, twin(t)[0], *twin(t)[1]) for i, t in [*enumerate(texts), (None, texts[3]), (3, texts[4])])
    assert pii.pseudonymise(rows.where("doc_id > 999"), KEY).count() == 0


def test_dates_of_a_form_stay_apart_and_in_their_form(spark):
    days = [datetime.date(2000, 1, 1) + datetime.timedelta(k) for k in range(800)]
    forms = {f for d in days for f in (f"{d.month}/{d.day}/{d.year}", f"{d.month:02}/{d.day:02}/{d.year}", f"{d.day:02}/{d.month:02}/{d.year}", f"{d.day}.{d.month}.{d.year}", f"{d.month:02}/{d.day}/{d.year}", f"{d}")}
    forms = sorted(forms)
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(forms)), "doc_id bigint, text string"), KEY).orderBy("doc_id").collect()]
    assert len(set(got)) == len(forms) and [regex.sub("[0-9]", "0", t) for t in got] == [regex.sub("[0-9]", "0", t) for t in forms]
    assert sum(a == b for a, b in zip(got, forms)) < 5
    assert all(one("date", t) is not None for t in got)


def test_very_long_texts_take_linear_time(spark):
    long = ["x@" + "a." * 50_000, "a" * 100_000 + "@b.com", "a." * 50_000 + "@c.de", "1234 " * 20_000, "@" * 100_000, "x@" + "b.com." * 20_000, "1." * 50_000, "+1 " * 30_000]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(long)), "doc_id bigint, text string"), KEY).collect()}
    assert [got[k]["text"] for k in range(len(long))] == [twin(t)[0] for t in long]


def test_symbols_of_large_radix_are_spread_evenly(spark):
    from pyspark.sql import functions as F

    moved = pii.feistel(F.array((F.col("id") % 2).cast("int"), F.col("id").cast("int")), F.array(F.lit(2), F.lit(9999)), F.lit("t"), KEY)
    got = [r["s"] for r in spark.range(9999).select(moved.alias("s")).collect()]
    assert all(0 <= b < 9999 for _, b in got) and sum(b >= 4096 for _, b in got) == pytest.approx(9999 * 5903 / 9999, rel=0.05)


def test_a_key_is_needed(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), "")
