"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated values (mail addresses, IPv4 addresses, dates, social security, phone and card
numbers) become lists of symbols, each with its own radix.  A keyed, unbalanced Feistel
network over two halves of the list adds SHA-256 output symbol by symbol, so the result is
a permutation within the format: the same value has the same pseudonym in every document,
different values of a form have different ones, card numbers keep a right check digit, dates
stay dates of the same form and width.  Values that fail validation stay as they are.

Who has the key can undo the pseudonyms, so it is given by the caller and not kept here.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import documents

ROUNDS = 8
KINDS = ("email", "ip", "date", "ssn", "phone", "card")
#: Setting of the session with the key of op6_pii; Spark hides values of settings with this word in their name.
KEY_SETTING = "spark.fieldspark.pseudonym.secret"

# The forms that are looked for.  A host name has at most 127 labels of at most 63 characters.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\d(+])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:(?:\d{4}[ -]){3}\d{4}|\d{13,19})(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in FORMS.values())
#: Runs of letters or digits of one kind, as (first code point, how many).  A character moves within its run.
RUNS = ((0x61, 26), (0x41, 26), (0x30, 10), (0xDF, 24), (0xF8, 8), (0xC0, 23), (0xD8, 7), (0x100, 128), (0x391, 17), (0x3A3, 7), (0x3B1, 25),
        (0x410, 32), (0x430, 32), (0x450, 16), (0x5D0, 27), (0x620, 27), (0x641, 10), (0x905, 53), (0xE01, 48), (0x3041, 86), (0x30A1, 90),
        (0x4E00, 20992), (0xAC00, 11172))
#: Days of the months of a common year.
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(symbols: Column, radices: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of lists of int symbols, symbol i being below radices[i].

    Each symbol is moved by 32 bits of its own: eight symbols share a digest.
    """
    n = F.size(symbols)
    half = F.floor(n / 2).cast("int")
    part = lambda x, first, size: F.slice(x, first, size)
    start = F.struct(part(symbols, F.lit(1), half).alias("a"), part(radices, F.lit(1), half).alias("ra"),
                     part(symbols, half + 1, n - half).alias("b"), part(radices, half + 1, n - half).alias("rb"))

    def shift(seed, i):
        digest = F.when(i < 8, seed).otherwise(F.sha2(F.concat_ws("|", seed, F.floor(i / 8).cast("string")), 256))
        return F.conv(F.substring(digest, F.pmod(i, F.lit(8)) * 8 + 1, F.lit(8)), 16, 10).cast("bigint")

    def turn(acc, number):
        seed = F.sha2(F.concat_ws("|", F.lit(key), tweak, number, F.array_join(F.transform(acc["b"], lambda x: x.cast("string")), ",")), 256)
        new = _bound(seed, lambda s: F.transform(acc["a"], lambda x, i: F.pmod(x + shift(s, i), F.get(acc["ra"], i)).cast("int")))
        return F.struct(acc["b"].alias("a"), acc["rb"].alias("ra"), new.alias("b"), acc["ra"].alias("rb"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def _digits(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("int"))


def _tens(symbols: Column) -> Column:
    return F.transform(symbols, lambda x: F.lit(10))


def _refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced in order: what is between them, and one of them after each."""
    return F.array_join(F.transform(F.split(value, "[0-9]", -1), lambda gap, i: F.concat(gap, F.coalesce(F.get(digits, i).cast("string"), F.lit("")))), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum, where the last digit is doubled (doubled=0) or the one before it (1)."""
    n = F.size(digits)
    double = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(digits, lambda x, i: F.when(F.pmod(n - 1 - i, F.lit(2)) == doubled, double(x)).otherwise(x))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def _card(value: Column, key: str) -> Column:
    def made(digits):
        n = F.size(digits)
        body = F.slice(digits, F.lit(1), n - 1)
        moved = feistel(body, _tens(body), F.concat(F.lit("card"), n.cast("string")), key)
        fresh = _bound(moved, lambda x: F.concat(x, F.array(F.pmod(10 - F.pmod(_luhn_sum(x, 0), F.lit(10)), F.lit(10)))))
        return F.when(F.pmod(_luhn_sum(digits, 1), F.lit(10)) == 0, _bound(fresh, lambda x: _refill(value, x)))

    return _bound(_digits(value), made)


def _phone(value: Column, key: str) -> Column:
    """The last ten digits move, the first of them among 0-1 or among 2-9."""

    def made(digits):
        n = F.size(digits)
        own = F.least(n, F.lit(10))
        last = F.slice(digits, n - own + 1, own)
        large = F.get(last, F.lit(0)) >= 2
        symbols = F.transform(last, lambda x, i: F.when((i == 0) & large, x - 2).otherwise(x))
        radices = F.transform(last, lambda x, i: F.when(i == 0, F.when(large, 8).otherwise(2)).otherwise(10))
        moved = feistel(symbols, radices, F.concat_ws("|", F.lit("phone"), n.cast("string"), large.cast("string")), key)
        moved = F.transform(moved, lambda x, i: F.when((i == 0) & large, x + 2).otherwise(x))
        return F.when(n.between(8, 15), _bound(F.concat(F.slice(digits, F.lit(1), n - own), moved), lambda x: _refill(value, x)))

    return _bound(_digits(value), made)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(F.array(index, group - 1, serial - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"), key)

    def text(x):
        a = F.when(x[0] >= 665, x[0] + 2).otherwise(x[0] + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((x[1] + 1).cast("string"), 2, "0"), F.lpad((x[2] + 1).cast("string"), 4, "0"))

    good = (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0)
    return F.when(good, F.element_at(F.transform(F.array(moved), text), 1))


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    moved = feistel(octets, F.transform(octets, lambda x: F.lit(256)), F.lit("ip"), key)
    return F.array_join(F.transform(moved, lambda x: x.cast("string")), ".")


def _month_days(month_width: int, day_width: int, late: bool) -> list[int]:
    """100 * month + day of a common year's days that a form can write; late: only days after the twelfth."""
    return [100 * m + d for m, n in enumerate(MONTH_DAYS, 1) for d in range(1, n + 1) if (month_width == 2 or m < 10) and (day_width == 2 or d < 10) and (not late or d > 12)]


def _date(value: Column, key: str) -> Column:
    """yyyy-mm-dd; dd.mm.yyyy; mm/dd/yyyy, or dd/mm/yyyy where the first number is over 12.

    Year and day move within a form: the order of its parts, their widths and a block of 200 years.
    29 February moves to another leap year of the block.
    """

    def made(p):
        iso, dotted = F.contains(value, F.lit("-")), F.contains(value, F.lit("."))
        late = ~iso & ~dotted & (F.get(p, F.lit(0)).cast("int") > 12)
        day_first = dotted | late
        at = lambda i, j, k: F.get(p, F.when(iso, i).when(day_first, j).otherwise(k))
        return _bound(F.struct(at(0, 2, 2).cast("int").alias("y"), at(1, 1, 0).alias("m"), at(2, 0, 1).alias("d"), late.alias("late"), day_first.alias("day_first"), iso.alias("iso")), moved)

    def moved(x):
        month, day = x["m"].cast("int"), x["d"].cast("int")
        widths = [(a, b) for a in (1, 2) for b in (1, 2)]
        chosen = F.lit(None).cast("array<int>")
        for a, b in widths:
            lists = [F.lit(_month_days(a, b, late)) if not (late and b == 1) else F.lit(None).cast("array<int>") for late in (False, True)]
            chosen = F.when((F.length(x["m"]) == a) & (F.length(x["d"]) == b), F.when(x["late"], lists[1]).otherwise(lists[0])).otherwise(chosen)
        block = F.floor((x["y"] + 100) / 200).cast("int")
        first, end = F.greatest(F.lit(1), block * 200 - 100), F.least(F.lit(9999), block * 200 + 99)
        leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        form = F.concat_ws("|", F.lit("date"), x["iso"].cast("string"), x["day_first"].cast("string"), x["late"].cast("string"), F.length(x["m"]), F.length(x["d"]), block)
        leaps = F.filter(F.sequence(first, end), leap)
        own_year = _bound(leaps, lambda years: F.get(years, F.get(feistel(F.array(F.array_position(years, x["y"]).cast("int") - 1), F.array(F.size(years)), F.concat(form, F.lit("|leap")), key), F.lit(0))))

        def common(days):
            place = F.array_position(days, month * 100 + day).cast("int") - 1
            out = feistel(F.array(x["y"] - first, place), F.array(end - first + 1, F.size(days)), form, key)
            return F.when(place >= 0, _bound(out, lambda o: written(o[0] + first, F.floor(F.get(days, o[1]) / 100), F.get(days, o[1]) % 100)))

        def written(year, month, day):
            y, m, d = F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), F.length(x["m"]), F.lit("0")), F.lpad(day.cast("string"), F.length(x["d"]), F.lit("0"))
            return F.when(x["iso"], F.concat_ws("-", y, m, d)).when(F.contains(value, F.lit(".")), F.concat_ws(".", d, m, y)).when(x["day_first"], F.concat_ws("/", d, m, y)).otherwise(F.concat_ws("/", m, d, y))

        extra = leap(x["y"]) & (month == 2) & (day == 29)
        return F.when(x["y"] < 1, F.lit(None)).when(extra, written(own_year, F.lit(2), F.lit(29))).otherwise(_bound(chosen, common))

    return _bound(F.split(value, "[./-]"), made)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 4, "0")), "UTF-16BE")


def _email(value: Column, key: str) -> Column:
    """The local part moves, each character within its run of RUNS; others, and the host, stay."""

    def placed(c):
        def of(code):
            first, many = code, F.lit(1)
            for begin, n in reversed(RUNS):
                inside = (code >= begin) & (code < begin + n)
                first, many = F.when(inside, begin).otherwise(first), F.when(inside, n).otherwise(many)
            return _bound(first, lambda f: F.struct(c.alias("c"), f.alias("first"), many.alias("many"), (code - f).alias("symbol")))

        return _bound(F.ascii(c), of)

    def made(p):
        pattern = F.array_join(F.transform(p, lambda x: F.concat_ws(":", x["first"], x["many"])), ",")
        moved = feistel(F.transform(p, lambda x: x["symbol"]), F.transform(p, lambda x: x["many"]), F.concat(F.lit("email"), pattern), key)
        letters = F.zip_with(p, moved, lambda x, m: F.when(x["many"] == 1, x["c"]).otherwise(_character(x["first"] + m)))
        return F.concat(F.array_join(letters, ""), F.lit("@"), F.substring_index(value, "@", -1))

    chars = F.regexp_extract_all(F.substring_index(value, "@", 1), F.lit("(?s)."), F.lit(0))
    return _bound(F.transform(chars, placed), made)


_MAKE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, text) of one found value; its text is null if the value is not valid or stays the same."""
    out = F.lit(None).cast("struct<kind:string,text:string>")
    for kind in reversed(KINDS):
        made = F.struct(F.lit(kind).alias("kind"), F.nullif(_MAKE[kind](value, key), value).alias("text"))
        out = F.when(value.rlike(rf"^(?:{FORMS[kind]})$"), made).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the whole text with its personal data replaced, and n_<kind> replacements.

    A value counts only if it was valid and its text changed: an address without a character of
    RUNS in its local part stays, as does the rare value that the permutation maps to itself.
    A null text stays null and has zero counts.  Rows stand alone, so repeated or null
    ids, other columns and empty tables need no care.  An empty key is an error.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.withColumn("hits", F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    made = F.when(F.size("hits") > 0, F.transform("hits", lambda m: pseudonym(m, key)))
    found = found.withColumn("made", made).withColumn("gaps", F.when(F.size("hits") > 0, F.split(text, ANY, -1)))
    pieces = F.transform("gaps", lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col("made"), i)["text"], F.get(F.col("hits"), i), F.lit(""))))
    count = lambda kind: F.coalesce(F.size(F.filter("made", lambda m: (m["kind"] == kind) & m["text"].isNotNull())), F.lit(0)).cast("bigint")
    return found.select("doc_id", F.when(F.col("made").isNull(), text).otherwise(F.array_join(pieces, "")).alias("text"),
                        *[F.when(F.col("made").isNull(), F.lit(0).cast("bigint")).otherwise(count(k)).alias(f"n_{k}") for k in KINDS])


def op6_pii(spark, sf_dir):
    """The key is the session's (KEY_SETTING); without one a fresh key links values within this result only."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    return pseudonymise(documents(spark, sf_dir), key)
