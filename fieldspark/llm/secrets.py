"""Secret scans in DataFrame functions only: base patterns, and character Markov models.

The base patterns give spans that always stay.  Two first-order Markov chains over
characters, one of random strings and one of ordinary identifiers, judge the other
long tokens: a token is a further span if the log-likelihood ratio of the chains
exceeds the prior odds.  Random strings are labelled by the base patterns over all
documents; ordinary identifiers are words of a bounded, documented sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import cut_lineage, sha256_hex, stored

# The base patterns of the contract and the least length of each.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

#: Fixed value: the characters of the Markov chains, in the order of their states.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z][A-Za-z0-9_-]{7,}"

SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"
#: Items of an array that is built step by step, before the next begins.
BLOCK = 256
#: An offset beyond the end of any text.
FAR = 1 << 40


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _emitted(items: Column, kind: str, onward, emit) -> Column:
    """Array of what emit(at, item) gives, each an array of the SQL type kind, where at follows onward(at, item) from 0.

    Arrays grow within blocks of BLOCK items only, so the time is linear in the items.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def block(at, some):
        start = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(some, start, lambda acc, x: F.struct(onward(acc["at"], x).cast("bigint").alias("at"), F.concat(acc["out"], emit(acc["at"], x)).alias("out")))

    def whole(all_items):
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / BLOCK).cast("int"))
        step = lambda acc, b: _bound(block(acc["at"], F.slice(all_items, b * BLOCK + 1, F.lit(BLOCK))),
                                     lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))
        return F.aggregate(blocks, start, step, lambda acc: F.flatten(acc["out"]))

    return F.when(F.size(items) > 0, _bound(items, whole)).otherwise(none)


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of a pattern's matches in code points; keep: a test of the group's value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), value.alias("value"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def end(at, row):
        return at + F.char_length(row["gap"]) + F.coalesce(F.char_length(row["hit"]), F.lit(0))

    def emit(at, row):
        span = F.struct((at + F.char_length(row["gap"])).cast("bigint").alias("start"), F.lit(kind).alias("kind"), end(at, row).cast("bigint").alias("end"), row["value"].alias("value"))
        good = row["hit"].isNotNull() if keep is None else row["hit"].isNotNull() & keep(row["value"])
        return F.when(good, F.array(span)).otherwise(none)

    return F.when(text.rlike(pattern), _emitted(rows, SPAN, end, emit)).otherwise(none)


def found_columns(text: Column) -> dict[str, Column]:
    """Spans of the three base kinds, and of the tokens that the chains will judge."""
    longer = lambda least: lambda value: F.char_length(value) >= least
    return {
        "assign": _spans(text, ASSIGN, 0, longer(ASSIGN_LEAST), 2),
        "access": _spans(text, rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", 1),
        "hex": _spans(text, rf"[0-9a-f]{{{HEX_LEAST},}}", 2),
        "tokens": _spans(text, TOKEN, 3),
    }


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the columns of found_columns."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.select("doc_id", *[c.alias(k) for k, c in found_columns(F.col("__text")).items()])


def _pairs(values: DataFrame) -> DataFrame:
    """Counts of neighbouring characters in a column `value` (at most the square of the alphabet)."""
    pairs = values.select(F.explode(F.regexp_extract_all("value", F.lit("(?=(..))"), F.lit(1))).alias("pair"))  # values are ASCII
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def log_table(counts: dict[str, int]) -> list[float]:
    """log P(next | previous) with add-one smoothing, row by row in ALPHABET's order."""
    out = []
    for a in ALPHABET:
        row = [counts.get(a + b, 0) + 1 for b in ALPHABET]
        total = sum(row)
        out += [math.log(x / total) for x in row]
    return out


def fit(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, sample_rows: int) -> list[float]:
    """The table of log-likelihood ratios, random over ordinary, one per pair of characters.

    Random: all values that the base patterns found, and all hexadecimal runs.  Ordinary:
    words of about sample_rows documents, chosen by a hash of id and text, outside base spans.
    """
    random = found.select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(F.col("s.value").alias("value"))
    total = max(1, docs.count())
    share = min(1.0, sample_rows / total)
    picked = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    plain = picked.select(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{ASSIGN}|{ACCESS}|[0-9a-f]{{16,}}", " ").alias("t"))
    ordinary = plain.select(F.explode(F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0))).alias("value"))
    a, b = (log_table({r["pair"]: r["n"] for r in _pairs(x).collect()}) for x in (random, ordinary))
    return [x - y for x, y in zip(a, b, strict=True)]


def ratio(value: Column, table: list[float]) -> Column:
    """Sum of the log ratios over neighbouring characters of an ASCII token."""
    n = len(ALPHABET)
    ratios = F.expr("cast(split('" + ",".join(f"{x:.9g}" for x in table) + "', ',') as array<double>)")
    state = F.expr("array(" + ",".join(str(max(0, ALPHABET.find(chr(i)))) for i in range(128)) + ")")
    codes = F.transform(F.split(value, ""), lambda c: F.element_at(state, F.ascii(c) + 1))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.coalesce(F.element_at(ratios, acc["last"] * n + c + 1), F.lit(0.0))).alias("sum"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 sample_rows: int = 20_000, log_odds: float = 9.2) -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end, value), sorted by start, then kind.

    Offsets count code points, ends are exclusive, whole texts are read; null counts as
    empty and gives no spans.  A token of 20 characters or more is added if its log ratio exceeds log_odds (a prior
    of one in ten thousand) and it overlaps no base span.  Without random or ordinary
    examples the chains are uniform and add nothing.  Rows with equal or null ids are
    treated one by one; other columns are ignored; an empty table gives no rows.
    """
    found = cut_lineage(found_spans(docs, id_col, text_col))
    table = fit(docs, found, id_col, text_col, sample_rows)
    return _judged(found, table, log_odds).select("doc_id", "assign", "access", "hex", "base", "added")


def _free(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: one pass forward and one back over all spans in order."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    is_base = lambda s: s["kind"] < KINDS.index("markov")
    ahead = _emitted(F.array_sort(F.concat(base, tokens)), SPAN, lambda at, s: F.when(is_base(s), F.greatest(at, s["end"])).otherwise(at),
                     lambda at, s: F.when(is_base(s) | (s["start"] >= at), F.array(s)).otherwise(none))
    back = _emitted(F.reverse(ahead), SPAN, lambda at, s: F.when(is_base(s), F.greatest(at, FAR - s["start"])).otherwise(at),
                    lambda at, s: F.when(~is_base(s) & (FAR - s["end"] >= at), F.array(s)).otherwise(none))
    return F.when((F.size(tokens) > 0) & (F.size(base) > 0), F.reverse(back)).otherwise(tokens)


def _judged(found: DataFrame, table: list[float], log_odds: float) -> DataFrame:
    """found with base and added, from the columns assign, access, hex and tokens."""
    return found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex"))).withColumn(
        "added", F.filter(_free(F.col("tokens"), F.col("base")), lambda t: ratio(t["value"], table) > F.lit(log_odds))
    )


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, **how) -> DataFrame:
    """The spans of secret_spans as counts and strings: one row per document."""
    found = secret_spans(docs, **how)
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        sha256_hex(_listed(F.col("base"))).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """text with sorted spans replaced; what lies between them is cut block by block, so no cut walks the whole text."""
    last = F.struct(F.char_length(text).cast("bigint").alias("start"), F.lit(0).alias("kind"), F.char_length(text).cast("bigint").alias("end"), F.lit("").alias("value"))
    gap = lambda at, s: F.struct(at.alias("start"), s["start"].alias("end"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    gaps = _emitted(F.concat(spans, F.array(last)), "struct<start:bigint,end:bigint>", lambda at, s: F.greatest(at, s["end"]),
                    lambda at, s: F.when(s["start"] >= at, F.array(gap(at, s))).otherwise(none))
    cut = lambda whole, base, g: F.substring(whole, (g["start"] - base + 1).cast("int"), (g["end"] - g["start"]).cast("int"))

    def pieces(some):
        begin, end = F.element_at(some, 1)["start"], F.element_at(some, -1)["end"]
        part = F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))
        return _bound(part, lambda p: F.transform(some, lambda g: cut(p, begin, g)))

    blocks = lambda all_gaps: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_gaps) - 1) / BLOCK).cast("int")),
                                          lambda b: _bound(F.slice(all_gaps, b * BLOCK + 1, F.lit(BLOCK)), pieces))
    return F.array_join(F.flatten(_bound(gaps, blocks)), mask)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]",
           sample_rows: int = 20_000, log_odds: float = 9.2) -> DataFrame:
    """docs with every span of secret_spans replaced by mask (overlapping spans by one).

    All columns stay and no row moves.  Spans are found once: rows and spans are written to
    the shared folder, the chains are fitted on that, and the masks are set while it is read.
    A null text stays null; rows with equal or null ids are treated one by one; an empty table
    gives no rows.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stored(rows.select("row", "doc_id", *[c.alias(k) for k, c in found_columns(F.col("text")).items()]), "spans")
    plain = found.select("doc_id", F.col("row")[text_col].alias("text"))
    table = fit(plain, found, "doc_id", "text", sample_rows)
    spans = _judged(found, table, log_odds).select("row", F.coalesce(F.col("row")[text_col], F.lit("")).alias("text"), F.array_sort(F.concat("base", "added")).alias("spans"))
    clean = F.when(F.size("spans") == 0, F.col("row")[text_col]).otherwise(_masked(F.col("text"), F.col("spans"), mask))
    return spans.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def op10_secrets(spark, sf_dir):
    from fieldspark.llm.common import documents

    return secret_report(documents(spark, sf_dir))
