"""Global statistics: G2-G4, G12, exact percentiles without one hot task, small tables beside large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.scalar import clean, ratio, safe_ratio
from fieldspark.sources.shared import stored


def beside(rows: DataFrame, most: int = 100_000):
    """A table to be joined with a large one: broadcast if it has at most `most` rows, else as it is.

    Its rows are worked out once, here, so the join neither guesses their number nor shuffles the large side.
    """
    found = rows.limit(most + 1).collect()
    return F.broadcast(rows.sparkSession.createDataFrame(found, rows.schema)) if len(found) <= most else rows


def exact_percentile(values: DataFrame, column: str, share: float, bins: int = 4096) -> float | None:
    """The linear percentile, as by sorting all values, without sorting or gathering them.

    Two scans of the values; both ranks that it lies between are found in them.  Nulls are left out; None
    if nothing is left.
    """
    found = exact_percentiles(values.select(F.lit(0).alias("of"), column), "of", column, [share], bins).first()
    return found["p"][0] if found else None


#: Ranks within one part in so many of all points are bracketed by the first scan.
ACCURACY = 10_000
#: How far on each side of a share its bracket reaches.
NEAR = 2 / ACCURACY
#: Rows of brackets that are ordered in one window by group; more are narrowed down in rounds.
BRACKET_ROWS = 1 << 20
#: Where all brackets together hold at most so many values by the first scan's error bound, the driver orders them.
DRIVER_ROWS = 100_000


def exact_percentiles(values: DataFrame, group: str, column: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """One row (group, p) per group with a value: its linear percentiles, in the order of shares.

    Two scans of the source, whatever the shares: approximate percentiles bracket each rank, then one
    grouped pass counts what lies between the brackets and keeps the distinct values within them.  Order
    statistics are read from these few rows alone.  A null group is a group; NaN sorts last.
    """
    v = values.select(F.col(group).alias("g"), F.col(column).cast("double").alias("v")).where("v is not null")
    p = _percentiles(v, [F.col("v").alias("c0")], shares, bins)
    kind = v.schema["g"].dataType.simpleString()
    return values.sparkSession.createDataFrame([(g, x) for (g, _), x in p.items()], f"`{group}` {kind}, p array<double>")


def exact_percentiles_of(values: DataFrame, group: str, columns: list[str], shares: list[float], bins: int = 4096) -> DataFrame:
    """One row (group, column, p) per group and column with a value, as exact_percentiles, for all columns in the same two scans."""
    v = values.select(F.col(group).alias("g"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    p = _percentiles(v, [F.col(f"c{k}") for k in range(len(columns))], shares, bins)
    kind = v.schema["g"].dataType.simpleString()
    return values.sparkSession.createDataFrame([(g, columns[k], x) for (g, k), x in p.items()], f"`{group}` {kind}, `column` string, p array<double>")


def _percentiles(v: DataFrame, columns: list, shares: list[float], bins: int) -> dict:
    """{(group, number of the column): percentiles}; v has g and the columns, whose nulls are left out."""
    spark, kind = v.sparkSession, v.schema["g"].dataType.simpleString()
    near = NEAR
    bounds = sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-near, near)})
    # First scan: sizes, and approximate percentiles a little outside each rank.
    first = v.groupBy("g").agg(*[x for k, c in enumerate(columns) for x in (F.count(c).alias(f"n{k}"), F.percentile_approx(c, bounds, ACCURACY).alias(f"b{k}"))]).collect()
    sizes = {(r["g"], k): r[f"n{k}"] for r in first for k in range(len(columns)) if r[f"n{k}"]}
    brackets = {}
    for r in first:
        for k in range(len(columns)):
            if not r[f"n{k}"]:
                continue
            at = dict(zip(bounds, r[f"b{k}"], strict=True))
            spans: list = []
            for lo, hi in sorted(((at[min(max(s - near, 0.0), 1.0)], at[min(max(s + near, 0.0), 1.0)]) for s in shares), key=lambda x: [(y != y, y) for y in x]):
                if spans and not _above(lo, spans[-1][1]):
                    spans[-1] = (spans[-1][0], hi if _above(hi, spans[-1][1]) else spans[-1][1])
                else:
                    spans.append((lo, hi))
            brackets[r["g"], k] = spans
    if not brackets:
        return {}
    # Second scan: a value's region is odd within a bracket, even between them, where only extremes and a count are kept.
    rows = [(g, k, [lo for lo, _ in x], [hi for _, hi in x]) for (g, k), x in brackets.items()]
    of_group: dict = {}
    for g, k, los, his in rows:
        of_group.setdefault(g, [None] * len(columns))[k] = (los, his)
    fields = ", ".join(f"`{k}` struct<los:array<double>,his:array<double>>" for k in range(len(columns)))
    joined = v.join(_small(spark, [(g, *x) for g, x in of_group.items()], f"of {kind}, {fields}"), F.col("g").eqNullSafe(F.col("of")))
    cells = []
    for k, c in enumerate(columns):
        of = F.col(f"`{k}`")
        region = F.size(F.filter(of["los"], _not_below(c))) + F.size(F.filter(of["his"], _over(c)))
        cells.append(F.struct(F.lit(k).alias("col"), c.alias("v"), region.alias("region")))
    d = joined.select("g", F.explode(F.array(*cells)).alias("x")).select("g", "x.*").where("v is not null") if len(cells) > 1 else joined.select("g", cells[0].alias("x")).select("g", "x.*").where("v is not null")
    inside = F.when(F.col("region") % 2 == 1, F.col("v"))
    kept = d.groupBy("g", "col", "region", inside.alias("inner")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # A bracket and the error of its ends hold a small share of all points; values that are equal are one row.
    few = sum(sizes.values()) * len(shares) * 8 / ACCURACY <= DRIVER_ROWS
    at_hand: dict = {}
    if few:
        whole: dict = {}
        for r in kept.collect():
            key = (r["g"], r["col"], r["region"])
            one = whole.setdefault(key, {"region": r["region"], "n": 0, "lo": r["lo"], "hi": r["hi"]})
            one["n"] += r["n"]
            one["lo"], one["hi"] = (r["lo"] if _above(one["lo"], r["lo"]) else one["lo"]), (r["hi"] if _above(r["hi"], one["hi"]) else one["hi"])
            if r["region"] % 2:
                at_hand.setdefault(key, []).append((r["inner"], r["n"]))
        counts = [{"g": g, "col": c, **x} for (g, c, _), x in whole.items()]
    else:
        kept = stored(kept, "brackets")
        counts = kept.groupBy("g", "col", "region").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    regions: dict = {}
    for r in sorted(counts, key=lambda r: r["region"]):
        regions.setdefault((r["g"], r["col"]), []).append(r)
    known, asked, lost = {}, [], set()
    for key, n in sizes.items():
        for rank in sorted({x for s in shares for x in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))}):
            rest = rank
            for r in regions[key]:
                if rest < r["n"]:
                    break
                rest -= r["n"]
            if rest == 0 or rest == r["n"] - 1:
                known[(*key, rank)] = r["lo"] if rest == 0 else r["hi"]
            elif r["lo"] == r["hi"]:
                known[(*key, rank)] = r["lo"]
            elif r["region"] % 2 == 0:
                lost.add(key)  # a bracket missed its rank
            else:
                asked.append((*key, r["region"], rank, rest))
    if few:
        ordered = {key: sorted(x, key=lambda y: (y[0] != y[0], y[0])) for key, x in at_hand.items()}
        for g, k, region, rank, rest in asked:
            for value, n in ordered[g, k, region]:
                if rest < n:
                    known[g, k, rank] = value
                    break
                rest -= n
    elif asked:
        same = F.col("g").eqNullSafe(F.col("of")) & (F.col("col") == F.col("c")) & (F.col("region") == F.col("r"))
        hit = kept.join(_small(spark, sorted({x[:3] for x in asked}, key=repr), f"of {kind}, c int, r int"), same)
        if max(r["kinds"] for r in counts) <= BRACKET_ROWS:
            upto = Window.partitionBy("of", "c", "r").orderBy("inner").rowsBetween(Window.unboundedPreceding, 0)
            hit = hit.select("of", "c", "r", "inner", "n", F.sum("n").over(upto).alias("end"))
            ours = _small(spark, asked, f"g {kind}, col int, region int, rank bigint, rest bigint")
            of = F.col("of").eqNullSafe(F.col("g")) & (F.col("c") == F.col("col")) & (F.col("r") == F.col("region"))
            found = hit.join(ours, of & (F.col("rest") < F.col("end")) & (F.col("rest") >= F.col("end") - F.col("n"))).select("g", "col", "rank", "inner").collect()
            known.update({(r["g"], r["col"], r["rank"]): r["inner"] for r in found})
        else:
            known.update(_narrowed(hit.select(F.struct("of", "c", "r").alias("g"), F.col("inner").alias("v"), "n"), [((g, c, r), rank, rest) for g, c, r, rank, rest in asked], f"struct<of:{kind},c:int,r:int>", bins))
    for g, k in lost:
        all_of = v.where(F.col("g").eqNullSafe(F.lit(g))).select(F.struct(F.col("g").alias("of"), F.lit(k).alias("c"), F.lit(0).alias("r")).alias("g"), columns[k].alias("v"), F.lit(1).cast("bigint").alias("n")).where("v is not null")
        n = sizes[g, k]
        ranks = sorted({x for s in shares for x in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))})
        known.update(_narrowed(all_of, [((g, k, 0), r, r) for r in ranks], f"struct<of:{kind},c:int,r:int>", bins))

    def between(key, share: float) -> float:
        n = sizes[key]
        at = int(share * (n - 1))
        low, high = known[(*key, at)], known[(*key, min(at + 1, n - 1))]
        part = share * (n - 1) - at
        return low + (high - low) * part if part and low != high else low

    return {key: [between(key, s) for s in shares] for key in sizes}


def _small(spark, rows: list, schema: str, most: int = 100_000) -> DataFrame:
    """Rows of the driver as a table: broadcast up to `most`."""
    d = spark.createDataFrame(rows, schema)
    return F.broadcast(d) if len(rows) <= most else d


def _not_below(c):
    return lambda lo: c >= lo


def _over(c):
    return lambda hi: c > hi


def _above(a: float, b: float) -> bool:
    """a sorts after b, NaN last."""
    return (a != a) > (b != b) if a != a or b != b else a > b


def _narrowed(v: DataFrame, asked: list, kind: str, bins: int) -> dict:
    """{(of, c, rank): value} of rows (g, v, n) for asked (g, rank, rest): histograms narrow all ranks together until extremes meet.

    Each round is a pass over v, so v is a small stored table, or a group whose bracket failed.
    """
    spark = v.sparkSession
    whole = {tuple(r["g"]): (r["lo"], r["hi"]) for r in v.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    state = [(g, rank, rest, *whole[g], whole[g][0] == whole[g][1]) for g, rank, rest in asked]
    known: dict = {}
    while state:
        known.update({(g[0], g[1], rank): lo for g, rank, _, lo, _, done in state if done})
        if not (still := [x[:5] for x in state if not x[5]]):
            break
        table = spark.createDataFrame(still, f"g {kind}, rank bigint, rest bigint, lo double, hi double")
        bounds = table.select(F.col("g").alias("of"), "lo", "hi").distinct()
        half = F.col("hi") / 2 - F.col("lo") / 2
        at = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / half * bins), F.lit(bins - 1)) + 1
        # The extremes are classes of their own, so each round narrows, infinite bounds included.
        place = F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), bins + 1).when((half > 0) & (half < float("inf")), at).otherwise(1)
        inside = v.join(F.broadcast(bounds), F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi")))
        classes = inside.groupBy("of", F.col("lo").alias("under"), place.alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        upto = Window.partitionBy("of", "under").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # bins + 2 rows at most
        classes = classes.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        hit = F.col("g").eqNullSafe(F.col("of")) & (F.col("lo") == F.col("under")) & (F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("before") + F.col("n"))
        state = [(tuple(r[0]), *r[1:]) for r in classes.join(F.broadcast(table), hit).select("g", "rank", F.col("rest") - F.col("before"), "first", "last", F.col("first") == F.col("last")).collect()]
    return known


def weak_asymmetry(points: DataFrame) -> DataFrame:
    """One row of pi's balance: counts, signed sums, rms, exact p99 and maximum of |pi|."""
    p = F.col("pi")
    a = points.agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(F.abs(p)).alias("sa"), F.sqrt(F.avg(p * p)).alias("rms"), F.max(F.abs(p)).alias("mx"),
        F.sum(F.greatest(p, F.lit(0.0))).alias("pos"), F.sum(F.least(p, F.lit(0.0))).alias("neg"), F.count_if(p > 0).alias("np"), F.count_if(p < 0).alias("nn"), F.count_if(p == 0).alias("nz"))
    d = a.withColumn("p99", F.lit(exact_percentile(points.select(F.abs(p).alias("a")), "a", 0.99)).cast("double"))
    mean = F.col("s") / F.col("n")
    return d.select(
        F.col("n").alias("count"), clean(F.col("s"), 4).alias("sum"), clean(F.col("sa"), 4).alias("abs_sum"), clean(F.col("rms")).alias("rms"),
        clean(F.col("p99")).alias("p99_abs"), clean(F.col("mx")).alias("max_abs"), clean(F.col("pos"), 4).alias("positive_sum"), clean(F.col("neg"), 4).alias("negative_sum"),
        F.col("np").alias("positive_count"), F.col("nn").alias("negative_count"), F.col("nz").alias("zero_count"),
        clean(ratio(mean, F.col("rms"))).alias("index"), clean(ratio(mean, F.col("p99"))).alias("ratio_p99"), clean(ratio(mean, F.col("mx"))).alias("ratio_max"))


def identity_qa(points: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Rms of each term and whether work_full - work_resolved + pi - s_bar closes, per frame."""
    r = F.col("work_full") - F.col("work_resolved") + F.col("pi") - F.col("s_bar")
    rms = lambda c: F.sqrt(F.avg(c * c))
    d = points.groupBy("frame").agg(F.count(F.lit(1)).alias("count"), *[rms(F.col(f)).alias(f"{f}_rms") for f in ("work_full", "work_resolved", "pi", "s_bar")],
                                    rms(r).alias("res"), F.max(F.abs(r)).alias("res_max"), F.sum("s_bar").alias("ss"), F.sum("pi").alias("sp"),
                                    F.count_if(F.isnan("pi") | (F.abs("pi") == float("inf"))).alias("nonfinite"))
    joint = F.sqrt(sum(F.col(f"{f}_rms") ** 2 for f in ("work_full", "work_resolved", "pi", "s_bar")))
    return d.select("frame", "count", "nonfinite", *[clean(F.col(f"{f}_rms")).alias(f"{f}_rms") for f in ("work_full", "work_resolved", "pi", "s_bar")],
                    (safe_ratio(F.col("res"), joint) <= tolerance).alias("passed"), (F.col("res_max") < 1e-9).alias("closes"),
                    clean(ratio(F.abs("ss"), F.abs("sp")), 4).alias("s_bar_over_pi"))


def frame_summary(points: DataFrame) -> DataFrame:
    q, u2 = F.col("q"), F.col("u2")
    return points.groupBy("frame").agg(
        clean(F.min(q)).alias("q_min"), clean(F.max(q)).alias("q_max"), clean(F.avg(q)).alias("q_mean"), clean(F.sqrt(F.avg(q * q))).alias("q_rms"),
        clean(F.min(u2)).alias("u2_min"), clean(F.max(u2)).alias("u2_max"), clean(F.avg(u2)).alias("u2_mean"), clean(F.avg((q > 0).cast("double"))).alias("fraction_q_positive"))
