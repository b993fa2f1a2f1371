"""Exact de-duplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, so an insertion changes only the
chunks around it.  Every text moves through one shuffle at most, chunk by chunk,
to prove that equal 64-bit chunk hashes mean equal chunks; from then on documents
are compared by their ordered lists of chunk identifiers (about one hundredth of
the text).  Hashes shared by different chunks are told apart by an ordinal, so
the result is exact and not probabilistic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import SPACE_RUN, cut_lineage, first_row, sha256_hex, with_row_keys


#: Pairs of neighbouring characters between which a text may be cut, by their kinds: words, digits and
#: letters without spaces (code, base64, hexadecimal), and scripts that write none.
EDGES = (r"[enrstao][.,;:]? (?=[aeiouAEIOU])", r"[0-4](?=[A-Ha-h])", r"[\u3041-\u3060\u4e00-\u5fff\uac00-\ub7ff](?=[\u3061-\u309f\u7000-\u8fff\uc000-\ucfff])")


def chunk_pattern(least: int = 384, most: int = 4096) -> str:
    """A chunk: at least `least` characters up to a content-defined edge, at most `most`.

    A run of `most` characters without an edge (one letter over and over) is cut there; the
    comparison stays exact, only an insertion then shifts the cuts up to the next edge.
    """
    edge = rf"(?:{'|'.join(EDGES)}|\z)"
    return rf"(?s).{{{least},{most}}}?{edge}|.{{1,{most}}}"


def chunked(docs: DataFrame, id_col: str, text_col: str, least: int, most: int) -> DataFrame:
    """doc_id, text_sha256 and the chunks of each normalised text, in order."""
    normal = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_RUN, " ")
    return (
        docs.select(F.col(id_col).alias("doc_id"), normal.alias("normal"))
        .select("doc_id", sha256_hex(F.col("normal")).alias("text_sha256"),
                F.regexp_extract_all("normal", F.lit(chunk_pattern(least, most)), F.lit(0)).alias("chunks"))
    )


def _hash(chunk, bits: int):
    return F.xxhash64(chunk) if bits >= 64 else F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def _told_apart(chunks: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """Per text (by its SHA-256), the places whose chunk is not the first of its hash: [(pos, ordinal)]."""
    rows = chunks.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("hash", _hash(F.col("chunk"), bits))
    rows = rows.join(shared.select("hash"), "hash", "left_semi")
    order = Window.partitionBy("hash").orderBy("chunk")
    ordinals = rows.select("hash", "chunk").distinct().withColumn("ordinal", F.row_number().over(order)).where("ordinal > 1")
    return (
        rows.join(ordinals, ["hash", "chunk"])
        .groupBy("text_sha256")
        .agg(F.array_sort(F.collect_set(F.struct("pos", "ordinal"))).alias("apart"))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     least: int = 384, most: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space;
    null counts as empty, and all empty texts are one group.  The smallest doc_id of
    a group is kept (with equal ids on several rows, all rows of that id).  A null id
    sorts last: a group of null ids only has keep_id null and keeps its rows.  An
    empty table gives no rows; other columns of docs are ignored.  hash_bits below 64
    exists to test that colliding hashes are told apart.
    """
    chunks = chunked(docs, id_col, text_col, least, most)
    recipes = chunks.select("doc_id", "text_sha256", F.transform("chunks", lambda c: _hash(c, hash_bits)).alias("recipe"))
    recipes = cut_lineage(recipes)
    contents = chunks.select(F.explode("chunks").alias("chunk")).select(_hash(F.col("chunk"), hash_bits).alias("hash"), "chunk").distinct()
    shared = cut_lineage(contents.groupBy("hash").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1"))
    if shared.isEmpty():
        recipes = recipes.withColumn("apart", F.lit(None).cast("array<struct<pos:int,ordinal:int>>"))
    else:
        recipes = cut_lineage(recipes.join(_told_apart(chunks, shared, hash_bits), "text_sha256", "left"))
    recipes = recipes.withColumn("apart", F.coalesce("apart", F.expr("cast(array() as array<struct<pos:int,ordinal:int>>)")))
    groups = cut_lineage(
        recipes.groupBy("recipe", "apart").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return recipes.join(groups, ["recipe", "apart"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each group of equal texts as exact_duplicates groups them.

    The row with the smallest id stays, a null id sorting last.  Rows are told apart by a
    key of their own: of rows that share id and text one stays, and a row goes only if its
    own text is a copy, whatever other rows its id has.
    """
    keyed = with_row_keys(docs, "__row")
    ordered = keyed.select(first_row(id_col, "__row").alias("first"), F.col(text_col).alias("text"))
    kept = exact_duplicates(ordered, "first", "text").where("kept").select(F.col("doc_id.key").alias("__row"))
    return keyed.join(kept, "__row", "left_semi").select(*docs.columns)


def op3_exact_dedup(spark, sf_dir):
    from fieldspark.llm.common import documents

    return exact_duplicates(documents(spark, sf_dir))


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
