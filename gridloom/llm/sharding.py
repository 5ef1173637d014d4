"""Sharding by proportional stratified interleaving (DataFrame operations only).

Rows are shuffled within their source by a seeded digest of the text, then of the id, and ranked; rank r of n has the
fraction (r - 1/2) / n; all rows in the order of that fraction form one sequence in which every stretch holds the
sources in proportion; the sequence is cut into shards whose counts differ by one at most (law `rows`).  Equal texts of
a source have neighbouring ranks, so a group of copies lies in as few shards as its share of the source needs.

Ranks are made without a task per source or per group of copies: a row's bucket is its place in 2**32 of texts and, in
it, in 2**BITS of ids.  Bucket counts are summed ahead, and only rows of one bucket are sorted together.  The global
order is made likewise from buckets of the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import documents, scratch

BUCKET_ROWS = 512
#: Bits of the id digest in a bucket: a text with many copies is sorted in so many pieces.
BITS = 12


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list, name: str, shift: int = 10) -> DataFrame:
    """Adds name: the 0-based rank within group, of rows whose buckets ascend with the order; 2**shift buckets are summed together."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    # running sums in two steps, so that not even the bucket counts meet in one task
    coarse = F.shiftright(F.col(bucket), shift)
    counts = counts.withColumn("_c", coarse)
    w_in = Window.partitionBy(*group, "_c").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*group, "_c").agg(F.sum("_n").alias("_s"))
    w_of = Window.partitionBy(*group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_c", F.coalesce(F.sum("_s").over(w_of), F.lit(0)).alias("_before"))
    keys = [*group, "_c"]
    ahead = counts.withColumn("_in", F.coalesce(F.sum("_n").over(w_in), F.lit(0))).join(sums, keys)
    ahead = ahead.select(*group, bucket, (F.col("_in") + F.col("_before")).alias("_ahead"))
    w = Window.partitionBy(*group, bucket).orderBy(*order)
    within = rows.withColumn("_r", F.row_number().over(w))
    return within.join(ahead, [*group, bucket]).withColumn(name, F.col("_ahead") + F.col("_r") - 1).drop("_r", "_ahead")


def interleave(docs: DataFrame, n_shards: int = 24, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, source, size, text_crc32, law, shard, slot, grown_shard.

    A null source is a source of its own; a null text has no bytes; null or repeated doc_ids are rows like others
    (fully equal rows are interchangeable).  An empty table gives an empty
    result; other columns are ignored.  Shard s holds positions ceil(s*N/n_shards) up to the next one's start; slot
    counts from 0 within it.  grown_shard is null: under the law `rows` every cut moves when a shard is added.
    """
    bytes_ = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = scratch(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("_src"),
            F.col("source"),
            (F.octet_length(bytes_) + 8).cast("long").alias("size"),
            F.crc32(bytes_).alias("text_crc32"),
            F.md5(F.concat(F.encode(F.lit(f"{seed}:"), "UTF-8"), bytes_)).alias("_text"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))).alias("_key"),
        ),
        "shard",
    )
    total = rows.count()
    n_buckets = max(1, -(-total // bucket_rows))
    first_bits = lambda c, n: F.conv(F.substring(c, 1, n // 4), 16, 10).cast("long")
    order = ["_text", "_key", "doc_id"]
    texts_together = max(0, 32 - n_buckets.bit_length())
    by_source = rows.groupBy("_src").agg(F.count("*").alias("_of"))
    keyed = rows.withColumn("_b", F.shiftleft(first_bits("_text", 32), BITS) + first_bits("_key", BITS))
    ranked = _ranked(keyed, ["_src"], "_b", order, "_rank", BITS + texts_together).join(by_source, "_src")
    fraction = (F.col("_rank") * 2 + 1) / (F.col("_of") * 2).cast("double")
    spread = ranked.withColumn("_f", fraction).withColumn("_b", F.least(F.floor(F.col("_f") * n_buckets), F.lit(n_buckets - 1)).cast("long"))
    placed = _ranked(spread, [], "_b", ["_f", "_src", *order], "_at")
    shard = F.expr(f"(_at * {n_shards}L) div {max(1, total)}L")
    first = F.expr(f"(_shard * {max(1, total)}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("_shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_at") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(documents(spark, sf_dir)).drop("source")


OP10_SQL = """
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, coalesce('s' || source, '') AS src, coalesce(text, '') AS t FROM documents),
k AS (SELECT *, octet_length(encode(t)) + 8 AS size, md5('17:' || t) AS of_text, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS of_id,
    list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM d),
r AS (SELECT *, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
    row_number() OVER (PARTITION BY src ORDER BY of_text, of_id, doc_id) AS nth, count(*) OVER (PARTITION BY src) AS n FROM k, crc),
a AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * nth - 1 AS DOUBLE) / (2 * n), src, of_text, of_id, doc_id) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 24 // total AS INTEGER) AS shard,
    CAST(place - (place * 24 // total * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM a
"""
