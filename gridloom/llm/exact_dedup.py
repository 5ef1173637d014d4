"""Exact dedup by a tree merge of sorted digest runs (DataFrame operations only).

Every input partition makes a run: its rows grouped by (64-bit digest, SHA-256, length), with the identifier to
retain and a count.  The runs are the leaves of a binomial tree; in each round the runs whose numbers agree above
the next BITS bits are exchanged and merged, dealt by digest too, so a merge never needs one task for a whole run.  Rows
to retain are structs, which Spark aggregates by sorting: every task sorts what it got by run and digest and merges
equal neighbours, so each level's runs are sorted.
The digest decides where a row goes; equality is decided by SHA-256 and byte length, verified in every merge.  The
way back goes down the same tree: each merged entry hands its result to its children, so a text that a third of
all rows hold is joined per run, not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import documents, scratch

BITS = 4
KEY = ["digest", "text_sha256", "n_bytes"]


def tree_merge(leaf: DataFrame, best, n_runs: int, bits: int = BITS) -> list[DataFrame]:
    """Levels of the tree, leaf runs first, the one root run last: (run, digest, text_sha256, n_bytes, best, n)."""
    levels = [leaf]
    while n_runs > 1:
        n_runs = -(-n_runs // (1 << bits))
        levels.append(
            levels[-1]
            .withColumn("run", F.shiftright("run", bits))
            .groupBy("run", *KEY)
            .agg(best("best").alias("best"), F.sum("n").alias("n"))
        )
    return levels


def exact_dedup(docs: DataFrame, keep: str = "largest", bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  keep is 'largest' or 'smallest' (by doc_id); any id wins
    against a null one.  Of rows that repeat both the text and the winning id, one is kept.  An empty table gives an
    empty result; columns other than doc_id and text are ignored.
    """
    best, known = {"largest": (F.max, F.isnotnull), "smallest": (F.min, F.isnull)}[keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = scratch(
        docs.select(
            F.xxhash64(text).alias("digest"),
            F.sha2(text, 256).alias("text_sha256"),
            F.octet_length(text).alias("n_bytes"),
            F.spark_partition_id().alias("run"),
            F.struct(known(doc_id).alias("known"), doc_id.alias("id"), F.monotonically_increasing_id().alias("row")).alias("me"),
        ),
        "exact",
    )
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    leaf = rows.groupBy("run", *KEY).agg(best("me").alias("best"), F.count("*").alias("n"))
    levels = tree_merge(leaf, best, n_runs, bits)
    down = levels[-1].select("run", *KEY, "best", "n")
    for level in reversed(levels[:-1]):
        child = level.select("run", *KEY).withColumn("above", F.shiftright("run", bits))
        down = child.join(down.withColumnRenamed("run", "above"), ["above", *KEY]).select("run", *KEY, "best", "n")
    return rows.join(down, ["run", *KEY]).select(
        F.col("me.id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("me.row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
