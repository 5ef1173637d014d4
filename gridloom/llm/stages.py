"""Filters over documents, from the operators: each keeps the columns of its input and drops what its operator rejects."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import decontamination, exact_dedup, jaccard_join, toxicity
from gridloom.llm.common import scratch

#: Rows of ids (8 bytes each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20


def without_ids(docs: DataFrame, dropped: DataFrame, tag: str) -> DataFrame:
    """Rows of docs whose doc_id is not among dropped (doc_id long); a null doc_id stays."""
    ids = scratch(dropped.select(F.col("doc_id").alias("_gone")).where("_gone is not null").distinct(), tag)
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that score below the threshold; null and empty texts score as no words do.

    Rows that repeat stay or go together; all columns stay as they are, one named score too; an empty table stays empty.
    """
    model = toxicity.train(docs, labels)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score_toxicity(docs, model, name).where(F.col(f"`{name}`") < threshold).drop(name)


def drop_exact_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row of each group of equal texts, the one that exact_dedup keeps; rows without an id: one a text, if no other has it."""
    found = scratch(exact_dedup.exact_dedup(docs, keep), "copies")
    copies = found.where("doc_id <> keep_id")
    kept = without_ids(docs, copies, "copy-ids")
    odd = found.where("not kept and not coalesce(doc_id <> keep_id, false)").select("doc_id", "text_sha256").distinct()
    if odd.isEmpty():
        return kept
    # rows that repeat id and text, or have no id: few, but any number is handled by a shuffle on id and digest
    keyed = kept.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    stays = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"))
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_text"))
    return keyed.join(stays, same, "left_semi").dropDuplicates(["doc_id", "_sha"]).select(docs.columns)


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of every group linked by overlap of k-word shingles.

    Null, empty and wordless texts, and rows without an id, stay; so do rows that repeat the id that stays.  Columns stay
    as they are; an empty table stays empty.
    """
    found = jaccard_join.jaccard_components(docs, k, percent, count_links=False)
    return without_ids(docs, found.where("component_id <> doc_id"), "near")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a verified test item; null and empty texts have none.

    Rows that repeat stay or go together; all columns stay as they are; an empty table, or an empty benchmark, changes
    nothing.
    """
    for group in decontamination.item_groups(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def clean(batches, shared=shared):
            index = decontamination.Index(shared.value[0], statistics=shared.value[1])
            for b in batches:
                yield b.filter(pa.array([not index.search(t or "") for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
