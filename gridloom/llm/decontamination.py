"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The items are the indexed collection; every passage of every training document is a query, and all items above the
threshold are retrieved, not the top few.  Impacts are divided by the item's score for itself, so the threshold is the
share of an item's own score that a passage reaches.  Postings are cut into blocks of ITEMS items with the largest
impact of each term in each block.  A passage's sum of block maxima bounds its score for every item in a block; these
sums are kept for all blocks and passages at once, and only where a bound reaches the threshold does the pivot
search run.  Retrieved pairs are verified: the 5-word shingles of the item's question and of its answer must occur in
the document around the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import spread_documents

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SHINGLE, SIMILARITY, PART_SIMILARITY = 5, 0.8, 0.5
ANSWER_SHARE = 0.25
ITEMS = 4
STRIDE = 64
#: Bytes of item text in one index; more items make more indexes, each with its own pass over the documents.
INDEX_BYTES = 8 << 20
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} or ({tuple(words)} if words else set())


def statistics_of(texts) -> dict:
    """Of all items with words: number, mean and largest length, and in how many each word is."""
    n = total = longest = 0
    df: Counter = Counter()
    for t in texts:
        words = words_of(t or "")
        if words:
            n, total, longest = n + 1, total + len(words), max(longest, len(words))
            df.update(set(words))
    return {"n": n, "mean": total / max(1, n), "longest": longest, "df": df}


class Index:
    """Inverted index of items: postings (item, impact) by term, block maxima, and the shingles to verify with."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, statistics: dict | None = None, answer_share: float = ANSWER_SHARE):
        """statistics (of all items, also those in other indexes) decide the scores; by default these items are all."""
        self.threshold = threshold
        statistics = statistics or statistics_of(t for _, t in items)
        kept = [(i, w) for i, w in ((i, words_of(t or "")) for i, t in items) if w]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        n, of_all, mean = len(kept), statistics["n"], statistics["mean"]
        df = dict.fromkeys(t for w in self.words for t in w)
        idf = {t: math.log(1 + (of_all - statistics["df"][t] + 0.5) / (statistics["df"][t] + 0.5)) for t in df}
        self.term = {t: k + 1 for k, t in enumerate(df)}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in range(len(df) + 1)]
        for item, w in enumerate(self.words):
            tf = Counter(w)
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in tf.items()}
            own = sum(impact.values())
            for t, v in impact.items():
                self.postings[self.term[t]].append((item, v / own))
        self.n_blocks = -(-n // ITEMS) if n else 0
        self.block_max = np.zeros((len(df) + 1, max(1, self.n_blocks)), np.float32)
        self.by_block: list[dict[int, list]] = [{} for _ in range(self.n_blocks)]
        for t, ps in enumerate(self.postings):
            for item, v in ps:
                self.by_block[item // ITEMS].setdefault(t, []).append((item, v))
                self.block_max[t, item // ITEMS] = max(self.block_max[t, item // ITEMS], v)
        self.stride = max(STRIDE, statistics["longest"])
        self.parts = []
        for w in self.words:
            cut = len(w) - max(1, round(len(w) * answer_share)) if len(w) > 1 else len(w)
            self.parts.append((shingles(w), shingles(w[:cut]), shingles(w[cut:]) if cut < len(w) else set()))

    def wand(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """All items of the given blocks whose score reaches the threshold: pivots over cursors, block by block.

        Cursors enter a block through the block index; in it, terms are bounded by their largest impact there.
        """
        found = []
        for block in blocks:
            lists = [(ps, float(self.block_max[t, block])) for t in terms if (ps := self.by_block[block].get(t))]
            at = [0] * len(lists)
            live = list(range(len(lists)))
            while live:
                live.sort(key=lambda k: lists[k][0][at[k]][0])
                bound, pivot = 0.0, None
                for k in live:
                    bound += lists[k][1]
                    if bound >= self.threshold - 1e-6:
                        pivot = lists[k][0][at[k]][0]
                        break
                if pivot is None:
                    break
                if lists[live[0]][0][at[live[0]]][0] == pivot:
                    score = 0.0
                    for k in live:
                        item, v = lists[k][0][at[k]]
                        if item != pivot:
                            break
                        score += v
                        at[k] += 1
                    if score >= self.threshold - 1e-9:
                        found.append((pivot, score))
                else:
                    for k in live:
                        ps = lists[k][0]
                        while at[k] < len(ps) and ps[at[k]][0] < pivot:
                            at[k] += 1
                live = [k for k in live if at[k] < len(lists[k][0])]
        return found

    def search(self, text: str) -> list[tuple[int, float, float, float, int]]:
        """(item id, BM25 share, question overlap, answer overlap, first word of the passage) of verified items."""
        words = words_of(text)
        if not words or not self.n_blocks:
            return []
        get = self.term.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        step = self.stride
        known = np.flatnonzero(ids)
        cells = known // step
        n_cells = -(-len(ids) // step)
        sums = np.zeros((n_cells + 1, self.block_max.shape[1]), np.float32)
        for cell, (s, e) in _stretches(cells):
            sums[cell] = self.block_max[np.unique(ids[known[s:e]])].sum(0)
        bounds = sums[:-1] + sums[1:]  # a passage is two cells; passages overlap by one
        best: dict[int, tuple] = {}
        for cell in np.flatnonzero((bounds >= self.threshold - 1e-4).any(1)).tolist():
            s, e = cell * step, min(len(ids), (cell + 2) * step)
            terms = np.unique(ids[s:e])
            terms = terms[terms > 0]
            tight = self.block_max[terms].sum(0)  # the cells' sums count a term in both twice
            blocks = np.flatnonzero(tight >= self.threshold - 1e-4).tolist()
            hits = self.wand(terms.tolist(), blocks) if blocks else []
            if not hits:
                continue
            around = shingles(words[max(0, s - step) : e + step])
            short: dict[int, set] = {}
            for item, score in hits:
                whole, question, answer = self.parts[item]
                overlap = [self._share(p, around, words, s, e, step, short) for p in (whole, question, answer)]
                if overlap[0] >= SIMILARITY and min(overlap[1:]) >= PART_SIMILARITY:
                    old = best.get(item)
                    if old is None or score > old[1]:
                        best[item] = (self.ids[item], score, overlap[1], overlap[2], s)
        return sorted(best.values())

    @staticmethod
    def _share(part: set, around: set, words: list[str], s: int, e: int, step: int, short: dict[int, set]) -> float:
        if not part:
            return 1.0
        size = len(next(iter(part)))
        if size < SHINGLE:
            if size not in short:
                w = words[max(0, s - step) : e + step]
                short[size] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            around = short[size]
        return len(part & around) / len(part)


def _stretches(cells: np.ndarray):
    if len(cells):
        cut = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        yield from zip(cells[cut].tolist(), zip(cut.tolist(), [*cut[1:].tolist(), len(cells)]))


def item_groups(benchmark: DataFrame, most: int = INDEX_BYTES) -> list[tuple[list[tuple[int, str]], dict]]:
    """Items in groups of bounded bytes, read in the order of their ids, each with the statistics of all items (for its
    own words); null texts and ids are left out.  A group bounds what a task holds, not what it finds.

    Benchmarks are small against the corpus: their words and texts pass through the driver.
    """
    groups, size = [[]], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].encode())
        if size and size + n > most:
            groups.append([])
            size = 0
        groups[-1].append((r["item_id"], r["text"]))
        size += n
    whole = statistics_of(t for g in groups for _, t in g)
    return [(g, whole | {"df": {w: whole["df"][w] for _, t in g for w in words_of(t)}}) for g in groups]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, question_overlap, answer_overlap, at_word.

    Documents without a hit have no row.  Null and empty texts have none; a null doc_id is passed on; repeated rows
    each give theirs.  Scores and passages are the same however index_bytes cuts the items.  An item without words is not searched; items of fewer than five words are one shingle.
    Other columns are ignored.
    """
    out = None
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, at_word long"
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "at_word"]
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    for group in item_groups(benchmark, index_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(group)  # at most index_bytes of text (or one item) by construction

        def search(batches, shared=shared):
            index = Index(shared.value[0], threshold, shared.value[1])
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for hit in index.search(t or "")]
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        found = texts.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spread_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
