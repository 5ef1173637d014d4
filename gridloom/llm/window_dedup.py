"""Substring dedup over word windows with a log-structured fingerprint index.

The index is a log per part of the fingerprint space: sorted, immutable runs of (64-bit window hash, 32-bit check
hash, first doc_id).  Documents come in batches of ascending doc_id.  A batch's sorted fingerprints are merge-joined
with every run of history, matches are verified by the check hash, which is made from other hashes of the words (so
words that collide in one are told apart by the other), the batch becomes a run of its own,
and runs of similar size are compacted.  A run is never changed, so a log can be stored and extended by later
batches (`window_log`, `dedup_windows(..., log=...)`).

Most windows of a corpus occur once.  Equal windows have equal *anchors* (least hash of the ANCHOR-word grams in the
window), so a first round finds the anchors that more than one document has, from 4 bytes an anchor, and only
windows under such anchors are logged.  A false match of 32-bit anchor keys merely logs a window more.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import (
    BASES,
    BLOCK_BYTES,
    NO_ID,
    PART_BYTES,
    WordHash,
    documents,
    ids_of,
    mix,
    pack_bits,
    part_slices,
    rolling,
    sliding_min,
    table_of,
    unpack_bits,
    word_hashes,
)

WINDOW, ANCHOR, BATCHES = 13, 5, 4
MESSAGE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()), ("firsts", pa.binary())])
MESSAGE_SQL = "part int, block long, keys binary, checks binary, firsts binary"
REPLY = pa.schema([("block", pa.int64()), ("round", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())])
REPLY_SQL = "block long, round int, part int, bits binary"
LOG = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("firsts", pa.binary())])
LOG_SQL = "part int, keys binary, checks binary, firsts binary"
_memo, _check_memo = WordHash(), WordHash(seed=1)


class Block:
    """Words, windows and anchors of a block's documents, laid end to end."""

    def __init__(self, table: pa.Table, window: int = WINDOW, anchor: int = ANCHOR):
        order = np.argsort(ids_of(table.column("doc_id")), kind="stable")
        table = table.take(pa.array(order))
        self.ids = ids_of(table.column("doc_id"))
        self.words = [t.split() for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.n = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.start = np.r_[0, np.cumsum(self.n)]
        a = np.concatenate([word_hashes(w, _memo) for w in self.words]) if self.words else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(self.ids)), self.n)
        m = max(0, len(a) - window + 1)
        self.at = np.flatnonzero((doc[:m] == doc[window - 1 : window - 1 + m]) & (self.ids[doc[:m]] != NO_ID))
        self.doc = doc[self.at]
        self.a, self.window = a, window
        self.anchor_of = mix(sliding_min(rolling(a, anchor, BASES[0]), window - anchor + 1)[self.at])  # least hashes are all small
        self.anchors, self.inverse = np.unique(self.anchor_of, return_inverse=True)

    def anchor_messages(self, n_parts: int, block: int) -> list[tuple]:
        lo = np.full(len(self.anchors), NO_ID)
        hi = np.full(len(self.anchors), -1)
        # documents are in the order of their ids: first and last document of an anchor
        lo[self.inverse[::-1]] = self.ids[self.doc[::-1]]
        hi[self.inverse] = self.ids[self.doc]
        low = self.anchors.astype(np.uint32)
        return [(p, block, low[s:e].tobytes(), pack_bits(lo[s:e] != hi[s:e]), b"") for p, s, e in part_slices(self.anchors, n_parts)]

    def windows(self, shared: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Of the windows under shared anchors: index, group, and per group key, check, first id; groups sorted."""
        pick = np.arange(len(self.at)) if shared is None else np.flatnonzero(shared[self.inverse])
        # only documents with such windows, laid end to end again
        docs, place = np.unique(self.doc[pick], return_inverse=True)
        moved = np.r_[0, np.cumsum(self.n[docs])[:-1]] - self.start[docs] if len(docs) else docs
        at = self.at[pick] + moved[place]
        nothing = np.zeros(0, np.uint64)
        a = np.concatenate([nothing, *(self.a[self.start[i] : self.start[i + 1]] for i in docs.tolist())])
        others = np.concatenate([nothing, *(word_hashes(self.words[i], _check_memo) for i in docs.tolist())])
        key = rolling(a, self.window, BASES[0])[at]
        check = rolling(others, self.window, BASES[1])[at].astype(np.uint32)
        order = np.lexsort((check, key))  # stable: documents stay ascending
        key, check = key[order], check[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])] if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        first = self.ids[self.doc[pick[order[starts]]]]
        return pick[order], np.cumsum(new) - 1, key[starts], check[starts], first

    def bits(self, replies: pa.Table, round_: int, keys: np.ndarray, n_parts: int) -> np.ndarray:
        rows = replies.to_pylist()
        got = {r["part"]: r["bits"] for r in rows if r["round"] == round_}
        out = np.zeros(len(keys), bool)
        for p, s, e in part_slices(keys, n_parts):
            out[s:e] = unpack_bits(got[p], e - s)  # a missing answer is an error, never "no"
        return out


def _answer_anchors(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    multi = np.concatenate([unpack_bits(r["checks"], len(k)) for r, k in zip(rows, keys)])
    values, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[multi]] = True
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return table_of(REPLY, [(r["block"], 1, r["part"], pack_bits(x)) for r, x in zip(rows, np.split(shared[inverse], cuts))])


class RunLog:
    """Sorted immutable runs (keys, checks, firsts), the newest last."""

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def merged(runs: list[tuple]) -> tuple:
        key, check, first = (np.concatenate(x) for x in zip(*runs))
        order = np.lexsort((first, check, key))
        key, check, first = key[order], check[order], first[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])] if len(key) else np.zeros(0, bool)
        return key[new], check[new], first[new]

    def lookup(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """First doc_id of each verified fingerprint in history, NO_ID if it is new: a merge join with every run."""
        found = np.full(len(key), NO_ID)
        for k, c, f in self.runs:
            at = np.searchsorted(k, key)
            open_ = np.flatnonzero(at < len(k))
            while len(open_):  # more than one step only where 64-bit keys collide
                here = at[open_]
                same = k[here] == key[open_]
                open_, here = open_[same], here[same]
                hit = c[here] == check[open_]
                found[open_[hit]] = np.minimum(found[open_[hit]], f[here[hit]])
                open_ = open_[~hit]
                at[open_] += 1
                open_ = open_[at[open_] < len(k)]
        return found

    def append(self, run: tuple) -> None:
        self.runs.append(run)
        while len(self.runs) > 1 and len(self.runs[-2][0]) <= 2 * len(self.runs[-1][0]):
            self.runs[-2:] = [self.merged(self.runs[-2:])]


def _unpacked(row: dict) -> tuple:
    return np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["checks"], np.uint32), np.frombuffer(row["firsts"], np.int64)


def _ingest(history: list[dict], rows: list[dict], per_batch: int) -> tuple[list[tuple], RunLog]:
    """Takes messages batch by batch; says of each fingerprint whether it starts in an earlier document."""
    log = RunLog()
    for r in history:
        log.append(_unpacked(r))
    replies = []
    rows.sort(key=lambda r: r["block"])
    for batch in sorted({r["block"] // per_batch for r in rows}):
        own = [r for r in rows if r["block"] // per_batch == batch]
        messages = [_unpacked(r) for r in own]
        run = RunLog.merged(messages)
        now = RunLog()
        now.runs = [run]
        for r, (key, check, first) in zip(own, messages):
            seen = np.minimum(log.lookup(key, check), now.lookup(key, check))
            replies.append((r["block"], 2, r["part"], pack_bits(seen < first)))
        log.append(run)
    return replies, log


def _batched(docs: DataFrame, batches: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int]:
    """(block, doc_id, text), blocks per batch, parts.  Batches cut the range of ids evenly; blocks hash within."""
    doc_id = F.col("doc_id").cast("long")
    s = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.min(doc_id), F.max(doc_id)).first()
    total, lo, hi = s[0], s[1] or 0, s[2] or 0
    per_batch = max(2, -(-total // (block_bytes * batches)))
    width = (hi - lo) // batches + 1
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731 - the range of ids may exceed a long
    batch = F.floor((wide(F.coalesce(doc_id, F.lit(hi))) - wide(F.lit(lo))) / wide(F.lit(str(width)))).cast("long")
    d = docs.select(
        (batch * per_batch + F.pmod(F.xxhash64("doc_id", "text"), F.lit(per_batch))).alias("block"),
        doc_id.alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return d.repartition(per_batch * batches, "block"), per_batch, max(4, -(-total // PART_BYTES))


def dedup_windows(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, log: DataFrame | None = None, n_parts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text, kept_sha256.

    Words are maximal runs without ASCII white space.  A word goes if it lies in a window of `window` words whose
    sequence also starts in a document with a smaller doc_id (in docs, or in `log`, an index made by window_log with
    the same n_parts).  Null or empty texts have no words; rows with a null doc_id neither remove nor lose words;
    rows that share a doc_id do not remove each other's.  Other columns are ignored.
    """
    d, per_batch, parts = _batched(docs, batches)
    parts, filtered = n_parts or parts, log is None

    def ask_anchors(key, table):
        return table_of(MESSAGE, Block(table, window).anchor_messages(parts, key[0].as_py()))

    def ask_windows(key, table, replies):
        if not table.num_rows:
            return table_of(MESSAGE, [])
        b = Block(table, window)
        shared = b.bits(replies, 1, b.anchors, parts) if filtered else None
        _, _, k, c, f = b.windows(shared)
        return table_of(MESSAGE, [(p, key[0].as_py(), k[s:e].tobytes(), c[s:e].tobytes(), f[s:e].tobytes()) for p, s, e in part_slices(k, parts)])

    def answer(table):
        return table_of(REPLY, _ingest([], table.to_pylist(), per_batch)[0])

    def answer_with_log(history, table):
        return table_of(REPLY, _ingest(history.to_pylist(), table.to_pylist(), per_batch)[0])

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary()), ("kept_sha256", pa.string())])

    def remove(key, table, replies):
        if not table.num_rows:
            return table_of(out_schema, [])
        b = Block(table, window)
        shared = b.bits(replies, 1, b.anchors, parts) if filtered else None
        pick, group, k, _, first = b.windows(shared)
        early = b.bits(replies, 2, k, parts)
        gone = pick[early[group] | (b.ids[b.doc[pick]] > first[group])]
        edge = np.zeros(len(b.a) + 1, np.int32)
        np.add.at(edge, b.at[gone], 1)
        np.add.at(edge, b.at[gone] + window, -1)
        keep = np.cumsum(edge[:-1]) == 0
        rows = []
        for i, words in enumerate(b.words):
            mine = keep[b.start[i] : b.start[i + 1]]
            text = b" ".join(words if mine.all() else compress(words, mine))
            rows.append((None if b.ids[i] == NO_ID else int(b.ids[i]), len(words), len(words) - int(mine.sum()), text, hashlib.sha256(text).hexdigest()))
        return table_of(out_schema, rows)

    by_block = d.groupBy("block")
    if log is None:
        first = by_block.applyInArrow(ask_anchors, MESSAGE_SQL).groupBy("part").applyInArrow(_answer_anchors, REPLY_SQL)
    else:
        first = d.sparkSession.createDataFrame([], REPLY_SQL)
    asked = by_block.cogroup(first.groupBy("block")).applyInArrow(ask_windows, MESSAGE_SQL)
    if log is None:
        second = asked.groupBy("part").applyInArrow(answer, REPLY_SQL)
    else:
        second = log.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer_with_log, REPLY_SQL)
    return by_block.cogroup(first.union(second).groupBy("block")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept_text binary, kept_sha256 string"
    ).withColumn("kept_text", F.decode("kept_text", "UTF-8"))


def window_log(docs: DataFrame, n_parts: int, window: int = WINDOW, batches: int = BATCHES, log: DataFrame | None = None) -> DataFrame:
    """The index of docs (and of an older log): one compacted run a part, rows (part, keys, checks, firsts)."""
    d, per_batch, _ = _batched(docs, batches)

    def ask(key, table):
        b = Block(table, window)
        _, _, k, c, f = b.windows(None)
        return table_of(MESSAGE, [(p, key[0].as_py(), k[s:e].tobytes(), c[s:e].tobytes(), f[s:e].tobytes()) for p, s, e in part_slices(k, n_parts)])

    def build(key, history, table):
        _, made = _ingest(history.to_pylist(), table.to_pylist(), per_batch)
        if not made.runs:
            return table_of(LOG, [])
        return table_of(LOG, [(key[0].as_py(), *(x.tobytes() for x in RunLog.merged(made.runs)))])

    old = log if log is not None else docs.sparkSession.createDataFrame([], LOG_SQL)
    asked = d.groupBy("block").applyInArrow(ask, MESSAGE_SQL)
    return old.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(build, LOG_SQL)


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(documents(spark, sf_dir)).drop("kept_text")


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
bad AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM bad),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS k
         FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
