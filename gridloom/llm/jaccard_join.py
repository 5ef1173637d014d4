"""N-gram Jaccard join by T-occurrence search with DivideSkip.

1. Document frequencies of all shingles, counted per block and per part of the shingle space, come back to the
   blocks as one byte a shingle (exact up to 32, then powers of two): one order for all, rare shingles first.
2. Two sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of each.  A block folds its
   documents with one of those shingles in common, and sizes that allow a link, into chains, and sends a chain as one
   entry, so that a shingle which a third of all rows have costs an entry or few a block.  Chains that meet become one
   candidate group (star edges, connected components).  Most documents end here.
3. Equal sets are one class with one representative.  The classes of a group have an inverted index.  The lists of a
   set are divided: the short ones are merged, which leaves sets with enough occurrences there; these are probed in the
   long lists, or the long lists are counted where that costs less.
Every pair of a group that can reach the threshold is tested, for the number of links; without that number, classes of
one component need no further test, so a group of near copies costs about one test a class.  Large groups are dealt as
pairs of bounded blocks, each task giving at most as many links as it has classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import BASES, NO_ID, WordHash, blocked, connected, documents, group_ids, ids_of, mix, part_slices, rolling, scratch, table_of, word_hashes

SHINGLE, PERCENT = 4, 85
GROUP_SHINGLES = 1 << 20
BLOCK = 4 << 20
BROADCAST_ROWS = 1 << 20
#: Items of lists that are counted in the time of one probe.
PROBE = 10000
MEMORY_SQL = "part int, block long, keys binary, counts binary, sizes binary"
MESSAGE = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary())])
REPLY = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ranks", pa.binary())])
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])
LINK_SQL = "a long, b long, digest binary, n long"
_memo = WordHash()


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of lower-cased text; of all words if there are fewer."""
    words = text.split()
    h = word_hashes(words, _memo)
    if len(h) >= k:
        return np.unique(rolling(h, k, BASES[0]))
    return mix(rolling(h, len(h), BASES[1]) + np.uint64(len(h))) if len(h) else h


def least_overlap(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def _sets(table: pa.Table, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    return ids_of(table.column("doc_id")), [shingle_set(t.lower(), k) for t in table.column("text").cast(pa.binary()).to_pylist()]


def _count(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint16) for r in rows])
    values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    df = np.bincount(inverse, weights=counts, minlength=len(values))
    rank = np.where(df <= 32, df, 32 + np.ceil(np.log2(np.maximum(df, 1)))).astype(np.uint8)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return table_of(REPLY, [(r["block"], r["part"], x.tobytes()) for r, x in zip(rows, np.split(rank[inverse], cuts))])


def chains(key: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Joins entries of a key whose sizes allow a link, directly or by others between them.

    Returns key, first node, least and largest size of each chain, and pairs (first node, other node).
    """
    order = np.lexsort((low, key))
    key, node, low, high = key[order], node[order], low[order], high[order]
    _, run = group_ids(key)
    reach = np.maximum.accumulate((run << 40) + high) - (run << 40)  # largest size so far, within the key
    new = np.r_[True, (key[1:] != key[:-1]) | (100 * reach[:-1] < percent * low[1:])][: len(key)]
    starts = np.flatnonzero(new)
    first = node[starts][np.cumsum(new) - 1]
    far = first != node
    pairs = np.unique(np.stack([np.minimum(first, node), np.maximum(first, node)], 1)[far], axis=0)
    return key[starts], node[starts], low[starts], reach[np.r_[starts[1:], len(key)][: len(starts)] - 1], pairs


def _stars(table: pa.Table, percent: int) -> pa.Table:
    """Links chains of all blocks that share a shingle and meet in size."""
    rows = table.to_pylist()
    key, node, size = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", np.uint64), ("counts", np.int64), ("sizes", np.int32)))
    low, high = size.reshape(-1, 2).astype(np.int64).T
    pairs = chains(key, node, low, high, percent)[-1]
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=EDGE)


class Links:
    """Labels of components; the smaller one is relabelled."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = [[i] for i in range(n)]
        self.edges: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        self.edges.append((i, j))


def divide_skip(
    sets: list[np.ndarray], percent: int = PERCENT, weight: np.ndarray | None = None, side: np.ndarray | None = None, mu: float = 0.01
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that span the components of the threshold graph over distinct non-empty sorted sets, and each set's number of links.

    Sets are taken by ascending size against those before them.  T = ceil(t n) occurrences are needed in the n lists
    of a set; L = T / (mu log2 M + 1) long lists (M: the longest) are set aside, T - L occurrences are needed in the
    others.  A link counts the weight of the other set; without weights only spanning links are sought, and numbers are
    0.  With sides, only sets of different sides are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    side = None if side is None else side[order]
    weights = None if weight is None else weight[order]
    degree = np.zeros(len(order), np.int64)
    flat = np.concatenate([sets[i] for i in order])
    doc = np.repeat(np.arange(len(order)), sizes)
    values, token = np.unique(flat, return_inverse=True)
    by = np.argsort(token, kind="stable")
    lists, begin = doc[by], np.r_[0, np.cumsum(np.bincount(token, minlength=len(values)))]
    tokens = np.split(token, np.cumsum(sizes)[:-1])
    links = Links(len(order))
    label = links.label

    def overlap(x: int, y: int) -> int:
        """Probes the longer set for each item of the shorter (the same as probing each long list for y)."""
        a, b = tokens[y], tokens[x]
        at = np.searchsorted(b, a)
        return int((b[np.minimum(at, len(b) - 1)] == a).sum())

    def linked(x: int, y, both):
        return 100 * both >= percent * (sizes[x] + sizes[y] - both)

    def joined(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.concatenate([lists[s : s + k] for s, k in zip(starts.tolist(), lengths.tolist())] or [lists[:0]])

    for x in range(1, len(order)):
        n = int(sizes[x])
        least = least_overlap(n, percent)
        start = begin[tokens[x]]
        length = begin[tokens[x] + 1] - start
        live = length > 1
        if live.sum() < least:
            continue
        start, length = start[live], length[live]
        by_length = np.argsort(length, kind="stable")
        start, length = start[by_length], length[by_length]
        n_long = min(least - 1, int(least / (mu * np.log2(length[-1] + 1) + 1)))
        dead = n - len(start)  # lists with this document alone
        n_short = max(0, n - n_long - dead)
        low = int(np.searchsorted(sizes, least))  # smaller sets cannot reach the overlap
        needed = least - n_long
        merged = joined(start[:n_short], length[:n_short])
        merged = merged[(merged < x) & (merged >= low)]
        if side is not None:
            merged = merged[side[merged] != side[x]]
        if not len(merged):
            continue
        y = int(merged[-1])
        if weights is None and linked(x, y, overlap(x, y)):
            # one test against the last candidate of the longest short list often settles the component
            links.join(x, y)
            merged = merged[label[merged] != label[x]]
        counts = np.bincount(merged, minlength=x)  # merges the sorted lists
        candidates = np.flatnonzero(counts >= needed)
        if weights is None:
            while len(candidates):
                y = int(candidates[-1])
                if linked(x, y, overlap(x, y)):
                    links.join(x, y)
                    candidates = candidates[label[candidates] != label[x]]
                else:
                    candidates = candidates[:-1]
            continue
        if PROBE * len(candidates) <= length[n_short:].sum():
            both = np.fromiter((overlap(x, y) for y in candidates.tolist()), np.int64, len(candidates))
        else:
            both = counts[candidates] + np.bincount(joined(start[n_short:], length[n_short:]), minlength=len(order))[candidates]
        candidates = candidates[linked(x, candidates, both)]
        degree[x] += weights[candidates].sum()
        degree[candidates] += weights[x]
        candidates = candidates[label[candidates] != label[x]]
        while len(candidates):
            links.join(x, int(candidates[-1]))
            candidates = candidates[label[candidates] != label[x]]
    numbers = np.zeros(len(order), np.int64)
    numbers[order] = degree
    return [(order[i], order[j]) for i, j in links.edges], numbers


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _link_group(table: pa.Table, k: int, percent: int, count: bool) -> pa.Table:
    """Links between the classes of a group, or between those of its two blocks."""
    ids, sets = _sets(table, k)
    given = zip(table.column("digest").to_pylist(), table.column("mine").to_pylist(), table.column("n_rows").to_pylist())
    classes = {d: (i, s, mine, n) for i, s, (d, mine, n) in zip(ids.tolist(), sets, given) if d == _digest(s)}  # an id may have other texts too
    if len(classes) < 2:
        return table_of(LINK, [])
    owner, distinct, mine, n_rows = zip(*classes.values())
    two = len(set(mine)) > 1
    weight = np.array(n_rows, np.int64) if count else None
    edges, numbers = divide_skip(distinct, percent, weight, np.array(mine) if two else None)
    rows = [(owner[i], owner[j], None, None) for i, j in edges]
    return table_of(LINK, rows + [(None, None, d, n) for d, n in zip(classes, numbers.tolist()) if n])


def jaccard_components(
    docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, group_shingles: int = GROUP_SHINGLES, count_links: bool = True
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), n_links.

    Documents link when 100 * intersection >= percent * union of their shingle sets.  Null, empty and wordless texts
    have the empty set and no links; rows with a null doc_id have no links and a null component; rows that share a
    doc_id are one document for components.  n_links is the number of other rows whose texts link with this one's; with
    count_links false it is null, and a group of near copies costs about one test a text.  An empty table gives an
    empty result; other columns are ignored.
    """
    d, n_parts = blocked(docs, block_bytes=BLOCK)
    n_parts *= 2  # all shingles are counted: more of them to a part than of other operators' anchors

    def ask(key, table):
        _, sets = _sets(table, k)
        keys, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
        low, counts = keys.astype(np.uint32), np.minimum(counts, 65535).astype(np.uint16)
        return table_of(MESSAGE, [(p, key[0].as_py(), low[s:e].tobytes(), counts[s:e].tobytes(), b"") for p, s, e in part_slices(keys, n_parts)])

    def prefixes(key, table, replies):
        ids, sets = _sets(table, k)
        block = key[0].as_py()
        keys = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
        got = {r["part"]: r["ranks"] for r in replies.to_pylist()}
        rank = np.zeros(len(keys), np.uint8)
        for p, s, e in part_slices(keys, n_parts):
            rank[s:e] = np.frombuffer(got[p], np.uint8)
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        digests = [_digest(s) for s in sets]
        rows = [(-1, block, ids.tobytes(), sizes.tobytes(), b"".join(digests))]
        own: dict[bytes, int] = {}
        for i in np.argsort(ids, kind="stable")[::-1].tolist():  # the smallest id of each class
            if len(sets[i]) and ids[i] != NO_ID:
                own[digests[i]] = i
        out_key, out_node, out_size = [], [], []
        for i in own.values():
            s = sets[i]
            r = rank[np.searchsorted(keys, s)]
            first = np.argsort(r, kind="stable")[: len(s) - least_overlap(len(s), percent) + 1]  # s ascends: ties go by hash
            first = first[r[first] > 1]
            out_key.append(s[first])
            out_node.append(np.full(len(first), ids[i]))
            out_size.append(np.full(len(first), len(s)))
        if out_key:
            a, node, size = (np.concatenate(x) for x in (out_key, out_node, out_size))
            a, node, low, high, pairs = chains(a, node, size, size, percent)
            size = np.stack([low, high], 1).astype(np.int32)
            rows.append((-2, block, pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), b""))
            rows += [(p, block, a[s:e].tobytes(), node[s:e].tobytes(), size[s:e].tobytes()) for p, s, e in part_slices(a, n_parts)]
        return table_of(MESSAGE, rows)

    def sizes_of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["keys"], np.int64)
                each = [pa.array(np.full(len(ids), r["block"])), pa.array(ids, mask=ids == NO_ID), pa.array(np.frombuffer(r["counts"], np.int64))]
                yield pa.record_batch([*each, pa.array([r["sizes"][16 * i : 16 * i + 16] for i in range(len(ids))], pa.binary())], names=["block", "doc_id", "n_shingles", "digest"])

    def pairs_of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.record_batch([pa.array(np.frombuffer(r[c], np.int64)) for c in ("keys", "counts")], schema=EDGE)

    by_block = d.groupBy("block")
    ranks = by_block.applyInArrow(ask, MEMORY_SQL).groupBy("part").applyInArrow(_count, "block long, part int, ranks binary")
    sent = scratch(by_block.cogroup(ranks.groupBy("block")).applyInArrow(prefixes, MEMORY_SQL), "prefix")
    sizes = scratch(sent.where("part = -1").mapInArrow(sizes_of, "block long, doc_id long, n_shingles long, digest binary"), "sizes")
    stars = sent.where("part >= 0").groupBy("part").applyInArrow(lambda t: _stars(t, percent), "a long, b long")
    groups = connected(stars.union(sent.where("part = -2").mapInArrow(pairs_of, "a long, b long")), "candidates")

    # a class that many rows hold has one row a block here, and results go back by block
    real = sizes.where("doc_id is not null and n_shingles > 0")
    local = real.groupBy("block", "digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows"), F.max("n_shingles").alias("n_shingles"))
    classes = scratch(local.groupBy("digest").agg(F.min("rep").alias("rep"), F.sum("n_rows").alias("n_rows"), F.max("n_shingles").alias("n_shingles")), "classes")
    members = scratch(groups.join(classes, F.col("node") == F.col("rep")).drop("node"), "members")
    load = members.groupBy("component").agg(F.count("*").alias("n"), (F.floor(F.sum("n_shingles") / group_shingles) + 1).alias("cuts"))
    load = scratch(load.where("n > 1").drop("n"), "load")
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    dealt = scratch(members.join(small(load), "component").select("component", "cuts", "digest", "rep", "n_rows"), "dealt")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(small(dealt), F.col("doc_id") == F.col("rep"))
    mine = F.pmod(F.xxhash64("digest"), F.col("cuts"))
    found = found.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    found = found.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "digest", "n_rows", "doc_id", "text")
    links = scratch(found.groupBy("component", "i", "j").applyInArrow(lambda t: _link_group(t, k, percent, count_links), LINK_SQL), "links")

    told = local.select("block", "digest").join(classes, "digest")
    several = real.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("doc_id")
    same_id = real.join(several, "doc_id").select("digest", F.col("doc_id").alias("a")).join(classes, "digest").select("a", F.col("rep").alias("b"))
    components = connected(links.where("a is not null").select("a", "b").union(same_id), "links")
    numbers = links.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("n"))
    told = told.join(components, F.col("rep") == F.col("node"), "left").join(numbers, "digest", "left")
    told = told.select("block", "digest", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("n_rows") - 1).alias("n"))
    known = F.col("doc_id").isNotNull()
    n_links = F.when(known, F.coalesce("n", F.lit(0))).otherwise(0) if count_links else F.lit(None).cast("long")
    return sizes.join(told, ["block", "digest"], "left").select(
        "doc_id", "n_shingles", F.when(known, F.coalesce("component", "doc_id")).alias("component_id"), n_links.cast("long").alias("n_links")
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, array_to_string(ws, ' ') AS g FROM w WHERE len(ws) BETWEEN 1 AND 3
      UNION SELECT doc_id, array_to_string(ws[p:p + 3], ' ') FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS p FROM w WHERE len(ws) > 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS c FROM sym UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON sym.a = r.c)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, w.doc_id) AS component_id, coalesce(l, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS m FROM r GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS l FROM sym GROUP BY a) USING (doc_id)
"""
