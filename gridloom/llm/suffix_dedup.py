"""Substring dedup over bytes by merging Burrows-Wheeler transforms.

Finds every `length`-byte string of a document that also starts in a document with a smaller doc_id.

Dealing.  All positions whose next `length` bytes have the same *anchor* (least hash of their ANCHOR-byte grams) meet
in one part.  A stretch of positions under one anchor is sent as one string, so a string of length - 1 + r bytes
carries r positions.  A first round finds the anchors that more than one document has, from 4 bytes an anchor; only
strings under those go on, equal strings of a block or part once, with the smallest doc_id that has them.

Merging.  In a part the distinct strings are cut into shards; each shard's suffixes are sorted and give its BWT.
The shards' BWTs are then merged without comparing a suffix again: starting from the plain concatenation of shards,
round h refines the interleave from "sorted by h bytes" to "sorted by h + 1 bytes" by one stable distribution of the
preceding bytes, and the borders that appear in round h are the places where neighbours share exactly h bytes.
After `length` rounds what is still undivided is a repeated interval: suffixes that share `length` bytes or more.
Its smallest doc_id decides for all of them.  Strings end in sentinels, which differ from each other, so no match
crosses a string or document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import BASES, NO_ID, blocked, documents, ids_of, mix, pack_bits, part_slices, parts_of, sliding_min, table_of, text_bytes, unpack_bits

LENGTH, ANCHOR, SHARDS = 50, 20, 2
BLOCK, PART = 3 << 20, 6 << 20
#: Suffixes that one merge takes at most, unless one anchor alone has more: a part is merged anchor range by anchor range.
MERGE = 1 << 17
#: Positions that one string carries at most. Repetitive text has long stretches under one anchor; cut at a fixed
#: step, their pieces are mostly equal and sent once.
PIECE = 256
ASK = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("flags", pa.binary())])
ASK_SQL = "part int, block long, keys binary, flags binary"
SEND = pa.schema([("part", pa.int32()), ("block", pa.int64())] + [(n, pa.binary()) for n in ("bytes", "lengths", "subs", "firsts", "which", "ids", "docs", "offsets")])
SEND_SQL = "part int, block long, bytes binary, lengths binary, subs binary, firsts binary, which binary, ids binary, docs binary, offsets binary"
#: What a part joins over its messages; occurrences have a place in `which`, their block's strings one in `lengths`.
STRING_COLUMNS = [("lengths", np.uint32), ("subs", np.uint32), ("firsts", np.int64), ("which", np.uint32), ("ids", np.int64), ("docs", np.uint32), ("offsets", np.int64)]
#: Positions of several messages that are answered together.
POSITIONS = 1 << 18
REPLY = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("bits", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
REPLY_SQL = "block long, part int, bits binary, docs binary, starts binary, ends binary"


def gram_hashes(b: np.ndarray, m: int) -> np.ndarray:
    """Mixed hash of every m consecutive bytes, composed from hashes of powers of two."""
    if len(b) < m:
        return np.zeros(0, np.uint64)
    base = np.uint64(BASES[0])
    power, h, have = base, b.astype(np.uint64) + np.uint64(1), 1
    out, done, rest = None, 0, m
    while rest:
        if rest & 1:
            tail = h[done : done + len(b) - m + 1]
            out = tail.copy() if out is None else out * power_of(base, have) + tail
            done += have
        rest >>= 1
        if rest:
            h = h[: len(h) - have] * power + h[have:]
            have *= 2
            power = power_of(base, have)
    return mix(out)


def power_of(base: np.uint64, k: int) -> np.uint64:
    return np.uint64(pow(int(base), k, 1 << 64))


class Block:
    """Bytes of a block's documents end to end, and the stretches of positions under one anchor."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        table = ordered(table)
        self.ids = ids_of(table.column("doc_id"))
        texts = table.column("text").cast(pa.binary()).to_pylist()
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.r_[0, np.cumsum(n)]
        self.raw = b"".join(texts)
        self.length = length
        b = np.frombuffer(self.raw, np.uint8)
        value = mix(sliding_min(gram_hashes(b, anchor), length - anchor + 1))  # mixed anew: least hashes are all small
        m = len(value)
        valid = np.zeros(m, bool)
        border = np.zeros(m + 1, bool)
        for i, (s, e) in enumerate(zip(self.start, self.start[1:])):
            if e - s >= length and self.ids[i] != NO_ID:
                valid[s : e - length + 1] = True
                border[s] = True
        border[1:m] |= (value[1:] != value[:-1]) | (valid[1:] != valid[:-1])
        at = np.flatnonzero(border[:m])
        ends = np.r_[at[1:], m]
        ok = valid[at]
        at, ends = at[ok], ends[ok]
        n_pieces = -(-(ends - at) // PIECE)
        whole = np.repeat(np.arange(len(at)), n_pieces)
        begin = at[whole] + PIECE * (np.arange(len(whole)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces))
        self.at, self.ends, self.anchor = begin, np.minimum(begin + PIECE, ends[whole]), value[at[whole]]
        self.doc = np.searchsorted(self.start, self.at, side="right") - 1
        order = np.argsort(self.anchor, kind="stable")
        self.at, self.ends, self.anchor, self.doc = (x[order] for x in (self.at, self.ends, self.anchor, self.doc))
        new = np.r_[True, self.anchor[1:] != self.anchor[:-1]] if len(order) else np.zeros(0, bool)
        self.first_of, self.group = np.flatnonzero(new), np.cumsum(new) - 1

    def ask(self, n_parts: int, block: int) -> list[tuple]:
        if not len(self.anchor):
            return []
        keys, ids = self.anchor[self.first_of], self.ids[self.doc]
        several = np.minimum.reduceat(ids, self.first_of) != np.maximum.reduceat(ids, self.first_of)
        low = keys.astype(np.uint32)
        return [(p, block, low[s:e].tobytes(), pack_bits(several[s:e])) for p, s, e in part_slices(keys, n_parts)]

    def send(self, n_parts: int, block: int, bits: dict[int, bytes]) -> list[tuple]:
        keys = self.anchor[self.first_of]
        shared = np.zeros(len(keys), bool)
        for p, s, e in part_slices(keys, n_parts):
            shared[s:e] = unpack_bits(bits[p], e - s)
        pick = np.flatnonzero(shared[self.group]) if len(keys) else np.zeros(0, np.int64)
        part, doc = parts_of(self.anchor[pick], n_parts), self.doc[pick]
        order = np.lexsort((doc, part))  # in a part documents ascend, so the first of equal strings has the least id
        pick, part, doc = pick[order], part[order], doc[order]
        at, raw, more = self.at[pick], self.raw, self.length - 1
        # equal strings have one anchor, so one part: strings are numbered part by part
        which, first, texts = distinct(pa.array([raw[s : e + more] for s, e in zip(at.tolist(), self.ends[pick].tolist())], pa.large_binary()))
        ends = np.r_[0, np.cumsum(sizes_of(texts))]
        bytes_ = texts.to_pylist()
        sizes, subs, firsts = np.diff(ends).astype(np.uint32), self.anchor[pick[first]].astype(np.uint32), self.ids[doc[first]]
        ids, docs, offsets = self.ids[doc], doc.astype(np.uint32), (at - self.start[doc]).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        text_cuts = np.searchsorted(first, cuts)  # first occurrences ascend
        which = (which - np.repeat(text_cuts[:-1], np.diff(cuts))).astype(np.uint32)
        rows = []
        for p, s, e, i, j in zip(part[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), text_cuts[:-1].tolist(), text_cuts[1:].tolist()):
            strings = [sizes[i:j], subs[i:j], firsts[i:j], which[s:e], ids[s:e], docs[s:e], offsets[s:e]]
            rows.append((p, block, b"".join(bytes_[i:j]), *(x.tobytes() for x in strings)))
        return rows


def distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of each string among the different ones (in the order of their first places), these places, and the strings."""
    coded = texts.dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return which, first, coded.dictionary


def sizes_of(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).to_numpy().astype(np.int64)


def ordered(table: pa.Table) -> pa.Table:
    """Rows in the order of id (nulls last), then text: the same in every round, however rows arrive."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def suffix_order(codes: np.ndarray, left: np.ndarray, enough: int | None = None) -> np.ndarray:
    """Suffixes of strings laid end to end (each ends with code 0; left: codes up to and with that 0), sorted whole or by
    `enough` codes at least: a merge of as many rounds looks no further.

    Prefix doubling from 8-byte keys; suffixes that are equal so far, or up to their sentinels, keep the order of their strings.
    """
    n = len(codes)
    padded = np.r_[codes, np.zeros(8, np.uint8)]
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(left > k, padded[k : k + n], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
    have, longest = 8, int(left.max(initial=0))
    longest = longest if enough is None else min(longest, enough)
    here = np.arange(n)
    while have < longest:
        ahead = np.where(left > have, rank[np.minimum(here + have, n - 1)] + 1, 0)
        pair = rank * (n + 1) + ahead
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        rank[order] = np.cumsum(np.r_[False, p[1:] != p[:-1]])
        have *= 2
    return order


def merge_bwts(bwts: list[np.ndarray], n_strings: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of the shards' sorted suffixes, the number of its undivided block at each place, and at each
    place the length shared with the place before (rounds, if it is that or more)."""
    n, n_ends = sum(map(len, bwts)), sum(n_strings)
    offsets = np.cumsum([0, *map(len, bwts)])
    chars = np.concatenate(bwts)
    ahead = np.zeros(n, np.int64)  # of each suffix: the one with the byte before it, in the same shard
    heads = []
    for b, k, at in zip(bwts, n_strings, offsets.tolist()):
        inner = np.flatnonzero(b)
        ahead[at + inner[np.argsort(b[inner], kind="stable")]] = at + np.arange(k, len(b))
        heads.append(at + np.arange(k))
    suffix = np.arange(n)  # at each place of the interleave
    border = np.zeros(n + 1, bool)
    border[n] = True
    lcp = np.full(n, rounds, np.int16)
    # A suffix alone in its block stays where it is, and so does the one it leads to after one more round: from then on
    # neither place is looked at.  live: places whose suffixes still lead on; free: where these lead, both ascending.
    live, free = np.arange(n), np.arange(n_ends, n)
    for h in range(rounds):
        block = np.cumsum(border[live])
        settled = border[live] & border[live + 1]
        c = chars[suffix[live]]
        inner = np.flatnonzero(c)
        move = inner[np.argsort(c[inner], kind="stable")]
        c, came = c[move], block[move]
        new = np.ones(len(free), bool)
        new[1:] = (c[1:] != c[:-1]) | (came[1:] != came[:-1])
        to = ahead[suffix[live[move]]]
        if h == 0:
            suffix[:n_ends] = np.concatenate(heads)
            border[:n_ends] = True
            lcp[:n_ends] = 0
        suffix[free] = to
        lcp[free[new & ~border[free]]] = h
        border[free] = new
        live, free = live[~settled], free[~settled[move]]
    z = np.searchsorted(offsets[1:], suffix, side="right").astype(np.uint8)
    return z, np.cumsum(border[:n], dtype=np.int32) - 1, lcp


def earliest(strings: list[bytes], firsts: np.ndarray, length: int, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """For every position of every string with `length` bytes ahead, the least first id of an equal such substring.

    Returns these flat, string by string, and the offset of each string among them.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    counts = np.maximum(sizes - length + 1, 0)
    offset = np.r_[0, np.cumsum(counts)]
    out = np.empty(offset[-1], np.int64)
    bwts, suffixes, n_strings, cuts = [], [], [], np.linspace(0, len(strings), min(shards, len(strings)) + 1).astype(int)
    for s, e in zip(cuts, cuts[1:]):
        joined = np.frombuffer(b"\xff".join(strings[s:e]) + b"\xff", np.uint8) + np.uint8(1)  # 0xFF is in no UTF-8: sentinel 0
        ends = np.cumsum(sizes[s:e] + 1)
        string = np.repeat(np.arange(s, e), sizes[s:e] + 1)
        place = np.arange(len(joined))
        left = ends[string - s] - place
        order = suffix_order(joined, left, length)
        bwts.append(np.where(place == (ends - sizes[s:e] - 1)[string - s], 0, np.r_[np.uint8(0), joined[:-1]]).astype(np.uint8)[order])
        start = (ends - sizes[s:e] - 1)[string - s]
        suffixes.append((string[order], (place - start)[order]))
        n_strings.append(e - s)
    z, block, _ = merge_bwts(bwts, n_strings, length)
    string = np.empty(len(z), np.int64)
    at = np.empty(len(z), np.int64)
    for j, (t, k) in enumerate(suffixes):
        mine = z == j
        string[mine], at[mine] = t, k
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    least = np.minimum.reduceat(firsts[string], starts)[block]
    real = at < counts[string]
    out[offset[string[real]] + at[real]] = least[real]
    return out, offset


def anchor_ranges(anchors: np.ndarray, sizes: np.ndarray, among: np.ndarray, most: int = MERGE) -> list[np.ndarray]:
    """The strings `among` all, range by range of anchors: whole anchors, about `most` suffixes."""
    order = among[np.argsort(anchors[among], kind="stable")]
    if not len(order):
        return []
    a = anchors[order]
    new = np.r_[True, a[1:] != a[:-1]]
    ahead = (np.cumsum(sizes[order]) - sizes[order])[new]  # suffixes before each anchor
    share = (ahead // most)[np.cumsum(new) - 1]
    return np.split(order, np.flatnonzero(share[1:] != share[:-1]) + 1)


def _answer_anchors(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    several = np.concatenate([unpack_bits(r["flags"], len(k)) for r, k in zip(rows, keys)])
    _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[several]] = True
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return table_of(REPLY, [(r["block"], r["part"], pack_bits(x), b"", b"", b"") for r, x in zip(rows, np.split(shared[inverse], cuts))])


def _answer_strings(table: pa.Table, length: int, shards: int) -> pa.Table:
    rows = table.select(["block", "part", *(c for c, _ in STRING_COLUMNS), "bytes"]).to_pydict()
    cut = {c: np.r_[0, np.cumsum([len(x) // np.dtype(t).itemsize for x in rows[c]])] for c, t in (("lengths", np.uint32), ("which", np.uint32))}
    of = {c: np.frombuffer(b"".join(rows.pop(c)), t) for c, t in STRING_COLUMNS}
    given = b"".join(rows.pop("bytes"))
    ends = np.r_[0, np.cumsum(of["lengths"].astype(np.int64))]
    own, at, strings = distinct(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(given)]))
    del given
    first_of = of["firsts"][at].copy()
    np.minimum.at(first_of, own, of["firsts"])
    sizes = sizes_of(strings)
    offset = np.r_[0, np.cumsum(np.maximum(sizes - length + 1, 0))]
    sub = of["subs"][at].astype(np.int64)
    # a string alone under its anchor shares nothing with another one: its own first document decides
    _, kind, alike = np.unique(sub, return_inverse=True, return_counts=True)
    alone = alike[kind] == 1
    least = np.repeat(first_of, np.diff(offset))
    several = np.flatnonzero(~alone)
    for chosen in anchor_ranges(sub, sizes + 1, several):
        found, begin = earliest(strings.take(pa.array(chosen)).to_pylist(), first_of[chosen], length, shards)
        n = np.diff(begin)
        least[np.repeat(offset[chosen] - begin[:-1], n) + np.arange(len(found))] = found
    # each occurrence: its string here, and the first document of that string in its own block
    text = of["which"] + np.repeat(cut["lengths"][:-1], np.diff(cut["which"]))
    first, text = of["firsts"][text], own[text]
    reach = np.r_[0, np.cumsum(offset[text + 1] - offset[text])][cut["which"]]  # positions up to each message
    replies = []
    m = 0
    while m < table.num_rows:  # messages together, as far as POSITIONS goes
        to = max(m + 1, int(np.searchsorted(reach, reach[m] + POSITIONS, side="right")) - 1)
        s, e = cut["which"][m], cut["which"][to]
        mine = text[s:e]
        n = offset[mine + 1] - offset[mine]
        occ = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(occ)) - np.repeat(np.cumsum(n) - n, n)
        # a later document of the same block loses the whole string
        edge = (least[offset[mine][occ] + k] < first[s:e][occ]) | (of["ids"][s:e] > first[s:e])[occ]
        same = edge[:-1] & edge[1:] & (occ[1:] == occ[:-1])
        begin, final = edge.copy(), edge.copy()
        begin[1:] &= ~same
        final[:-1] &= ~same
        spans = occ[begin]
        docs, offs = of["docs"][s:e][spans], of["offsets"][s:e][spans]
        start, end = offs + k[begin], offs + k[final] + length
        cuts = np.searchsorted(spans, cut["which"][m : to + 1] - s).tolist()
        for r, (i, j) in enumerate(zip(cuts, cuts[1:]), m):
            replies.append((rows["block"][r], rows["part"][r], b"", docs[i:j].tobytes(), start[i:j].tobytes(), end[i:j].tobytes()))
        m = to
    return table_of(REPLY, replies)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    A byte goes if a `length`-byte string covering it also starts in a document with a smaller doc_id; n_spans counts
    maximal removed runs.  Null and empty texts have no bytes; rows with a null doc_id neither remove nor lose bytes;
    rows that share a doc_id do not remove each other's.  Other columns are ignored.
    """
    total = text_bytes(docs)
    d, _ = blocked(docs, total, BLOCK)
    n_parts = max(4, -(-total // PART))

    def ask(key, table):
        return table_of(ASK, Block(table, length, anchor).ask(n_parts, key[0].as_py()))

    def send(key, table, replies):
        bits = {r["part"]: r["bits"] for r in replies.to_pylist()}
        return table_of(SEND, Block(table, length, anchor).send(n_parts, key[0].as_py(), bits) if table.num_rows else [])

    def answer(table):
        return _answer_strings(table, length, shards)

    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def cut(key, table, replies):
        table = ordered(table)
        ids = table.column("doc_id").to_pylist()
        spans = [np.frombuffer(b"".join(replies.column(c).to_pylist()), t) for c, t in (("docs", np.uint32), ("starts", np.int64), ("ends", np.int64))]
        order = np.lexsort((spans[1], spans[0]))
        doc, start, end = (x[order] for x in spans)
        at = np.searchsorted(doc, np.arange(len(ids) + 1))
        rows = []
        for i, (doc_id, text) in enumerate(zip(ids, table.column("text").cast(pa.binary()).to_pylist())):
            s, e = start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
            kept, removed, runs, begun = [], 0, 0, 0
            if len(s):
                reach = np.maximum.accumulate(e)
                new = np.r_[True, s[1:] > reach[:-1]]
                s, e = s[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]
                removed, runs = int((e - s).sum()), len(s)
                for a, b in zip(s.tolist(), e.tolist()):
                    kept.append(text[begun:a])
                    begun = b
            rest = b"".join([*kept, text[begun:]])
            rows.append((doc_id, len(text), removed, runs, rest, hashlib.sha256(rest).hexdigest()))
        return table_of(out, rows)

    by_block = d.groupBy("block")
    shared = by_block.applyInArrow(ask, ASK_SQL).groupBy("part").applyInArrow(_answer_anchors, REPLY_SQL)
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(send, SEND_SQL)
    spans = sent.groupBy("part").applyInArrow(answer, REPLY_SQL)
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).drop("kept")


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, substring(h, 400 * k + 1, 498) AS c FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 199) // 200)) AS k FROM d)),
p AS (SELECT doc_id, k, c, unnest(range(0, least(200, len(c) // 2 - 49))) AS q FROM c),
w AS (SELECT doc_id, 200 * k + q AS p, min(doc_id) OVER (PARTITION BY md5(substring(c, 2 * q + 1, 100))) AS first FROM p),
bad AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w WHERE doc_id > first),
runs AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 50 THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM bad),
spans AS (SELECT doc_id, g, min(p) AS s, max(p) + 50 AS e FROM runs GROUP BY doc_id, g),
gaps AS (SELECT d.doc_id, spans.s, coalesce(lag(spans.e) OVER (PARTITION BY d.doc_id ORDER BY spans.s), 0) AS b, spans.e, h
         FROM d JOIN spans USING (doc_id)),
head AS (SELECT doc_id, string_agg(substring(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS t, max(e) AS e,
                sum(e - s) AS n, count(*) AS k FROM gaps GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(t, '') || substring(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN head USING (doc_id)
"""
