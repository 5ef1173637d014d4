"""LM scoring with a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Restaurants: one per context, and a context is a whole previous word (or the start of a text); all have one parent.  A
word's customers in a context sit at tables; each table is a customer of the parent, where the base measure gives every
new word a table of its own.  So the parent's predictive probability of a word is (tables - d0) / (theta0 + all tables),
and the rest is the probability of a new word.

A pair (context, word) that occurs once has one table and cannot move.  So blocks of text first ask, by 40 or so bits a
pair, which of their pairs occur elsewhere; the others are only counted, by word and by context.  The pairs that occur
twice or more are dealt by context, so a restaurant's customers and tables are in one part; a word's tables over all
parts are exchanged between rounds.  In a round every dish of two or more customers is reseated SWEEPS times, as a
block, by its number of tables given everything else (sizes of tables do not enter the score): drawn from the whole
distribution up to EXACT customers, by Metropolis-Hastings draws above.  Dishes are reseated in two halves with fresh
totals between; tables that other parts open in the same round are seen in the next one (approximate distributed Gibbs).
The strength of the contexts is sampled each round by auxiliary variables; discounts are estimated from the counts of
ones and twos.  Seating starts at one table a dish.  After the burn-in the numbers of tables of each round are one
sample; predictive probabilities are averaged over the samples.

Texts are packed once into blocks, one row each; a block asks every part for its words and pairs, and gets counts and
numbers of tables back.  Everything gathered grows with the corpus and is dealt over parts; nothing of it is broadcast.
A context's distinct listed words are in one part, however many customers it has.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import NO_ID, bucketed, documents, ids_of, mix, pack_bits, part_slices, scratch, table_of, text_bytes, unpack_bits

THETA = 1.0
BURN_IN, SAMPLES, SWEEPS = 2, 3, 2
EXACT = 1024
FOLDS = 10
BLOCK, PART_BYTES = 8 << 20, 16 << 20
MESSAGE_SQL = "part int, block long, words binary, c binary, sw binary, su binary, deg binary, pw binary, pc binary"
MESSAGE = pa.schema([("part", pa.int32()), ("block", pa.int64()), *((x, pa.binary()) for x in ("words", "c", "sw", "su", "deg", "pw", "pc"))])
STATE_SQL = "part int, words binary, c binary, sw binary, su binary, deg binary, wl binary, pj binary, pc binary, blocks binary, aw array<binary>, ap array<binary>"
STATE = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("words", "c", "sw", "su", "deg", "wl", "pj", "pc", "blocks")), ("aw", pa.list_(pa.binary())), ("ap", pa.list_(pa.binary()))])
MAIL_SQL = "key int, peer int, kind int, a binary, b binary, stat array<double>"
MAIL = pa.schema([("key", pa.int32()), ("peer", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("stat", pa.list_(pa.float64()))])
OWN, SENT, ROUTE = 0, 1, 2
REPLY_SQL = "block long, part int, kind int, a binary, b binary, c binary, d binary, e binary"
REPLY = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcde")])
OUT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, known_score double, perplexity double"
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")), *((x, pa.float64()) for x in ("base_score", "score", "known_score", "perplexity"))])
END = b""  # the end of a text, and the context of its first word; no word is empty


def held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return doc_id is not None and zlib.crc32(b"%d" % doc_id) % folds == 0


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 0 or more as compressed byte planes."""
    v = np.ascontiguousarray(values, np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, 8).T.tobytes()) if len(v) else b""


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).reshape(-1)


def packed_sorted(values: np.ndarray) -> bytes:
    v = np.ascontiguousarray(values).astype(np.uint64)
    return packed(np.diff(v, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).view(np.uint64), dtype=np.uint64)


def _pack_blocks(batches):
    """Texts as rows of about BLOCK bytes: block, ids, sizes, texts."""
    part, made = TaskContext.get().partitionId(), 0
    ids, texts, load = [], [], 0

    def row():
        data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.record_batch([pa.array([(part << 24) | made], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([packed(sizes)]), pa.array([data])], names=["block", "ids", "sizes", "texts"])

    for b in batches:
        for doc_id, text in zip(ids_of(pa.chunked_array([b.column(0)])).tolist(), b.column(1).cast(pa.binary()).to_pylist()):
            if texts and load + len(text) > BLOCK:
                yield row()
                made += 1
                ids, texts, load = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            load += len(text)
    if texts:
        yield row()


class Block:
    """Tokens of a block's texts, distinct words (sorted by hash), distinct pairs (sorted by context, then word)."""

    def __init__(self, row: dict, folds: int = FOLDS):
        self.ids = np.frombuffer(row["ids"], np.int64)
        ends = np.cumsum(unpacked(row["sizes"]))
        data = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(ends[-1])))
        texts = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(np.r_[0, ends]), pa.py_buffer(data)])
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.values.dictionary_encode()
        forms, which = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        begin = split.offsets.to_numpy()
        real = np.fromiter(map(bool, forms), bool, len(forms))[which]  # white space at an edge leaves an empty string
        before = np.r_[0, np.cumsum(real)][begin]
        self.n = np.diff(before) + 1
        del data, texts, split, coded
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, forms), np.uint64, len(forms))
        end = xxhash.xxh3_64_intdigest(END)
        self.words = np.union1d(h[list(map(bool, forms))], np.array([end], np.uint64))
        boundary = int(np.searchsorted(self.words, np.uint64(end)))
        rank = np.searchsorted(self.words, h)
        ends_at = np.cumsum(self.n) - 1
        self.token = np.full(int(self.n.sum()), boundary, np.int64)
        inner = np.ones(len(self.token), bool)
        inner[ends_at] = False
        self.token[inner] = rank[which[real]]
        self.held = np.array([held_out(None if i == NO_ID else i, folds) for i in self.ids.tolist()])
        code = np.r_[boundary, self.token[:-1]] * len(self.words) + self.token  # every text ends with END
        code, self.pair = np.unique(code, return_inverse=True)
        self.pu, self.pw = code // len(self.words), code % len(self.words)
        train = np.repeat(~self.held, self.n)
        self.count = np.bincount(self.pair, weights=train, minlength=len(code)).astype(np.int64)
        self.c = np.bincount(self.token, weights=train, minlength=len(self.words)).astype(np.int64)
        key = mix(mix(self.words)[self.pu] + self.words[self.pw])
        self.by_key = np.argsort(key)
        self.key = key[self.by_key]

    def classes(self, replies: dict[int, dict], n_parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per pair: listed (the parts have it), single (its one training occurrence is here)."""
        out = np.zeros((2, len(self.key)), bool)
        for p, s, e in part_slices(self.key, n_parts):
            for k, column in enumerate("ab"):
                out[k, self.by_key[s:e]] = unpack_bits(replies[p][column], e - s)
        return out[0], out[1]


def fingerprint_bits(total: int) -> int:
    """Bits of a pair's hash that are asked with: some 11 more than the corpus has tokens."""
    return min(64, max(32, int(total).bit_length() + 9))


def _fingerprints(batches, n_parts: int, bits: int, folds: int):
    for b in batches:
        for row in b.to_pylist():
            x = Block(row, folds)
            fp, count = x.key >> np.uint64(64 - bits), x.count[x.by_key]
            rows = [(p, row["block"], packed_sorted(fp[s:e]), pack_bits(count[s:e] > 0), pack_bits(count[s:e] > 1)) for p, s, e in part_slices(x.key, n_parts)]
            yield from table_of(ASKED, rows).to_batches()


ASKED_SQL = "part int, block long, fps binary, seen binary, more binary"
ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("fps", pa.binary()), ("seen", pa.binary()), ("more", pa.binary())])


def _classed(table: pa.Table) -> pa.Table:
    """Which pairs occur twice or more, or once and are asked for elsewhere (listed); which once and here (single)."""
    rows = table.to_pylist()
    fps = [unpacked_sorted(r["fps"]) for r in rows]
    n = np.concatenate([unpack_bits(r["seen"], len(f)).astype(np.int8) + unpack_bits(r["more"], len(f)) for r, f in zip(rows, fps)])
    distinct, of = np.unique(np.concatenate(fps), return_inverse=True)
    total, asking = np.bincount(of, weights=n, minlength=len(distinct)), np.bincount(of, weights=n == 0, minlength=len(distinct))
    listed = ((total > 1) | ((total == 1) & (asking > 0)))[of]
    single = ((total == 1) & (asking == 0))[of]
    out, at = [], 0
    for r, f in zip(rows, fps):
        out.append((r["block"], r["part"], 1, pack_bits(listed[at : at + len(f)]), pack_bits(single[at : at + len(f)]), None, None, None))
        at += len(f)
    return table_of(REPLY, out)


def _listing(table: pa.Table, replies: pa.Table, n_parts: int, folds: int) -> pa.Table:
    """Messages of blocks to parts: words with their counts and single pairs, and listed pairs by context."""
    got: dict[int, dict[int, dict]] = {}
    for r in replies.to_pylist():
        got.setdefault(r["block"], {})[r["part"]] = r
    out = []
    for row in table.to_pylist():
        x = Block(row, folds)
        listed, single = x.classes(got[row["block"]], n_parts)
        sw, su = (np.bincount(i[single], minlength=len(x.words)) for i in (x.pw, x.pu))
        pick = np.flatnonzero(listed)
        pu, pw, pc = x.pu[pick], x.words[x.pw[pick]] >> np.uint64(16), x.count[pick]
        for p, s, e in part_slices(x.words, n_parts):
            a, b = np.searchsorted(pu, [s, e]).tolist()
            deg = np.bincount(pu[a:b] - s, minlength=e - s)
            out.append((p, row["block"], packed_sorted(x.words[s:e]), packed(x.c[s:e]), packed(sw[s:e]), packed(su[s:e]), packed(deg), packed(pw[a:b]), packed(pc[a:b])))
    return table_of(MESSAGE, out)


def _state(table: pa.Table) -> pa.Table:
    """Sums the messages to a part, and remembers what each block asked for."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    lists = [unpacked_sorted(r["words"]) for r in rows]
    words, of = np.unique(np.concatenate(lists), return_inverse=True)
    sums = {k: np.bincount(of, weights=np.concatenate([unpacked(r[k]) for r in rows]), minlength=len(words)).astype(np.int64) for k in ("c", "sw", "su")}
    degs = [unpacked(r["deg"]) for r in rows]
    u = np.repeat(of, np.concatenate(degs))
    pw = np.concatenate([unpacked(r["pw"]) for r in rows])
    wl, j = np.unique(pw, return_inverse=True)
    code, pair = np.unique(u * max(1, len(wl)) + j, return_inverse=True)
    pc = np.bincount(pair, weights=np.concatenate([unpacked(r["pc"]) for r in rows]), minlength=len(code)).astype(np.int64)
    u, j = code // max(1, len(wl)), code % max(1, len(wl))
    aw = np.split(of, np.cumsum([len(x) for x in lists])[:-1])
    ap = np.split(pair, np.cumsum([int(x.sum()) for x in degs])[:-1])
    return table_of(STATE, [(rows[0]["part"], packed_sorted(words), packed(sums["c"]), packed(sums["sw"]), packed(sums["su"]), packed(np.bincount(u, minlength=len(words))), packed_sorted(wl), packed(j), packed(pc), packed([r["block"] for r in rows]), [packed_sorted(x) for x in aw], [packed_sorted(x) for x in ap])])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive x: Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - shift


@functools.lru_cache(4)
def log_ways_table(d: float, n: int = EXACT) -> np.ndarray:
    """[c, t]: log of the summed weights of all seatings of c customers at t tables (generalised Stirling numbers)."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[1, 1] = 0.0
    k = np.arange(n + 1)
    for c in range(1, n):
        stay = np.log(np.maximum(c - d * k, 1e-300)) + s[c]
        s[c + 1] = np.logaddexp(np.r_[-np.inf, s[c][:-1]], stay)
    return s


def log_ways(c: np.ndarray, t: np.ndarray, d: float, nodes: int = 48, step: float = 0.25) -> np.ndarray:
    """The same for any c and t, up to a constant of c.

    c! / (t! d**t) times the coefficient of z**c in (1 - (1 - z)**d)**t: Cauchy's integral along a parabola through the
    saddle point that opens around the cut from 1 on.
    """
    n, m = c.astype(float)[:, None], t.astype(float)[:, None]
    low, high = np.full(n.shape, 1e-9), np.full(n.shape, 60.0)
    for _ in range(30):
        s = (low + high) / 2
        over = m * d * -np.expm1(-s) * np.exp(s * (1 - d)) > n * -np.expm1(-s * d)
        low, high = np.where(over, low, s), np.where(over, s, high)
    y = np.clip(np.exp(-low), 1 / n, 1 - 1e-9)
    g = 1 - y**d
    g1, g2 = d * y ** (d - 1) / g, d * (1 - d) * y ** (d - 2) / g
    bend = np.maximum(n / (1 - y) ** 2 + m * (g2 - g1**2), 0.25 / y**2)
    apart = step / (2 * y * np.sqrt(bend))
    q = 1 + 1j * np.arange(nodes) * apart
    w = -y * q * q
    e = m * np.log(1 - (-w) ** d) - (n + 1) * np.log(1 + w) + np.log(q)
    top = e[:, :1].real
    v = np.exp(e - top).real
    total = (v.sum(1) - v[:, 0] / 2) * apart[:, 0] * 2 * y[:, 0] / np.pi
    t = t.astype(float)
    return np.where(t == c, 0.0 - log_gamma(c + 1.0), top[:, 0] + np.log(np.maximum(total, 1e-300)) - log_gamma(t + 1) - t * np.log(d))


class Seating:
    """Dishes of some contexts: customers c and tables t of each, its context u and word j.

    alone: tables of a context besides these dishes; own: tables of a word in all restaurants; every: tables of all.
    """

    def __init__(self, c, t, u, j, alone, own, every: float, d1: float, d0: float, theta: float = THETA, seed: int = 0):
        self.c, self.t, self.u, self.j = c, t.copy(), u, j
        self.alone, self.d1, self.d0, self.theta = alone, d1, d0, theta
        self.own_before, self.all_before = own - np.bincount(j, weights=t, minlength=len(own)), every - t.sum()
        self.movable = np.flatnonzero(c > 1)
        self.rng = np.random.Generator(np.random.Philox(seed))
        self.refresh()

    def refresh(self) -> None:
        self.tables_of = self.alone + np.bincount(self.u, weights=self.t, minlength=len(self.alone))
        self.own = self.own_before + np.bincount(self.j, weights=self.t, minlength=len(self.own_before))
        self.every = self.all_before + self.t.sum()

    def _others(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables of the context, of the word and of all, without the dishes' own."""
        t = self.t[m]
        return np.maximum(self.tables_of[self.u[m]] - t, 0.0), np.maximum(self.own[self.j[m]] - t, 0.0), np.maximum(self.every - t, 0.0)

    def draw_tables(self, m: np.ndarray) -> None:
        """Numbers of tables of dishes of up to EXACT customers, from all that are possible."""
        c = self.c[m]
        n = int(c.max())
        here, own, every = (x[:, None] for x in self._others(m))
        k = np.arange(1, n)[None, :]
        sizes, of = np.unique(c, return_inverse=True)
        weight = log_ways_table(self.d1)[sizes, 1 : n + 1][of]
        weight[:, 1:] += np.cumsum(np.log((self.theta + self.d1 * (here + k)) * np.maximum(own + k - self.d0, 1e-9) / (THETA + every + k)), axis=1)
        p = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
        self.t[m] = 1 + np.minimum((p < self.rng.random((len(m), 1)) * p[:, -1:]).sum(1), c - 1)

    def step_tables(self, m: np.ndarray) -> None:
        """Metropolis-Hastings draws of the numbers of tables of dishes of any count, proposed around the most probable."""
        c, d, rng = self.c[m], self.d1, self.rng
        here, own, every = self._others(m)

        def weight(at, t):
            return log_ways(c[at], t, d) + t * np.log(d) + log_gamma(self.theta / d + here[at] + t) + log_gamma(np.maximum(own[at] + t - self.d0, 1e-9)) - log_gamma(THETA + every[at] + t)

        every_one = np.arange(len(m))
        low, high = np.ones(len(m), np.int64), c - 1
        while (low < high).any():  # one peak
            mid = (low + high) // 2
            rises = weight(every_one, mid + 1) > weight(every_one, mid)
            low, high = np.where(rises, np.minimum(mid + 1, high), low), np.where(rises, high, mid)
        peak = low
        off = np.maximum(1, np.minimum(np.sqrt(peak).astype(np.int64), np.minimum(peak, c - peak) - 1))
        bend = 2 * weight(every_one, peak) - weight(every_one, peak + off) - weight(every_one, np.maximum(peak - off, 1))
        spread = np.maximum(off / np.sqrt(np.maximum(bend, 1e-6)) / 1.6, 0.3)

        def proposed(at, t):  # a logistic distribution in whole numbers
            a, b = ((np.abs(t - peak[at]) + x) / spread[at] for x in (-0.5, 0.5))
            return a + np.log(np.expm1(b - a)) - np.logaddexp(0, a) - np.logaddexp(0, b)

        t = self.t[m]
        now = weight(every_one, t) - proposed(every_one, t)
        for _ in range(4):
            to = peak + np.rint(rng.logistic(size=len(m)) * spread).astype(np.int64)
            at = np.flatnonzero((to >= 1) & (to <= c))
            then = weight(at, to[at]) - proposed(at, to[at])
            ok = np.log(rng.random(len(at))) < then - now[at]
            t[at[ok]], now[at[ok]] = to[at[ok]], then[ok]
        self.t[m] = t

    def sweep(self) -> None:
        """Reseats every dish of two or more customers, one random half after the other."""
        half = self.rng.random(len(self.movable)) < 0.5
        for m in (self.movable[half], self.movable[~half]):
            m = m[np.argsort(self.c[m], kind="stable")]
            small = m[self.c[m] <= EXACT]
            if len(small):
                c = self.c[small]
                alike, load = np.floor(3 * np.log2(c)), np.cumsum(c) >> 19  # dishes of about a size, bounded work at a time
                for part in np.split(small, np.flatnonzero((alike[1:] != alike[:-1]) | (load[1:] != load[:-1])) + 1):
                    self.draw_tables(part)
            large = m[len(small) :]
            for part in np.array_split(large, -(-len(large) // 4096)) if len(large) else ():
                self.step_tables(part)
            self.refresh()

    def strength_sums(self, customers: np.ndarray) -> tuple[float, float]:
        """Auxiliary variables of theta: the sum of the y, and of the log x, over all contexts."""
        m = customers > 1
        n, t = customers[m], self.tables_of[m].astype(np.int64)
        log_x = np.log(np.maximum(self.rng.beta(self.theta + 1, np.maximum(n - 1, 1)), 1e-300)).sum()
        least = np.bincount(np.maximum(t, 1))[::-1].cumsum()[::-1][2:]  # contexts with 2 tables or more, with 3, and so on
        y = self.rng.binomial(least, self.theta / (self.theta + self.d1 * np.arange(1, len(least) + 1))).sum()
        return float(y), float(log_x)


def next_strength(y: float, log_x: float, rng: np.random.Generator) -> float:
    """theta given its auxiliary variables, under a Gamma(1, 1) prior."""
    return float(np.clip(rng.gamma(1 + y) / (1 - log_x), 1e-3, 1e6))


def _dishes(state: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    deg = unpacked(state["deg"])
    return np.repeat(np.arange(len(deg)), deg), unpacked(state["pj"]), unpacked(state["pc"])


def _mail_tables(part: int, wl: np.ndarray, sums: np.ndarray, n_parts: int, first: bool) -> list[tuple]:
    """A part's tables by word, to the parts of the words; with the words themselves the first time."""
    return [(p, part, SENT, packed_sorted(wl[s:e]) if first else b"", packed(sums[s:e]), None) for p, s, e in part_slices(wl << np.uint64(16), n_parts)]


def _first_tables(batches, n_parts: int):
    for b in batches:
        for r in b.to_pylist():
            wl, j, c = unpacked_sorted(r["wl"]), unpacked(r["pj"]), unpacked(r["pc"])
            sums = np.bincount(j, weights=c > 0, minlength=len(wl)).astype(np.int64)
            yield from table_of(MAIL, _mail_tables(r["part"], wl, sums, n_parts, True)).to_batches()


def _word_tables(state: pa.Table, mail: pa.Table) -> pa.Table:
    """Sums the tables of a part's words and answers who sent some; the first time also keeps the routes."""
    if not state.num_rows:
        return table_of(MAIL, [])
    r = state.to_pylist()[0]
    total = unpacked(r["sw"]).copy()
    got = mail.to_pylist()
    routes = {x["peer"]: unpacked_sorted(x["a"]).astype(np.int64) for x in got if x["kind"] == ROUTE}
    sent = [x for x in got if x["kind"] == SENT]
    out = []
    if "words" in r:
        words = unpacked_sorted(r["words"]) >> np.uint64(16)
        for x in sent:
            routes[x["peer"]] = np.searchsorted(words, unpacked_sorted(x["a"]))
            out.append((r["part"], x["peer"], ROUTE, packed_sorted(routes[x["peer"]]), b"", None))
    for x in sent:
        total[routes[x["peer"]]] += unpacked(x["b"])  # the words of one message differ
    out += [(peer, r["part"], SENT, packed(total[at]), b"", None) for peer, at in routes.items()]
    out.append((r["part"], -1, OWN, packed(total), b"", [float(total.sum()), float((total == 1).sum()), float((total == 2).sum())]))
    return table_of(MAIL, out)


def _reseat(state: pa.Table, mail: pa.Table, n_parts: int, totals: dict, seed: int, sweeps: int) -> pa.Table:
    """One round: sweeps over a part's dishes; gives their tables, and the sums by word."""
    if not state.num_rows:
        return table_of(MAIL, [])
    r = state.to_pylist()[0]
    got = mail.to_pylist()
    u, j, c = _dishes(r)
    before = [x for x in got if x["kind"] == OWN]
    t = unpacked(before[0]["a"]) if before else np.minimum(c, 1)
    wl, customers = unpacked_sorted(r["wl"]), unpacked(r["c"])
    answers = sorted((x for x in got if x["kind"] == SENT), key=lambda x: x["peer"])
    own = np.concatenate([unpacked(x["a"]) for x in answers] or [np.zeros(0, np.int64)]).astype(float)
    s = Seating(c, t, u, j, unpacked(r["su"]).astype(float), own, totals["every"], totals["d1"], totals["d0"], totals["theta"], seed * 1000003 + r["part"])
    for _ in range(sweeps):
        s.sweep()
    sums = np.bincount(j, weights=s.t, minlength=len(wl)).astype(np.int64)
    return table_of(MAIL, [(r["part"], -1, OWN, packed(s.t), b"", list(s.strength_sums(customers))), *_mail_tables(r["part"], wl, sums, n_parts, False)])


def _answer(state: pa.Table, mail: pa.Table, samples: int) -> pa.Table:
    """Per block: counts of its words, their tables and those of their contexts, counts and tables of its listed pairs."""
    if not state.num_rows:
        return table_of(REPLY, [])
    r = state.to_pylist()[0]
    u, _, c = _dishes(r)
    got = {(x["kind"], x["peer"]): unpacked(x["a"]) for x in mail.to_pylist()}
    customers, alone = unpacked(r["c"]), unpacked(r["su"])
    out = []
    pair_tables = [got[OWN, s] for s in range(samples)]
    word_tables = [got[SENT, s] for s in range(samples)]
    context_tables = [alone + np.bincount(u, weights=t, minlength=len(alone)).astype(np.int64) for t in pair_tables]
    for block, aw, ap in zip(unpacked(r["blocks"]).tolist(), r["aw"], r["ap"]):
        w, p = unpacked_sorted(aw).astype(np.int64), unpacked_sorted(ap).astype(np.int64)
        each = lambda lists, at: packed(np.concatenate([x[at] for x in lists]))
        out.append((block, r["part"], 2, packed(customers[w]), each(word_tables, w), each(context_tables, w), packed(c[p]), each(pair_tables, p)))
    return table_of(REPLY, out)


def predictive(c, t, customers, context_tables, parent, d1: float, theta: float) -> np.ndarray:
    """P(word | context) of c customers at t tables; the parent's alone where the context has no customers."""
    own = (np.maximum(c - d1 * t, 0.0) + (theta + d1 * context_tables) * parent) / (theta + customers)
    return np.where(customers > 0, own, parent)


def parent_of(count, tables, every: float, n_words: int, d0: float) -> np.ndarray:
    """The parent's probability of a word, or of a new word where the training texts have none."""
    return np.where(count > 0, np.maximum(tables - d0, 1e-9), THETA + d0 * n_words) / (THETA + every)


def _told(table: pa.Table, replies: pa.Table, n_parts: int, folds: int, totals: dict) -> pa.Table:
    got: dict[tuple[int, int], dict[int, dict]] = {}
    for r in replies.to_pylist():
        got.setdefault((r["block"], r["kind"]), {})[r["part"]] = r
    out, n = [], len(totals["theta"])
    for row in table.to_pylist():
        x = Block(row, folds)
        listed, single = x.classes(got[row["block"], 1], n_parts)
        answers = got[row["block"], 2]
        count = np.zeros(len(x.words))
        tables, context_tables = np.zeros((n, len(x.words))), np.zeros((n, len(x.words)))
        c, t = single.astype(float), np.repeat(single[None].astype(float), n, 0)
        pick = np.flatnonzero(listed)
        pu = x.pu[pick]
        for p, s, e in part_slices(x.words, n_parts):
            a = answers[p]
            count[s:e] = unpacked(a["a"])
            tables[:, s:e] = unpacked(a["b"]).reshape(n, -1)
            context_tables[:, s:e] = unpacked(a["c"]).reshape(n, -1)
            i, j = np.searchsorted(pu, [s, e]).tolist()
            c[pick[i:j]] = unpacked(a["d"])
            t[:, pick[i:j]] = unpacked(a["e"]).reshape(n, -1)
        p = np.zeros(len(c))
        for k in range(n):
            parent = parent_of(count, tables[k], totals["every"][k], totals["n_words"], totals["d0"])
            p += predictive(c, t[k], count[x.pu], context_tables[k][x.pu], parent[x.pw], totals["d1"], totals["theta"][k])
        logs = np.log10(p / n)[x.pair]
        seen = count[x.token]
        base = np.log10((seen + 0.1) / totals["divisor"])
        lead = np.cumsum(x.n) - x.n  # every text has a token: its end
        known = seen > 0
        sums = [np.add.reduceat(v, lead) for v in (known.astype(np.int64), base, logs, np.where(known, logs, 0.0))]
        ids = pa.array(x.ids, mask=x.ids == NO_ID)
        columns = [ids, pa.array(x.held), pa.array(x.n), pa.array(sums[0]), pa.array(np.full(len(ids), totals["tokens"])), *map(pa.array, sums[1:]), pa.array(10.0 ** (-sums[2] / x.n))]
        out.append(pa.table(columns, schema=OUT))
    return pa.concat_tables(out) if out else table_of(OUT, [])


def discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _count_sums(batches):
    """Per state: training tokens, words, pairs with one customer and with two."""
    for b in batches:
        for r in b.to_pylist():
            c, pc = unpacked(r["c"]), unpacked(r["pc"])
            row = (c.sum(), (c > 0).sum(), unpacked(r["sw"]).sum() + (pc == 1).sum(), (pc == 2).sum())
            yield pa.record_batch([pa.array([int(v)], pa.int64()) for v in row], names=["tokens", "words", "ones", "twos"])


def score_documents(docs: DataFrame, folds: int = FOLDS, burn_in: int = BURN_IN, samples: int = SAMPLES, sweeps: int = SWEEPS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, known_score, perplexity.

    Learns from documents that are not held out (crc32(doc_id as text) mod folds is 0), scores all.  A null text is
    empty: its end is its one token.  A null doc_id is not held out.  With no training token every probability is the
    base measure's.  Rows may repeat; other columns are ignored.  A word that training has not is the event "new word",
    in score as in base_score; known_score is the part of score that known tokens have, perplexity 10**(-score /
    n_tokens).  Words are told apart by 64-bit hashes, inside a pair by 48 bits.
    """
    spark = docs.sparkSession
    total = text_bytes(docs)
    n_parts = max(4, -(-total // PART_BYTES))
    bits = fingerprint_bits(total)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-total // BLOCK), 4096))
    texts = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(text, '') as text")
    blocks = bucketed(texts.mapInArrow(_pack_blocks, "block long, ids binary, sizes binary, texts binary"), "block", n, "texts")
    asked = blocks.mapInArrow(lambda b: _fingerprints(b, n_parts, bits, folds), ASKED_SQL)
    classes = scratch(asked.groupBy("part").applyInArrow(_classed, REPLY_SQL), "classes")
    by_block = blocks.groupBy("block")
    listing = by_block.cogroup(classes.groupBy("block")).applyInArrow(lambda t, r: _listing(t, r, n_parts, folds), MESSAGE_SQL)
    state = bucketed(listing.groupBy("part").applyInArrow(_state, STATE_SQL), "part", n, "state")
    sums = state.select("c", "sw", "pc").mapInArrow(_count_sums, "tokens long, words long, ones long, twos long").groupBy().sum().first()
    tokens, n_words, ones, twos = (int(v or 0) for v in sums)

    def collected(mail: DataFrame, k: int) -> list[float]:
        rows = mail.where(f"kind = {OWN}").agg(*(F.coalesce(F.sum(F.col("stat")[i]), F.lit(0.0)) for i in range(k))).first()
        return list(rows)

    def reseat(now: dict, seed: int):
        return lambda s, m: _reseat(s, m, n_parts, now, seed, sweeps)

    first = state.select("part", "wl", "pj", "pc").mapInArrow(lambda b: _first_tables(b, n_parts), MAIL_SQL)
    words = scratch(state.select("part", "words", "sw").groupBy("part").cogroup(first.groupBy("key")).applyInArrow(_word_tables, MAIL_SQL), "tables")
    routes = words.where(f"kind = {ROUTE}")
    every, own_ones, own_twos = collected(words, 3)
    totals = {"d1": discount(ones, twos), "d0": discount(own_ones, own_twos), "every": every, "theta": THETA}
    rng = np.random.Generator(np.random.Philox(2))
    seats, found, told = None, None, {"theta": [], "every": []}
    for k in range(burn_in + samples):
        mail = words.where(f"kind = {SENT}")
        mail = mail if seats is None else mail.unionByName(seats.where(f"kind = {OWN}"))
        dealt = state.select("part", "c", "su", "deg", "wl", "pj", "pc").groupBy("part").cogroup(mail.groupBy("key"))
        now = dict(totals)
        seats = scratch(dealt.applyInArrow(reseat(now, k), MAIL_SQL), "seats")
        back = routes.unionByName(seats.where(f"kind = {SENT}"))
        words = scratch(state.select("part", "sw").groupBy("part").cogroup(back.groupBy("key")).applyInArrow(_word_tables, MAIL_SQL), "tables")
        totals["every"] = collected(words, 1)[0]
        totals["theta"] = next_strength(*collected(seats, 2), rng)
        if k >= burn_in:
            told["theta"].append(now["theta"])
            told["every"].append(totals["every"])
            sample = [x.where(f"kind = {OWN}").select("key", F.lit(k - burn_in).alias("peer"), F.lit(kind).alias("kind"), "a") for x, kind in ((seats, OWN), (words, SENT))]
            both = sample[0].unionByName(sample[1])
            found = both if found is None else found.unionByName(both)
    told |= {"d1": totals["d1"], "d0": totals["d0"], "n_words": n_words, "tokens": tokens, "divisor": tokens + 0.1 * (n_words + 1)}
    replies = state.select("part", "c", "su", "deg", "pj", "pc", "blocks", "aw", "ap").groupBy("part").cogroup(found.groupBy("key"))
    replies = replies.applyInArrow(lambda s, m: _answer(s, m, samples), REPLY_SQL).unionByName(classes)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(lambda t, r: _told(t, r, n_parts, folds, told), OUT_SQL)


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
