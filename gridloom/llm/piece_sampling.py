"""SentencePiece encoding and decoding with Gumbel top-k sampling without replacement.

A text is a lattice of pieces; a piece's weight is ALPHA times minus the log of its rank, and backward sums make every
lattice node a distribution over the pieces that leave it.  Perturbed A-star search: an open entry stands for a set of
segmentations, and its value is the largest Gumbel-perturbed log probability in that set.  The best entry is opened
first.  The maximum of a set and the place where it is taken are independent, so opening an entry draws the place:
the node where the segmentation leaves its parent's path (in proportion to the probability that leaves there), the
piece taken there, then one piece a node to the text's end.  What is left of the parent's set, and what leaves the new
path, go back on the queue with values that are Gumbel noise cut at the opened value.  The first k entries opened are k
distinct segmentations, drawn without replacement in proportion to their probability.  With the next open value as
threshold kappa, 1 - exp(-exp(log p - kappa)) is the inclusion score of a sample.  All noise is a hash of the row key,
sample, word and step.

No piece crosses the start of a word, so lattices are built per distinct word and remembered (bounded); the words of
many texts are walked at once, step by step, and long texts in stretches of a fixed number of words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from gridloom.llm.common import mix, release, spread_documents

SPACE = "▁"
ALPHA = 1.0
SAMPLES = 2
SEED = 9
WORDS_AT_ONCE, STRETCH = 1 << 15, 1 << 13
#: Lattice nodes that are remembered, and characters whose lattices and paths are held at once.
NODES, CHARS_AT_ONCE = 1 << 19, 1 << 18
END = -1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, rank, kind) by id from a SentencePiece model file; kind 0 text, 1 byte, 2 control."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), -float(sp.get_score(i)), 1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0) for i in range(sp.get_piece_size())]


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def decode(ids, pieces: list[tuple[str, float, int]]) -> bytes:
    """Text of ids as UTF-8: byte pieces are bytes, the word mark is a space, the first one is dropped."""
    return decoder(pieces)(ids)


def decoder(pieces):
    table = np.array([bytes([int(p[3:-1], 16)]) if kind == 1 else b"" if kind == 2 else p.replace(SPACE, " ").encode() for p, _, kind in pieces], object)
    return lambda ids: b"".join(table[np.asarray(ids, np.int64)].tolist())[1:]


#: Stands for a word mark that the text itself holds; a lone surrogate is in no text.
OWN_MARK = "\udfff"


def units_of(text: str) -> list[str]:
    """Words of a text that no piece crosses the start of, as keys: `w` is a word with one mark ahead, "\n" + `w` one
    without, anything with a mark in it (runs of spaces) or a line break alone is itself."""
    out: list[str] = []
    if not text:
        return out
    for k, line in enumerate(text.replace(SPACE, OWN_MARK).split("\n")):
        if k:
            out.append("\n")
        parts = line.split(" ")
        if "" in parts:
            for u in UNIT.findall((SPACE if k == 0 else "") + line.replace(" ", SPACE)):
                out.append("\n" + u if u[0] != SPACE else u if len(u) == 1 or SPACE in u[1:] else u[1:])
        else:
            if k:
                parts[0] = "\n" + parts[0]
            out += parts
    return out


def spelled_out(key: str) -> str:
    return key if SPACE in key or key == "\n" else key[1:] if key[0] == "\n" else SPACE + key


class Lattices:
    """Lattices of words, end to end: node n has the edges first[n] to first[n + 1], likely ones first, each with child,
    log probability given the node, the sum of probabilities up to it, and a place in the pool of id sequences.  New words are added many at once: one walk of the
    vocabulary's trie from all their characters together, then backward sums by distance from the word's end."""

    def __init__(self, pieces: list[tuple[str, float, int]], alpha: float = ALPHA):
        kept = [(p, i, -alpha * math.log(rank + 2)) for i, (p, rank, kind) in enumerate(pieces) if kind == 0 and p and SPACE not in p.lstrip(SPACE)]
        self.byte = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.byte_score = -alpha * math.log(len(pieces) + 2)
        self.chars = np.unique(np.frombuffer("".join(p for p, _, _ in kept).encode("utf-32-le"), np.uint32))
        place = {chr(c): k for k, c in enumerate(self.chars.tolist())}
        n, step = len(self.chars), {}
        ends = {}
        for p, i, score in kept:
            at = 0
            for c in p:
                at = step.setdefault(at * n + place[c], len(step) + 1)
            ends[at] = (i, score)
        keys = np.array(list(step), np.int64)
        after = np.array(list(step.values()), np.int32)
        # the trie's steps as a hash table with open addressing: at a key's place or at one of the next `tries`
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.next = np.full((1 << self.bits) + 64, -1, np.int64), np.zeros((1 << self.bits) + 64, np.int32)
        slot, self.tries = self.slot(keys), 0
        left = np.arange(len(keys))
        while len(left):
            at = slot[left] + self.tries
            free, one = np.unique(at, return_index=True)
            one = one[self.keys[free] < 0]
            self.keys[at[one]], self.next[at[one]] = keys[left[one]], after[left[one]]
            left = np.delete(left, one)
            self.tries += 1
            if self.tries >= 64:
                raise ValueError("the trie's hash table is too full")
        self.piece, self.score = np.full(len(step) + 1, -1, np.int64), np.zeros(len(step) + 1)
        for at, (i, score) in ends.items():
            self.piece[at], self.score[at] = i, score
        self.begin = np.full(n + 1, -1, np.int64)  # states after one character; the last place is for unknown ones
        self.begin[keys[keys < n]] = after[keys < n]
        self.inner = np.zeros(len(step) + 1, bool)  # states with a way on
        self.inner[keys // n] = True
        self.n_pieces = len(pieces)
        # pool of id sequences: every piece alone, then the byte sequences of characters without a piece
        self.id_at, self.ids, self.spelled = list(range(len(pieces) + 1)), list(range(len(pieces))), {}
        self.pool = None
        self.clear()

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * GOLDEN) >> np.uint64(64 - self.bits)).astype(np.int64)

    def steps(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys that the trie has, and their next states."""
        at = self.slot(keys)
        ok = self.keys[at] == keys
        out = np.where(ok, self.next[at], 0)
        left = np.flatnonzero(~ok)
        for _ in range(1, self.tries):
            at_left = at[left] = at[left] + 1
            have = self.keys[at_left]
            hit = have == keys[left]
            out[left[hit]] = self.next[at_left[hit]]
            left = left[~hit & (have >= 0)]
            if not len(left):
                break
        places = np.flatnonzero(out)
        return places, out[places]

    def clear(self) -> None:
        self.root: dict[str, int] = {}
        self.n_nodes = self.n_edges = 0
        self.first = np.zeros(1, np.int64)
        self.child, self.seq, self.logp, self.cum = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0), np.zeros(0)

    def grow(self, nodes: int, edges: int) -> None:
        """Room for more nodes and edges; arrays double, so that adding words costs what the words do."""
        for room, names in ((self.n_nodes + nodes + 1, ("first",)), (self.n_edges + edges, ("child", "seq", "logp", "cum"))):
            for name in names:
                old = getattr(self, name)
                if room > len(old):
                    new = np.empty(max(room, min(2 * len(old), len(old) + (1 << 21))), old.dtype)
                    new[: len(old)] = old
                    setattr(self, name, new)

    def spell(self, code: int) -> int:
        """Place in the pool of the byte pieces of a character."""
        at = self.spelled.get(code)
        if at is None:
            c = chr(code)
            self.ids += [self.byte[b] for b in (SPACE if c == OWN_MARK else c).encode()]
            self.id_at.append(len(self.ids))
            at = self.spelled[code] = len(self.id_at) - 2
            self.pool = None
        return at

    def of(self, units: list[str]) -> np.ndarray:
        """First nodes of words (keys); they stay until the next call."""
        try:
            coded = pa.array(units, pa.string()).dictionary_encode()
            words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        except UnicodeEncodeError:  # a mark of the text's own
            place: dict[str, int] = {}
            which = np.array([place.setdefault(u, len(place)) for u in units], np.int64)
            words = list(place)
        fresh = [u for u in words if u not in self.root]
        if fresh:
            if self.n_nodes > NODES:
                self.clear()
                fresh = words
            self.add(fresh)
        return np.fromiter(map(self.root.__getitem__, words), np.int64, len(words))[which]

    def add(self, keys: list[str]) -> None:
        units = list(map(spelled_out, keys))
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = np.repeat(np.cumsum(size), size)
        char = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        char = np.where(self.chars[char] == code, char, -1)
        n = len(code)
        start, state, reach = np.arange(n), np.zeros(n, np.int64), 0
        found = []
        count = np.zeros(n, np.int64)
        single = np.zeros(n, bool)
        while len(start):
            c = char[start + reach]
            if reach:
                ok, state = self.steps(np.where(c >= 0, state * len(self.chars) + c, -2))
                start = start[ok]
            else:
                state = self.begin[c]
                ok = np.flatnonzero(state >= 0)
                start, state = start[ok], state[ok]
            reach += 1
            whole = np.flatnonzero(self.piece[state] >= 0)
            if len(whole):
                s = start[whole]
                found.append((s, reach, self.piece[state[whole]], self.score[state[whole]]))
                count[s] += 1  # starts differ
                if reach == 1:
                    single[s] = True
            going = np.flatnonzero((start + reach < end[start]) & self.inner[state])
            start, state = start[going], state[going]
        bare = np.flatnonzero(~single)
        if len(bare):
            codes, which = np.unique(code[bare], return_inverse=True)
            spelled = np.array([self.spell(c) for c in codes.tolist()], np.int64)[which]
            sizes = np.diff(self.id_at)[spelled]
            found.insert(0, (bare, 1, spelled, self.byte_score * sizes))
            count[bare] += 1
        if self.pool is None:
            self.pool = (np.array(self.id_at, np.int64), np.array(self.ids, np.int32))
        first = np.r_[0, np.cumsum(count)]
        m = int(first[-1])
        self.grow(n, m)
        base, lead = self.n_nodes, self.n_edges
        seq, cum, logp = self.seq[lead : lead + m], self.cum[lead : lead + m], self.logp[lead : lead + m]
        target, score, place = np.empty(m, np.int64), np.empty(m), first[:-1].copy()
        for s, length, piece, worth in reversed(found):  # long pieces first: they are the likely ones
            at = place[s]
            seq[at], score[at], target[at] = piece, worth, s + length
            place[s] += 1
        start = np.repeat(np.arange(n), count)
        last = target == end[start]
        target[last] = n
        total = np.zeros(n + 1)
        left = end - np.arange(n)
        by_left = np.argsort(left.astype(np.int32), kind="stable")
        cuts = np.cumsum(np.bincount(left)).tolist()
        for s, e in zip(cuts[:-1], cuts[1:]):
            nodes = by_left[s:e]
            own = count[nodes]
            ahead = np.cumsum(own) - own
            edge = np.repeat(first[nodes] - ahead, own) + np.arange(int(ahead[-1] + own[-1]))
            v = score[edge] + total[target[edge]]
            most = np.maximum.reduceat(v, ahead)
            v -= np.repeat(most, own)
            total[nodes] = most + np.log(np.add.reduceat(np.exp(v), ahead))
        logp[:] = score + total[target] - total[start]
        p = np.exp(logp)
        run = np.cumsum(p)
        cum[:] = run - (run - p)[first[start]]
        cum[first[1:] - 1] = 2.0  # the last edge of a node takes what rounding leaves
        self.child[lead : lead + m] = np.where(last, END, target + base)
        self.first[base + 1 : base + n + 1] = first[1:] + lead
        self.n_nodes, self.n_edges = base + n, lead + m
        self.root.update(zip(keys, (np.cumsum(size) - size + base).tolist()))

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.first[: self.n_nodes + 1], self.child, self.logp, self.cum, self.seq, *self.pool


#: Log probability under which a path has no mass in doubles: nothing can leave it there.
NO_MASS = -745.0


def unit(h: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from hashes."""
    return (h >> np.uint64(12)).astype(np.float64) * 2.0**-52


def noise(key: int, counter: int) -> float:
    """A number in (0, 1) from a key and a place."""
    h = int.from_bytes(hashlib.blake2b(b"%d,%d" % (key, counter), digest_size=7).digest(), "little")
    return ((h >> 4) + 0.5) * 2.0**-52


class Path:
    """A segmentation of one text, from the node where it left its parent's path: `word` words are done, `offset` nodes of the next."""

    def __init__(self, key: int, value: float, word: int = 0, offset: int = 0, phi: float = 0.0, ids: np.ndarray | None = None):
        self.key, self.value, self.word, self.offset, self.phi = key, value, word, offset, phi
        self.chunks = [] if ids is None else [ids]
        self.n_ids = 0 if ids is None else len(ids)
        #: Nodes passed while the path still has mass: word, offset, edge within the node, log probability before and of the edge, ids before.
        self.heads: list[tuple[np.ndarray, ...]] = []
        self.gone: dict[int, list[int]] = {}  # by node passed: edges that other paths took
        self._rates: np.ndarray | None = None

    def ids(self) -> np.ndarray:
        return np.concatenate(self.chunks) if self.chunks else np.zeros(0, np.int32)

    def rates(self) -> np.ndarray:
        """Probability that leaves the path at each node passed, without what other paths took; asked for when the path is whole."""
        if self._rates is None:
            if len(self.heads) > 1:
                self.heads = [tuple(np.concatenate(x) for x in zip(*self.heads))]
            self._rates = -np.expm1(self.heads[0][4]) * np.exp(self.heads[0][3]) if self.heads else np.zeros(0)
        return self._rates

    def remainder(self, below: float, nth: int) -> float:
        """Value of the set of segmentations that leave this path: Gumbel noise at the log of its mass, cut at `below`."""
        mass = float(self.rates().sum())
        if mass <= 1e-300:
            return -math.inf
        wait = math.log(-math.log(noise(self.key, 2 * nth + 1))) - math.log(mass)
        return -float(np.logaddexp(-below, wait))


def walk(jobs: list[tuple[Path, np.ndarray]], lattices: Lattices) -> None:
    """Follows each path over the words (first nodes) of its stretch, one drawn edge a node."""
    root = np.concatenate([roots for _, roots in jobs])
    first, child, logp, cum, seq, id_at, ids = lattices.arrays()
    n = np.array([len(roots) for _, roots in jobs])
    node = root.copy()
    begin = np.cumsum(n) - n
    word = np.arange(len(node)) + np.repeat(np.array([p.word for p, _ in jobs]) - begin, n)
    node[begin] += np.array([p.offset for p, _ in jobs])
    key = mix(np.repeat(np.array([p.key for p, _ in jobs], np.uint64), n) ^ mix(word.astype(np.uint64)))
    live, count, steps, step = np.arange(len(node)), np.zeros(len(node), np.int64), [], np.zeros(1, np.uint64)
    while len(live):
        u = unit(mix(key[live] + step))
        here = node[live]
        edge = first[here]
        late = np.flatnonzero(u >= cum[edge])
        while len(late):
            edge[late] += 1
            late = late[u[late] >= cum[edge[late]]]
        steps.append((live, here, edge))
        step += GOLDEN
        count[live] += 1
        after = child[edge]
        on = np.flatnonzero(after != END)
        live = live[on]
        node[live] = after[on]
    at = np.cumsum(count) - count
    passed, stood = np.empty((2, int(count.sum())), np.int64)
    for k, (where, here, edge) in enumerate(steps):
        to = at[where] + k
        passed[to] = edge
        stood[to] = here
    own, piece = logp[passed], seq[passed].astype(np.int64)
    if int(piece.max()) < lattices.n_pieces:
        flat, lead = piece, None  # single pieces have their own number as place
    else:
        size = id_at[piece + 1] - id_at[piece]
        lead = np.cumsum(size) - size
        flat = ids[np.repeat(id_at[piece] - lead, size) + np.arange(int(size.sum()))]
    flat = flat.astype(np.int32)
    cuts = np.r_[at[begin], len(passed)].tolist()
    for k, (p, roots) in enumerate(jobs):
        s, e = cuts[k], cuts[k + 1]
        a, b = (s, e) if lead is None else (int(lead[s]), int(lead[e]) if e < len(lead) else len(flat))
        if p.phi > NO_MASS:
            before = p.phi + np.cumsum(own[s:e]) - own[s:e]
            m = int(np.searchsorted(-before, -NO_MASS))
            w = np.repeat(np.arange(begin[k], begin[k] + n[k]), count[begin[k] : begin[k] + n[k]])[:m]
            e0 = passed[s : s + m]
            nodes = stood[s : s + m]
            had = np.arange(m) if lead is None else lead[s : s + m] - a
            p.heads.append((word[w], nodes - root[w], e0 - first[nodes], before[:m], own[s : s + m], had + p.n_ids))
        p.chunks.append(flat[a:b])
        p.n_ids += b - a
        p.phi += float(own[s:e].sum())
        p.word += len(roots)
        p.offset = 0


def follow(paths: list[tuple[Path, np.ndarray]], lattices: Lattices) -> None:
    """Walks all paths to the ends of their texts, a bounded number of words at once."""
    jobs, load = [], 0
    for p, roots in paths:
        for at in range(p.word, len(roots), STRETCH):
            jobs.append((p, roots[at : at + STRETCH]))
            load += len(jobs[-1][1])
            if load >= WORDS_AT_ONCE or at + STRETCH < len(roots):  # the next stretch starts where this one ends
                walk(jobs, lattices)
                jobs, load = [], 0
    if jobs:
        walk(jobs, lattices)


def branch(parent: Path, roots: np.ndarray, lattices: Lattices, value: float, key: int) -> Path:
    """The beginning of the best path in the parent's remaining set: it leaves at a drawn node by a drawn edge."""
    run = np.cumsum(parent.rates())
    i = int(np.searchsorted(run, noise(key, 0) * run[-1], side="right"))
    word, offset, chosen, before, _, had = (x[i] for x in parent.heads[0])
    word = int(word)
    node = int(roots[word]) + int(offset)
    first, child, logp, _, seq, id_at, ids = lattices.arrays()
    s, e = int(first[node]), int(first[node + 1])
    p = np.exp(logp[s:e])
    taken = parent.gone.setdefault(i, [])
    p[[int(chosen), *taken]] = 0.0
    run = np.cumsum(p)
    x = int(np.searchsorted(run, noise(key, 2) * run[-1], side="right"))
    taken.append(x)
    own = float(logp[s + x])
    # the rest of the node's mass; exactly none if no edge is left
    parent.rates()[i] = 0.0 if len(taken) + 1 == e - s else max(0.0, parent.rates()[i] - math.exp(before + own))
    after, q = int(child[s + x]), int(seq[s + x])
    place = (word + 1, 0) if after == END else (word, after - node + int(offset))
    head = np.concatenate([parent.ids()[: int(had)], ids[id_at[q] : id_at[q + 1]]])
    return Path(key, value, *place, float(before) + own, head)


def sample(texts: list[tuple[bytes, str]], lattices: Lattices, k: int = SAMPLES, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per (row key, text): up to k distinct segmentations as (ids, log probability, value, inclusion score), best first."""
    units = [units_of(t) for _, t in texts]
    every = lattices.of(list(chain.from_iterable(units)))
    roots = np.split(every, np.cumsum([len(words) for words in units])[:-1])
    seeds = [int.from_bytes(hashlib.blake2b(b"%d:" % seed + key, digest_size=8).digest(), "little") for key, _ in texts]
    now: list[Path | None] = [Path(s, -math.log(-math.log(noise(s, 1)))) for s in seeds]
    open_: list[list[tuple[float, Path]]] = [[] for _ in texts]
    done: list[list[Path]] = [[] for _ in texts]
    for nth in range(k):
        follow([(p, r) for p, r in zip(now, roots) if p is not None], lattices)
        for t, p in enumerate(now):
            if p is None:
                continue
            done[t].append(p)
            queue = open_[t]
            queue.append((p.remainder(p.value, 1), p))
            now[t] = None
            best = max(range(len(queue)), key=lambda j: queue[j][0])
            value, parent = queue[best]
            if nth + 1 < k and value > -math.inf:
                now[t] = branch(parent, roots[t], lattices, value, (seeds[t] + (nth + 1) * int(GOLDEN)) % (1 << 64))
                queue[best] = (parent.remainder(value, nth + 2), parent)
    out = []
    for paths, queue in zip(done, open_):
        kappa = max(v for v, _ in queue)
        out.append([(p.ids(), p.phi, p.value, -math.expm1(-math.exp(min(p.phi - kappa, 700.0)))) for p in paths])
    return out


def stretches(b: pa.RecordBatch) -> Iterator[list[tuple[int | None, str]]]:
    """All rows of a batch as (doc_id, text, empty if null), in lists that end where they reach CHARS_AT_ONCE."""
    batch, load = [], 0
    for d, t in zip(b.column("doc_id"), b.column("text")):
        batch.append((d.as_py(), t.as_py() or ""))
        load += len(batch[-1][1])
        if load >= CHARS_AT_ONCE:
            yield batch
            batch, load = [], 0
    if batch:
        yield batch


def sample_segmentations(docs: DataFrame, model_path: str | None = None, k: int = SAMPLES, seed: int = SEED, digest: bool = False) -> DataFrame:
    """Rows (doc_id, sample, n_pieces, log_prob, value, inclusion, round_trip) and ids, or ids_sha256 if digest.

    Every text gives min(k, number of its segmentations) distinct samples, numbered from 1 in the order of their
    values; a null or empty text has one, without pieces.  The noise depends on doc_id (on the text if that is null),
    so rows that repeat an id and text repeat their samples.  round_trip: decoding gives the text back.  Other columns
    are ignored.  The model is read on the driver; its pieces (of bounded number) are broadcast.
    """
    pieces = load_pieces(model_path or default_model())
    if len(pieces) > 1 << 20:
        raise ValueError("a vocabulary of more than 2**20 pieces is not broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    last = ("ids_sha256", pa.string()) if digest else ("ids", pa.list_(pa.int32()))
    names = ["doc_id", "sample", "n_pieces", "log_prob", "value", "inclusion", "round_trip", last[0]]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), last[1]]

    def run(batches):
        release()
        lattices, text_of = Lattices(shared.value), decoder(shared.value)
        for b in batches:
            for batch in stretches(b):
                got = sample([((t.encode() if d is None else b"%d" % d), t) for d, t in batch], lattices, k, seed)
                out = []
                for (d, t), paths in zip(batch, got):
                    raw = t.encode()
                    for nth, (ids, phi, value, inclusion) in enumerate(paths):
                        told = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest() if digest else ids
                        out.append((d, nth + 1, len(ids), phi, value, inclusion, text_of(ids) == raw, told))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(types)], names=names)

    schema = "doc_id long, sample int, n_pieces long, log_prob double, value double, inclusion double, round_trip boolean, " + ("ids_sha256 string" if digest else "ids array<int>")
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def decode_segmentations(rows: DataFrame, model_path: str | None = None, column: str = "ids") -> DataFrame:
    """Adds decoded (the text) to rows with a column of ids; a null list gives null, an empty one the empty text.

    Byte pieces that make no valid UTF-8 become replacement characters.  An id outside the vocabulary is an error.  A
    column named decoded is replaced; all others stay as they are, repeated rows too.
    """
    shared = rows.sparkSession.sparkContext.broadcast(load_pieces(model_path or default_model()))
    kept = rows.drop("decoded")

    def run(batches):
        text_of = decoder(shared.value)
        n = len(shared.value)
        for b in batches:
            told = []
            for ids in b.column(b.schema.get_field_index(column)).to_pylist():
                if ids and not 0 <= min(ids) <= max(ids) < n:
                    raise ValueError(f"an id outside the vocabulary of {n}")
                told.append(None if ids is None else text_of(ids).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(told, pa.string())], names=[*b.schema.names, "decoded"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", StringType())]))


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_segmentations(spread_documents(spark, sf_dir), digest=True)
