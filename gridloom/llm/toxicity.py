"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows around what it catches.

The lexicon is learned from labelled rows: words, and stems (word beginnings), that toxic documents have far more
often.  It sits in a trie.  A word of a text is looked up exactly, as a word that begins with a stem, and, through the
intersection of its Levenshtein automaton with the trie, as a misspelt lexicon word.  Each hit is weighted by its
context window: quotation marks around it and verbs of reporting point to quotation, words of address to abuse.  A
logistic model over the sums gives the score.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm.common import bounded_broadcast_bytes, scratch, spread_documents

#: Labelled rows used for fitting, the first by a hash of doc_id: the documented bound of the sample.
SAMPLE_ROWS = 8000
#: Share of the toxic rows in which an entry occurs at least.
LEAST_SHARE = 0.015
STEMS = range(4, 9)
WINDOW = 8
WORD = re.compile(r"[^\W_]+")
#: Words of reporting and of address in the four languages of the corpus, and quotation marks.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes reported claimed word term sagte schrieb nannte zitierte wort dit écrit appelé mot citation dijo escribió llamó palabra cita".split())
ADDRESS = frozenset("you your yours yourself du dich dein ihr euch tu toi vous votre ton te usted tú vosotros".split())
QUOTES = "\"“”„«»‚‘’"
#: A mark between two letters is an apostrophe; an opening one has a word after it only, a closing one a word before it.
OPENING = re.compile(rf"(?<!\w)[{QUOTES}](?=\w)")
CLOSING = re.compile(rf"(?<=[\w.,;!?…])[{QUOTES}](?!\w)")


class Levenshtein:
    """Automaton of the words within `most` edits of a word.

    A state is a first row of the edit matrix and, from it, the rows within `most`.  Moves depend on those, on which of
    the next letters of the word are the read one, and on the rows left, so they are shared by all words.
    """

    moves: dict[tuple, tuple] = {}

    def __init__(self, word: str, most: int):
        self.size, self.most, self.width = len(word), most, 2 * most + 2
        self.places: dict[str, int] = {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def start(self) -> tuple:
        return 0, tuple((i, i) for i in range(min(self.most, self.size) + 1))

    def step(self, state: tuple, c: str) -> tuple:
        first, rows = state
        key = rows, (self.places.get(c, 0) >> first) & ((1 << self.width) - 1), min(self.size - first, self.width), self.most
        move = self.moves.get(key)
        if move is None:
            move = self.moves[key] = self.moved(*key)
        return first + move[0], move[1]

    @staticmethod
    def moved(rows: tuple, same: int, left: int, most: int) -> tuple:
        new: list[tuple[int, int]] = []
        if rows and rows[0][1] < most:
            new.append((0, rows[0][1] + 1))
        known = dict(rows)
        for i, v in rows:
            if i == left:
                break
            v += not same >> i & 1
            if new and new[-1][0] == i:
                v = min(v, new[-1][1] + 1)
            if i + 1 in known:
                v = min(v, known[i + 1] + 1)
            if v <= most:
                new.append((i + 1, v))
        return (new[0][0], tuple((i - new[0][0], v) for i, v in new)) if new else (0, ())

    def distance(self, state: tuple) -> int | None:
        """Edits between the word and what was read, None if they are too many."""
        first, rows = state
        return rows[-1][1] if rows and first + rows[-1][0] == self.size else None

    def nearest_beginning(self, state: tuple) -> int | None:
        """Least edits between a beginning of the word, not all of it, and what was read."""
        first, rows = state
        return min((v for i, v in rows if first + i < self.size), default=None)


class Lexicon:
    """Trie of weighted entries: whole words and stems."""

    memory = 1 << 18

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.words = {t: w for t, stem, w in entries if not stem}
        self.stems = {t: w for t, stem, w in entries if stem}
        self.stem_sizes = sorted({len(t) for t in self.stems})
        self.root: dict = {}
        # With `most` edits one of most + 1 pieces of a term is whole, shifted by `most` at the most: only words that
        # have such a piece, about the length and about the letters of the term meet the automaton.  The end of a stem
        # can be anywhere in a word, and the word may have any other letters.
        self.pieces: dict[tuple[int, int], dict[str, list]] = {}
        for t, stem in [(t, False) for t in self.words] + [(t, True) for t in self.stems]:
            most = self.edits(len(t))
            if not most:
                continue
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node["_" if stem else ""] = t  # no word has this letter
            cut = [round(len(t) * k / (most + 1)) for k in range(most + 2)]
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                for at in [0] if k == 0 else [a - len(t)] if k == most and not stem else range(a - most, a + most + 1):
                    self.pieces.setdefault((at, b - a), {}).setdefault(t[a:b], []).append((len(t), frozenset(t), most, stem))
        self.seen: dict[str, tuple | None] = {}

    @staticmethod
    def edits(n: int) -> int:
        return 0 if n < 5 else 1 if n < 8 else 2

    def intersect(self, word: str) -> tuple[str, int, float] | None:
        """Nearest lexicon word, or stem of a beginning, within its number of edits, and its weight: a walk of trie and automaton together."""
        most = self.edits(len(word) + 2)
        if not most:
            return None
        automaton, best = Levenshtein(word, most), None
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for c, child in node.items():
                if c == "" or c == "_":
                    d = automaton.nearest_beginning(state) if c else automaton.distance(state)
                    if d is None:
                        continue
                    weight = (self.stems if c else self.words)[child]
                    if d <= self.edits(len(child)) and (best is None or (d, child, -weight) < (best[1], best[0], -best[2])):
                        best = (child, d, weight)
                else:
                    after = automaton.step(state, c)
                    if after[1]:
                        stack.append((child, after))
        return best

    def find(self, word: str) -> tuple[float, int] | None:
        """(weight, kind) of a word: kind 0 exact, 1 stem, 2 misspelt; None if nothing matches."""
        hit = self.seen.get(word, 0)
        if hit != 0:
            return hit
        if len(self.seen) >= self.memory:
            self.seen.clear()
        self.seen[word] = hit = self._find(word)
        return hit

    def _find(self, word: str) -> tuple[float, int] | None:
        if word in self.words:
            return self.words[word], 0
        own = [self.stems[word[:n]] for n in self.stem_sizes if len(word) > n and word[:n] in self.stems]
        if own:
            return max(own), 1
        n, letters = len(word), None
        for (at, size), pieces in self.pieces.items():
            at += n if at < 0 else 0
            for length, term, most, stem in pieces.get(word[at : at + size], ()) if at >= 0 else ():
                if n > length - most if stem else abs(length - n) <= most:
                    letters = letters or frozenset(word)
                    if len(term - letters) <= most if stem else len(letters ^ term) <= 2 * most:
                        near = self.intersect(word)
                        if near:
                            return near[2] / (1 + near[1]), 2
                        return None
        return None


def features(text: str, lexicon: Lexicon) -> list[float]:
    low = text.lower()
    hits, n, kinds, abuse, quoted, top = 0, 0, [0.0, 0.0, 0.0], 0.0, 0.0, 0.0
    find, distinct = lexicon.find, set()
    words = WORD.findall(low)
    places = None
    for k, w in enumerate(words):
        hit = find(w)
        if hit is None:
            continue
        if places is None:
            places = [m.start() for m in WORD.finditer(low)]
        weight, kind = hit
        around = words[max(0, k - WINDOW) : k + WINDOW + 1]
        s, e = places[k], places[k] + len(w)
        before, after = max(0, s - 60), min(len(low), e + 60)
        marks = len(OPENING.findall(low, before, s + 1)) > len(CLOSING.findall(low, before, s)) and CLOSING.search(low, e - 1, after) is not None
        quotation = 0.6 * marks + 0.3 * any(x in REPORTING for x in around)
        address = 0.3 * any(x in ADDRESS for x in around)
        hits += 1
        distinct.add(w)
        kinds[kind] += 1
        abuse += weight * (1 - quotation + address)
        quoted += quotation > 0.3
        top = max(top, weight * (1 - quotation))
    n = max(1, len(words))
    return [
        math.log1p(abuse), top, math.log1p(len(distinct)), math.log1p(kinds[0]), math.log1p(kinds[1]),
        math.log1p(kinds[2]), quoted / max(1, hits), math.log1p(1000 * hits / (n + 50)), math.log1p(1000 * kinds[1] / (n + 50)), math.log(n + 1),
    ]


class Rows:
    """Rows (label, distinct words) that can be read again and again: their words stay packed, one row's at a time is open."""

    def __init__(self, packed: list[tuple[int, bytes]]):
        self.packed = packed

    @staticmethod
    def pack(words: set[str]) -> bytes:
        return zlib.compress(json.dumps(sorted(words)).encode(), 1)

    def __iter__(self) -> Iterator[tuple[int, list[str]]]:
        return ((label, json.loads(zlib.decompress(words))) for label, words in self.packed)


def one_of_each(rows: Iterable[tuple[int, list[str]]]) -> Iterator[tuple[bool, int, list[str]]]:
    """Rows, and whether each is no copy of an earlier one: copies share their least or their largest three word hashes.

    Otherwise any word of a text that was copied often would look like a word of its label.
    """
    seen = set()
    for label, words in rows:
        h = sorted(zlib.crc32(w.encode()) for w in words)
        marks = {("least", *h[:3]), ("largest", *h[-3:])}
        yield not marks & seen, label, words
        seen |= marks


def units_of(words: list[str]) -> set[tuple[str, bool]]:
    units = set()
    for w in words:
        if len(w) > 3:
            units.add((w, False))
        units.update((w[:n], True) for n in STEMS if len(w) > n)
    return units


def learn_lexicon(rows: Iterable[tuple[int, list[str]]]) -> list[tuple[str, bool, float]]:
    """Entries (term, is a stem, weight) from (label, distinct words): log odds of document frequencies, smoothed.

    The rows are read twice: toxic ones give the terms, clean ones are counted for those terms only.
    """
    counts = (Counter(), Counter())
    totals = [0, 0]
    kept = []
    for new, label, words in one_of_each(rows):
        kept.append(new)
        totals[label] += new
        if new and label:
            counts[1].update(units_of(words))
    if not totals[0] or not totals[1]:
        return []
    least = max(3, totals[1] * LEAST_SHARE)
    words_of: dict[str, int] = {}
    for (t, stem), a in counts[1].items():
        if not stem:
            for n in STEMS:
                if n < len(t):
                    words_of[t[:n]] = max(words_of.get(t[:n], 0), a)
    # a stem of one word: the word stands for it
    terms = {unit: a for unit, a in counts[1].items() if a >= least and not (unit[1] and words_of.get(unit[0], 0) > 0.8 * a)}
    for new, (label, words) in zip(kept, rows):
        if new and not label:
            counts[0].update(units_of(words) & terms.keys())
    found = []
    for unit, a in terms.items():
        weight = math.log((a + 0.1) / (totals[1] + 0.2)) - math.log((counts[0][unit] + 0.5) / (totals[0] + 1.0))
        if weight >= 1.5:
            found.append((weight * math.sqrt(a), unit, weight))
    found.sort(key=lambda x: (-x[0], x[1]))
    stems = {t: w for _, (t, stem), w in found if stem}
    covered = lambda t, w: any(stems.get(t[:n], 0) > w - 1 for n in STEMS if n < len(t))  # noqa: E731  a shorter stem says as much
    return [(t, stem, w) for _, (t, stem), w in found if not covered(t, w)]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the first is the intercept), means and scales, by Newton's method with an L2 penalty."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)  # a feature without variation gets no weight
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = np.diag([0.01] + [penalty] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w, mean, scale


def fold(doc_id, of: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(1))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> str:
    """Model as JSON from at most sample_rows labelled training rows (fold not 0); null labels or ids are skipped."""
    doc_id = F.col("doc_id").cast("long")
    rows = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = rows.where(fold(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample_rows)
    sample = scratch(docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id"), "toxic")

    def words_of(batches):
        for b in batches:
            words = [Rows.pack(set(WORD.findall(t.lower()))) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("toxic"), pa.array(words, pa.binary())], names=["toxic", "words"])

    got = sample.mapInArrow(words_of, "toxic int, words binary").toLocalIterator()
    entries = learn_lexicon(Rows([(r["toxic"], bytes(r["words"])) for r in got]))

    def measured(batches):
        lexicon = Lexicon(entries)
        for b in batches:
            x = [features(t, lexicon) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    data = sample.mapInArrow(measured, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in data], float)
    if not len(data) or y.min() == y.max():  # nothing to tell apart: the share of toxic rows, smoothed
        p = (y.sum() + 0.5) / (len(y) + 2)
        return json.dumps({"entries": entries, "w": [math.log(p / (1 - p))] + [0.0] * 10, "mean": [0.0] * 10, "scale": [1.0] * 10})
    w, mean, scale = logistic(np.array([r["x"] for r in data]), y)
    return json.dumps({"entries": entries, "w": w.tolist(), "mean": mean.tolist(), "scale": scale.tolist()})


def score_toxicity(docs: DataFrame, model: str, name: str = "score") -> DataFrame:
    """Adds a column `name` (0 to 1) to docs, whole texts; a column that already has that name is replaced by it.

    Null and empty texts get the model's score of no words.  Equal texts have equal scores, rows that repeat stay
    repeated, and an empty table stays empty.  All other columns pass through.
    """
    bounded_broadcast_bytes(len(model), 1 << 20, "toxicity model")

    def scored(batches):
        m = json.loads(model)
        lexicon = Lexicon([tuple(e) for e in m["entries"]])
        w, mean, scale = (np.array(m[k]) for k in ("w", "mean", "scale"))
        for b in batches:
            x = np.array([features(t or "", lexicon) for t in b.column("text").to_pylist()]).reshape(-1, len(mean))
            p = 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, name])

    kept = docs.drop(name)
    return kept.mapInArrow(scored, StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
