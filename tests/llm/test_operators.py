"""Operators against brute force, on a table with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import json
import math
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import common, decontamination, exact_dedup, jaccard_join, pii, piece_sampling, pitman_yor, sharding, suffix_dedup, toxicity, window_dedup
from gridloom.llm.common import connected, scratch

SCHEMA = "doc_id long, text string, source string, block long, part int, score double, run int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéö") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    other = " ".join(word() for _ in range(15))
    texts = []
    for k in range(50):
        words = [word() for _ in range(r.randint(1, 120))]
        if k % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if k % 7 == 0:
            words += other.split()
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[8] + " more", texts[8].replace(" ", "\n", 1).upper(), "", None, " \t\n", "x", "one two", "ONE two"]
    texts += ["For " * 400, "For " * 300 + "end", "aaaa" * 300, "\x1fodd\x85space kept", " ".join(word() for _ in range(4000)), passage, "a" * 49, "a" * 50]
    rows = [(k * 3 % 97, t, ("hot" if k % 3 else None) if k % 5 else f"s{k % 4}", k, k, 0.5, 1) for k, t in enumerate(texts)]
    rows.append((None, texts[0], None, 1, 1, 0.1, 1))
    rows.append((None, texts[0], None, 1, 1, 0.1, 1))
    rows.append((rows[5][0], texts[5], "hot", 1, 1, 0.1, 1))  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def both(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_suffix_dedup(docs, none):
    firsts: dict[bytes, int] = {}
    rows = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    for i, b in rows:
        for p in range(len(b) - 49 if i is not None else 0):
            firsts[b[p : p + 50]] = min(i, firsts.get(b[p : p + 50], i))
    want = Counter()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49 if i is not None else 0):
            if firsts[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[(i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert both(suffix_dedup.dedup_substrings(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_merged_transforms():
    r = random.Random(1)
    strings = sorted({"".join(r.choice("ab") for _ in range(r.randint(6, 30))).encode() for _ in range(60)})
    firsts = np.array([r.randint(0, 99) for _ in strings])
    got, offset = suffix_dedup.earliest(strings, firsts, 6, 4)
    want = {}
    for s, f in zip(strings, firsts.tolist()):
        for p in range(len(s) - 5):
            want[s[p : p + 6]] = min(f, want.get(s[p : p + 6], f))
    for k, s in enumerate(strings):
        assert got[offset[k] : offset[k + 1]].tolist() == [want[s[p : p + 6]] for p in range(len(s) - 5)]
    codes = [np.frombuffer(s + b"\xff", np.uint8) + np.uint8(1) for s in strings]
    ends = np.cumsum([len(c) for c in codes])
    joined = np.concatenate(codes)
    left = np.repeat(ends, [len(c) for c in codes]) - np.arange(len(joined))
    order = suffix_dedup.suffix_order(joined, left)
    tails = [bytes(joined[i : i + left[i] - 1]) for i in order]
    assert tails == sorted(tails)


def test_window_dedup(docs, none):
    rows = [(i, WORD.findall(t or "")) for i, t, *_ in corpus()]
    first: dict[tuple, int] = {}
    for i, w in rows:
        for p in range(len(w) - 12 if i is not None else 0):
            first[tuple(w[p : p + 13])] = min(i, first.get(tuple(w[p : p + 13]), i))
    want = Counter()
    for i, w in rows:
        gone = set()
        for p in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert both(window_dedup.dedup_windows(docs), *columns) == want
    assert window_dedup.dedup_windows(none).count() == 0


def test_windows_of_words_that_collide(spark, monkeypatch):
    """Words whose first hashes are equal are told apart; ids may be as far apart as longs can."""
    class Colliding(type(window_dedup._memo)):
        def __missing__(self, word):
            return super().__missing__(b"same" if word in (b"left", b"right") else word)

    line = [f"w{k}" for k in range(12)]
    texts = [" ".join(line + [last]) for last in ("left", "right", "left")]
    ids = [-(2**63), 5, 2**63 - 2]
    monkeypatch.setattr(window_dedup, "_memo", Colliding())
    block = window_dedup.Block(window_dedup.pa.table({"doc_id": ids, "text": texts}))
    _, group, keys, _, _ = block.windows(None)
    assert len(keys) == 2 and len(set(keys.tolist())) == 1 and sorted(np.bincount(group)) == [1, 2]
    monkeypatch.undo()
    got = window_dedup.dedup_windows(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {ids[0]: 0, ids[1]: 0, ids[2]: 13}


def test_window_log_grows(docs):
    old, new = docs.where("doc_id < 40"), docs.where("doc_id >= 40")
    half = window_dedup.window_log(old.where("doc_id < 20"), 4)
    log = window_dedup.window_log(old.where("doc_id >= 20"), 4, log=half)
    columns = ("doc_id", "n_removed", "kept_sha256")
    at_once = both(window_dedup.dedup_windows(docs.where("doc_id is not null")).where("doc_id >= 40"), *columns)
    assert both(window_dedup.dedup_windows(new, log=log, n_parts=4), *columns) == at_once


def test_run_log_compacts():
    log, r = window_dedup.RunLog(), np.random.default_rng(0)
    seen: dict[int, int] = {}
    for batch in range(9):
        keys = np.unique(r.integers(0, 500, 60)).astype(np.uint64)
        found = log.lookup(keys, keys.astype(np.uint32))
        assert found.tolist() == [seen.get(int(k), window_dedup.NO_ID) for k in keys]
        log.append((keys, keys.astype(np.uint32), np.full(len(keys), batch)))
        for k in keys.tolist():
            seen.setdefault(int(k), batch)
    assert len(log.runs) <= 5
    same = np.array([7, 7], np.uint64)
    log.append((same, np.array([1, 2], np.uint32), np.array([3, 4])))
    assert log.lookup(same, np.array([2, 9], np.uint32)).tolist()[0] == 4


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, none, keep):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[t or ""].append(i)
    want, n_kept = Counter(), 0
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        for i in ids:
            want[(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup.exact_dedup(docs, keep, bits=1).cache()
    assert both(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_is_native(docs):
    told = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", told)
    assert re.search(r"SortAggregate\(key=\[run#\d+, digest#", told)  # runs are merged in order


def brute_components(rows, percent=85):
    sets = []
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        sets.append((i, {tuple(w[p : p + 4]) for p in range(len(w) - 3)} or ({tuple(w)} if w else set())))
    root = {i: i for i, _ in sets if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((top(i), top(j)))
                root[hi] = lo
    linked = lambda a, b: None not in (a[0], b[0]) and a[1] and b[1] and 100 * len(a[1] & b[1]) >= percent * len(a[1] | b[1])
    return Counter((i, len(s), None if i is None else top(i), sum(bool(linked((i, s), other)) for b, other in enumerate(sets) if b != a)) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("group", [jaccard_join.GROUP_SHINGLES, 150])
def test_jaccard_components(docs, none, group):
    want = brute_components([(i, t) for i, t, *_ in corpus()])
    assert both(jaccard_join.jaccard_components(docs, group_shingles=group), "doc_id", "n_shingles", "component_id", "n_links") == want
    spanning = both(jaccard_join.jaccard_components(docs, group_shingles=group, count_links=False), "doc_id", "n_shingles", "component_id")
    assert spanning == Counter(key[:3] for key in want.elements())
    assert jaccard_join.jaccard_components(none).count() == 0


def test_divide_skip_against_all_pairs():
    r = np.random.default_rng(2)
    base = [np.unique(r.integers(0, 10**6, n)) for n in (5, 40, 80, 80)]
    sets = []
    for b in base:
        for _ in range(12):
            s = set(b.tolist())
            for x in r.permutation(b)[: r.integers(0, max(1, len(b) // 6))].tolist():
                s.discard(x)
            s |= set(r.integers(0, 10**6, r.integers(0, 5)).tolist())
            sets.append(np.array(sorted(s), np.uint64))
    sets = [np.frombuffer(x, np.uint64) for x in {s.tobytes() for s in sets}]
    n = len(sets)

    def classes(pairs):
        root = list(range(n))
        def top(i):
            while root[i] != i:
                i = root[i]
            return i
        for i, j in pairs:
            root[top(i)] = top(j)
        return {frozenset(k for k in range(n) if top(k) == top(i)) for i in range(n)}

    links = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert links and classes(jaccard_join.divide_skip(sets)[0]) == classes(links)
    weight, side = np.arange(1, n + 1), np.arange(n) % 2
    for sides in (None, side):
        kept = [(i, j) for i, j in links if sides is None or side[i] != side[j]]
        want = np.zeros(n, np.int64)
        for i, j in kept:
            want[i] += weight[j]
            want[j] += weight[i]
        for probe in (0, 10000, 10**9):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(jaccard_join, "PROBE", probe)
                spanning, numbers = jaccard_join.divide_skip(sets, weight=weight, side=sides)
            assert classes(spanning) == classes(kept) and (numbers == want).all()


def test_chains_are_the_same_in_blocks():
    r = np.random.default_rng(5)
    key, size = r.integers(0, 6, 300).astype(np.uint64), r.integers(1, 400, 300)
    node = np.arange(300)

    def classes(*pairs):
        root = list(range(300))
        def top(i):
            while root[i] != i:
                i = root[i]
            return i
        for i, j in np.concatenate(pairs).tolist():
            root[top(i)] = top(j)
        return {frozenset(k for k in range(300) if top(k) == top(i)) for i in range(300)}

    for percent in (85, 99):
        at_once = jaccard_join.chains(key, node, size, size, percent)[-1]
        parts = [jaccard_join.chains(key[b::7], node[b::7], size[b::7], size[b::7], percent) for b in range(7)]
        last = jaccard_join.chains(*(np.concatenate([p[c] for p in parts]) for c in range(4)), percent)[-1]
        assert classes(at_once) == classes(last, *(p[-1] for p in parts))


def test_connected(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, 9), (9, 4), (4, 7), (7, 1), (5, 5)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in (1, 4, 7, 9)}}


def test_connected_has_small_plans(spark, monkeypatch):
    """The driver holds the plan of every job of a round: none reads its table more than six times."""
    scans = []

    def counted(df, tag):
        scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return scratch(df, tag)

    monkeypatch.setattr(common, "scratch", counted)
    connected(spark.createDataFrame([(1, 9), (9, 4), (4, 7), (20, 21)], "a long, b long"))
    assert len(scans) > 2 and max(scans) <= 6


def test_sharding(docs, none):
    rows = sharding.interleave(docs, 7, bucket_rows=4).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in corpus())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for source, total in Counter(r.source for r in rows).items():
        per = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(per[s] - total / 7) <= 2 for s in range(7)), source
    # by hand: ranks by source in the order of text digest and id digest, then all rows by fraction
    digest = lambda x: hashlib.md5(b"17:" + x).hexdigest()
    sources = defaultdict(list)
    for i, t, source, *_ in corpus():
        sources["" if source is None else "s" + source].append((digest((t or "").encode()), digest(b"" if i is None else str(i).encode()), -1 if i is None else i, zlib.crc32((t or "").encode())))
    line = sorted(((2 * k + 1) / (2.0 * len(of)), name, *row) for name, of in sources.items() for k, row in enumerate(sorted(of)))
    place = [k * 7 // len(line) for k in range(len(line))]
    want = Counter((row[-2] if row[-2] >= 0 else None, row[-1], place[k], k - place.index(place[k])) for k, row in enumerate(line))
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows) == want
    again = sharding.interleave(docs, 7, bucket_rows=64)
    assert {(r.doc_id, r.text_crc32, r.shard) for r in again.collect()} == {(r.doc_id, r.text_crc32, r.shard) for r in rows}
    assert sharding.interleave(none).count() == 0


def test_pitman_yor(docs, none):
    tokens = [(i, WORD.findall((t or "").encode().lower().decode()) + [None]) for i, t, *_ in corpus()]
    train = Counter(w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    got = defaultdict(list)
    for r in pitman_yor.score_documents(docs).collect():
        got[(r.doc_id, r.n_tokens)].append(r)
    base = model = 0.0
    for i, ws in tokens:
        r = got[(i, len(ws))][0]
        assert r.n_known == sum(train[w] > 0 for w in ws) and r.train_tokens == n
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
        base, model = base + r.base_score, model + r.score
    assert model > base  # on the whole the model fits better
    assert pitman_yor.score_documents(none).count() == 0


def test_pitman_yor_score_at_the_starting_seats(docs):
    """No sweeps: one table a dish, so every score can be computed by hand."""
    tokens = [(i, ["", *(t or "").encode().lower().split(), ""]) for i, t, *_ in corpus()]
    tokens = [(i, [w.decode() for w in map(lambda x: x if isinstance(x, bytes) else x.encode(), ws)]) for i, ws in tokens]
    train = [ws for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 10]
    pairs = Counter((u, w) for ws in train for u, w in zip(ws, ws[1:]))
    customers, tables_of, own = Counter(), Counter(u for u, _ in pairs), Counter(w for _, w in pairs)
    for (u, _), c in pairs.items():
        customers[u] += c
    ones, twos = (sum(c == k for c in pairs.values()) for k in (1, 2))
    d1 = pitman_yor.discount(ones, twos)
    d0 = pitman_yor.discount(*(sum(c == k for c in own.values()) for k in (1, 2)))
    every = len(pairs)

    def p(u, w):
        parent = (own[w] - d0 if own[w] else 1 + d0 * len(own)) / (1 + every)
        if not customers[u]:
            return parent
        return (max(0, pairs[u, w] - d1 * (pairs[u, w] > 0)) + (1 + d1 * tables_of[u]) * parent) / (1 + customers[u])

    want = Counter((i, round(sum(math.log10(p(u, w)) for u, w in zip(ws, ws[1:])), 6)) for i, ws in tokens)
    rows = pitman_yor.score_documents(docs, burn_in=0, samples=1, sweeps=0).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in rows) == want
    known = {(i, len(ws) - 1): sum(math.log10(p(u, w)) for u, w in zip(ws, ws[1:]) if own[w]) for i, ws in tokens}
    assert all(math.isclose(r.known_score, known[r.doc_id, r.n_tokens], abs_tol=1e-6) for r in rows)
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9) for r in rows)


def test_sweeps_keep_a_distribution_and_fit_better():
    r = random.Random(3)
    n_words, n_contexts = 40, 12
    c = np.array([min(2000, int(r.paretovariate(0.7))) if r.random() < 0.5 else 0 for _ in range(n_words * n_contexts)])
    u, j = np.divmod(np.flatnonzero(c), n_words)
    c = c[c > 0]
    t = np.ones(len(c), np.int64)
    s = pitman_yor.Seating(c, t, u, j, np.zeros(n_contexts), np.bincount(j, weights=t, minlength=n_words), float(len(c)), 0.7, 0.4)
    customers = np.bincount(u, weights=c, minlength=n_contexts)
    assert pitman_yor.next_strength(*s.strength_sums(customers), s.rng) > 0
    for _ in range(20):
        s.sweep()
        assert (s.t >= 1).all() and (s.t <= c).all() and s.every == s.t.sum() == s.own.sum() == s.tables_of.sum()
        seen = np.bincount(j, minlength=n_words) > 0
        parent = pitman_yor.parent_of(seen, s.own, s.every, int(seen.sum()), 0.4)
        new = pitman_yor.parent_of(0, 0, s.every, int(seen.sum()), 0.4)
        for context in np.unique(u):
            of, ts = np.zeros(n_words + 1), np.zeros(n_words + 1)
            of[j[u == context]], ts[j[u == context]] = c[u == context], s.t[u == context]
            p = pitman_yor.predictive(of, ts, customers[context], s.tables_of[context], np.r_[np.where(seen, parent, 0), new], 0.7, s.theta)
            assert math.isclose(p[np.r_[seen, True]].sum(), 1.0, rel_tol=1e-9)
    assert (s.t[c > 100] > 1).any()


def one_dish(c, d, others, own, t=1, d0=0.5):
    """A dish among others: the context has that many other tables, the word that many, and all restaurants as many as the context."""
    one = np.zeros(1, np.int64)
    return pitman_yor.Seating(np.array([c]), np.array([t]), one, one, np.array([others]), np.array([own + t]), others + t, d, d0)


def test_seating_agrees_with_the_process():
    """Tables of one dish with c customers, reseated alone: their number follows the distribution of all seatings."""
    c, d, theta, others, own = 6, 0.5, 1.0, 3.0, 2.0
    weight = Counter()

    def go(sizes, p):  # seat c customers of the one dish in all ways
        k = len(sizes)
        if sum(sizes) == c:
            weight[k] += p
            return
        go(sizes + (1,), p * (theta + d * (others + k)) * (own + k - 0.5) / (theta + others + k))
        for i, n in enumerate(sizes):
            go(sizes[:i] + (n + 1,) + sizes[i + 1 :], p * (n - d))

    go((), 1.0)
    exact = {k: w / sum(weight.values()) for k, w in weight.items()}
    s, got, runs = one_dish(c, d, others, own), Counter(), 6000
    for _ in range(runs):
        s.sweep()
        got[int(s.t[0])] += 1
    assert all(abs(got[k] / runs - p) < 0.03 for k, p in exact.items())


def test_decontamination(spark, docs, none):
    r = random.Random(8)
    word = lambda: "".join(r.choice("bcdfglmn") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(r.randint(15, 90)))) for k in range(40)] + [(90, None), (91, "..."), (92, "tiny item")]
    texts, want = [], set()
    for k in range(60):
        words = [word() for _ in range(r.randint(5, 400))]
        if k % 3 == 0:
            item = items[k % 40]
            at = r.randint(0, len(words))
            words[at:at] = item[1].split()
            want.add((k, item[0]))
        if k % 10 == 1:
            words += items[k % 40][1].split()[:5]  # the beginning of a question alone is no leak
        texts.append((k, " ".join(words)))
    texts += [(70, None), (71, ""), (72, items[5][1].upper()), (73, items[6][1].replace(" ", ", "))]
    want |= {(72, 5), (73, 6)}
    table = spark.createDataFrame([(d, t, "s", 1, 1, 0.0, 1) for d, t in texts], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    scored = []
    for bound in (1 << 20, 2000):
        found = decontamination.contaminated(table, bench, index_bytes=bound).cache()
        assert set(both(found, "doc_id", "item_id")) == want
        scored.append(both(found.selectExpr("*", "round(score, 9) as s"), "doc_id", "item_id", "s", "question_overlap", "answer_overlap", "at_word"))
    assert scored[0] == scored[1]  # the cut into indexes changes nothing
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_wand_finds_all_above_threshold():
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randint(3, 12)))) for k in range(50)]
    index = decontamination.Index(items, 0.5)
    for _ in range(60):
        terms = sorted({index.term[w] for w in r.sample(words, 25) if w in index.term})
        exact = Counter()
        for t in terms:
            for item, v in index.postings[t]:
                exact[item] += v
        want = {i for i, v in exact.items() if v >= 0.5}
        assert {i for i, _ in index.wand(terms, list(range(index.n_blocks)))} == want


PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_spans(text):
    for kind, p in PLAIN.items():
        for m in p.finditer(text):
            d = pii.digits_of(m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                yield kind, *m.span()


def test_pii_base_against_plain_patterns(spark, none):
    r = random.Random(6)
    pool = ["a@b.co", "x@y", "@", ".", "..", " ", "-", "+1 ", "(23) ", "4111 1111 1111 1111", "255.1.2.3", "1.2.3.4.5", "256.1.1.1", "0001.2.3.4", "é", "7" * 20, "12", "a.b@c.d.e_f@g.hh", "\n", "%", "٣"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == list(plain_spans(t)), t
    crf = pii.SemiCrf(pii.fit(pii.examples(n=30), epochs=5))
    for t in texts[:200]:
        base, spans = pii.find_pii(t, crf)
        assert set(base) <= set(spans)
    table = spark.createDataFrame([(k, t, "s", 1, 1, 0.0, 1) for k, t in enumerate([*texts[:50], None, "", "9" * 30000])] + [(None, "a@b.co", None, 1, 1, 0.0, 1)], SCHEMA)
    for row in pii.detect(table).collect():
        text = "a@b.co" if row.doc_id is None else [*texts[:50], "", "", "9" * 30000][row.doc_id]
        base = list(plain_spans(text)) if len(text) < 30000 else []
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert row.n_email == sum(k == "email" for k, _, _ in base)
    assert pii.detect(none).count() == 0


def test_semi_crf_held_out():
    crf = pii.SemiCrf(pii.fit())
    right = extra = missed = 0
    for text, gold in pii.examples(99, 120):
        got = {(k, s, e) for k, s, e, p in crf.decode(text) if p >= pii.SURE}
        right, extra, missed = right + len(got & set(gold)), extra + len(got - set(gold)), missed + len(set(gold) - got)
    assert right / (right + extra) > 0.95 and right / (right + missed) > 0.4


def test_semi_crf_sums_against_all_segmentations():
    r = np.random.default_rng(1)
    n, spans = 5, [(i, j) for i in range(5) for j in range(i + 1, 6)]
    scores = r.normal(size=(len(spans), 2))
    total, share, best = 0.0, np.zeros_like(scores), (-1e9, None)

    def go(i, score, used):
        nonlocal total, best
        if i == n:
            total += math.exp(score)
            for u in used:
                share[u] += math.exp(score)
            best = max(best, (score, tuple(used)))
            return
        go(i + 1, score, used)
        for k, (a, b) in enumerate(spans):
            if a == i:
                for c in range(2):
                    go(b, score + scores[k, c], [*used, (k, c)])

    go(0, 0.0, [])
    crf = pii.SemiCrf(None)
    assert np.allclose(crf.sums(n, spans, scores), share / total)
    assert tuple(crf.best(n, spans, scores)) == best[1]


def test_levenshtein_against_table():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(5)
    for _ in range(800):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(2))
        automaton = toxicity.Levenshtein(a, 2)
        state = automaton.start()
        for c in b:
            state = automaton.step(state, c)
        edits = distance(a, b)
        assert automaton.distance(state) == (edits if edits <= 2 else None)
        shorter = min((distance(a[:k], b) for k in range(len(a))), default=9)
        assert automaton.nearest_beginning(state) == (shorter if shorter <= 2 else None)
    lexicon = toxicity.Lexicon([("worthless", False, 6.0), ("idiot", False, 7.0), ("grub", True, 3.0)])
    assert lexicon.find("worthles")[1] == 2 and lexicon.find("idiott")[1] == 2 and lexicon.find("idiot") == (7.0, 0)
    assert lexicon.find("grubby")[1] == 1 and lexicon.find("grub") is None and lexicon.find("ideal") is None


def test_toxicity(spark, none):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    bad = ["zorkish", "vexling", "quibnar"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = [word() for _ in range(r.randint(10, 60))]
        if toxic:
            for _ in range(3):
                words[r.randint(0, len(words) - 1)] = r.choice(bad)
        rows.append((k, " ".join(words), "s", 1, 1, 0.0, 1))
        labels.append((k, int(toxic)))
    rows += [(900, None, None, 1, 1, 0.0, 1), (901, "", None, 1, 1, 0.0, 1), (None, "a zorkish vexling", None, 1, 1, 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(docs, toxicity.train(docs, table)).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all((got[k] >= 0.5) == (k % 6 == 0) for k in held)
    assert all(0 <= p <= 1 for p in got.values()) and got[900] == got[901] < 0.5
    assert toxicity.score_toxicity(none, toxicity.train(none, table.limit(0))).count() == 0


def test_toxicity_of_odd_rows(spark):
    """Repeated rows score alike, a long text is read to its end, a column named score is replaced, others pass."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    calm = lambda k: " ".join(word() for _ in range(10 + k % 40))
    rows = [(k, calm(k // 2) + (" zorkish vexling" if k % 2 else " plain talk"), "s", 1, 1, 0.5, 1) for k in range(200)]
    train = spark.createDataFrame(rows, SCHEMA)
    rows += [(300, "plain talk " * 100000, None, 1, 1, 0.5, 1), (301, "plain talk " * 100000 + "zorkish " * 3, None, 1, 1, 0.5, 1), (3, *rows[3][1:]), (302, rows[3][1], None, 1, 1, 0.5, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(train, spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs, model)
    assert sorted(got.columns) == sorted(docs.columns)
    score = defaultdict(set)
    for r in got.collect():
        score[r.doc_id].add(r.score)
    assert all(len(s) == 1 for s in score.values()) and score[3] == score[302] and score[300] != score[301]
    named = toxicity.score_toxicity(docs, model, "mine").collect()
    assert all(r.score == 0.5 and {r.mine} == score[r.doc_id] for r in named)


def test_learning_a_lexicon_holds_little_at_once():
    """Words of clean rows are not held: the driver's memory follows the terms of the toxic rows and one row."""

    class Read:
        def __iter__(self):
            for k in range(400):
                toxic = int(k % 20 == 0)
                yield toxic, [f"{k}x{i}" for i in range(300)] + (["zorkish", "plain"] if toxic else ["plain"])

    rows = list(Read())
    want = toxicity.learn_lexicon(rows)
    assert want and {t for t, _, _ in want} == {"zorkish"}
    packed = toxicity.Rows([(label, toxicity.Rows.pack(set(words))) for label, words in rows])
    assert [(label, sorted(words)) for label, words in rows] == list(packed) == list(packed)
    assert toxicity.learn_lexicon(packed) == want
    del rows
    tracemalloc.start()
    try:
        assert toxicity.learn_lexicon(Read()) == want
        assert tracemalloc.get_traced_memory()[1] < 10 << 20
    finally:
        tracemalloc.stop()


def test_apostrophes_are_no_quotation():
    lexicon = toxicity.Lexicon([("zorkish", False, 6.0)])
    for text in ("it’s a zorkish thing, isn’t it", "it's zorkish isn't it"):
        assert toxicity.features(text, lexicon)[6] == 0
    for text in ("he wrote ‘a zorkish thing’ there", "er sagte „zorkish“ dazu", "il dit «zorkish» ici", "er sagte »zorkish« dazu"):
        assert toxicity.features(text, lexicon)[6] == 1, text


def test_quotation_counts_less():
    lexicon = toxicity.Lexicon([("zorkish", False, 6.0)])
    plain, quoted = toxicity.features("you are zorkish today", lexicon), toxicity.features('he wrote "so zorkish" there', lexicon)
    assert plain[0] > quoted[0] and quoted[6] == 1


def test_crf_adds_spans_on_a_table(spark):
    texts = ["call (212) 555-1234 now", "host 10[.]4[.]3[.]4 up", "mail user1 [at] mail1 [dot] com please", "in 1999 and 2004 we had 12345 items", "me@x.org and 4.4.4.4", None]
    texts += [" ; ".join(f"0044 123 456 1{k:03d}" for k in range(n)) for n in (10, 200, 3000)]
    rows = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[k].spans for k in range(6)] == ["phone:5:19", "ip:5:19", "email:5:31", "", "email:0:8,ip:13:20", ""]
    assert [rows[k].n_spans for k in (6, 7, 8)] == [10, 200, 3000]
    assert all(rows[k].n_phone == 0 for k in (0, 6, 7, 8))  # base counts are of base spans


def test_crf_on_generated_text():
    crf = pii.SemiCrf(np.array(json.loads(pii.default_weights())))
    hits, found, gold = Counter(), Counter(), Counter()
    for text, want in pii.examples(99, 300):
        got = set(pii.find_pii(text, crf)[1])
        found.update(k for k, *_ in got)
        gold.update(k for k, *_ in want)
        hits.update(x[0] for x in want if x in got)
    assert all(hits[k] >= 0.8 * gold[k] and hits[k] >= 0.9 * found[k] for k in pii.KINDS)


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.load_pieces(piece_sampling.default_model())


def test_samples_follow_the_distribution(pieces):
    lattices = piece_sampling.Lattices(pieces)
    score = {p: (i, -math.log(rank + 2)) for i, (p, rank, kind) in enumerate(pieces) if kind == 0}

    def ways(unit):
        if not unit:
            return [((), 0.0)]
        return [((score[unit[:j]][0], *rest), score[unit[:j]][1] + s) for j in range(1, len(unit) + 1) if unit[:j] in score for rest, s in ways(unit[j:])]

    every = {a + b: x + y for a, x in ways("▁an") for b, y in ways("▁ate")}
    norm = math.log(sum(map(math.exp, every.values())))
    exact = {w: math.exp(s - norm) for w, s in every.items()}
    n = 6000
    got = piece_sampling.sample([(b"%d" % k, "an ate") for k in range(n)], lattices, 3)
    one = Counter(tuple(r[0][0].tolist()) for r in got)
    two = Counter((tuple(r[0][0].tolist()), tuple(r[1][0].tolist())) for r in got)
    assert all(abs(one[w] / n - p) < 0.03 for w, p in exact.items())
    assert all(abs(two[w, v] / n - p * q / (1 - p)) < 0.03 for w, p in exact.items() for v, q in exact.items() if w != v)
    assert all(len({tuple(s[0].tolist()) for s in r}) == 3 and r[0][2] >= r[1][2] >= r[2][2] for r in got)
    assert all(math.isclose(s[1], math.log(exact[tuple(s[0].tolist())]), rel_tol=1e-9) for r in got[:200] for s in r)
    assert abs(np.mean([sum(math.exp(s[1]) / s[3] for s in r) for r in got]) - 1) < 0.02  # inclusion scores are unbiased


def test_piece_round_trip(docs, none, pieces):
    rows = piece_sampling.sample_segmentations(docs).collect()
    texts = {(i, len(t or "")): t or "" for i, t, *_ in corpus()}
    assert all(r.round_trip for r in rows)
    assert {r.doc_id for r in rows} == {i for i, _ in texts}
    whole = piece_sampling.decoder(pieces)
    lattices = piece_sampling.Lattices(pieces)
    for t in ("", " ", "▁ mark ▁▁", "  two  spaces\n\n\ttab", "日本 😀 \udcff"[:-1], "x" * 5000, "\x00\x01"):
        for ids, *_ in piece_sampling.sample([(b"k", t)], lattices, 2)[0]:
            assert whole(ids.tolist()) == t.encode()
    assert piece_sampling.sample_segmentations(none).count() == 0
    back = piece_sampling.decode_segmentations(piece_sampling.sample_segmentations(docs)).collect()
    assert back and all(r.decoded == texts[r.doc_id, len(r.decoded)] for r in back)
    odd = docs.sparkSession.createDataFrame([(1, None, "mine"), (1, [], "mine"), (1, [], "mine")], "doc_id long, ids array<int>, decoded string")
    assert sorted(str(r.decoded) for r in piece_sampling.decode_segmentations(odd).collect()) == ["", "", "None"]


def test_long_texts_keep_their_samples(pieces):
    """An unbroken word and a text of a megabyte: distinct samples that decode, the same alone and among others."""
    lattices = piece_sampling.Lattices(pieces)
    texts = [(b"1", "ab" * 20000), (b"2", "some words of a text " * 50000), (b"3", "tail")]
    whole = piece_sampling.decoder(pieces)
    together = piece_sampling.sample(texts, lattices, 2)
    for row, samples in zip(texts, together):
        assert len({tuple(s[0].tolist()) for s in samples}) == 2
        alone = piece_sampling.sample([row], piece_sampling.Lattices(pieces), 2)[0]
        for s, t in zip(samples, alone):
            assert whole(s[0].tolist()) == row[1].encode() and s[0].tolist() == t[0].tolist()
            assert math.isclose(s[1], t[1], rel_tol=1e-9) and math.isclose(s[3], t[3], rel_tol=1e-6)


def test_substring_messages_cost_little_each():
    """Calls that a block makes for a part more, and a part for a message more: there are blocks times parts of these."""
    r = random.Random(8)
    passage = "".join(r.choices("abcdefgh ", k=4000))
    texts = ["".join(r.choices("abcdefgh ", k=300)) + passage[50 * k : 50 * k + 900] for k in range(60)]

    def calls(run):
        n = 0

        def seen(frame, event, arg):
            nonlocal n
            n += event in ("call", "c_call")

        sys.setprofile(seen)
        try:
            return run(), n
        finally:
            sys.setprofile(None)

    def block(k, rows, n_parts):
        b = suffix_dedup.Block(pa.table({"doc_id": pa.array(rows, pa.int64()), "text": [texts[i] for i in rows]}), 50, 20)
        keys = b.anchor[b.first_of]
        bits = {p: suffix_dedup.pack_bits(np.ones(e - s, bool)) for p, s, e in suffix_dedup.part_slices(keys, n_parts)}
        return calls(lambda: b.send(n_parts, k, bits))

    (few, cost_few), (many, cost_many) = block(0, range(60), 2), block(0, range(60), 400)
    assert cost_many - cost_few < 40 * (len(many) - len(few))

    def answer(step):
        sent = [m for k in range(0, 60, step) for m in block(k, range(k, k + step), 1)[0]]
        table = suffix_dedup.table_of(suffix_dedup.SEND, sent)
        reply, n = calls(lambda: suffix_dedup._answer_strings(table, 50, 2))
        gone = {(m["block"] + d, p) for m in reply.to_pylist() for d, s, e in zip(*(np.frombuffer(m[c], t) for c, t in (("docs", np.uint32), ("starts", np.int64), ("ends", np.int64)))) for p in range(s, e)}
        return len(sent), n, gone

    (n_few, few, want), (n_many, many, got) = answer(30), answer(1)
    assert n_many == 60 and n_few == 2 and got == want
    assert many - few < 40 * (n_many - n_few)


def test_sampling_holds_little_at_once():
    """Texts of many different words, run as one worker does: the peak stays small, and words that other operators remember go."""
    r = random.Random(3)
    texts = [" ".join("".join(r.choices("etaoinshrdlu", k=r.randint(3, 9))) for _ in range(300)) for _ in range(1200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    context = SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x))
    table = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda run, _: run)
    table.selectExpr = lambda *_: table
    run = piece_sampling.sample_segmentations(table)
    jaccard_join.shingle_set(b"words of another operator")
    tracemalloc.start()
    n = sum(out.num_rows for out in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * len(texts) and peak < 170e6, peak
    assert not jaccard_join._memo


@pytest.mark.parametrize("c", [6, 300, 3000])
def test_a_sweep_reseats_a_dish_of_any_count(c):
    """One dish among others, swept from one table: tables follow the exact distribution given the others."""
    d, others, own, n_runs = 0.6, 5000.0, 400.0, 400
    ways = pitman_yor.log_ways_table(d, c)[c, 1:]
    k = np.arange(1, c)
    weight = ways + np.r_[0, np.cumsum(np.log((1 + d * (others + k)) * (own + k - 0.5) / (1 + others + k)))]
    p = np.exp(weight - weight.max())
    p /= p.sum()
    mean = (p * np.arange(1, c + 1)).sum()
    sd = math.sqrt((p * (np.arange(1, c + 1) - mean) ** 2).sum())
    near = pitman_yor.log_ways(np.full(c, c), np.arange(1, c + 1), d)
    assert np.abs((near - near[0]) - (ways - ways[0])).max() < 0.01
    s, got = one_dish(c, d, others, own), []
    for _ in range(n_runs):
        s.sweep()
        got.append(int(s.t[0]))
    assert abs(got[2] - mean) < 6 * sd  # three sweeps leave the start
    assert abs(np.mean(got[3:]) - mean) < 0.4 * sd and 0.75 * sd < np.std(got[3:]) < 1.3 * sd


def test_whole_lexicon_is_sought_misspelt():
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    words = list(dict.fromkeys(word(9) for _ in range(300)))
    stems = list(dict.fromkeys("kl" + word(6) for _ in range(40)))
    lexicon = toxicity.Lexicon([(w, False, 8.0 - k / 50) for k, w in enumerate(words)] + [(s, True, 2.0) for s in stems])
    for w in words:  # also those ranked late or with odds under e**4
        for wrong in (w[:4] + w[5:], w[:4] + "z" + w[5:], w[:2] + w[3:6] + w[7:]):
            assert lexicon.find(wrong)[1] == 2, (w, wrong)
    for s in stems:
        assert lexicon.find(s + "zzzzzz")[1] == 1 and lexicon.find(s[:3] + "z" + s[4:] + "zzzzzz") == (1.0, 2)
    assert lexicon.find("zzzzzzzzz") is None
