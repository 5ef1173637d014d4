"""The pipeline's stages against brute force on the smallest tables."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from gridloom.llm import queries, stages

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def run(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in stage(spark, docs, SF).collect()]
        kept.append({r[0]: r for r in rows})
        assert len(kept[-1]) == len(rows), name
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == columns
    return kept


def source():
    return {r[0]: r for r in duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()}


def test_rows_are_unchanged(run):
    have = source()
    for rows in run:
        assert all(have[i] == r for i, r in rows.items())


def test_toxicity_keeps_clean_documents(run):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    clean = [i for i in source() if labels.get(i) == 0]
    assert sum(i in run[0] for i in clean) >= 0.97 * len(clean)


def test_exact_copies(run):
    best: dict[str, int] = {}
    for i, r in run[0].items():
        best[r[1]] = max(i, best.get(r[1], -1))
    assert set(run[1]) == set(best.values())


def test_near_copies(run):
    sets = {}
    for i, r in run[1].items():
        w = WORD.findall(r[1].lower() if r[1].isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    top = lambda i: i if root[i] == i else top(root[i])
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert set(run[2]) == {i for i in ids if top(i) == i}


def test_contaminated(run):
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    assert set(run[2]) - set(run[3]) == {i for i, r in run[2].items() if any(t in r[1] for t in items)}


def test_filters_with_odd_rows(spark):
    schema = "doc_id long, text string, score double, block int"
    docs = spark.createDataFrame([(None, "a b", 0.0, 1), (None, "a b", 0.0, 1), (1, "a b", 0.1, 2), (2, None, 0.2, 3), (3, "", 0.3, 4), (4, "c d", 0.4, 5), (4, "c d", 0.4, 5), (None, "e", 0.0, 6)], schema)
    got = stages.drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, (tuple(r)[:2] for r in got.collect()))) == sorted(map(str, [(1, "a b"), (3, ""), (4, "c d"), (None, "e")]))
    near = stages.drop_near_copies(docs)
    assert {r.doc_id for r in near.collect()} == {None, 1, 2, 3, 4}


def test_row_filters_with_odd_rows(spark):
    """Toxic and contaminated rows go; a column named score keeps its values; nulls, repeats and a long text pass."""
    schema = "doc_id long, text string, score double, _toxicity int, item_id long"
    item = " ".join(f"item{k}" for k in range(30))
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = [(k, " ".join([word() for _ in range(10 + k // 2 % 40)] + ["zorkish" if k % 2 else "calm"] * 3), 7.25, k, 1) for k in range(1, 201)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 201)], "doc_id long, toxic int")
    rows += [(None, "a calm remark", 0.0135, 0, 1)] * 2 + [(250, None, None, None, None), (251, "", 1.0, 1, 1), (252, "calm words " * 100000, 2.0, 2, 2)]
    docs = spark.createDataFrame(rows, schema)
    got = stages.drop_toxic(docs, labels)
    assert got.columns == docs.columns
    kept = sorted(map(str, map(tuple, got.collect())))
    assert kept == sorted(str(r) for r in rows if not r[1] or "zorkish" not in r[1])
    assert stages.drop_toxic(docs.limit(0), labels).count() == 0
    rows = rows[150:]
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    rows += [(260, f"ahead {item} behind", 3.0, 3, 3)] * 2 + [(261, "calm words " * 100000 + item, 3.0, 3, 3)]
    docs = spark.createDataFrame(rows, schema)
    clean = stages.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(map(str, map(tuple, clean.collect()))) == sorted(str(r) for r in rows if r[0] not in (260, 261))
    assert stages.drop_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert stages.drop_contaminated(docs.limit(0), bench).count() == 0


def test_whole_run(spark, run):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(run[3])
    assert all(r.round_trip and len(r.ids) == r.n_pieces for r in rows)


def test_every_operator_is_registered():
    names = queries.queries()
    assert [n for n in range(1, 11) if sum(k.startswith(f"op{n}_") for k in names) != 1] == []
