"""Array stores: discovery, scans, pushdown, formats, errors."""

import json
import time

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from gridloom.engine import Engine
from gridloom.functions.dialect import translate
from gridloom.iostats import format_bytes
from gridloom.shell import Shell, hint, ticker
from gridloom.sources.codec import bit_shuffle, bit_unshuffle, blosc_decode, blosc_encode, decode, encode
from gridloom.sources.grid import matching, metadata, plan, read_boxes, read_grid
from gridloom.sources.meta import StoreError, discover, parse_v2_dtype
from gridloom.sources.store import S3_CHAIN, Store, is_remote, unsigned
from gridloom.sources.writer import save_grid, write_array, write_group, write_store

BLOSC = [{"name": "blosc", "cname": "lz4", "clevel": 5, "shuffle": "shuffle", "typesize": 8, "blocksize": 0}]
RNG = np.random.default_rng(3)
TEMPERATURE, HUMIDITY = RNG.integers(-50, 60, (7, 10, 10)), RNG.integers(10, 80, (7, 10, 10))


@pytest.fixture(scope="module")
def stores(tmp_path_factory):
    root = tmp_path_factory.mktemp("stores")
    coords = {"time": np.arange(7), "lat": np.arange(10), "lon": np.arange(10)}
    made = {}
    for version in (2, 3):
        for name, codecs in (("plain", []), ("blosc", BLOSC)):
            path = str(root / f"v{version}{name}.zarr")
            made[version, name] = write_store(path, coords, {"temperature": TEMPERATURE, "humidity": HUMIDITY}, (1, 10, 10), version, codecs)
    return made


@pytest.fixture(scope="module")
def weather(spark, stores):
    engine = Engine(spark)
    engine.sql(f"CREATE EXTERNAL TABLE weather STORED AS ZARR LOCATION '{stores[3, 'plain']}'")
    return engine


def flat(path, columns=None):
    meta = discover(path)
    schema = meta.schema() if columns is None else T.StructType([meta.schema()[c] for c in columns])
    batches = [b for p in plan(meta, schema.names, []) for b in read_boxes(meta, schema, p.boxes, Store(path))]
    return {n: np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k, n in enumerate(schema.names)}


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize("codec", ["plain", "blosc"])
def test_formats_read_alike(spark, stores, version, codec):
    df = read_grid(spark, stores[version, codec])
    assert df.columns == ["time", "lat", "lon", "humidity", "temperature"]
    assert [f.nullable for f in df.schema] == [False] * 3 + [True] * 2
    rows = df.orderBy("time", "lat", "lon").collect()
    assert len(rows) == 700
    assert [r.temperature for r in rows] == TEMPERATURE.reshape(-1).tolist()
    assert [r.humidity for r in rows] == HUMIDITY.reshape(-1).tolist()


def test_pushdown_counts(spark, stores):
    df = read_grid(spark, stores[3, "plain"])
    for condition, n in (("time = 0", 100), ("time = 0 and lat = 0", 10), ("time = 0 and lat = 0 and lon = 0", 1), ("time = 9999", 0), ("time in (1, 3)", 200), ("time >= 5", 200), ("time > 1 and time < 4", 200), ("0 = time", 100), ("time = 1 and time = 2", 0), ("cast(time as double) = 5.25", 0), ("time = 2.0", 100)):
        assert df.where(condition).count() == n, condition


def test_filters_prune_chunks(stores):
    meta = discover(stores[3, "plain"])
    cells = lambda filters: sum(len(p.boxes) for p in plan(meta, ["temperature"], filters))
    assert cells([]) == 7
    assert cells([EqualTo(("time",), 3)]) == 1
    assert cells([In(("time",), (1, 2))]) == 2
    assert cells([GreaterThanOrEqual(("time",), 5)]) == 2
    assert cells([EqualTo(("time",), 99)]) == 0


def test_only_projected_variables_are_read(stores):
    meta = discover(stores[3, "plain"])
    store = Store(stores[3, "plain"])
    schema = T.StructType([meta.schema()["time"], meta.schema()["humidity"]])
    for p in plan(meta, schema.names, []):
        list(read_boxes(meta, schema, p.boxes, store))
    assert store.bytes_read == 700 * 8


def test_matching_keeps_duplicates_and_types(tmp_path):
    path = write_store(str(tmp_path / "d.zarr"), {"x": np.array([3.5, 1.0, 3.5, np.nan, 2.0])}, {}, version=3)
    c = discover(path).coords[0]
    assert matching(c, [EqualTo(("x",), 3.5)]).tolist() == [0, 2]
    assert matching(c, [EqualTo(("x",), 1)]).tolist() == [1]
    assert matching(c, [EqualTo(("x",), "text")]).tolist() == [0, 1, 2, 3, 4]
    assert matching(c, [GreaterThanOrEqual(("x",), 2.0)]).tolist() == [0, 2, 3, 4]
    assert matching(c, [LessThan(("x",), 2.0)]).tolist() == [1, 4]  # a superset: Spark checks again


@pytest.mark.parametrize("named", [True, False])
def test_equal_sizes(tmp_path, named):
    values = np.arange(20 * 1.0).reshape(2, 10)
    path = write_store(str(tmp_path / "e.zarr"), {"b": np.arange(2), "a": np.arange(10)}, {"v": values}, (1, 5), 3, named=named)
    assert [c.name for c in discover(path).coords] == ["b", "a"]
    square = write_store(str(tmp_path / "s.zarr"), {"b": np.arange(3), "a": np.arange(3)}, {"v": np.zeros((3, 3))}, version=2, named=named)
    assert [c.name for c in discover(square).coords] == (["b", "a"] if named else ["a", "b"])


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_round_trip(tmp_path_factory, data):
    kind = data.draw(st.sampled_from(["<i1", "<i2", "<i4", "<i8", "<u1", "<u2", "<u4", "<f4", "<f8", ">i4", ">f8", ">u2", "|b1"]))
    shape = tuple(data.draw(st.lists(st.integers(1, 6), min_size=2, max_size=3)))
    chunks = tuple(data.draw(st.integers(1, n)) for n in shape)
    version = data.draw(st.sampled_from([2, 3]))
    codec = data.draw(st.sampled_from([[], [{"name": "gzip", "level": 1}], [{"name": "zstd", "level": 1}], [{**BLOSC[0], "cname": "zstd"}], BLOSC]))
    values = np.random.default_rng(1).integers(0, 2 if kind == "|b1" else 100, shape).astype(kind)
    coords = {f"d{k}": np.arange(n) * (k + 1) for k, n in enumerate(shape)}
    path = write_store(str(tmp_path_factory.mktemp("rt") / "s.zarr"), coords, {"v": values}, chunks, version, codec, order=data.draw(st.sampled_from("CF")), skip_fill=True)
    got = flat(path)
    mesh = np.meshgrid(*coords.values(), indexing="ij")
    order = np.lexsort([got[f"d{k}"] for k in reversed(range(len(shape)))])
    assert got["v"][order].tolist() == values.reshape(-1).tolist()
    for k in range(len(shape)):
        assert got[f"d{k}"][order].tolist() == mesh[k].reshape(-1).tolist()


def test_wide_types(spark, tmp_path):
    values = {"u8": np.array([[2**64 - 1, 5]], "u8"), "h": np.array([[0.5, 2.0]], "f2"), "flag": np.array([[True, False]])}
    path = write_store(str(tmp_path / "w.zarr"), {"x": np.array([1]), "y": np.array([1, 2])}, values)
    rows = read_grid(spark, path).orderBy("y").collect()
    assert (int(rows[0].u8), rows[0].h, rows[0].flag) == (2**64 - 1, 0.5, True)


def test_codecs():
    raw = np.arange(70000, dtype="<i8").tobytes()
    for name in ("lz4", "zstd", "zlib"):
        for shuffled in (True, False, "bits"):
            assert blosc_decode(blosc_encode(raw, 8, name, shuffled)) == raw
    for c in ("gzip", "zlib", "zstd", "lz4"):
        assert decode(encode(raw, [{"name": c}], 8), [{"name": c}], len(raw)) == raw
    with pytest.raises(ValueError):
        decode(b"", [{"name": "unheard"}], 0)


def test_bit_shuffle_by_hand():
    data = np.array([1, 3, 0, 0, 0, 0, 0, 128], "u1").tobytes()
    assert bit_shuffle(data, 1) == bytes([0b11, 0b10, 0, 0, 0, 0, 0, 0x80])  # row k: bit k of each element
    for width in (1, 2, 4, 8):
        for n in (8, 64, 72, 9):
            raw = np.random.default_rng(n).bytes(n * width)
            assert bit_unshuffle(bit_shuffle(raw, width), width) == raw


@pytest.mark.parametrize("where", ["start", "end"])
def test_shards(spark, tmp_path, where):
    """Shards of 4 x 4 cells in chunks of 2 x 2, gzipped, one not stored, a checksum behind the index."""
    values = np.arange(48, dtype="<i4").reshape(8, 6)
    path = write_store(str(tmp_path / "s.zarr"), {"x": np.arange(8), "y": np.arange(6)}, {"v": values}, chunks=(4, 4))
    values[0:2, 0:2] = -7
    file = tmp_path / "s.zarr/v/zarr.json"
    meta = json.loads(file.read_text())
    plain, index = {"name": "bytes", "configuration": {"endian": "little"}}, [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
    meta["codecs"] = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "codecs": [plain, {"name": "gzip"}], "index_codecs": index, "index_location": where}}]
    meta["fill_value"] = -7
    file.write_text(json.dumps(meta))
    padded = np.full((8, 8), -7, "<i4")
    padded[:, :6] = values
    for i, j in np.ndindex(2, 2):
        body, places, at = b"", [], (4 * 16 + 4) * (where == "start")
        for a, b in np.ndindex(2, 2):
            cells = padded[4 * i + 2 * a :, 4 * j + 2 * b :][:2, :2]
            piece = b"" if (cells == -7).all() else encode(cells.tobytes(), [{"name": "gzip"}], 4)
            places += [at, len(piece)] if piece else [2**64 - 1] * 2
            body, at = body + piece, at + len(piece)
        table = np.array(places, "<u8").tobytes() + b"\0" * 4
        (tmp_path / f"s.zarr/v/c/{i}/{j}").write_bytes(table + body if where == "start" else body + table)
    got = {(r.x, r.y): r.v for r in read_grid(spark, path).collect()}
    assert got == {(x, y): int(values[x, y]) for x in range(8) for y in range(6)}
    meta["codecs"][0]["configuration"]["chunk_shape"] = [3, 2]
    file.write_text(json.dumps(meta))
    with pytest.raises(StoreError, match="divide"):
        metadata(path, fresh=True)


def test_statistics_keep_type(tmp_path):
    big = np.array([2**60 + 1, 2**60 + 3])
    meta = discover(write_store(str(tmp_path / "b.zarr"), {"x": big}, {}))
    assert meta.statistics()["columns"]["x"]["max"] == 2**60 + 3


def test_metadata_answers(weather):
    for text, want in (
        ("SELECT count(*) AS c FROM weather", (700,)),
        ("SELECT count(temperature) AS c, min(lat) AS lo, max(time) AS hi FROM weather", (700, 0, 6)),
        ("SELECT count(NULL) AS c FROM weather", (0,)),
        ("SELECT max(x) AS hi FROM (SELECT lat AS x FROM weather) t", (9,)),
    ):
        df = weather.sql(text)
        assert tuple(df.first()) == want
        assert "BatchScan" not in df._jdf.queryExecution().toString(), text
    for text, want in (
        ("SELECT count(DISTINCT lat) AS c FROM weather", 10),
        ("SELECT count(*) FILTER (WHERE lat < 3) AS c FROM weather", 210),
        ("SELECT max(lat) AS hi FROM (SELECT -lat AS lat FROM weather) t", 0),
        ("SELECT count(*) AS c FROM weather WHERE lat = 1", 70),
        ("SELECT max(temperature) AS hi FROM weather", int(TEMPERATURE.max())),
    ):
        df = weather.sql(text)
        assert df.first()[0] == want
        assert "BatchScan" in df._jdf.queryExecution().toString(), text


def test_projection_reaches_the_scan(weather):
    told = weather.sql("SELECT time, avg(temperature) AS a FROM weather GROUP BY time")._jdf.queryExecution().toString()
    assert "humidity" not in told.split("Physical Plan")[1]
    assert weather.spark.table("weather").columns == ["time", "lat", "lon", "humidity", "temperature"]


def test_statements(weather, tmp_path):
    assert weather.sql("SELECT column_name FROM information_schema.columns WHERE table_name = 'weather'").count() == 5
    assert "weather" in [r.table_name for r in weather.sql("SELECT table_name FROM information_schema.tables").collect()]
    assert weather.sql("DESCRIBE weather").count() == 5
    assert "Statistics" in [r.plan_type for r in weather.sql("EXPLAIN ANALYZE SELECT * FROM weather WHERE time = 1").collect()]
    assert weather.sql("EXPLAIN VERBOSE SELECT lat FROM weather").count() == 1
    weather.register("gone", weather.stores["weather"])
    weather.sql("DROP TABLE gone")
    with pytest.raises(Exception):
        weather.sql("SELECT * FROM gone")
    with pytest.raises(Exception):
        weather.sql("SELECT nothing FROM weather")
    assert weather.sql("SELECT count(*) AS c FROM weather").first().c == 700


def test_errors(tmp_path):
    with pytest.raises(FileNotFoundError):
        discover(str(tmp_path / "absent"))
    with pytest.raises(StoreError):
        discover(str(tmp_path))
    store = Store(str(tmp_path / "bad.zarr"))
    write_group(store, 3)
    with pytest.raises(StoreError, match="no arrays"):
        discover(store.path)
    write_array(store, "v", np.zeros((2, 2)))
    with pytest.raises(StoreError, match="no coordinate"):
        discover(store.path)
    write_array(store, "x", np.arange(2), dimensions=("x",))
    with pytest.raises(StoreError, match="'v'"):
        discover(store.path)
    store.put("v/zarr.json", b"{")
    with pytest.raises(StoreError, match="not JSON"):
        discover(store.path)
    with pytest.raises(StoreError):
        parse_v2_dtype([["a", "<i4"]])


def test_missing_chunks_are_fill(tmp_path):
    path = write_store(str(tmp_path / "m.zarr"), {"x": np.arange(4), "y": np.arange(3)}, {"v": np.full((4, 3), 7)}, (2, 2), fill=7, skip_fill=True)
    assert not (tmp_path / "m.zarr" / "v" / "c").exists()
    assert set(flat(path)["v"].tolist()) == {7}


def test_io_follows_the_filters(weather):
    """One chunk of seven is read for one time; a plan with metrics is the one that ran."""
    weather.sql("SELECT * FROM weather").collect()
    whole = weather.last_io.data_bytes
    weather.sql("SELECT * FROM weather WHERE time = 3").collect()
    assert whole > 0 and weather.last_io.data_bytes * 7 == whole
    weather.sql("SELECT * FROM weather WHERE 5 <= time AND lat IN (1, 2)").collect()
    assert weather.last_io.data_bytes * 7 == whole * 2
    rows = {r.plan_type: r.plan for r in weather.sql("EXPLAIN ANALYZE SELECT lat, sum(temperature) AS s FROM weather WHERE time = 3 GROUP BY lat").collect()}
    assert "numOutputRows" in rows["Plan with Metrics"] and "HashAggregate" in rows["Plan with Metrics"]


def test_translate():
    assert translate("SELECT 'trunc(1.5, 1)' AS a, `sha256(x)` -- make_array(1)") == "SELECT 'trunc(1.5, 1)' AS a, `sha256(x)` -- make_array(1)"
    assert translate("SELECT array_has(make_array(1, 2), (1))") == "SELECT array_contains(array(1, 2), (1))"
    for bad in ("SELECT date_bin(INTERVAL '1 month', t)", "SELECT arrow_cast(1, 'X')", "SELECT digest(x, 'crc')", "SELECT array_has(a)", "SELECT trunc(1"):
        with pytest.raises(ValueError):
            translate(bad)


def test_save_grid(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 0.5), (1, 20, 1.5), (3, 10, 2.5)], "a int, b int, v double")
    path = save_grid(df, f"file://{tmp_path}/g.zarr", ["a", "b"], ["v"], [1, 2])
    assert {tuple(r) for r in read_grid(spark, path).collect()} == {(1, 10, 0.5), (1, 20, 1.5), (3, 10, 2.5), (3, 20, 0.0)}


def test_metadata_is_read_anew(tmp_path):
    path = write_store(str(tmp_path / "n.zarr"), {"x": np.arange(3)}, {})
    assert metadata(path, fresh=True).total_rows == 3
    write_array(Store(path), "x", np.arange(5), dimensions=("x",))
    assert metadata(path, fresh=True).total_rows == 5


def test_shell(weather):
    import io

    out = io.StringIO()
    shell = Shell(weather, out)
    assert shell.run("help") and shell.run("") and shell.run("select broken") and shell.run("SELECT count(*) AS c FROM weather")
    assert not shell.run("quit")
    assert "700" in out.getvalue() and "Error" in out.getvalue()
    shown = io.StringIO()
    shown.isatty = lambda: True
    with ticker(shown, shell.progress, 0.01):
        time.sleep(0.2)
    assert "0 of 0 tasks · 0." in shown.getvalue() and shown.getvalue().endswith("\x1b[K")
    assert hint("sel", ["SELECT 1", "drop"]) == "ECT 1" and hint("s", ["SELECT 1"]) is None


def test_credentials_of_stores(monkeypatch):
    for name in S3_CHAIN:
        monkeypatch.delenv(name, raising=False)
    ask = lambda options, keys=False: unsigned(options, keys, S3_CHAIN, "/no/such/file")
    assert ask({}) and not ask({}, True) and not ask({"anonymous": "false"}) and ask({"anonymous": "TRUE"}, True)
    monkeypatch.setenv("AWS_PROFILE", "mine")
    assert not ask({})


def test_small_things():
    assert [format_bytes(n) for n in (12, 6700, 13916)] == ["12 B", "6.70 KB", "13.92 KB"]
    assert is_remote("s3://b/x") and not is_remote("/x") and not is_remote("file:///x")
