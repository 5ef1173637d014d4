"""Registered queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.engine import Engine, materialize
from gridloom.functions.dialect import register_functions, translate
from gridloom.plans.queries_sql import CUBE, EMB, GRID, TABLES
from gridloom.session import ensure_importable, shared_dir
from gridloom.sources.grid import read_grid
from gridloom.sources.writer import save_grid

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BLOSC = [{"name": "blosc", "cname": "lz4", "clevel": 5, "shuffle": "shuffle", "typesize": 4, "blocksize": 0}]
_grids: dict[tuple[str, str, str], str] = {}


def tables(spark: SparkSession, sf_dir: str) -> None:
    for name in NAMES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def grid_path(spark: SparkSession, sf_dir: str, name: str, version: int = 3, codecs=()) -> str:
    """A store made of the tables, written once a session to the shared folder: emb (vec_id, dim) or cube (m, ln, rf)."""
    key = (spark.sparkContext.applicationId, sf_dir, f"{name}-v{version}-{'-'.join(c['name'] for c in codecs) or 'plain'}")
    if key not in _grids:
        ensure_importable(spark)
        path = f"{shared_dir(spark)}/grids/{abs(hash(key)):x}-{key[2]}.zarr"
        if name == "emb":
            df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode("embedding").alias("dim", "v"))
            save_grid(df, path, ["vec_id", "dim"], ["v"], [256, 64], version, codecs)
        else:
            df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(
                (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"), F.col("l_linenumber").alias("ln"), F.ascii("l_returnflag").alias("rf")
            ).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
            save_grid(df, path, ["m", "ln", "rf"], ["q", "n"], [12, 7, 3], version, codecs)
        _grids[key] = path
    return _grids[key]


def _grid_engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    engine = Engine(spark)
    if "embeddings" in text:
        tables(spark, sf_dir)
    for name in ("emb", "cube"):
        if f" {name}" in text:
            engine.sql(f"CREATE EXTERNAL TABLE {name} STORED AS ZARR LOCATION '{grid_path(spark, sf_dir, name)}'")
    return engine


def _over_grid(text: str):
    return lambda spark, sf_dir: _grid_engine(spark, sf_dir, text).sql(text)


def _over_tables(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables(spark, sf_dir)
        register_functions(spark)
        return spark.sql(translate(text))

    return query


def _with(prefix: str, text: str) -> str:
    return f"WITH {prefix}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {prefix} {text}"


def _scan(name: str, version: int, codecs):
    return lambda spark, sf_dir: read_grid(spark, grid_path(spark, sf_dir, name, version, codecs))


def _materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = grid_path(spark, sf_dir, "cube")
    return materialize(spark, path, path + ".parquet", "ln").groupBy("ln").agg(F.sum("q").alias("q"), F.max("m").alias("m"))


def _formats_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format versions 2 and 3, plain and compressed, side by side on the coordinates."""
    first = read_grid(spark, grid_path(spark, sf_dir, "cube", 2)).withColumnRenamed("q", "v2")
    other = read_grid(spark, grid_path(spark, sf_dir, "cube", 3, BLOSC), ["m", "ln", "rf", "q"]).withColumnRenamed("q", "v3")
    return first.join(other, ["m", "ln", "rf"]).select("m", "ln", "rf", "v2", "v3")


def _information_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _grid_engine(spark, sf_dir, " cube")
    return engine.sql("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = 'cube'")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_engine(spark, sf_dir, " cube").sql("DESCRIBE cube").select("col_name", "data_type")


OTHERS = {
    "grid_scan_v2": (_scan("emb", 2, ()), f"WITH {EMB} SELECT vec_id, dim, v FROM emb"),
    "grid_scan_blosc": (_scan("emb", 3, BLOSC), f"WITH {EMB} SELECT vec_id, dim, v FROM emb"),
    "grid_scan_zstd": (_scan("cube", 3, [{"name": "zstd", "level": 3}]), f"WITH {CUBE} SELECT m, ln, rf, n, q FROM cube"),
    "grid_scan_gzip": (_scan("cube", 3, [{"name": "gzip", "level": 5}]), f"WITH {CUBE} SELECT m, ln, rf, n, q FROM cube"),
    "grid_formats_agree": (_formats_agree, f"WITH {CUBE} SELECT m, ln, rf, q AS v2, q AS v3 FROM cube"),
    "grid_materialized": (_materialized, f"WITH {CUBE} SELECT ln, sum(q) AS q, max(m) AS m FROM cube GROUP BY ln"),
    "grid_information_schema": (_information_schema, "SELECT * FROM (VALUES ('m', 'int'), ('ln', 'int'), ('rf', 'int'), ('n', 'bigint'), ('q', 'double')) t(column_name, data_type)"),
    "grid_describe": (_described, "SELECT * FROM (VALUES ('m', 'int'), ('ln', 'int'), ('rf', 'int'), ('n', 'bigint'), ('q', 'double')) t(col_name, data_type)"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["grid_group_by_one"](spark, sf_dir)


def queries() -> dict:
    found = {name: _over_grid(text) for name, text in GRID.items()}
    found |= {name: _over_tables(text if isinstance(text, str) else text[0]) for name, text in TABLES.items()}
    return found | {name: query for name, (query, _) in OTHERS.items()}


def oracle_sql() -> dict:
    found = {name: _with(f"{EMB}, {CUBE}", text) for name, text in GRID.items()}
    found |= {name: text if isinstance(text, str) else text[1] for name, text in TABLES.items()}
    return found | {name: sql for name, (_, sql) in OTHERS.items()}
