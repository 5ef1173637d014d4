"""Façade: register stores, run SQL with the dialect's statements, answer from metadata, scan only needed columns."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridloom.functions.dialect import register_functions, translate
from gridloom.iostats import IoStats, planned_io
from gridloom.plans.metadata import answer_from_metadata, needed_columns, run_with_metrics, scan_filters
from gridloom.sources.grid import metadata, plan, read_grid, register

EXTERNAL = re.compile(r"^\s*CREATE\s+EXTERNAL\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+STORED\s+AS\s+(\w+)\s+LOCATION\s+'([^']+)'\s*;?\s*$", re.I)
DROP = re.compile(r"^\s*DROP\s+(?:TABLE|VIEW)\s+(IF\s+EXISTS\s+)?(\w+)\s*;?\s*$", re.I)
EXPLAIN = re.compile(r"^\s*EXPLAIN\s+(ANALYZE|VERBOSE)\s+(.*)$", re.I | re.S)
SCHEMA_VIEW = re.compile(r"\binformation_schema\s*\.\s*(columns|tables|views)\b", re.I)


class Engine:
    """SQL over array stores and other tables of one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.stores: dict[str, str] = {}
        self.last_io = IoStats()
        register(spark)
        register_functions(spark)

    def register(self, name: str, path: str) -> None:
        """Makes the store at path the table `name`; fails if it is no store."""
        metadata(path, fresh=True)
        read_grid(self.spark, path).createOrReplaceTempView(name)
        self.stores[name.lower()] = path

    def register_file(self, name: str, kind: str, path: str) -> None:
        """Parquet, CSV, JSON, ORC or text as a table."""
        reader = self.spark.read.option("header", "true").option("inferSchema", "true") if kind.lower() == "csv" else self.spark.read
        reader.format(kind.lower()).load(path).createOrReplaceTempView(name)

    def drop(self, name: str, if_exists: bool = False) -> None:
        self.stores.pop(name.lower(), None)
        if not self.spark.catalog.dropTempView(name) and not if_exists:
            self.spark.sql(f"DROP TABLE {name}")

    def sql(self, text: str) -> DataFrame:
        """Runs one statement."""
        text = text.strip().rstrip(";")
        if m := EXTERNAL.match(text):
            if not (m[1] and m[2].lower() in self.stores):
                self.register(m[2], m[4]) if m[3].upper() == "ZARR" else self.register_file(m[2], m[3], m[4])
            return self._message("OK")
        if m := DROP.match(text):
            self.drop(m[2], bool(m[1]))
            return self._message("OK")
        if text.lower().startswith("\\d"):
            return self.spark.sql("SHOW TABLES")
        if m := EXPLAIN.match(text):
            return self._analyze(translate(m[2])) if m[1].upper() == "ANALYZE" else self.spark.sql(f"EXPLAIN EXTENDED {translate(m[2])}")
        if SCHEMA_VIEW.search(text):
            text = self._with_information_schema(text)
        return self._optimized(translate(text))

    def _message(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(text,)], "result string")

    def _optimized(self, text: str) -> DataFrame:
        df = self.spark.sql(text)
        if not self.stores or not re.match(r"\s*(SELECT|WITH|\(|FROM)\b", text, re.I):
            return df
        paths = set(self.stores.values())
        answer = answer_from_metadata(df, paths)
        if answer is not None:
            self.last_io = IoStats()
            return answer
        narrowed = {}
        for name, path in self.stores.items():
            if re.search(rf"\b{re.escape(name)}\b", text, re.I):
                columns = needed_columns(df, path)
                schema = metadata(path).schema()
                if columns is not None:
                    # analysis wants every column that the text names; a bare row count wants one coordinate
                    named = {c for c in schema.names if re.search(rf"\b{re.escape(c)}\b", text, re.I)}
                    narrowed[name] = sorted(named.union(columns)) or [schema.names[0]]
        if not narrowed:
            return df
        try:
            for name, columns in narrowed.items():
                order = [c for c in metadata(self.stores[name]).schema().names if c in columns]
                read_grid(self.spark, self.stores[name], order).createOrReplaceTempView(name)
            slim = self.spark.sql(text)
        finally:
            for name in narrowed:
                read_grid(self.spark, self.stores[name]).createOrReplaceTempView(name)
        self.last_io = IoStats()
        for name, columns in narrowed.items():
            meta = metadata(self.stores[name])
            for filters in scan_filters(slim, self.stores[name]) or [[]]:
                self.last_io += planned_io(meta, columns, plan(meta, columns, filters))
        return slim if slim.schema == df.schema else df

    def _with_information_schema(self, text: str) -> str:
        """Replaces information_schema.x by a view built from the session's catalog."""
        tables = self.spark.catalog.listTables()
        if re.search(r"information_schema\s*\.\s*columns", text, re.I):
            rows = []
            for t in tables:
                rows += [("spark", t.namespace[0] if t.namespace else "public", t.name, f.name, k + 1, f.dataType.simpleString(), "YES" if f.nullable else "NO") for k, f in enumerate(self.spark.table(t.name).schema.fields)]
            schema = "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string"
            self.spark.createDataFrame(rows, schema).createOrReplaceTempView("_information_columns")
        rows = [("spark", t.namespace[0] if t.namespace else "public", t.name, "VIEW" if t.isTemporary and t.name.lower() not in self.stores else "BASE TABLE") for t in tables if not t.name.startswith("_information_")]
        schema = "table_catalog string, table_schema string, table_name string, table_type string"
        self.spark.createDataFrame(rows, schema).createOrReplaceTempView("_information_tables")
        self.spark.createDataFrame([r for r in rows if r[3] == "VIEW"], schema).createOrReplaceTempView("_information_views")
        return SCHEMA_VIEW.sub(lambda m: f"_information_{m[1].lower()}", text)

    def _analyze(self, text: str) -> DataFrame:
        """Runs the query and returns the plan that ran, with its metrics, rows, time and the I/O of its scans."""
        began = time.perf_counter()
        df = self._optimized(text)
        rows, told = run_with_metrics(df)
        self.last_io.seconds = time.perf_counter() - began
        schema = T.StructType([T.StructField("plan_type", T.StringType()), T.StructField("plan", T.StringType())])
        return self.spark.createDataFrame([("Plan with Metrics", told), ("Statistics", self.last_io.line(rows))], schema)


def materialize(spark: SparkSession, path: str, target: str, partition_by: str | None = None) -> DataFrame:
    """Writes a store as Parquet partitioned by its outer coordinate (or another), for repeated queries: column and
    partition pruning and aggregates from footers are then Catalyst's own."""
    meta = metadata(path)
    by = partition_by or meta.coords[0].name
    read_grid(spark, path).write.mode("overwrite").partitionBy(by).parquet(target)
    return spark.read.schema(meta.schema()).parquet(target)
