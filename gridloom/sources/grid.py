"""The `zarr` data source: an array store as a table, one row per cell, read chunk by chunk.

Filters on coordinates choose the cells of each axis before anything is read, and are handed back so that Spark checks
them again.  Boxes of whole chunks are grouped into partitions of about `partition_rows` cells; variables outside the
schema are never opened.  Equality, IN, ranges and null checks are used; everything else is Spark's.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from gridloom.sources.meta import Coordinate, StoreMeta, discover
from gridloom.sources.store import Store

PARTITION_ROWS = 1 << 20
BATCH_ROWS = 1 << 16
_cache: dict[tuple, tuple[float, StoreMeta]] = {}
CACHE_SECONDS = 5.0


def metadata(path: str, options: dict | None = None, fresh: bool = False) -> StoreMeta:
    """Discovered metadata; within a process a scan and its planning share one discovery for a few seconds."""
    key = (path, tuple(sorted((options or {}).items())))
    found = _cache.get(key)
    if fresh or found is None or time.monotonic() - found[0] > CACHE_SECONDS:
        _cache[key] = found = (time.monotonic(), discover(path, options))
    return found[1]


def matching(c: Coordinate, filters: list) -> np.ndarray:
    """Places of the coordinate's values that can satisfy the filters: every equal value, never too few."""
    v = c.values
    keep = np.ones(len(v), bool)
    for f in filters:
        if isinstance(f, IsNull) or (not isinstance(f, In) and f.value is None):
            keep[:] = False
            continue
        values = f.value if isinstance(f, In) else [f.value]
        if v.dtype.kind in "SU" or not all(isinstance(x, (int, float, bool)) for x in values):
            continue  # not comparable here: Spark decides
        if v.dtype.kind == "f":
            near = lambda x: np.isclose(v, x, rtol=1e-6, atol=1e-12) | (np.isnan(v) & np.isnan(x))
        else:
            near = lambda x: v == x
        if isinstance(f, (EqualTo, EqualNullSafe)):
            keep &= near(values[0])
        elif isinstance(f, In):
            keep &= np.logical_or.reduce([near(x) for x in values if x is not None] or [np.zeros(len(v), bool)])
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):  # NaN is the largest value for Spark
            keep &= (v >= values[0]) | near(values[0]) | (np.isnan(v) if v.dtype.kind == "f" else False)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            keep &= (v <= values[0]) | near(values[0]) | (np.isnan(values[0]) if v.dtype.kind == "f" else False)
    return np.flatnonzero(keep)


class Boxes(InputPartition):
    """Boxes of cells: for each axis the chosen places, all within one chunk of the base grid."""

    def __init__(self, boxes: list[tuple[np.ndarray, ...]]):
        self.boxes = boxes


def plan(meta: StoreMeta, columns: list[str], filters: list, partition_rows: int = PARTITION_ROWS) -> list[Boxes]:
    """Partitions of the cells that can satisfy the filters."""
    chosen = [matching(c, [f for f in filters if f.attribute == (c.name,)]) for c in meta.coords]
    if any(not len(x) for x in chosen):
        return []
    arrays = [a for a in meta.variables if a.name in columns]
    if arrays:
        grid = [max(a.chunks[k] for a in arrays) for k in range(len(meta.coords))]
    else:  # only coordinates: cut the outer axes into boxes of bounded size
        grid, room = [], max(1, partition_rows)
        for n in reversed(meta.shape):
            grid.insert(0, max(1, min(n, room)))
            room = max(1, room // max(1, n))
    parts = []
    for places, size in zip(chosen, grid):
        cell = places // size
        parts.append(np.split(places, np.flatnonzero(cell[1:] != cell[:-1]) + 1))
    out, boxes, rows = [], [], 0
    for at in np.ndindex(*map(len, parts)):
        box = tuple(p[k] for p, k in zip(parts, at))
        n = int(np.prod([len(b) for b in box]))
        if boxes and rows + n > partition_rows:
            out.append(Boxes(boxes))
            boxes, rows = [], 0
        boxes.append(box)
        rows += n
    out.append(Boxes(boxes))
    return out


def column(values: np.ndarray, kind: T.DataType, arrow: pa.DataType) -> pa.Array:
    if values.dtype.kind == "S":
        return pa.array([v.decode("utf-8", "replace") for v in values.tolist()], arrow)
    if isinstance(kind, T.DecimalType):
        return pa.array(values.tolist(), pa.decimal128(20, 0)).cast(arrow)
    if values.dtype.byteorder not in "=|":
        values = values.astype(values.dtype.newbyteorder("="))
    return pa.array(values).cast(arrow)


def read_boxes(meta: StoreMeta, schema: T.StructType, boxes: list[tuple[np.ndarray, ...]], store: Store, batch_rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows of the boxes in row-major order, as Arrow batches."""
    arrow = to_arrow_schema(schema)
    coords = {c.name: k for k, c in enumerate(meta.coords)}
    variables = {v.name: v for v in meta.variables}
    for box in boxes:
        shape = tuple(len(b) for b in box)
        n = int(np.prod(shape))
        columns = []
        for f, field in zip(schema.fields, arrow):
            if f.name in coords:
                k = coords[f.name]
                v = meta.coords[k].values[box[k]].reshape([-1 if a == k else 1 for a in range(len(shape))])
                flat = np.broadcast_to(v, shape).reshape(-1)
            else:
                region = variables[f.name].region(store, tuple((int(b[0]), int(b[-1]) + 1) for b in box))
                if any(len(b) != s for b, s in zip(box, region.shape)):
                    region = region[np.ix_(*[b - b[0] for b in box])]
                flat = region.reshape(-1)
            columns.append(column(flat, f.dataType, field.type))
        if not columns:
            raise ValueError("a scan needs a column")
        whole = pa.RecordBatch.from_arrays(columns, schema=arrow)
        for s in range(0, n, batch_rows):
            yield whole.slice(s, batch_rows)


class GridReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, dict(options)
        self.filters: list = []

    def _meta(self) -> StoreMeta:
        return metadata(self.options["path"], {k: v for k, v in self.options.items() if k != "path"})

    def pushFilters(self, filters):
        names = {c.name for c in self._meta().coords}
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNull)) and len(f.attribute) == 1 and f.attribute[0] in names:
                self.filters.append(f)
            yield f

    def partitions(self):
        return plan(self._meta(), self.schema.names, self.filters, int(self.options.get("partition_rows", PARTITION_ROWS)))

    def read(self, partition):
        if partition is None:  # Spark asks once when there is nothing to read
            return
        meta = self._meta()
        yield from read_boxes(meta, self.schema, partition.boxes, Store(self.options["path"], self.options))


class GridSource(DataSource):
    """spark.read.format("zarr").load(path); options: path, partition_rows, and those of the file system."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("the zarr source needs a path; use CREATE TEMPORARY VIEW ... USING zarr OPTIONS (path '...')")
        return path

    def schema(self) -> T.StructType:
        return metadata(self._path(), {k: v for k, v in self.options.items() if k != "path"}).schema()

    def reader(self, schema: T.StructType) -> GridReader:
        self._path()
        known = set(self.schema().names)
        missing = [n for n in schema.names if n not in known]
        if missing:
            raise ValueError(f"the store has no {', '.join(missing)}")
        return GridReader(schema, self.options)


def register(spark) -> None:
    """Makes the source known to a session."""
    from gridloom.session import ensure_importable

    ensure_importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)


def read_grid(spark, path: str, columns: list[str] | None = None, **options):
    """DataFrame over a store; only the named columns are read."""
    register(spark)
    reader = spark.read.format("zarr").options(**{k: str(v) for k, v in options.items()})
    if columns is not None:
        full = metadata(path, {k: str(v) for k, v in options.items()}).schema()
        reader = reader.schema(T.StructType([full[c] for c in columns]))
    return reader.load(path)
