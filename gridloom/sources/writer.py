"""Writing array stores: a small one from numpy arrays, or a grid from a DataFrame, chunk by chunk on the executors."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.codec import encode
from gridloom.sources.meta import TYPES
from gridloom.sources.store import Store

NAMES = {np.dtype(kind): name for name, (kind, _) in TYPES.items()}


def _plain(fill: object, dtype: np.dtype) -> object:
    if dtype.kind == "f" and not np.isfinite(fill):
        return "NaN" if np.isnan(fill) else "Infinity" if fill > 0 else "-Infinity"
    return bool(fill) if dtype.kind == "b" else str(fill) if dtype.kind in "SU" else int(fill) if dtype.kind in "iu" else float(fill)


def array_metadata(version: int, shape, chunks, dtype: np.dtype, fill=0, codecs=(), order: str = "C", dimensions=None, attributes=None, separator: str | None = None) -> dict[str, dict]:
    """File name: content of an array's metadata."""
    attributes = dict(attributes or {})
    if version == 2:
        packed = [{"id": c["name"], **{k: v for k, v in c.items() if k != "name"}} for c in codecs]
        meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype.str, "fill_value": _plain(fill, dtype), "order": order, "filters": None, "compressor": packed[0] if packed else None}
        if separator:
            meta["dimension_separator"] = separator
        if dimensions:
            attributes["_ARRAY_DIMENSIONS"] = list(dimensions)
        return {".zarray": meta, **({".zattrs": attributes} if attributes else {})}
    chain = [{"name": "transpose", "configuration": {"order": list(range(len(shape)))[::-1]}}] if order == "F" else []
    chain.append({"name": "bytes", "configuration": {"endian": "big" if dtype.str[0] == ">" else "little"}})
    chain += [{"name": c["name"], "configuration": {k: v for k, v in c.items() if k != "name"}} for c in codecs]
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": NAMES[dtype.newbyteorder("=")], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": separator or "/"}}, "fill_value": _plain(fill, dtype), "codecs": chain, "attributes": attributes}
    if dimensions:
        meta["dimension_names"] = list(dimensions)
    return {"zarr.json": meta}


def chunk_key(version: int, cell, separator: str | None = None) -> str:
    body = (separator or ("." if version == 2 else "/")).join(map(str, cell)) or "0"
    return body if version == 2 else f"c{separator or '/'}{body}"


def chunk_bytes(block: np.ndarray, chunks, dtype: np.dtype, fill, codecs, order: str) -> bytes:
    full = np.full(chunks, fill, dtype)
    full[tuple(slice(0, n) for n in block.shape)] = block
    return encode(full.tobytes("F" if order == "F" else "C"), list(codecs), dtype.itemsize)


def write_array(store: Store, name: str, values: np.ndarray, chunks=None, version: int = 3, fill=0, codecs=(), order: str = "C", dimensions=None, attributes=None, skip_fill: bool = False, separator: str | None = None) -> None:
    chunks = tuple(chunks or values.shape)
    for file, meta in array_metadata(version, values.shape, chunks, values.dtype, fill, codecs, order, dimensions, attributes, separator).items():
        store.put(f"{name}/{file}", json.dumps(meta).encode())
    for cell in np.ndindex(*[-(-n // c) for n, c in zip(values.shape, chunks)]):
        block = values[tuple(slice(k * c, (k + 1) * c) for k, c in zip(cell, chunks))]
        if not (skip_fill and (block == fill).all()):
            store.put(f"{name}/{chunk_key(version, cell, separator)}", chunk_bytes(block, chunks, values.dtype, fill, codecs, order))


def write_group(store: Store, version: int, attributes: dict | None = None) -> None:
    if version == 2:
        store.put(".zgroup", json.dumps({"zarr_format": 2}).encode())
        store.put(".zattrs", json.dumps(attributes or {}).encode())
    else:
        store.put("zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": attributes or {}}).encode())


def write_store(path: str, coords: dict[str, np.ndarray], variables: dict[str, np.ndarray], chunks=None, version: int = 3, codecs=(), named: bool = True, **options) -> str:
    """A store of coordinates (in the order of the axes) and variables over all of them."""
    store = Store(path)
    write_group(store, version)
    for name, values in coords.items():
        write_array(store, name, np.asarray(values), version=version, codecs=codecs, dimensions=(name,) if named else None)
    for name, values in variables.items():
        write_array(store, name, np.asarray(values), chunks, version, codecs=codecs, dimensions=tuple(coords) if named else None, **options)
    return path


def save_grid(df: DataFrame, path: str, dims: list[str], measures: list[str], chunks: list[int], version: int = 3, codecs=(), fill=0) -> str:
    """Writes df as a store: each dims combination is a cell; absent cells get the fill value.

    Coordinates (distinct values per dimension, sorted) are metadata and pass through the driver; cells are dealt by
    chunk and each chunk is written by the task that holds it.  A chunk is the unit of memory.
    """
    axes = {d: [r[0] for r in df.select(d).distinct().orderBy(d).toLocalIterator()] for d in dims}
    kinds = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8", "boolean": "b1"}
    types = dict(df.dtypes)
    shape, chunks, codecs = tuple(len(axes[d]) for d in dims), tuple(chunks), list(codecs)
    store = Store(path)
    write_group(store, version)
    for d in dims:
        write_array(store, d, np.array(axes[d], kinds[types[d]]), version=version, dimensions=(d,), codecs=codecs)
    for m in measures:
        for file, meta in array_metadata(version, shape, chunks, np.dtype(kinds[types[m]]), fill, codecs, dimensions=dims).items():
            store.put(f"{m}/{file}", json.dumps(meta).encode())
    placed = df.select(*dims, *measures)
    spark = df.sparkSession
    for d, size in zip(dims, chunks):
        index = spark.createDataFrame([(v, k) for k, v in enumerate(axes[d])], f"`{d}` {types[d]}, `_i_{d}` bigint")
        placed = placed.join(index, d).withColumn(f"_c_{d}", F.floor(F.col(f"_i_{d}") / size))
    cell_columns = [f"_c_{d}" for d in dims]

    def write(key, table):
        cell = tuple(k.as_py() for k in key)
        own = Store(path)
        at = tuple(table.column(f"_i_{d}").to_numpy() - k * c for d, k, c in zip(dims, cell, chunks))
        for m in measures:
            dtype = np.dtype(kinds[types[m]])
            block = np.full(chunks, fill, dtype)
            block[at] = table.column(m).to_numpy()
            own.put(f"{m}/{chunk_key(version, cell)}", chunk_bytes(block, chunks, dtype, fill, codecs, "C"))
        return pa.table({"cells": pa.array([table.num_rows], pa.int64())})

    placed.groupBy(*cell_columns).applyInArrow(write, "cells long").agg(F.sum("cells")).collect()
    return path
