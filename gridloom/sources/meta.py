"""Discovery of array stores (format versions 2 and 3) and the table they make.

A store is one flat group.  A one-dimensional array that names its own dimension is a coordinate, other arrays are
variables; the table has one row per cell of the product of all coordinates.  Axes are named by the arrays' dimension
names where there are any, else by size, ties in the order of names.  Minimum and maximum of a coordinate keep its type.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import types as T

from gridloom.sources.codec import decode
from gridloom.sources.store import Store

#: Data type names of format version 3, their numpy kinds and the column types they become.
TYPES = {
    "int8": ("i1", T.ByteType()),
    "int16": ("i2", T.ShortType()),
    "int32": ("i4", T.IntegerType()),
    "int64": ("i8", T.LongType()),
    "uint8": ("u1", T.ShortType()),
    "uint16": ("u2", T.IntegerType()),
    "uint32": ("u4", T.LongType()),
    "uint64": ("u8", T.DecimalType(20, 0)),
    "float16": ("f2", T.FloatType()),
    "float32": ("f4", T.FloatType()),
    "float64": ("f8", T.DoubleType()),
    "bool": ("b1", T.BooleanType()),
}


class StoreError(ValueError):
    """The path holds no store that can be a table; the message names the array at fault."""


def parse_v2_dtype(text: object, name: str = "") -> np.dtype:
    if not isinstance(text, str):
        raise StoreError(f"array {name!r}: structured data types are not supported")
    if not re.fullmatch(r"[<>|=]?([iuf][1248]|b1|[SU]\d+)", text):
        raise StoreError(f"array {name!r}: unknown data type {text!r}")
    return np.dtype(text)


def column_type(dtype: np.dtype) -> T.DataType:
    if dtype.kind in "SU":
        return T.StringType()
    for kind, column in TYPES.values():
        if dtype.newbyteorder("=") == np.dtype(kind):
            return column
    raise StoreError(f"data type {dtype} is not supported")


@dataclass(frozen=True)
class ArrayMeta:
    name: str
    dtype: np.dtype
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    fill: object
    codecs: tuple[dict, ...]
    order: tuple[int, ...]  # axes in the order in which a chunk stores them
    separator: str
    prefix: str
    dimensions: tuple[str, ...] | None
    attributes: dict = field(default_factory=dict, hash=False, compare=False)
    shards: Shards | None = None

    def key(self, cell: tuple[int, ...]) -> str:
        if self.prefix and not cell:
            return f"{self.name}/{self.prefix}"
        body = self.separator.join(map(str, cell)) or "0"
        return f"{self.name}/{self.prefix}{self.separator if self.prefix else ''}{body}"

    def chunk(self, store: Store, cell: tuple[int, ...]) -> np.ndarray:
        """A whole chunk, padded past the array's edge as it is stored; fill values if the store lacks it."""
        data = store.get(self.key(cell))
        if data is None:
            return np.full(self.chunks, self.fill, self.dtype)
        return self.unpack(data)

    def unpack(self, data: bytes) -> np.ndarray:
        raw = decode(data, list(self.codecs), int(np.prod(self.chunks)) * self.dtype.itemsize)
        stored = [self.chunks[a] for a in self.order]
        cells = self.shards.assemble(raw, stored).astype(self.dtype, copy=False) if self.shards else np.frombuffer(raw, self.dtype, int(np.prod(stored))).reshape(stored)
        return cells.transpose(np.argsort(self.order))

    def region(self, store: Store, box: tuple[tuple[int, int], ...]) -> np.ndarray:
        """The cells start <= i < stop of each axis, from the chunks that overlap them."""
        out = np.empty([b - a for a, b in box], self.dtype)
        ranges = [range(a // c, -(-b // c)) for (a, b), c in zip(box, self.chunks)]
        for cell in np.ndindex(*[len(r) for r in ranges]):
            cell = tuple(r[k] for r, k in zip(ranges, cell))
            data = self.chunk(store, cell)
            src, dst = [], []
            for (a, b), c, k in zip(box, self.chunks, cell):
                lo, hi = max(a, k * c), min(b, (k + 1) * c)
                src.append(slice(lo - k * c, hi - k * c))
                dst.append(slice(lo - a, hi - a))
            out[tuple(dst)] = data[tuple(src)]
        return out


@dataclass(frozen=True)
class Shards:
    """Chunks that hold smaller chunks: an index of (offset, length) pairs at one end tells where each of them lies."""

    inner: ArrayMeta
    index: tuple[dict, ...]
    order: str  # byte order of the index
    first: bool

    def assemble(self, raw: bytes, shape: list[int]) -> np.ndarray:
        counts = [s // c for s, c in zip(shape, self.inner.chunks)]
        size = 16 * int(np.prod(counts))
        stored = size + 4 * len(self.index)  # a checksum has four bytes
        index = decode(raw[:stored] if self.first else raw[len(raw) - stored :], list(self.index), size)
        places = np.frombuffer(index, f"{self.order}u8").reshape(*counts, 2)
        out = np.full(shape, self.inner.fill, self.inner.dtype)
        for cell in np.ndindex(*counts):
            at, length = map(int, places[cell])
            if at != 2**64 - 1:  # the mark of a chunk that is not stored
                out[tuple(slice(k * c, k * c + c) for k, c in zip(cell, self.inner.chunks))] = self.inner.unpack(raw[at : at + length])
        return out


@dataclass(frozen=True)
class Coordinate:
    array: ArrayMeta
    values: np.ndarray

    @property
    def name(self) -> str:
        return self.array.name


@dataclass(frozen=True)
class StoreMeta:
    path: str
    version: int
    coords: tuple[Coordinate, ...]
    variables: tuple[ArrayMeta, ...]
    metadata_bytes: int = 0

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(c.values) for c in self.coords)

    @property
    def total_rows(self) -> int:
        return int(np.prod([len(c.values) for c in self.coords], dtype=object))

    def schema(self) -> T.StructType:
        fields = [T.StructField(c.name, column_type(c.array.dtype), False) for c in self.coords]
        return T.StructType(fields + [T.StructField(v.name, column_type(v.dtype), True) for v in self.variables])

    def statistics(self) -> dict:
        """Exact rows; per coordinate distinct count, minimum and maximum in its own type (None where it has NaN)."""
        out = {"rows": self.total_rows, "columns": {}}
        for c in self.coords:
            v = c.values
            plain = len(v) and not (v.dtype.kind == "f" and np.isnan(v).any())
            out["columns"][c.name] = {"nulls": 0, "distinct": len(np.unique(v)), "min": v.min().item() if plain and v.dtype.kind not in "SU" else None, "max": v.max().item() if plain and v.dtype.kind not in "SU" else None}
        for a in self.variables:
            out["columns"][a.name] = {"nulls": 0}
        return out


def _json(data: bytes, what: str) -> dict:
    try:
        found = json.loads(data)
    except ValueError as e:
        raise StoreError(f"{what}: not JSON ({e})") from None
    if not isinstance(found, dict):
        raise StoreError(f"{what}: not a JSON object")
    return found


def _fill(value: object, dtype: np.dtype) -> object:
    if value is None:
        return "" if dtype.kind in "SU" else 0
    if isinstance(value, str) and dtype.kind == "f":
        if value.startswith("0x"):
            return np.frombuffer(bytes.fromhex(value[2:]), dtype.newbyteorder(">"))[0]
        return float(value.replace("Infinity", "inf"))
    return value


def detect_version(store: Store) -> int:
    if store.get("zarr.json") is not None:
        return 3
    if store.get(".zgroup") is not None or store.get(".zarray") is not None:
        return 2
    for name in store.children():
        if store.get(f"{name}/zarr.json") is not None:
            return 3
        if store.get(f"{name}/.zarray") is not None:
            return 2
    raise StoreError(f"{store.path!r} is not an array store")


def _array_v2(store: Store, name: str) -> ArrayMeta | None:
    data = store.get(f"{name}/.zarray")
    if data is None:
        return None
    m = _json(data, f"{name}/.zarray")
    extra = store.get(f"{name}/.zattrs")
    attributes = _json(extra, f"{name}/.zattrs") if extra else {}
    dtype = parse_v2_dtype(m.get("dtype", "<f8"), name)
    codecs = [{"name": f["id"], **f} for f in m.get("filters") or []]
    if m.get("compressor"):
        codecs.append({"name": m["compressor"]["id"], **m["compressor"]})
    shape = tuple(m["shape"])
    axes = tuple(range(len(shape)))
    names = attributes.get("_ARRAY_DIMENSIONS")
    return ArrayMeta(name, dtype, shape, tuple(m["chunks"]), _fill(m.get("fill_value"), dtype), tuple(codecs), axes[::-1] if m.get("order") == "F" else axes, m.get("dimension_separator", "."), "", tuple(names) if names else None, attributes)


def _array_v3(store: Store, name: str) -> ArrayMeta | None:
    data = store.get(f"{name}/zarr.json")
    if data is None:
        return None
    m = _json(data, f"{name}/zarr.json")
    if m.get("node_type") != "array":
        return None
    kind = m.get("data_type", "float64")
    if kind not in TYPES:
        raise StoreError(f"array {name!r}: unknown data type {kind!r}")
    dtype = np.dtype(TYPES[kind][0])
    shape = tuple(m["shape"])
    fill, chunks = _fill(m.get("fill_value"), dtype), tuple(m["chunk_grid"]["configuration"]["chunk_shape"])
    dtype, codecs, order, shards = _chain(name, m.get("codecs") or [{"name": "bytes"}], dtype, fill, chunks)
    encoding = m.get("chunk_key_encoding") or {"name": "default"}
    separator = (encoding.get("configuration") or {}).get("separator", "/" if encoding["name"] == "default" else ".")
    names = m.get("dimension_names")
    names = tuple(names) if names and all(names) else None
    return ArrayMeta(name, dtype, shape, chunks, fill, codecs, order, separator, "c" if encoding["name"] == "default" else "", names, m.get("attributes") or {}, shards)


def _chain(name: str, chain: list[dict], dtype: np.dtype, fill, chunks: tuple[int, ...]) -> tuple:
    """Byte order, bytes-to-bytes codecs, order of axes and shards of a chunk's codecs."""
    order, codecs, shards, seen = tuple(range(len(chunks))), [], None, False
    for c in chain:
        config = c.get("configuration") or {}
        if c["name"] == "transpose":
            order = tuple(order[a] for a in config["order"])
        elif c["name"] == "bytes":
            seen = True
            if config.get("endian", "little") == "big":
                dtype = dtype.newbyteorder(">")
        elif c["name"] == "sharding_indexed":
            seen = True
            shards = _shards(name, config, dtype, fill, [chunks[a] for a in order])
        elif not seen:
            raise StoreError(f"array {name!r}: codec {c['name']!r} is not supported")
        else:
            codecs.append({"name": c["name"], **config})
    return dtype, tuple(codecs), order, shards


def _shards(name: str, config: dict, dtype: np.dtype, fill, shape: list[int]) -> Shards:
    chunks = tuple(config["chunk_shape"])
    if len(chunks) != len(shape) or any(s % c for s, c in zip(shape, chunks)):
        raise StoreError(f"array {name!r}: chunks of {chunks} do not divide shards of {tuple(shape)}")
    dtype, codecs, order, shards = _chain(name, config.get("codecs") or [{"name": "bytes"}], dtype, fill, chunks)
    inner = ArrayMeta(name, dtype, tuple(shape), chunks, fill, codecs, order, "/", "c", None, {}, shards)
    index_type, index, _, _ = _chain(name, config.get("index_codecs") or [{"name": "bytes"}], np.dtype("<u8"), 0, chunks)
    if any(c["name"] != "crc32c" for c in index):
        raise StoreError(f"array {name!r}: a shard's index must have a fixed size")
    return Shards(inner, index, ">" if index_type.str[0] == ">" else "<", config.get("index_location", "end") == "start")


def _axes_by_size(variable: ArrayMeta, coords: list[ArrayMeta]) -> list[str] | None:
    left, named = sorted(coords, key=lambda c: c.name), []
    for size in variable.shape:
        match = next((c for c in left if c.shape[0] == size), None)
        if match is None:
            return None
        left.remove(match)
        named.append(match.name)
    return named


def discover(path: str, options: dict | None = None) -> StoreMeta:
    store = Store(path, options)
    version = detect_version(store)
    read = _array_v2 if version == 2 else _array_v3
    arrays = [a for n in store.children() if (a := read(store, n)) is not None]
    if not arrays:
        raise StoreError(f"{path!r} holds no arrays")
    coords = [a for a in arrays if len(a.shape) == 1 and (a.dimensions is None or a.dimensions == (a.name,))]
    variables = sorted((a for a in arrays if a not in coords), key=lambda a: a.name)
    if not coords:
        raise StoreError(f"{path!r} has no coordinate: no one-dimensional array names its own dimension")
    by_name = {c.name: c for c in coords}
    full = [v for v in variables if len(v.shape) == len(coords)]
    order = None
    for v in full:
        if v.dimensions:
            if set(v.dimensions) == set(by_name):
                order = list(v.dimensions)
                break
        else:
            order = _axes_by_size(v, coords)
            if order:
                break
    order = order or sorted(by_name)
    shape = tuple(by_name[n].shape[0] for n in order)
    for v in variables:
        if v.shape != shape or (v.dimensions and list(v.dimensions) != order):
            raise StoreError(f"variable {v.name!r} has shape {v.shape} over {v.dimensions or 'unnamed axes'}; the table's is {shape} over {tuple(order)}")
    found = []
    for n in order:
        a = by_name[n]
        found.append(Coordinate(a, a.region(store, ((0, a.shape[0]),))))
    return StoreMeta(path, version, tuple(found), tuple(variables), store.bytes_read)
