"""Chunk codecs: raw bytes, zlib, gzip, zstd, lz4, blosc (lz4, zstd, zlib; byte and bit shuffle), crc32c trailers, transpose.

The blosc frame is written and read from its published format: a 16-byte header (version, codec version, flags,
type size, bytes, block size, compressed bytes), then block offsets, then per block one stream, or one a byte plane
if the block is split.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa

#: Fixed values of the blosc format: flag bits, and codec numbers in the flags' upper three bits.
SHUFFLE, MEMCPY, BITSHUFFLE, NOT_SPLIT = 0x1, 0x2, 0x4, 0x10
BLOSC_CODECS = {0: "blosclz", 1: "lz4", 2: "snappy", 3: "zlib", 4: "zstd"}


def _arrow(name: str) -> pa.Codec:
    return pa.Codec(name)


def _inflate(name: str, data: bytes, size: int) -> bytes:
    if name == "lz4":
        return _arrow("lz4_raw").decompress(data, size, asbytes=True)
    if name == "zstd":
        return _arrow("zstd").decompress(data, size, asbytes=True)
    if name == "snappy":
        return _arrow("snappy").decompress(data, size, asbytes=True)
    if name == "zlib":
        return zlib.decompress(data)
    raise ValueError(f"blosc codec {name!r} is not supported")


def unshuffle(data: bytes, width: int) -> bytes:
    n = len(data) // width
    head = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T.tobytes()
    return head + data[n * width :]


def shuffle(data: bytes, width: int) -> bytes:
    n = len(data) // width
    head = np.frombuffer(data, np.uint8, n * width).reshape(n, width).T.tobytes()
    return head + data[n * width :]


def bit_unshuffle(data: bytes, width: int) -> bytes:
    """Rows of the elements' bits, lowest first, back to elements; only blocks of a multiple of eight elements have them."""
    n = len(data) // width
    if n % 8:
        return data
    rows = np.frombuffer(data, np.uint8, n * width).reshape(8 * width, n // 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * width :]


def bit_shuffle(data: bytes, width: int) -> bytes:
    n = len(data) // width
    if n % 8:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n * width).reshape(n, width), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n * width :]


def blosc_decode(data: bytes) -> bytes:
    _, _, flags, width, size, block, packed = struct.unpack("<BBBBIII", data[:16])
    if flags & MEMCPY:
        return bytes(data[16 : 16 + size])
    name = BLOSC_CODECS.get(flags >> 5, "unknown")
    if not size:
        return b""
    n = -(-size // block)
    starts = struct.unpack(f"<{n}i", data[16 : 16 + 4 * n])
    out = []
    for k, at in enumerate(starts):
        want = min(block, size - k * block)
        whole = want == block
        streams = width if not flags & NOT_SPLIT and whole and width <= 16 and block // width >= 128 and name in ("lz4", "snappy", "blosclz") else 1
        parts = []
        for _ in range(streams):
            (length,) = struct.unpack("<i", data[at : at + 4])
            at += 4
            each = want // streams
            parts.append(bytes(data[at : at + length]) if length == each else _inflate(name, bytes(data[at : at + length]), each))
            at += length
        raw = b"".join(parts)
        if flags & BITSHUFFLE:
            raw = bit_unshuffle(raw, width)
        out.append(unshuffle(raw, width) if flags & SHUFFLE and width > 1 else raw)
    return b"".join(out)


def blosc_encode(data: bytes, width: int, name: str = "lz4", shuffled: bool | str = True, block: int = 1 << 18) -> bytes:
    """One or more unsplit blocks, shuffled by bytes or by 'bits'; a stream that does not shrink is stored."""
    if name not in ("lz4", "zstd", "zlib"):
        raise ValueError(f"cannot write blosc with {name!r}")
    size = len(data)
    block = max(width, min(block - block % width, max(size, width)))
    pieces = []
    for s in range(0, size, block):
        raw = data[s : s + block]
        if shuffled == "bits":
            raw = bit_shuffle(raw, width)
        elif shuffled and width > 1:
            raw = shuffle(raw, width)
        packed = zlib.compress(raw) if name == "zlib" else _arrow("lz4_raw" if name == "lz4" else "zstd").compress(raw, asbytes=True)
        packed = packed if len(packed) < len(raw) else raw
        pieces.append(struct.pack("<i", len(packed)) + packed)
    code = {v: k for k, v in BLOSC_CODECS.items()}[name]
    flags = (BITSHUFFLE if shuffled == "bits" else SHUFFLE if shuffled and width > 1 else 0) | NOT_SPLIT | code << 5
    at, starts = 16 + 4 * len(pieces), []
    for p in pieces:
        starts.append(at)
        at += len(p)
    return struct.pack("<BBBBIII", 2, 1, flags, width, size, block, at) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(pieces)


def decode(data: bytes, codecs: list[dict], size: int) -> bytes:
    """Undoes bytes-to-bytes codecs, the last first; size is the decoded chunk's."""
    for c in reversed(codecs):
        name = c["name"]
        if name == "blosc":
            data = blosc_decode(data)
        elif name == "zlib":
            data = zlib.decompress(data)
        elif name == "gzip":
            data = gzip.decompress(data)
        elif name == "zstd":
            import zstandard

            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif name == "lz4":  # 4-byte size, then a raw block
            (n,) = struct.unpack("<I", data[:4])
            data = _arrow("lz4_raw").decompress(bytes(data[4:]), n, asbytes=True)
        elif name == "crc32c":
            data = data[:-4]
        else:
            raise ValueError(f"codec {name!r} is not supported")
    return data


def encode(data: bytes, codecs: list[dict], width: int) -> bytes:
    for c in codecs:
        name = c["name"]
        if name == "blosc":
            how = c.get("shuffle", True)
            data = blosc_encode(data, width, c.get("cname", "lz4"), "bits" if how in (2, "bitshuffle") and how is not True else how not in (False, 0, "noshuffle"))
        elif name == "zlib":
            data = zlib.compress(data, c.get("level", 5))
        elif name == "gzip":
            data = gzip.compress(data, c.get("level", 5), mtime=0)
        elif name == "zstd":
            import zstandard

            data = zstandard.ZstdCompressor(level=c.get("level", 3)).compress(data)
        elif name == "lz4":
            data = struct.pack("<I", len(data)) + _arrow("lz4_raw").compress(data, asbytes=True)
        else:
            raise ValueError(f"cannot write codec {name!r}")
    return data
