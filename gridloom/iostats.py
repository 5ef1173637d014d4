"""I/O counters of scans, and sizes in decimal units."""

from __future__ import annotations

from dataclasses import dataclass, fields

from gridloom.sources.meta import StoreMeta

#: Decimal units.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_bytes(n: float) -> str:
    if n < 1000:
        return f"{int(n)} B"
    unit = 0
    while n >= 1000 and unit < len(UNITS) - 1:
        n /= 1000
        unit += 1
    return f"{n:.2f} {UNITS[unit]}"


@dataclass
class IoStats:
    """Decoded bytes by kind, bytes of metadata read, arrays touched, and seconds."""

    metadata_bytes: int = 0
    coord_bytes: int = 0
    data_bytes: int = 0
    coord_arrays: int = 0
    data_arrays: int = 0
    seconds: float = 0.0

    @property
    def arrays(self) -> int:
        return self.coord_arrays + self.data_arrays

    @property
    def memory_bytes(self) -> int:
        return self.metadata_bytes + self.coord_bytes + self.data_bytes

    def __add__(self, other: IoStats) -> IoStats:
        return IoStats(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(self)))

    def line(self, rows: int) -> str:
        return f"{rows} rows · {self.arrays} arrays · {format_bytes(self.memory_bytes)} mem · {self.seconds:.3f} s"


def planned_io(meta: StoreMeta, columns: list[str], partitions: list) -> IoStats:
    """What a scan of these partitions decodes: chunks of the variables in columns, and all coordinates."""
    arrays = [a for a in meta.variables if a.name in columns]
    data = 0
    for a in arrays:
        cells = set()
        for p in partitions:
            for box in p.boxes:
                cells.update(_cells(a, box))
        size = a.dtype.itemsize
        for c in a.chunks:
            size *= c
        data += size * len(cells)
    return IoStats(meta.metadata_bytes, sum(c.values.nbytes for c in meta.coords), data, len(meta.coords), len(arrays))


def _cells(array, box):
    from itertools import product

    return product(*(sorted({int(i) // c for i in (b[0], b[-1])} | set(range(int(b[0]) // c, int(b[-1]) // c + 1))) for b, c in zip(box, array.chunks)))
