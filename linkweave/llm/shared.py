"""What the operators share: shared-folder tables, word splitting, hashing.

Words are runs of bytes other than the six ASCII blanks ``\\x20 \\x09-\\x0D``;
that is what ``bytes.split()`` splits on, so no regular expression is needed.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.plans.lineage import Scratch, new_path, remove, staged, work_dir

__all__ = ["Scratch", "new_path", "remove", "staged", "work_dir"]

#: The same words as a Java / RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Words of a text (long); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = True
_BYTE = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)
_STRETCH = 1 << 18
_powers: list[np.ndarray] = []


def _power_table(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64; at least n of each."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            size = max(n, _STRETCH + 1024)
            inverse = pow(_STEP, -1, 1 << 64)
            _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_STEP, inverse)]
    return _powers


def _stretch_hashes(b: np.ndarray) -> np.ndarray:
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = _BLANK[b]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_table(len(b))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * power[: len(b)], out=sums[1:])
        # The length keeps words of bytes that add nothing apart.
        return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order: polynomials over their bytes,
    by prefix sums over the text instead of word by word."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= _STRETCH:
        return _stretch_hashes(b)
    parts, at = [], 0
    while at < len(b):
        cut = min(len(b), at + _STRETCH)
        while cut < len(b) and not _BLANK[b[cut]]:
            ahead = np.flatnonzero(_BLANK[b[cut : cut + _STRETCH]])
            cut = cut + int(ahead[0]) if len(ahead) else min(len(b), cut + _STRETCH)
        parts.append(_stretch_hashes(b[at:cut]))
        at = cut
    return np.concatenate(parts)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    width_here = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width_here + 1, width_here, np.uint64)
        for i in range(width_here):
            out = out * np.uint64(_STEP) + hashes[i : n - width_here + 1 + i]
    return mixed(out)


def quoted(name: str) -> Column:
    """A top-level column by its whole name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """base, with as many '_' behind as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def fingerprints(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a hash of all columns of a row, as two longs."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = quoted(f.name)
        # Hashes pass nulls over, and know no maps and variants.
        whole = F.to_json(F.struct(c)) if any(x in f.dataType.simpleString() for x in ("map<", "variant")) else c
        parts += [whole, c.isNull()]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def slices(rows: pa.RecordBatch | pa.Array, column: int = 0, most: int = 2 << 20):
    """Pieces of a batch, or of a string column, with about so many bytes of text each,
    so that what Python makes of them stays small whatever the batch."""
    sizes = pc.binary_length(rows.column(column) if isinstance(rows, pa.RecordBatch) else rows)
    sizes = np.cumsum(np.asarray(pc.fill_null(sizes, 0), np.int64))
    at = 0
    while at < len(sizes):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield rows.slice(at, upto - at)
        at = upto


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def tidy() -> None:
    """Gives freed memory back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
