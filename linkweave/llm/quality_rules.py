"""Quality rules: compression bands over the base counts of a text.

Repetitive text compresses far better than prose and random text far worse, and
both depend on length; so zstandard ratios (raw bytes / compressed bytes) are
held against limits for the text's length, over the whole text and over fixed
chunks of it. The operator is one Arrow UDF over the text: no shuffle, and the
other columns never leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, raw_texts, slices, tidy

VERDICT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,ratio:double,chunks_out:double,kept:boolean,reason:string>"
)


@dataclass(frozen=True)
class Bands:
    """Limits by length: (up to so many bytes, least ratio, greatest ratio).

    A text is rejected if its whole ratio leaves the band of its length, or if
    more than `max_chunks_out` of its chunk bytes lie in chunks that leave the
    chunk band. A last chunk of under a quarter of `chunk_bytes` is too short to
    tell and does not count, unless it is the only one; a longer one is held
    against the least ratio of its own length, if that is lower.

    Least ratios lie above what words of random base64 and base85 letters give at
    the upper end of the length, from 1,024 bytes on also of random lower-case
    letters (whose ratios meet those of prose below that), and under prose at its
    lower end."""

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.0, 2.2),
        (192, 1.1, 2.2),
        (256, 1.15, 2.2),
        (320, 1.22, 2.2),
        (384, 1.27, 2.2),
        (512, 1.33, 2.2),
        (768, 1.38, 2.3),
        (1024, 1.5, 2.3),
        (1280, 1.65, 2.4),
        (1536, 1.69, 2.4),
        (2048, 1.72, 2.4),
        (4096, 1.75, 2.6),
        (16384, 1.78, 3.0),
        (65536, 1.8, 3.5),
        (float("inf"), 1.8, 4.0),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.72, 3.0)
    max_chunks_out: float = 0.3
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50

    def limits(self, n_bytes: int) -> tuple[float, float]:
        return next((low, high) for upto, low, high in self.whole if n_bytes <= upto)

    def chunk_limits(self, n_bytes: int) -> tuple[float, float]:
        low, high = self.chunk
        return (low if n_bytes >= self.chunk_bytes else min(low, self.limits(n_bytes)[0])), high


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a `width`-word window found twice or more, its first place included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    key = codes[:n]
    for i in range(1, width):
        key = key * len(ids) + codes[i : n + i]
        if i + 1 < width and len(ids) > 1_000_000:  # the next product might not fit
            key = np.unique(key, return_inverse=True)[1]
    _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
    if len(counts) == n:
        return 0
    hit, covered = counts[at] > 1, np.zeros(len(words), bool)
    for i in range(width):
        covered[i : n + i] |= hit
    return int(covered.sum())


def judge(raw: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, rep = len(words), repeat_words(words)
    base_failed = n < bands.min_words or 100 * rep > bands.max_repeat_percent * n
    size = lambda x: len(compressor.compress(x))
    ratio, out, reason = 0.0, 0.0, "too_short" if n < bands.min_words else "repeated_words" if base_failed else None
    if raw:
        ratio = len(raw) / size(raw)
        chunks = [raw[i : i + bands.chunk_bytes] for i in range(0, len(raw), bands.chunk_bytes)]
        if len(chunks) > 1 and len(chunks[-1]) < bands.chunk_bytes // 4:
            chunks.pop()
        if len(chunks) > 1:
            odd = 0
            for c in chunks:
                low, high = bands.chunk_limits(len(c))
                odd += 0 if low <= len(c) / size(c) <= high else len(c)
            out = odd / sum(map(len, chunks))
        low, high = bands.limits(len(raw))
        if not base_failed:
            reason = "incompressible" if ratio < low else "repetitive" if ratio > high else "chunks" if out > bands.max_chunks_out else None
    return (
        n,
        len(b"".join(words).decode("utf-8", "replace")),
        len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        rep,
        base_failed,
        ratio,
        out,
        reason is None,
        reason,
    )


def verdict(text: Column, bands: Bands = Bands()) -> Column:
    """Struct of counts, ratios, `base_failed`, `kept` and `reason` for each text.

    Null and empty texts: no words, ratio 0, base_failed, not kept. Every text is
    read whole."""

    @F.arrow_udf(VERDICT)
    def of(texts: pa.Array) -> pa.Array:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(x or b"", bands, compressor) for part in slices(texts) for x in raw_texts(part)]
        tidy()
        names = [x.split(":")[0] for x in VERDICT[7:-1].split(",")]
        kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.float64(), pa.bool_(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names) if rows else pa.array([], pa.struct(list(zip(names, kinds, strict=True))))

    return of(text)


def compression_bands(docs: DataFrame, text: str = "text", bands: Bands = Bands(), into: str = "verdict") -> DataFrame:
    """docs with the struct `into`. A column of that name is replaced; all others,
    whatever their names, and rows, repeated or not and in any number, stay as they
    are. Null and empty texts: see `verdict`; texts are read whole."""
    return docs.withColumn(into, verdict(quoted(text), bands))


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs, whatever their names;
    repeated rows are kept or rejected alike."""
    return docs.where(verdict(quoted(text), bands)["kept"])
