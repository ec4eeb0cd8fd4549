"""Token-ID output in training order.

Documents become token sequences; every sequence has a dense index, and a keyed
Feistel permutation (cycle-walking back into the range) gives it a global slot.
Slot ranges are shards: files of fixed-stride records, so that slot s stands in
shard s // per_shard at byte (s % per_shard) * stride, and a reader resumes
anywhere without an index.

The scan runs twice, once to count the sequences of each task and once to write
them, and its partitions are the same both times; the second run checks that.
"""

from __future__ import annotations

import base64
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mixed, partitions, slices, tidy

#: doc_id, window, number of tokens; then the tokens; then a line end.
HEADER = np.dtype([("doc_id", "<i8"), ("window", "<i4"), ("n", "<i4")])
NO_DOC = np.iinfo(np.int64).min


class Feistel:
    """A keyed permutation of range(n)."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        seeds = np.random.default_rng(key).integers(1, 2**63, rounds, dtype=np.int64)
        self.keys = [np.uint64(int(x)) for x in seeds]

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(x + key) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> h, x & mask
        for key in reversed(self.keys) if back else self.keys:
            a, b = (b ^ self._round(a, key), a) if back else (b, a ^ self._round(b, key))
        return (a << h) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        y = self._once(np.asarray(x, np.uint64), back)
        while (out := y >= np.uint64(self.n)).any():
            y[out] = self._once(y[out], back)
        return y.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


#: Texts in which a space might not begin a pre-token: next to another blank, or
#: at an end; and texts with any blank but space and line feed.
_UNSAFE = r"  | \n|\n |^[ \n]|[ \n]$|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class ByteBpe:
    """Byte-level BPE ids (little-endian uint16) from a public rank file.

    A single space between two non-blanks always begins a pre-token, so texts fall
    apart there: the distinct words of many texts are encoded once, all in one call
    (a token that begins with a space begins a word), and texts gather their ids.
    Texts where that might not hold are encoded one by one."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1  # a free id: end of text
        if self.end >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.begins = np.zeros(self.end + 1, bool)
        for token, i in table.items():
            self.begins[i] = token[:1] == b" "

    def one(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint16)

    def _lengths_and_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Safe texts (without null) as words: (list offsets, index of each word among the
        distinct ones, (first token, number of tokens) of those and their ids)."""
        words = pc.split_pattern(texts, " ")
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        ids = self.one(" " + pc.binary_join(distinct, " ")[0].as_py())
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(coded.dictionary):
            raise RuntimeError("words and tokens do not agree")
        return offsets - offsets[0], coded.indices.to_numpy(), [first, np.diff(np.append(first, len(ids))), ids]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's); none for null and empty."""
        n = len(texts)
        counts = np.zeros(n, np.int64)
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        odd = pc.fill_null(pc.match_substring_regex(texts, _UNSAFE), False)
        safe = np.flatnonzero(pc.and_not(some, odd).to_numpy(zero_copy_only=False))
        rest = {int(i): self.one(texts[int(i)].as_py()) for i in np.flatnonzero(pc.and_(some, odd).to_numpy(zero_copy_only=False))}
        for i, ids in rest.items():
            counts[i] = len(ids)
        flat = np.empty(0, np.uint16)
        if len(safe):
            offsets, index, (first, size, ids) = self._lengths_and_ids(texts.take(pa.array(safe)))
            heads = offsets[:-1]  # a text's first word has no space in front
            bare = [self.one(w) for w in pc.list_element(pc.split_pattern(texts.take(pa.array(safe)), " ", max_splits=1), 0).to_pylist()]
            first, size = first[index], size[index]
            bare_sizes = np.array([len(x) for x in bare])
            first[heads] = len(ids) + np.cumsum(bare_sizes) - bare_sizes
            size[heads] = bare_sizes
            ids = np.concatenate([ids, *bare])
            ends = np.cumsum(size)
            total = int(ends[-1])
            flat = ids[np.arange(total) + np.repeat(first - (ends - size), size)]
            counts[safe] = np.diff(np.append(0, ends[offsets[1:] - 1]))
        if not rest:
            return flat, counts
        out, at = [], 0
        for i in range(n):
            if i in rest:
                out.append(rest[i])
            else:
                out.append(flat[at : at + counts[i]])
                at += counts[i]
        return np.concatenate(out), counts


_bpe: dict[tuple, ByteBpe] = {}


def _tokenizer(ranks: bytes, pattern: str) -> ByteBpe:
    key = (zlib.crc32(ranks), len(ranks), pattern)
    if key not in _bpe:
        _bpe[key] = ByteBpe(ranks, pattern)
    return _bpe[key]


def _windows(n_tokens, length: int):
    return -(-n_tokens // length)


def write_shards(docs: DataFrame, path: str, ranks_file: str, pattern: str, length: int = 512, per_shard: int = 16_384, key: int = 9) -> dict:
    """Shards of the token sequences of docs (doc_id, text) under path/data, and the
    manifest, which is also returned, under path/manifest.

    A text is its tokens and an end token, cut into windows of `length`; the last
    is filled up with the end token. Null and empty texts give no sequence; rows
    without an id are written under the least long; repeated rows repeat their
    sequences; texts are read whole, and a long one is many sequences. Other columns,
    whatever their names, are not read. Empty table: a manifest and no shard. The rank file is read on the
    driver and sent to tasks (its size is that of a vocabulary)."""
    spark = docs.sparkSession
    with open(ranks_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def count(batches):
        bpe, n = _tokenizer(ranks.value, pattern), 0
        for b in batches:
            for part in slices(b, 1):
                sizes = bpe.encode(part.column(1))[1]
                n += int(_windows(sizes[sizes > 0] + 1, length).sum())
            tidy()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], ["part", "n"])

    counts = sorted(map(tuple, rows.mapInArrow(count, "part long, n long").where("n > 0").collect()))  # one row a task
    total, starts = 0, {}
    for part, n in counts:
        starts[part] = (total, n)
        total += n
    manifest = {"sequences": total, "length": length, "per_shard": per_shard, "key": key, "stride": HEADER.itemsize + 2 * length + 1, "shards": -(-total // per_shard)}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    if not total:
        return manifest
    begun, order = spark.sparkContext.broadcast(starts), Feistel(total, key)

    def place(batches):
        part = TaskContext.get().partitionId()
        bpe = _tokenizer(ranks.value, pattern)
        at, n = begun.value.get(part, (0, 0))
        last, end = at + n, np.array([bpe.end], "<u2").tobytes()
        for b in batches:
            for texts in slices(b, 1):
                ids, sizes = bpe.encode(texts.column(1))
                data, done, out = ids.tobytes(), 0, []
                for doc, n in zip(texts.column(0).to_pylist(), sizes.tolist(), strict=True):
                    if not n:
                        continue
                    own = data[done : done + 2 * n] + end
                    done += 2 * n
                    for w in range(_windows(n + 1, length)):
                        piece = own[2 * w * length : 2 * (w + 1) * length]
                        out.append(struct.pack("<qii", NO_DOC if doc is None else doc, w, len(piece) // 2) + piece + end * (length - len(piece) // 2))
                for i in range(0, len(out), 8192):
                    some = out[i : i + 8192]
                    slots = order.slot(np.arange(at, at + len(some), dtype=np.int64))
                    at += len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(some, pa.binary())], ["slot", "record"])
            tidy()
        if at != last:
            raise RuntimeError(f"partition {part} has other rows than when they were counted")

    # Slots are dense and even, so their ranges need no sampling.
    parts = max(1, min(max(partitions(docs), manifest["shards"] // 64), manifest["shards"]))
    shard = F.expr(f"slot div {per_shard}")
    placed = rows.mapInArrow(place, "slot long, record binary").withColumn("shard", shard)
    # By shard first, as the writer needs it: else it sorts again, and by shard alone.
    ranged = placed.repartitionById(parts, F.expr(f"int(shard * {parts} div {manifest['shards']})")).sortWithinPartitions("shard", "slot")
    ranged.select(F.col("record").cast("string").alias("value"), "shard").write.partitionBy("shard").option("lineSep", "\n").text(f"{path}/data")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """slot, shard, doc_id, window, n_tokens, tokens (binary, uint16) from a slot on;
    shards before it are not opened. A shard whose size is not a whole number of
    records raises ValueError."""
    m = read_manifest(spark, path)
    schema = "slot long, shard long, doc_id long, window int, n_tokens int, tokens binary"
    if not m["shards"]:
        return spark.createDataFrame([], schema)
    stride, per_shard, length = m["stride"], m["per_shard"], m["length"]

    def cut(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(data) % stride:
                    raise ValueError(f"shard {shard} is cut short")
                kind = np.dtype([("head", HEADER), ("tokens", f"V{2 * length}"), ("end", "S1")])
                r = np.frombuffer(data, kind)
                slots = shard * per_shard + np.arange(len(r))
                r, slots = r[slots >= from_slot], slots[slots >= from_slot]
                doc = r["head"]["doc_id"]
                tokens = [t.tobytes()[: 2 * n] for t, n in zip(r["tokens"], r["head"]["n"], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(np.full(len(r), shard)), pa.array(doc, mask=doc == NO_DOC), pa.array(r["head"]["window"]), pa.array(r["head"]["n"]), pa.array(tokens, pa.binary())],
                    ["slot", "shard", "doc_id", "window", "n_tokens", "tokens"],
                )

    files = spark.read.format("binaryFile").load(f"{path}/data").select(F.col("shard").cast("long"), "content")
    return files.where(F.col("shard") >= from_slot // per_shard).mapInArrow(cut, schema)
