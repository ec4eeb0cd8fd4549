"""N-gram Jaccard join: near copies among whole texts, none lost.

A text's set is its distinct word shingles; sets, not rows, are compared, so that
exact copies are one point whatever their number. Two sets link when
100 * |A & B| >= percent * |A | B|. What links is found in this order:

1. Blocks. Shingles have one global order, rare ones first. Two sets that link
   share a shingle among the first few of each (prefix filter: 1/7 of the smaller
   set and 1/4 of the larger at 75 %), so blocks are the sets that share such a
   shingle. The order comes from counts of all shingles of all texts in hashed
   buckets, so that passages which many texts share come last and make no block.
   Any order gives the same links; this one keeps blocks small. Few of these shingles
   are in two sets: a pass before finds out which may be, so that only they are
   shuffled with their sets. Of blocks with the
   same sets, as the many shingles of a group of copies make, one stays.
2. Points and trees. Shingles hash into groups and a set is the point of its group
   counts, four bits each. The sum of coordinate minima bounds the overlap of two sets.
   The points of a block are packed into an R-tree, whose leaves are `fanout` points
   next to each other in size and then coordinates. Its nodes give the first
   candidates: of each point the one of its leaf with the greatest bound, and of each
   node's first point that of the node above. They are as many as the points, and
   connected components of those that are verified make most blocks one class;
   blocks of one class need no more work, so a large group of copies costs in
   proportion to its size.
   A block of one leaf whose candidates are all pairs that the bound leaves is done.
3. Search. In the other blocks trees are searched: a node bounds the overlap by its
   upper corner. First each point looks for its nearest ones of other classes, then,
   where there were more, for all that the bound leaves. Blocks of over `leaf_block`
   sets are cut in parts that meet pairwise.
4. Verification. What the bound leaves is verified on the texts' sets themselves.

Shingles are 64-bit hashes; a set is known by a 64-bit fingerprint, and it is
checked with 128 bits that no two sets share one.
"""

from __future__ import annotations

import itertools
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators.grouping import connected_components

from .shared import Scratch, free_name, mixed, partitions, quoted, raw_texts, shingle_hashes, slices, staged, tidy, word_hashes

#: Buckets of the shingle counts: the top bits of a hash.
BUCKET_BITS = 18
#: Most bits of the filter of texts that are fetched (8 MB), and the texts that it can
#: tell; more of them are joined unfiltered. False hits only cost time.
FILTER_BITS, FILTER_KEYS = 26, 1 << 23
#: Sets of a task that are remembered so as not to emit copies; and rows of a block
#: that are held to see whether another block has the same.
REMEMBERED, HELD = 100_000, 65_536
#: Most bits of the filter of tokens that several sets share (32 MB); and tokens that are
#: packed at once, and that one range of the filter gathers, about.
SHARED_BITS, GATHERED = 28, 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
NO_DOC = np.iinfo(np.int64).min

@dataclass(frozen=True)
class Join:
    """percent: least Jaccard similarity, in percent. width: words in a shingle.
    fanout: points and nodes in a node of the R-tree. leaf_block: sets in a part of
    a block. nearest: candidates that the first search of a point gives."""

    percent: int = 75
    width: int = 5
    fanout: int = 16
    leaf_block: int = 2048
    nearest: int = 4

    def overlap(self, n):
        """Least overlap of two linked sets with n elements in all."""
        return -(-self.percent * n // (100 + self.percent))

    def smaller_prefix(self, n: int) -> int:
        return n - int(self.overlap(2 * n)) + 1

    def larger_prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z in lower case."""
    return np.unique(shingle_hashes(word_hashes(raw.lower()), width))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def count_vector(s: np.ndarray) -> bytes:
    """Group counts of a set, four bits each; half as many groups as elements, up to as
    many. Groups are ranges of the top bits, so that neighbouring groups add up to those
    of half as many. 15 stands for any more."""
    bits = min(20, max(4, (max(len(s), 1) - 1).bit_length() - 1))
    v = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (v[::2] | (v[1::2] << 4)).tobytes()


def groups_of(point: bytes) -> int:
    return 2 * len(point)


def folded(point: bytes, groups: int) -> np.ndarray:
    """A point in so many coordinates or fewer, as counts; what stands for more stays as much."""
    p = np.frombuffer(point, np.uint8)
    v = np.stack([p & 15, p >> 4], axis=1).ravel().astype(np.int64)
    v[v == 15] = 1 << 30
    return v if len(v) == groups else v.reshape(groups, -1).sum(axis=1)


def may_link(p: bytes, q: bytes, n: int, how: Join) -> bool:
    """Whether the sum of coordinate minima lets two points of n elements in all link."""
    g = min(groups_of(p), groups_of(q))
    return int(np.minimum(folded(p, g), folded(q, g)).sum()) >= how.overlap(n)


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs of the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def survey(docs: DataFrame, how: Join) -> DataFrame:
    """One pass over the texts: rows (bucket, n) with the distinct shingles of each
    bucket, and rows (doc, hash, fp, fp2, n, point) with each text's set and its point."""
    names = ["bucket", "doc", "hash", "fp", "fp2", "n", "point"]

    def run(batches):
        counts, shift = np.zeros(1 << BUCKET_BITS, np.int64), np.uint64(64 - BUCKET_BITS)
        for whole in batches:
            for b in slices(whole, 1):
                sets = [shingle_set(raw or b"", how.width) for raw in raw_texts(b.column(1))]
                fps = [fingerprint(s) for s in sets]
                counts += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=len(counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(fps), pa.int64()), b.column(0), b.column(2), *(pa.array([x[i] for x in fps], pa.int64()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(count_vector, sets), pa.binary())], names
                )
            tidy()
        at = np.flatnonzero(counts)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at), none, none, none, none, pa.array(counts[at]), pa.nulls(len(at), pa.binary())], names)

    return docs.mapInArrow(run, "bucket long, doc long, hash long, fp long, fp2 long, n long, point binary")


def bucket_ranks(survey_table: DataFrame) -> np.ndarray:
    """For each bucket its place when buckets are sorted by count. Of fixed size,
    whatever the corpus."""
    rows = survey_table.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    ranks = np.empty(len(counts), np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint64)
    return ranks


def ordered(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in the global order: a bucket's bits give way to its rank, so values
    stay distinct and sort rare first."""
    low = np.uint64(64 - BUCKET_BITS)
    return np.sort((ranks[(s >> low).astype(np.int64)] << low) | (s & np.uint64((1 << (64 - BUCKET_BITS)) - 1)))


def _prefixes(batches, ranks: np.ndarray, how: Join):
    """The prefixes (tokens, fp, n) of the sets of each slice of texts. A task gives a
    set once, or a few times."""
    done: set[int] = set()
    for whole in batches:
        for b in slices(whole, 1):
            out = []
            for raw in raw_texts(b.column(1)):
                s = shingle_set(raw or b"", how.width)
                n = len(s)
                if not n or (fp := fingerprint(s)[0]) in done:
                    continue
                if len(done) > REMEMBERED:
                    done.clear()
                done.add(fp)
                out.append((ordered(s, ranks)[: how.larger_prefix(n)], fp, n))
            if out:
                yield out
        tidy()


def _flat(sets: list[tuple], how: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of prefixes, each with its set's fp and size, and whether it is in the
    prefix that the set needs against larger ones."""
    lengths = [len(x[0]) for x in sets]
    fps, sizes = (np.repeat(np.array([x[i] for x in sets], kind), lengths) for i, kind in ((1, np.int64), (2, np.int32)))
    return np.concatenate([x[0] for x in sets]), fps, sizes, np.concatenate([np.arange(len(x[0])) < how.smaller_prefix(x[2]) for x in sets])


def prefix_size(reps: DataFrame, how: Join) -> tuple[int, int]:
    """The number of sets, and about how many tokens their prefixes have."""
    sets, n = reps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return sets, sets + n * (100 - how.percent) // 100


def _packed(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted keys as compressed differences, byte by byte, and the bytes before that."""
    d = np.diff(keys, prepend=np.uint64(0))
    k = max(1, (int(d.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T[:k]).tobytes()
    return len(planes), pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(n: int, size: int, data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=size, codec="zstd"), np.uint8).reshape(-1, n)
    d = np.zeros((n, 8), np.uint8)
    d[:, : len(planes)] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype=np.uint64)


def size_classes(n: np.ndarray, how: Join) -> np.ndarray:
    """Classes of sizes, 0 to 63: those of two sets that link are equal or neighbours."""
    # A little wider than the ratio, so that no rounding puts a class between.
    return np.minimum(np.log(n) / (max(np.log(100 / how.percent), 0.05) + 1e-6), 63).astype(np.uint64)


def _twice(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, of equal ones two at most."""
    keep = np.ones(len(keys), bool)
    keep[2:] = keys[2:] != keys[:-2]
    return keys[keep]


def shared_tokens(docs: DataFrame, ranks, how: Join, total: int) -> np.ndarray:
    """Bits (bytes) at the places of tokens that prefixes share, for `may_share`: of two
    sets at least whose size classes allow a link, in the smaller prefix of one that is
    not of the higher class. total: about how many tokens prefixes have. A token goes to the
    shuffle as a key (bits of a hash, size class, 0 if in the smaller prefix), packed as the
    difference to the key before; of equal keys two of those packed together. Chance
    hits of keys and of places only cost rows."""
    bits = min(SHARED_BITS, max(10, total.bit_length() + 1))
    key_bits = min(56, max(bits, total.bit_length()) + 8)
    below = key_bits + 7 - bits
    words = 1 << (bits - 6)
    ranges = min(words, max(partitions(docs), total // GATHERED))
    starts = np.array([words * r // ranges for r in range(ranges + 1)], np.uint64) << np.uint64(6 + below)

    one = np.uint64(1)

    def give(batches):
        def flush():
            keys = np.concatenate(held)
            keys = _twice(np.sort(keys))
            cut = np.searchsorted(keys, starts)
            at = np.flatnonzero(cut[1:] > cut[:-1])
            packed = [_packed(keys[cut[r] : cut[r + 1]] - starts[r]) for r in at]
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.diff(cut)[at], pa.int32()), pa.array([p[0] for p in packed], pa.int32()), pa.array([p[1] for p in packed], pa.binary())], ["range", "n", "size", "data"])

        held, n = [], 0
        for sets in _prefixes(batches, ranks.value, how):
            tokens, _, sizes, small = _flat(sets, how)
            held.append((mixed(tokens) >> np.uint64(64 - key_bits) << np.uint64(7)) | (size_classes(sizes, how) << np.uint64(1)) | ~small)
            n += len(tokens)
            if n >= GATHERED:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def take(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for r, *x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                held.setdefault(r, []).append(_unpacked(*x))
        for r, parts in held.items():
            keys = np.sort(np.concatenate(parts))
            # Rising classes of one hash, those in the smaller prefix first: the next one tells.
            x, y = keys[:-1], keys[1:]
            hit = (x & one == 0) & (x >> np.uint64(7) == y >> np.uint64(7)) & ((y >> one & np.uint64(63)) - (x >> one & np.uint64(63)) <= one)
            on = np.zeros(int(starts[r + 1] - starts[r] >> np.uint64(below)), bool)
            on[(x[hit] >> np.uint64(below)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["range", "bits"])
        tidy()

    given = docs.mapInArrow(give, "range int, n int, size int, data binary")
    rows = given.repartitionById(ranges, "range").mapInArrow(take, "range int, bits binary").toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r, x in zip(rows.column("range").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        at = words * r // ranges * 8
        out[at : at + len(x)] = np.frombuffer(x, np.uint8)
    return out


def may_share(tokens: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which tokens have their bit in shared; all that are in several prefixes do."""
    place = mixed(tokens) >> np.uint64(64 - (8 * len(shared)).bit_length() + 1)
    return (shared[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def prefixes(docs: DataFrame, ranks, shared, how: Join) -> DataFrame:
    """(token, fp, n, small): of the prefix of each set the tokens that may be in another;
    small where a token is in the prefix that the set needs against larger ones."""

    def run(batches):
        for sets in _prefixes(batches, ranks.value, how):
            tokens, fps, sizes, small = _flat(sets, how)
            keep = may_share(tokens, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (_signed(tokens), fps, sizes, small)], ["token", "fp", "n", "small"])

    return docs.mapInArrow(run, "token long, fp long, n int, small boolean")


def blocks(tokens: DataFrame, how: Join = Join()) -> DataFrame:
    """(token, fp, same, too): the blocks, of tokens that several sets share. A set is in
    one only if it could link with the next larger or smaller ones there for their sizes
    and prefixes. The first row of a block has 128 bits (same, too) of a sum over its
    sets, equal for blocks of the same sets. Streams over sorted rows; a block of over
    HELD rows passes as it comes, as if no other had its sets."""

    def partnered(f, n, x, start):
        """Rows that a larger one follows whose size allows a link, if the token is in
        the row's smaller prefix; and those that such a smaller one precedes."""
        i = np.arange(len(f))
        small = np.append(-1, np.maximum.accumulate(np.where(x, i, -1))[:-1])
        larger = (small >= start) & (100 * n[small] >= how.percent * n)
        smaller = np.zeros(len(f), bool)
        smaller[:-1] = x[:-1] & (start[1:] == start[:-1]) & (100 * n[:-1] >= how.percent * n[1:])
        return larger | smaller

    def out(t, f, n, x, begun: bool, passes: bool):
        """Rows of whole blocks. begun: the first one's beginning has passed, and so
        do its rows; passes: all do."""
        first = np.append(True, t[1:] != t[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
        keep = partnered(f, n.astype(np.int64), x, start) | passes
        if begun:
            keep |= start == 0
        t, f, old = t[keep], f[keep], start[keep]
        if not len(t):
            return None
        first = np.append(True, old[1:] != old[:-1])
        at = np.flatnonzero(first)
        with np.errstate(over="ignore"):
            same, too = (np.repeat(np.add.reduceat(mixed(f.view(np.uint64) ^ np.uint64(k)), at).view(np.int64), np.diff(np.append(at, len(t)))) for k in (0, 0x5851F42D4C957F2D))
        if begun:
            first[0] = False
        if passes:  # its own mark, which no sum over sets gives but by chance
            too = t
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(f), pa.array(same, mask=~first), pa.array(too, mask=~first)], ["token", "fp", "same", "too"])

    def run(batches):
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool))
        begun = False  # rows of the held block have passed
        last = None  # the last row seen, so that a set from another task is passed over
        for b in batches:
            t, f, n = (b.column(i).to_numpy() for i in range(3))
            x = b.column(3).to_numpy(zero_copy_only=False)
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
            new[0] = last != (t[0], f[0])
            last = (t[-1], f[-1])
            t, f, n, x = held = tuple(np.concatenate(c) for c in zip(held, (t[new], f[new], n[new], x[new]), strict=True))
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1]))
            if cut:
                if rows := out(*(c[:cut] for c in held), begun, False):
                    yield rows
                begun, held = False, tuple(c[cut:] for c in held)
            if len(held[0]) > HELD:
                yield out(*held, begun, True)
                held, begun = tuple(c[:0] for c in held), True
        if len(held[0]) and (rows := out(*held, begun, False)):
            yield rows

    sorted_rows = tokens.repartition(partitions(tokens), "token").sortWithinPartitions("token", "n", "fp")
    return sorted_rows.mapInArrow(run, "token long, fp long, same long, too long")


def distinct_blocks(rows: DataFrame) -> DataFrame:
    """(token, fp) of one block of each that have the same sets."""
    kept = rows.where("same is not null").groupBy("same", "too").agg(F.min("token").alias("token")).select("token")
    return rows.select("token", "fp").join(kept, "token")


def _leaf_pairs(n: np.ndarray, points: list[bytes], at: np.ndarray, how: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each point of each leaf the one after it in its leaf with the greatest bound
    for their sizes, if the bound lets them link; and which leaves have more pairs that
    might. at: rows of the leaves, -1 for none."""
    width = at.shape[1]
    lengths = np.array(list(map(groups_of, points)))
    groups = np.where(at >= 0, lengths[at], 1 << 30).min(axis=1)
    found, more_left = [], np.zeros(len(at), bool)
    for g in np.unique(groups):
        leaves = np.flatnonzero(groups == g)
        for these in np.array_split(leaves, -(-len(leaves) * width * int(g) // (1 << 22))):
            some, left = at[these], np.zeros(len(these), np.int64)
            a = np.zeros((*some.shape, g), np.uint16)
            for i, j in np.argwhere(some >= 0):
                a[i, j] = np.minimum(folded(points[some[i, j]], g), 65535)
            size = np.where(some >= 0, n[some], 0)
            best, to = np.zeros(some.shape), np.full(some.shape, -1)
            for d in range(1, width):
                bound = np.minimum(a[:, d:], a[:, :-d]).sum(axis=2, dtype=np.int64)
                x, y = size[:, :-d], size[:, d:]
                fits = (x > 0) & (y > 0) & (100 * np.minimum(x, y) >= how.percent * np.maximum(x, y)) & (bound >= how.overlap(x + y))
                left += fits.sum(axis=1)
                score = np.where(fits, bound / np.maximum(x + y, 1), 0)
                more = score > best[:, :-d]
                best[:, :-d][more], to[:, :-d][more] = score[more], some[:, d:][more]
            hit = to >= 0
            found.append((some[hit], to[hit]))
            more_left[these] = left > hit.sum(axis=1)
    return *(np.concatenate(x) for x in zip(*found, strict=True)), more_left


def neighbours(rows: DataFrame, how: Join) -> DataFrame:
    """Rows (a, b): candidates that the nodes of the blocks' trees give, one or two a
    point; and rows (token): blocks that have more pairs which might link, for all that
    these show: those of several leaves, and leaves with more than was given.
    rows: token, fp, n, point. Streams over rows in the order of the leaves, with one
    leaf and the first points of the nodes above it held, whatever the block."""
    f = how.fanout

    def above(heads: dict, k: int, row: tuple) -> tuple | None:
        """The first point (fp, n, point) of the node above those that the k-th leaf
        begins; its own is noted as theirs. None for the block's first leaf."""
        if not k:
            heads.clear()
            heads["root"] = row
            return None
        level = 0
        while k % f == 0:
            heads[level] = row
            k, level = k // f, level + 1
        return heads.get(level, heads["root"])

    def run(batches):
        held, heads, done = [], {}, 0  # rows of a leaf that may go on; its block's heads, and its leaves before
        token = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = [*held, *zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
            if not held:
                continue
            t = np.array([r[0] for r in held])
            start = np.append(True, t[1:] != t[:-1])
            at = np.flatnonzero(start)
            pos = np.arange(len(t)) - np.repeat(at, np.diff(np.append(at, len(t))))
            # The last leaf waits, unless nothing follows.
            rest = len(t) if b is None else len(t) - 1 - int(pos[-1]) % f
            first = np.flatnonzero(pos[:rest] % f == 0)
            if len(first):
                leaf = np.full((len(first), f), -1)
                k = np.repeat(np.arange(len(first)), np.diff(np.append(first, rest)))
                leaf[k, pos[:rest] % f] = np.arange(rest)
                n, points = np.array([r[2] for r in held]), [r[3] for r in held]
                x, y, more = _leaf_pairs(n, points, leaf, how)
                after = np.append(first[1:], rest)
                ends = (after == len(t)) | start[np.minimum(after, len(t) - 1)]
                tokens = []
                pairs = [(held[i][1], held[j][1]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                for i, end, left in zip(first.tolist(), ends.tolist(), more.tolist(), strict=True):
                    if held[i][0] != token or (start[i] and i):
                        token, done = held[i][0], 0
                    head, (fp, size, point) = above(heads, done, held[i][1:]), held[i][1:]
                    if done or left or not end:
                        tokens.append(token)
                    done += 1
                    if head and 100 * min(head[1], size) >= how.percent * max(head[1], size) and may_link(head[2], point, head[1] + size, how):
                        pairs.append((head[0], fp))
                none = [None] * len(tokens)
                yield pa.RecordBatch.from_arrays([pa.array([*(min(p) for p in pairs), *none], pa.int64()), pa.array([*(max(p) for p in pairs), *none], pa.int64()), pa.array([None] * len(pairs) + tokens, pa.int64())], ["a", "b", "token"])
            held = held[rest:]
        tidy()

    x = rows.select("token", "fp", "n", "point").repartition(partitions(rows), "token").sortWithinPartitions("token", "n", "point", "fp")
    return x.mapInArrow(run, "a long, b long, token long")


def _place(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(1 << bits))


def key_filter(keys: DataFrame, n: int, key: Column) -> Column:
    """Whether a row's key (a hash) is among the n in column `hash` of keys, or (rarely)
    not: bits at hashed places, tested in the scan."""
    bits = min(FILTER_BITS, max(10, (64 * n).bit_length()))
    spark = keys.sparkSession
    words = keys.select(_place(F.col("hash"), bits).alias("p")).groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    data = spark.createDataFrame(pa.table({"bits": pa.array([out], pa.list_(pa.int64()))})).scalar()
    place = _place(key, bits)
    word = F.get(data, F.floor(place / F.lit(64)).cast("int"))
    return F.expr("1L") == F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))


def points_of(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The points of the sets in rows, a written table, and a few others: only they are shuffled."""
    sets = rows.select(F.col("fp").alias("hash")).distinct()
    return points.where(key_filter(sets, sets.count(), F.col("fp")))


def verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame, how: Join, tmp: Scratch, repeats: bool) -> DataFrame:
    """The pairs (a, b) whose sets link. pairs and reps must be written tables. Texts
    meet, which are smaller than their sets; up to FILTER_KEYS, a filter lets only those
    of the pairs through to the shuffle. repeats: texts may hold a row several times."""
    side = lambda c: reps.select(F.col("fp").alias(c), F.col("doc").alias(f"doc_{c}"), F.col("hash").alias(f"hash_{c}"))
    keyed = tmp.staged(pairs.join(side("a"), "a").join(side("b"), "b"), "jaccard-keyed")
    needed = keyed.select(F.col("hash_a").alias("hash")).unionAll(keyed.select(F.col("hash_b").alias("hash"))).distinct()
    n = needed.count()
    if n <= FILTER_KEYS:
        texts = texts.where(key_filter(needed, n, F.col("hash")))
    if repeats:
        texts = texts.dropDuplicates(["doc", "hash"])

    def run(batches):
        last = (None, None)
        for whole in batches:
            for b in slices(whole, 2, 4 << 20):
                keep = []
                for a, c, x, y in zip(*(b.column(i).to_pylist() for i in (0, 1)), *(raw_texts(b.column(i)) for i in (2, 3)), strict=True):
                    s = shingle_set(x, how.width)
                    if last[0] != c:
                        last = c, shingle_set(y, how.width)
                    t = last[1]
                    if fingerprint(s)[0] != a or fingerprint(t)[0] != c:
                        raise RuntimeError("a text has another set than when it was surveyed")
                    keep.append(len(np.intersect1d(s, t, assume_unique=True)) >= how.overlap(len(s) + len(t)))
                yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep)) for i in range(2)], ["a", "b"])
            tidy()

    x = keyed
    for c in "ab":
        x = x.join(texts.select(F.col("doc").alias(f"doc_{c}"), F.col("hash").alias(f"hash_{c}"), F.col("text").alias(f"text_{c}")), [f"doc_{c}", f"hash_{c}"])
    return x.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


class RTree:
    """Points of one block, packed by size and then coordinates; a node has its
    points' upper corner and least size, a level `fanout` times fewer nodes than
    the one below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, how: Join):
        self.how = how
        self.order = np.lexsort((*points[:, :4].T, sizes))
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > how.fanout:
            p, n = self.levels[-1]
            at = np.arange(0, len(n), how.fanout)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(n, at)))

    def search(self, point: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the points that could link with a point of no greater size, and
        the bounds of their overlaps."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, n = self.levels[depth]
            bound = np.minimum(p[at], point).sum(axis=1)
            # A larger set than the point: at least its size, at most what percent allows.
            fits = (bound >= self.how.overlap(size + np.maximum(n[at], size))) & (self.how.percent * n[at] <= 100 * size)
            at, bound = at[fits], bound[fits]
            if depth:
                at = (at[:, None] * self.how.fanout + np.arange(self.how.fanout)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at], bound


def survivors_of(block: dict[str, np.ndarray], how: Join, nearest: bool) -> tuple[np.ndarray, bool]:
    """Pairs (a, b) of one block's rows, from parts lo and hi, of different labels,
    that the bound does not exclude: of each row those of greatest bound, or all of
    which the block is the first that both are in. And whether there are more."""
    n, fp, label, part = (block[c] for c in ("n", "fp", "label", "part"))
    token, g = int(block["token"][0]), min(map(groups_of, block["point"]))
    points = np.stack([folded(x, g) for x in block["point"]])
    lo, hi = int(block["lo"][0]), int(block["hi"][0])
    out, more = [np.empty((0, 2), np.int64)], False
    for mine, theirs in {(lo, hi), (hi, lo)}:
        own, other = np.flatnonzero(part == mine), np.flatnonzero(part == theirs)
        if not len(own) or not len(other):
            continue
        tree = RTree(points[other], n[other], how)
        for i in own:
            j, bound = tree.search(points[i], int(n[i]))
            j = other[j]
            fits = (label[j] != label[i]) & ((n[j] > n[i]) | ((n[j] == n[i]) & (fp[j] > fp[i])))
            j, bound = j[fits], bound[fits]
            if nearest and len(j) > how.nearest:  # ties fall differently in every block
                j, more = j[np.lexsort((fp[j] ^ token, -bound))[: how.nearest]], True
            elif not nearest and len(j):
                j = j[[int(np.intersect1d(block["tokens"][i], block["tokens"][k], assume_unique=True)[0]) == token for k in j]]
            if len(j):
                out.append(np.stack([np.full(len(j), fp[i]), fp[j]], axis=1))
    return np.concatenate(out), more


def surviving(rows: DataFrame, how: Join, nearest: bool) -> DataFrame:
    """Rows (a, b) that the R-trees of the blocks (token, lo, hi) of rows leave, and
    rows (token) of blocks that have more. A block, of at most two parts, is held whole."""
    names = ["token", "lo", "hi", "part", "fp", "n", "label", "point", *([] if nearest else ["tokens"])]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def pairs(table: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
            """Pairs of the blocks that are whole, and the rows of one that may go on."""
            t, lo, hi = (table.column(c).to_numpy() for c in names[:3])
            cut = np.flatnonzero((t[1:] != t[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            cols = {c: table.column(c).to_numpy(zero_copy_only=False) for c in names}
            found, tokens, at = [np.empty((0, 2), np.int64)], [], 0
            for end in [*cut.tolist(), *([len(t)] if last else [])]:
                if end - at > 1:
                    ends, more = survivors_of({c: v[at:end] for c, v in cols.items()}, how, nearest)
                    found.append(ends)
                    tokens += [int(t[at])] * more
                at = end
            ends, none = np.concatenate(found), pa.nulls(len(tokens), pa.int64())
            sides = [pa.concat_arrays([pa.array(ends[:, i]), none]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*sides, pa.concat_arrays([pa.nulls(len(ends), pa.int64()), pa.array(tokens, pa.int64())])], ["a", "b", "token"]), table.slice(at)

        for b in batches:
            held.append(b)
            first, end = held[0].slice(0, 1).to_pylist()[0], b.slice(b.num_rows - 1).to_pylist()[0]
            if any(first[c] != end[c] for c in names[:3]):
                out, rest = pairs(pa.Table.from_batches(held), False)
                held = rest.combine_chunks().to_batches()
                yield out
        if held:
            yield pairs(pa.Table.from_batches(held), True)[0]
        tidy()

    x = rows.select(names).repartition(partitions(rows), "token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return x.mapInArrow(run, "a long, b long, token long")


def open_blocks(rows: DataFrame, classes_of: DataFrame) -> DataFrame:
    """The rows (token, fp) of the blocks of more than one class, with label."""
    x = rows.join(classes_of, "fp", "left").withColumn("label", F.coalesce("component", "fp")).drop("component")
    several = x.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    return x.join(several, "token")


def in_parts(rows: DataFrame, points: DataFrame, how: Join) -> DataFrame:
    """Rows of blocks with size, point and the parts lo and hi that meet."""
    parts = rows.groupBy("token").agg(F.ceil(F.count("*") / how.leaf_block).alias("parts"))
    x = rows.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return x.withColumn("lo", F.least("part", "o")).withColumn("hi", F.greatest("part", "o")).drop("o", "parts").join(points, "fp")


def joined_classes(classes_of: DataFrame, links: DataFrame) -> DataFrame:
    """classes_of (fp, component) after further links (a, b) of written tables: only
    the classes that these join go through components again, each as one node."""
    label = lambda c: classes_of.select(F.col("fp").alias(c), F.col("component").alias(f"of_{c}"))
    ends = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    ends = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    to = connected_components(ends, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = classes_of.join(to, "component", "left").select("fp", F.coalesce("to", "component").alias("component"))
    new = to.withColumnRenamed("component", "fp").join(classes_of, "fp", "left_anti").select("fp", F.col("to").alias("component"))
    return staged(old.unionByName(new), "jaccard-components")


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Spark removes the files of a query's shuffles when its result is written, rather
    than when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("token is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, how: Join = Join(), told: dict[str, int] | None = None) -> DataFrame:
    """docs (doc_id, text) to one row each: doc_id, n_shingles, component_id, the
    smallest doc_id that links reach.

    Null and empty texts, and those of blanks, have no shingles and link with
    nothing: component_id is their own doc_id. Texts of fewer words than a shingle
    are one shingle; texts are read whole, however long. A null doc_id takes part but
    names no class unless it is the only id, when component_id is null. Repeated rows
    are copies. Other columns, whatever their names, are not read; an empty table gives
    no rows. Tables on the way are removed as soon as they are read.

    told: takes the numbers of rows in blocks, of candidates and of links by step."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), "text", F.xxhash64("text").alias("hash"))

    def tell(name: str, df: DataFrame) -> None:
        if told is not None:
            told[name] = df.count()

    with shuffles_removed(spark), Scratch(spark) as tmp, Scratch(spark) as block_tmp, Scratch(spark) as once:
        seen = tmp.staged(survey(texts, how), "jaccard-survey")
        ids = seen.where("bucket is null").select("doc", "hash", "fp", "fp2", "n", "point")
        reps = ids.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc", "hash")).alias("of"), F.first("n").alias("n"), F.first("point").alias("point"), F.min("fp2").alias("one"), F.max("fp2").alias("two"))
        reps = tmp.staged(reps.select("*", "of.*").drop("of"), "jaccard-reps")
        repeats = not ids.groupBy("doc", "hash").count().where("count > 1").isEmpty()
        if not reps.where("one <> two").isEmpty():
            raise ValueError("two different sets have one 64-bit fingerprint")
        points = reps.select("fp", "n", "point")
        ranks = spark.sparkContext.broadcast(bucket_ranks(seen))
        # One row of each set, and some that the filter does not know from it.
        n_sets, total = prefix_size(reps, how)
        each = texts.where(key_filter(reps.select(F.xxhash64("doc", "hash").alias("hash")), n_sets, F.xxhash64("doc", "hash")))
        shared = spark.sparkContext.broadcast(shared_tokens(each, ranks, how, total))
        every = once.staged(blocks(prefixes(each, ranks, shared, how), how), "jaccard-every-block")
        tell("rows of blocks", every)
        rows = block_tmp.staged(distinct_blocks(every), "jaccard-blocks")
        tell("rows of distinct blocks", rows)
        once.drop()

        # What the nodes of the trees give.
        near = once.staged(neighbours(rows.join(points_of(rows, points), "fp"), how).distinct(), "jaccard-near")
        pairs = tried = tmp.staged(near.where("token is null").select("a", "b"), "jaccard-tried")
        tell("candidates of nodes", pairs)
        links = tmp.staged(verified(pairs, texts, reps, how, once, repeats), "jaccard-links")
        tell("links of nodes", links)
        rows = block_tmp.staged(rows.join(near.where("token is not null").select("token"), "token"), "jaccard-unfinished")
        tell("rows of unfinished blocks", rows)
        once.drop()
        classes_of = connected_components(links, "a", "b").withColumnRenamed("node", "fp")

        # What a search of the trees finds between classes: of each point the nearest,
        # then all, in the blocks where there were more.
        for nearest in (True, False):
            step = "nearest" if nearest else "all"
            rows = block_tmp.staged(open_blocks(rows.select("token", "fp"), classes_of), "jaccard-open")
            tell(f"rows of open blocks, {step}", rows)
            if rows.isEmpty():
                break
            x = in_parts(rows, points_of(rows, points), how)
            if not nearest:
                x = x.join(rows.groupBy("fp").agg(F.array_sort(F.collect_list("token")).alias("tokens")), "fp")  # a prefix at most
            found = once.staged(surviving(x, how, nearest), "jaccard-found")
            pairs = tmp.staged(_pairs(found).join(tried, ["a", "b"], "left_anti"), "jaccard-tried")
            tell(f"candidates of search, {step}", pairs)
            tried = tried.unionByName(pairs)
            if not pairs.isEmpty():
                more = tmp.staged(verified(pairs, texts, reps, how, once, repeats), "jaccard-more")
                tell(f"links of search, {step}", more)
                if not more.isEmpty():
                    classes_of = joined_classes(classes_of, more)
            rows = block_tmp.staged(rows.select("token", "fp").join(found.where("token is not null").select("token").distinct(), "token"), "jaccard-rest")
            once.drop()
        block_tmp.drop()

        x = ids.select("doc", "fp", "n").join(classes_of, "fp", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("component", "fp")))
        own = F.when(F.col("doc") != NO_DOC, F.col("doc"))
        x = x.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), "label")
        least = x.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
        x = x.join(least, "label", "left")
        return staged(x.select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "jaccard-classes")


def one_of_each(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows of docs, one of each class, that with the smallest doc_id (a null one
    last). Where doc_ids are null or repeated, rows are told apart by a number of
    their own, for which docs is written once more; rows without words are classes
    of their own, but rows of one doc_id without words are one. All columns stay,
    whatever their names; an empty table gives no rows."""
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        found = classes(docs, how)
        return _without(docs, found.where("doc_id <> component_id").select("doc_id"), "doc_id")
    row = free_name(docs, "row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-rows")
    found = classes(rows.select(F.col(row).alias("doc_id"), "text"), how).withColumnRenamed("doc_id", "nth")
    x = rows.select(F.col(row).alias("nth"), "doc_id").join(found, "nth")
    bare = F.col("n_shingles") == 0
    key = [F.when(~bare | F.col("doc_id").isNull(), F.col("component_id")), F.when(bare, F.col("doc_id"))]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "nth"))
    kept = x.groupBy(key[0].alias("x"), key[1].alias("y")).agg(first.alias("f")).select(F.col("f.nth").alias(row))
    dropped = staged(rows.select(row).join(kept, row, "left_anti"), "jaccard-dropped")
    return _without(rows, dropped, row).select([quoted(c) for c in docs.columns])


def _without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """rows without those of the ids dropped. Up to FILTER_KEYS, only rows that a filter
    of the ids lets through are shuffled; all others stay where they are."""
    every = [quoted(c) for c in rows.columns]
    dropped = dropped.withColumn("hash", F.xxhash64(key))
    n = dropped.count()
    hit = key_filter(dropped, n, F.xxhash64(key)) if n <= FILTER_KEYS else F.lit(True)
    some = rows.where(hit).join(dropped.select(key), key, "left_anti").select(every)
    return rows.where(~hit).select(every).union(some) if n <= FILTER_KEYS else some
