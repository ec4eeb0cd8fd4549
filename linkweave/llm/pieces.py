"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is a lattice of vocabulary pieces, and its encoding the best path. For a
unigram model a step weighs the piece's score. For a BPE model a step weighs 0 if
the two adjacent pieces are what BPE makes of their joined text, and minus
infinity otherwise: the one path of weight 0 is the BPE encoding, because the
first merge across a boundary would also happen between its two pieces alone.

The state at a position is the last piece begun before it. A chunk of a text is
the matrix of best weights from states at its start to states at its end. Matrices
multiply associatively (max, +): those of a giant document's chunks are multiplied
`fan` at a time, in as many rounds over the cluster as that takes, until one is left.
The best end state then goes down the same rounds, each block of `fan` finding its
inner states between its two known ones, and at last each chunk is traced back apart.

No piece reaches over a blank that follows a non-blank. So within a chunk all
paths meet at such blanks; between the first and the last of them words are
encoded one by one (and remembered), and only the ends need the lattice. What lies
between them adds the same to all weights, and is left out of the matrices. A
document of one chunk is all such words.

Weights are whole numbers, so sums are exact in any order. Unigram paths of equal
score are told apart by two more sums in lower digits: of a constant for each piece,
and of that constant times its place. A stretch moved elsewhere keeps its best path,
so a text has the same ids however it is cut.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, quoted, slices, staged, tidy

BLANK = "▁"
State = tuple[int, int]  # begin and end of the last piece; (0, 0) before the text
Matrix = dict[State, dict[State, int]]  # no entry: no path
START: State = (0, 0)
#: Digits of a weight below those of the score: a sum of pieces' constants, and one
#: of constants times places.
SUM_BITS, PLACE_BITS, SCORE_UNIT = 64, 96, 1 << 20


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for x, row in a.items():
        to: dict[State, int] = {}
        for y, w in row.items():
            for z, v in b.get(y, {}).items():
                if z not in to or w + v > to[z]:
                    to[z] = w + v
        if to:
            out[x] = to
    return out


def combined(matrices: Iterable[Matrix]) -> Matrix:
    return reduce(product, matrices)


def best_end(m: Matrix) -> State:
    """The state after a whole text on the best path; m is the text's matrix."""
    return max(m[START], key=lambda s: (m[START][s], s))


def inner_states(matrices: list[Matrix], begin: State, end: State) -> list[State]:
    """The states before, between and after chunks on the best path from begin to end."""
    reach: list[dict[State, int]] = [{begin: 0}]
    for m in matrices[:-1]:
        reach.append(product({begin: reach[-1]}, m)[begin])
    out = [end]
    for before, m in zip(reach[::-1], matrices[::-1], strict=True):
        end = max((s for s in before if end in m.get(s, {})), key=lambda s: (before[s] + m[s][end], s))
        out.append(end)
    return out[::-1]


class Model:
    """A SentencePiece model (BPE or unigram) with identity normalisation."""

    def __init__(self, proto: bytes, most: int = 200_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        norm = m.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models that keep blanks, add one in front and normalise nothing else are supported")
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        kind = pb.ModelProto.SentencePiece
        if any(p.type == kind.USER_DEFINED for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.unigram = m.trainer_spec.model_type == 1
        score = {p.piece: p.score for p in m.pieces if p.type == kind.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kind.NORMAL}
        self.unk = m.trainer_spec.unk_id
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
        if len(self.bytes) != 256:
            raise ValueError("only models with a piece for each byte are supported")
        self.score = score
        self.longest = max(map(len, score), default=1)
        self.worst = min(score.values(), default=0.0) - 10.0
        self.meets = all(BLANK not in p.lstrip(BLANK) for p in score)
        self.dtype = np.dtype("<u2" if len(m.pieces) <= 1 << 16 else "<u4")
        self.text = [b"" if p.type in (kind.CONTROL, kind.UNUSED) else bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else p.piece.replace(BLANK, " ").encode() for p in m.pieces]
        self.text[self.unk] = " ⁇ ".encode()
        self.seen: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.most = most

    # The lattice

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: the best-scored pair, leftmost first."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def step(self, before: str, piece: str, at: int) -> int | None:
        """Weight of a piece at a place of the text, after another (after '' where all
        paths meet); None if it can't stand there."""
        if self.unigram:
            c = (zlib.crc32(piece.encode()) & 0xFFFFF) + 1
            score = round(self.score.get(piece, self.worst) * SCORE_UNIT)
            return (score << (SUM_BITS + PLACE_BITS)) + (c << PLACE_BITS) + c * at
        key = (before, piece)
        if key not in self.pairs:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            self.pairs[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return 0 if self.pairs[key] else None

    def nexts(self, s: str, at: int) -> Iterable[int]:
        """Ends of the pieces that begin at a place; a character without a piece is one."""
        yield from (e for e in range(at + 1, min(len(s), at + self.longest) + 1) if s[at:e] in self.score or e == at + 1)

    def paths(self, s: str, begin: State, stop: int, shift: int = 0) -> dict[State, tuple[int, State | None]]:
        """Best weight of, and state before, each state reachable from begin through
        pieces that begin before stop. Places are relative to s, which begins at `shift`."""
        best: dict[State, tuple[int, State | None]] = {begin: (0, None)}
        by_end: dict[int, list[State]] = {begin[1]: [begin]}
        for at in range(begin[1], stop):
            for x in by_end.get(at, ()):
                before = s[x[0] : x[1]] if x[1] > x[0] else ""
                if self.meets and at and s[at] == BLANK != s[at - 1]:
                    before = ""
                for e in self.nexts(s, at):
                    w, y = self.step(before, s[at:e], at + shift), (at, e)
                    if w is None:
                        continue
                    if y not in best:
                        by_end.setdefault(e, []).append(y)
                    if y not in best or best[x][0] + w > best[y][0]:
                        best[y] = (best[x][0] + w, x)
        return best

    @staticmethod
    def traced(paths: dict, state: State) -> list[State]:
        """Pieces up to and with state, the one begun from left out."""
        out = []
        while paths[state][1] is not None:
            out.append(state)
            state = paths[state][1]
        return out[::-1]

    # Words

    def remembered(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a blank in front."""
        seen = self.seen
        try:
            return [seen[w] for w in words]
        except KeyError:
            pass
        if len(seen) > self.most:
            seen.clear()
        new = list({w for w in words if w and w not in seen})
        if self.unigram:
            ids = [self._lattice(BLANK + w.replace(" ", BLANK)) for w in new]
        else:
            ids = [np.array(x, self.dtype).tobytes() for x in self.sp.encode(new, num_threads=1)]
        got = dict(zip(new, ids, strict=True))
        got[""] = self.ids_of(BLANK)
        seen.update((w, x) for w, x in got.items() if len(w) <= 32)
        return [got[w] if w in got else seen[w] for w in words]

    def ids_of(self, piece: str) -> bytes:
        ids = [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]
        return np.array(ids, self.dtype).tobytes()

    def _lattice(self, s: str) -> bytes:
        """Ids of a stretch between places where all paths meet."""
        paths = self.paths(s, START, len(s))
        end = max((y for y in paths if y[1] == len(s)), key=lambda y: (paths[y][0], y))
        return b"".join(self.ids_of(s[b:e]) for b, e in self.traced(paths, end))

    def words(self, s: str) -> bytes:
        """Ids of a stretch that begins with a blank and ends before one, or at the end."""
        if not s:
            return b""
        s = s.replace(BLANK, " ")
        if "  " not in s:
            return b"".join(self.remembered(s[1:].split(" ")))
        return b"".join(self.remembered([w[1:] for w in re.findall(r" +[^ ]*", s)]))

    def meeting(self, s: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last place in [lo, hi] where all paths meet."""
        if not self.meets:
            return None
        first = re.compile(f"(?<=[^{BLANK}]){BLANK}").search(s, lo, hi + 1)
        if not first:
            return None
        last = first.start()
        for at in range(hi, last, -1):
            if at < len(s) and s[at] == BLANK != s[at - 1]:
                last = at
                break
        return first.start(), last

    # Chunks: s is the chunk with `left` characters before it and up to longest - 1 after

    def states_at(self, s: str, at: int) -> list[State]:
        """All states that a place could have: pieces begun before it that reach it."""
        return [(b, e) for b in range(max(0, at - self.longest), at) for e in self.nexts(s, b) if e >= at]

    def transfer(self, s: str, left: int, size: int, at: int) -> Matrix:
        """The matrix of the chunk that begins at place `at` of its text; its states are
        in places of the text."""
        lo, hi, shift = left, left + size, at - left
        ins = [START] if not at else self.states_at(s, lo)
        meet = self.meeting(s, lo, hi - 1)
        ends = lambda paths: {y: w for y, (w, _) in paths.items() if y[0] < hi <= y[1]}
        if meet is None:
            rows = {x: ends(self.paths(s, x, hi, shift)) for x in ins}
            return moved({x: row for x, row in rows.items() if row}, shift)
        p, q = meet
        tail, out = ends(self.paths(s, (q, q), hi, shift)), {}
        for x in ins:
            if x[1] == p:
                out[x] = tail
            elif x[1] < p:
                heads = [w for y, (w, _) in self.paths(s, x, p, shift).items() if y[1] == p]
                if heads:
                    out[x] = {y: max(heads) + v for y, v in tail.items()}
        return moved(out, shift)

    def between(self, s: str, left: int, size: int, at: int, begin: State, end: State) -> bytes:
        """Ids of the pieces begun in the chunk, from its state before to its state after."""
        lo, hi, shift = left, left + size, at - left
        begin, end = back(begin, shift), back(end, shift)
        meet = self.meeting(s, lo, hi - 1)
        join = lambda states: b"".join(self.ids_of(s[b:e]) for b, e in states)
        if meet is None:
            return join(self.traced(self.paths(s, begin, hi, shift), end))
        p, q = meet
        head = b""
        if begin[1] < p:
            paths = self.paths(s, begin, p, shift)
            head = join(self.traced(paths, max((y for y in paths if y[1] == p and y != begin), key=lambda y: (paths[y][0], y))))
        return head + self.words(s[p:q]) + join(self.traced(self.paths(s, (q, q), hi, shift), end))

    # Whole texts

    def encode(self, text: str, chunk: int | None = None) -> bytes:
        """Ids of a text; with `chunk`, by chunks of so many characters."""
        if not text:
            return b""
        s = BLANK + text.replace(" ", BLANK)
        if self.meets and (chunk is None or len(s) <= chunk):
            return self.words(s)
        chunk = chunk or len(s)
        cuts = [(*chunked(s, at, chunk, self.longest), at) for at in range(0, len(s), chunk)]
        matrices = [self.transfer(*cut) for cut in cuts]
        states = inner_states(matrices, START, best_end(combined(matrices)))
        return b"".join(self.between(*cut, a, b) for cut, a, b in zip(cuts, states, states[1:], strict=False))

    def spelled(self, ids: bytes) -> bytes:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, self.dtype).tolist()))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of ids, the blank in front taken off."""
        out = self.spelled(ids)
        return out[1:] if out[:1] == b" " else out


def chunked(s: str, at: int, chunk: int, longest: int) -> tuple[str, int, int]:
    """(chunk with its surroundings, characters before it, characters in it)"""
    left = min(at, longest)
    return s[at - left : at + chunk + longest], left, min(chunk, len(s) - at)


def moved(m: Matrix, by: int) -> Matrix:
    go = lambda x: x if x == START else (x[0] + by, x[1] + by)
    return {go(x): {go(y): w for y, w in row.items()} for x, row in m.items()}


def back(x: State, by: int) -> State:
    return x if x == START else (x[0] - by, x[1] - by)


_models: dict[int, Model] = {}


def _model(proto: bytes) -> Model:
    key = hash(proto)
    if key not in _models:
        _models.clear()
        _models[key] = Model(proto)
    return _models[key]


_PACKED = "struct<ids:binary,n_tokens:bigint,round_trip:boolean,chunks:int>"


def _whole(column: pa.Array, proto: bytes) -> pa.StructArray:
    """A slice's texts at a time, so that words and decoded texts of a batch never are
    in memory together."""
    m = _model(proto)
    ids, same, some = [], [], []
    for part in slices(column):
        for t in part.to_pylist():
            ids.append(m.encode(t) if t else b"")
            same.append(m.decode(ids[-1]) == (t or "").encode())
            some.append(bool(t))
    n = [len(i) // m.dtype.itemsize for i in ids]
    out = pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(same, pa.bool_()), pa.array(some).cast(pa.int32())], ["ids", "n_tokens", "round_trip", "chunks"])
    del ids
    tidy()
    return out


def encode(docs: DataFrame, model_file: str, text: str = "text", into: str = "pieces", giant: int = 32_768, chunk: int = 8_192, fan: int = 32) -> DataFrame:
    """docs with the struct `into`: ids (binary, little-endian uint16, uint32 for
    vocabularies over 65,536), n_tokens, round_trip (whether decoding the ids gives
    the text back: all but texts that hold U+2581, which stands for a blank), chunks.

    Texts of over `giant` characters are cut into chunks that are rows of their
    own, dealt over all executors; no text is cut short, and ids do not depend on
    giant, chunk or fan. Null and empty texts have no ids, no tokens, 0 chunks, and
    come back. A column named `into` is replaced; all others stay, whatever their
    names, and so do repeated rows. An empty table gives none. The model file is read
    on the driver and sent to tasks (its size is that of a vocabulary)."""
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    longest = Model(proto.value).longest
    column = quoted(text)
    is_giant = F.coalesce(F.length(column) > giant, F.lit(False))
    rest = [quoted(c) for c in docs.columns if c.lower() != into.lower()]

    @F.arrow_udf(_PACKED)
    def whole(texts: pa.Array) -> pa.Array:
        return _whole(texts, proto.value)

    plain = docs.where(~is_giant).select(*rest, whole(column).alias(into))
    uid = free_name(docs, "uid")
    giants = staged(docs.where(is_giant).select("*", F.monotonically_increasing_id().alias(uid)), "pieces-giants")
    if giants.isEmpty():
        return plain

    # A row's chunks, with their surroundings, in the JVM: (uid, k, s, left, size).
    parts = F.regexp_extract_all(F.concat(F.lit(BLANK), F.translate(column, " ", BLANK)), F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    x = giants.select(quoted(uid).alias("uid"), parts.alias("p"), F.contains(column, F.lit(BLANK)).alias("mark"))
    p = F.col("p")
    before = lambda i: F.when(i > 0, F.right(F.get(p, i - 1), F.lit(longest))).otherwise("")
    after = lambda i: F.coalesce(F.left(F.get(p, i + 1), F.lit(longest)), F.lit(""))
    cut = F.transform(p, lambda c, i: F.struct(i.cast("long").alias("k"), F.concat(before(i), c, after(i)).alias("s"), F.length(before(i)).alias("left"), F.length(c).alias("size")))
    chunks = staged(x.select("uid", "mark", F.explode(cut).alias("c")).select("uid", "mark", "c.*").repartition("uid", "k"), "pieces-chunks")

    def matrix(batches):
        for b in batches:
            m = _model(proto.value)
            for part in slices(b, 2):
                rows = [m.transfer(s, left, size, k * chunk) for k, s, left, size in zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pickle.dumps(x) for x in rows], pa.binary())], ["uid", "k", "matrix"])
            tidy()

    def multiplied(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("k").to_pylist(), table.column("matrix").to_pylist(), strict=True))
        m = combined(pickle.loads(x) for _, x in rows)
        return pa.table({"uid": table.column("uid")[:1], "k": pa.array([rows[0][0] // fan]), "matrix": pa.array([pickle.dumps(m)], pa.binary())})

    fields = "uid long, k long, matrix binary"
    rounds = [staged(chunks.select("uid", "k", "s", "left", "size").mapInArrow(matrix, fields), "pieces-matrices")]
    block = F.expr(f"k div {fan}").alias("block")
    most = chunks.agg(F.max("k")).first()[0] + 1
    while most > 1:
        rounds.append(staged(rounds[-1].groupBy("uid", block).applyInArrow(multiplied, fields), "pieces-products"))
        most = -(-most // fan)

    pairs = "uid long, k long, a array<long>, b array<long>"

    def ends(batches):
        for b in batches:
            last = [list(best_end(pickle.loads(x))) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(START)] * len(last)), pa.array(last)], ["uid", "k", "a", "b"])

    def inside(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("k").to_pylist(), table.column("matrix").to_pylist(), strict=True))
        states = inner_states([pickle.loads(x) for _, x in rows], *(tuple(table.column(c)[0].as_py()) for c in "ab"))
        return pa.table({"uid": pa.array(table.column("uid")), "k": [k for k, _ in rows], "a": [list(x) for x in states[:-1]], "b": [list(x) for x in states[1:]]})

    states = rounds[-1].mapInArrow(ends, pairs)
    for level in rounds[-2::-1]:
        known = states.select("uid", F.col("k").alias("block"), "a", "b")
        states = level.select("*", block).join(known, ["uid", "block"]).groupBy("uid", "block").applyInArrow(inside, pairs)

    def trace(batches):
        for b in batches:
            m = _model(proto.value)
            for part in slices(b, 2):
                ids, same = [], []
                for k, s, left, size, x, y in zip(*(part.column(i).to_pylist() for i in (1, 2, 3, 4, 5, 6)), strict=True):
                    x, y, shift = tuple(x), tuple(y), k * chunk - left
                    ids.append(m.between(s, left, size, k * chunk, x, y))
                    same.append(m.spelled(ids[-1]) == s[max(x[1] - shift, 0) : y[1] - shift].replace(BLANK, " ").encode())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], ["uid", "k", "ids", "same"])
            tidy()

    traced = chunks.join(states, ["uid", "k"])
    marks = chunks.where("k = 0").select("uid", "mark")
    traced = traced.select("uid", "k", "s", "left", "size", "a", "b").mapInArrow(trace, "uid long, k long, ids binary, same boolean")
    size = _model(proto.value).dtype.itemsize
    per_doc = traced.groupBy("uid").agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY k)").alias("ids"), F.bool_and("same").alias("same"), F.count("*").cast("int").alias("chunks")).join(marks, "uid")
    packed = F.struct("ids", F.expr(f"octet_length(ids) div {size}").alias("n_tokens"), (F.col("same") & ~F.col("mark")).alias("round_trip"), "chunks")
    per_doc = per_doc.select(F.col("uid").alias(uid), packed.alias(free_name(docs, into + "_")))
    done = giants.join(per_doc, uid)
    return plain.unionByName(done.select(*rest, quoted(free_name(docs, into + "_")).alias(into)))


def decode(df: DataFrame, model_file: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """df with the text of each row's ids (binary as `encode` writes them); null for null.
    A column named `into` is replaced; rows and other columns stay as they are."""
    with open(model_file, "rb") as f:
        proto = df.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        m = _model(proto.value)
        return pa.array([None if x is None else m.decode(x).decode("utf-8", "replace") for x in column.to_pylist()], pa.string())

    return df.withColumn(into, of(quoted(ids)))
