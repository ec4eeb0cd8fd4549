"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads windows of UTF-8 bytes in both directions, labels every
position, and a document's probabilities are the mean over all its positions. It
is trained here, in numpy on the driver, by backpropagation through time on a
bounded sample of labelled windows; prediction runs as one Arrow UDF over whole
texts, thousands of windows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import raw_texts, slices, tidy

UNKNOWN = "und"
#: A letter of any script; numerals such as a half or a Roman eight are none.
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample: `per_language` documents of each language, fewer
    (one at least) where languages are so many that they pass `max_rows`; of each
    document `sample_chars` characters, from a place that a hash picks. They bound
    the fit alone: predictions read whole texts. hidden: units per direction;
    window: bytes that a training sequence has."""

    per_language: int = 400
    max_rows: int = 25_600
    sample_chars: int = 1024
    hidden: int = 8
    window: int = 64
    batch: int = 256
    steps: int = 300
    rate: float = 0.02
    seed: int = 10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class BiGru:
    """Weights by direction: w (256, 3H) input by byte, u (H, 3H) recurrent, b (3H);
    out (2H, C), c (C). Gates: update, reset, candidate."""

    def __init__(self, classes: int, hidden: int, seed: int):
        r = np.random.default_rng(seed)
        new = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0] if shape[0] != 256 else hidden)).astype(np.float32)
        self.hidden = hidden
        self.p = {"out": new(2 * hidden, classes), "c": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": new(256, 3 * hidden), f"u{d}": new(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def _run(self, d: str, x: np.ndarray):
        """States (T, B, H) over bytes x (T, B), and what their gradients need."""
        n, (steps, rows) = self.hidden, x.shape
        u_zr, u_c = np.ascontiguousarray(self.p[f"u{d}"][:, : 2 * n]), np.ascontiguousarray(self.p[f"u{d}"][:, 2 * n :])
        table = self.p[f"w{d}"] + self.p[f"b{d}"]
        h, out, saved = np.zeros((rows, n), np.float32), np.empty((steps, rows, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = table[x[t]]
            zr = _sigmoid(a[:, : 2 * n] + h @ u_zr)
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n :] + (r * h) @ u_c)
            saved.append((t, h, z, r, c))
            h = out[t] = h + z * (c - h)
        return out, saved

    def _states(self, d: str, x: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        """The states of _run, (T, B, H), in buffers that stay in cache; positions that
        aren't live (a text's end, padded) keep their state."""
        n, (steps, rows) = self.hidden, x.shape
        u = self.p[f"u{d}"].copy()
        u[:, : 2 * n] *= 0.5  # a sigmoid is a hyperbolic tangent of half
        u_zr, u_c = np.ascontiguousarray(u[:, : 2 * n]), np.ascontiguousarray(u[:, 2 * n :])
        table = self.p[f"w{d}"] + self.p[f"b{d}"]
        table[:, : 2 * n] *= 0.5
        t_zr, t_c = np.ascontiguousarray(table[:, : 2 * n]), np.ascontiguousarray(table[:, 2 * n :])
        h, out = np.zeros((rows, n), np.float32), np.empty((steps, rows, n), np.float32)
        zr, m, c, rh = (np.empty((rows, k), np.float32) for k in (2 * n, 2 * n, n, n))
        half = np.float32(0.5)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(t_zr, x[t], axis=0, out=zr, mode="clip")
            np.matmul(h, u_zr, out=m)
            zr += m
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            np.multiply(zr[:, n:], h, out=rh)
            np.matmul(rh, u_c, out=c)
            np.take(t_c, x[t], axis=0, out=rh, mode="clip")
            c += rh
            np.tanh(c, out=c)
            c -= h
            c *= zr[:, :n]
            if live is not None:
                c *= live[t][:, None]
            h = np.add(h, c, out=out[t])
        return out

    def labels(self, x: np.ndarray, live: np.ndarray | None) -> np.ndarray:
        """Class probabilities of every position: (T * B, C), T first."""
        f, b = self._states("f", x, live), self._states("b", x, live)
        n = self.hidden
        s = f.reshape(-1, n) @ self.p["out"][:n]
        s += b.reshape(-1, n) @ self.p["out"][n:]
        s += self.p["c"]
        top = s[:, 0].copy()
        for k in range(1, s.shape[1]):
            np.maximum(top, s[:, k], out=top)
        s -= top[:, None]
        np.exp(s, out=s)
        s /= (s @ np.ones(s.shape[1], np.float32))[:, None]
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions of whole windows x (T, B) of classes y (B),
        and its gradients by backpropagation through time."""
        n, (steps, rows) = self.hidden, x.shape
        f, saved_f = self._run("f", x)
        b, saved_b = self._run("b", x)
        both = np.concatenate([f, b], axis=2)
        s = both @ self.p["out"] + self.p["c"]
        s -= s.max(axis=2, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=2, keepdims=True)
        at = np.arange(rows)
        loss = float(-np.log(p[:, at, y] + 1e-12).mean())
        p[:, at, y] -= 1
        p /= steps * rows
        flat = both.reshape(-1, 2 * n)
        g = {"out": flat.T @ p.reshape(len(flat), -1), "c": p.sum(axis=(0, 1))}
        back = p @ self.p["out"].T
        for d, saved, part in (("f", saved_f, back[:, :, :n]), ("b", saved_b, back[:, :, n:])):
            u = self.p[f"u{d}"]
            gw, gu, dh = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u), np.zeros((rows, n), np.float32)
            for t, h, z, r, c in reversed(saved):
                dh = dh + part[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h) * z * (1 - z)
                drh = dc @ u[:, 2 * n :].T
                dr = drh * h * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                gu[:, : 2 * n] += h.T @ da[:, : 2 * n]
                gu[:, 2 * n :] += (r * h).T @ dc
                np.add.at(gw, x[t], da)
                dh = dh * (1 - z) + drh * r + da[:, : 2 * n] @ u[:, : 2 * n].T
            g |= {f"w{d}": gw, f"u{d}": gu, f"b{d}": gw.sum(axis=0)}
        return loss, g

    def train(self, data: list[bytes], classes: list[int], how: Training) -> None:
        """Adam over random windows, every class drawn as often."""
        r, m = np.random.default_rng(how.seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        by = {c: [d for d, k in zip(data, classes, strict=True) if k == c] for c in sorted(set(classes))}
        for step in range(1, how.steps + 1):
            y = r.choice(list(by), how.batch)
            x = np.full((how.batch, how.window), 32, np.uint8)
            for i, c in enumerate(y):
                d = by[c][r.integers(len(by[c]))]
                d = d[(s := int(r.integers(max(1, len(d) - how.window + 1)))) : s + how.window]
                d = (d * (how.window // len(d) + 1))[: how.window]
                x[i] = np.frombuffer(d, np.uint8)
            _, g = self.gradients(np.ascontiguousarray(x.T), y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = how.rate * min(1.0, step / 20) * (1 - step / (how.steps + 1))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                a, b = m[k]
                a += 0.1 * (v - a)
                b += 0.01 * (v * v - b)
                self.p[k] -= np.float32(rate) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + np.float32(1e-8))


def pooled(net: BiGru, texts: list[bytes], window: int = 128, rows: int = 2048) -> np.ndarray:
    """Mean class probabilities over all bytes of each text. Texts are cut in
    windows, which run `rows` at a time; the last of each text, filled up, apart."""
    classes = len(net.p["c"])
    sums = np.zeros((len(texts), classes))

    def run(x: np.ndarray, own: np.ndarray, live: np.ndarray | None) -> None:
        p = net.labels(np.ascontiguousarray(x.T), live).reshape(window, len(x), classes)
        np.add.at(sums, own, p.sum(axis=0) if live is None else np.einsum("tbc,tb->bc", p, live))

    sizes = np.array([len(t) for t in texts])
    full, rest = sizes // window, sizes % window
    whole = np.frombuffer(b"".join(t[: k * window] for t, k in zip(texts, full.tolist(), strict=True)), np.uint8).reshape(-1, window)
    own = np.repeat(np.arange(len(texts)), full)
    for at in range(0, len(own), rows):
        run(whole[at : at + rows], own[at : at + rows], None)
    ends = np.flatnonzero(rest)
    for at in range(0, len(ends), rows):
        some = ends[at : at + rows]
        x = np.zeros((len(some), window), np.uint8)
        for i, t in enumerate(some):
            x[i, : rest[t]] = np.frombuffer(texts[t][full[t] * window :], np.uint8)
        run(x, some, (np.arange(window)[:, None] < rest[some]).astype(np.float32))
    return sums / np.maximum(sizes, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 5 is 0. A null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, how: Training = Training()) -> tuple[BiGru, list[str]]:
    """A network and its languages from docs (doc_id, text, lang); rows held out and
    rows without lang are not read into it. The same rows give the same network."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return BiGru(1, how.hidden, how.seed), []
    per_language = max(1, min(how.per_language, how.max_rows // len(counts)))
    # Each language's share of a hash range: about twice the rows wanted.
    unit = 1 << 30
    h = F.pmod(F.xxhash64("doc_id", F.lit(how.seed)), F.lit(unit))
    upto = F.create_map(*[F.lit(v) for c in counts for v in (c["lang"], min(unit, 2 * per_language * unit // c["count"] + unit // c["count"] * 40))])
    begin = F.pmod(F.xxhash64("doc_id", F.lit(-how.seed)), F.greatest(F.length("text") - how.sample_chars, F.lit(0)) + 1) + 1
    picked = rows.select("lang", h.alias("h"), F.substring(F.col("text"), begin.cast("int"), F.lit(how.sample_chars)).alias("t"))
    picked = picked.where(F.col("h") < F.try_element_at(upto, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    picked = picked.where("t <> ''").withColumn("n", nth).where(F.col("n") <= per_language)
    sample = sorted((r["lang"], r["h"], r["t"]) for r in picked.collect())
    langs, data, classes = sorted({x[0] for x in sample}), [], []
    for i, lang in enumerate(langs):
        own = [t.encode() for x, _, t in sample if x == lang and t][:per_language]
        data += own
        classes += [i] * len(own)
    net = BiGru(len(langs), how.hidden, how.seed)
    net.train(data, classes, how)
    return net, langs


def predict(text: Column, net: BiGru, langs: list[str]) -> Column:
    """Struct lang, score (mean probability of it) of each whole text. Null, empty
    and letterless texts, and all texts where no language was learned: 'und', 0."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        lang, score, at = [UNKNOWN] * len(texts), np.zeros(len(texts)), 0
        for part in slices(texts, most=8 << 20):
            raw = raw_texts(part)
            use = [i for i, t in enumerate(raw) if t and langs]
            if use:
                p = pooled(net, [raw[i] for i in use])
                for i, row in zip(use, p, strict=True):
                    lang[at + i], score[at + i] = langs[int(row.argmax())], min(1.0, float(row.max()))
            at += len(raw)
        tidy()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang", "score"])

    return of(F.when(text.rlike(LETTER), text))


def identify(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang).

    A null doc_id is held out. Null, empty and letterless texts get 'und' and 0, and so
    do all where no row has a lang to learn. Texts are read whole, however long;
    repeated rows are answered each, and equal texts alike. Other columns, whatever
    their names, are not read. Empty table: no rows."""
    net, langs = fit(docs, how)
    x = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), net, langs).alias("_p"))
    return x.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
