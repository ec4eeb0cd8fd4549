"""Queries that SQL does not express, against plain recomputations."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

from linkweave.llm import importance, quality_rules, queries, shared, training_order
from tests.llm.test_operators import BPE, base_counts, prose


def test_importance_by_hand(spark):
    r = random.Random(41)
    data = [(i, prose(r, r.randint(0, 60))) for i in range(90)] + [(200, None), (201, "One"), (5, "again")]
    marks = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 60)]
    how = importance.Sampling(buckets=64, keep=0.4, seed=9)
    got = importance.resample(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), how).collect()

    def grams(text):
        h = [shared.word_hashes(w.lower().encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return [int(shared.mixed(x)[0]) % 64 for x in h] + [int(shared.shingle_hashes(np.concatenate(p), 2)[0]) % 64 for p in zip(h, h[1:])]

    good = {i for i, quality, toxic in marks if quality == 1 and toxic != 1}
    every, target = Counter(), Counter()
    for i, t in data:
        every.update(grams(t))
        if i in good:
            target.update(grams(t))
    all_raw, all_target = sum(every.values()) + 64, sum(target.values()) + 64
    p = [(every[b] + 1) / all_raw for b in range(64)]
    ratio = [math.log((target[b] + 64 * p[b]) / all_target) - math.log(p[b]) for b in range(64)]
    want = []
    for i, t in data:
        score = sum(ratio[b] for b in grams(t))
        u = ((xxhash.xxh3_64_intdigest(f"9:{i}".encode()) >> 12) + 0.5) / 2.0**52
        want.append((i, score, math.floor((score - math.log(-math.log(u))) * (1 << 20))))
    order = lambda x: (x[0], x[1])
    for a, b in zip(sorted(((x.doc_id, x.log_ratio, x.key) for x in got), key=order), sorted(want, key=order), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-8 and abs(a[2] - b[2]) <= 1
    kept = {(x.doc_id, x.key) for x in got if x.kept}
    ranked = sorted(((x.doc_id, x.key) for x in got), key=lambda x: (-x[1], x[0]))
    assert kept == set(ranked[: math.ceil(0.4 * len(data))])


def test_quality_verdict_by_hand(spark):
    r = random.Random(42)
    junk = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(n))
    data = [prose(r, n) for n in (10, 60, 300, 2000)] + [junk(n) for n in (400, 3000, 9000)] + [prose(r, 900) + junk(3000), "same words here " * 300, ("a b c d e " * 12 + prose(r, 40) + "\n") * 3, None, ""]
    bands = quality_rules.Bands()
    size = lambda raw: len(zstandard.ZstdCompressor(level=bands.level).compress(raw))
    band = lambda n: next((low, high) for upto, low, high in bands.whole if n <= upto)

    def keeps(text):
        n, _, _, _, repeated = base_counts(text)
        raw = (text or "").encode()
        if n < 50 or 100 * repeated > 50 * n:
            return False
        low, high = band(len(raw))
        chunks = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
        if len(chunks) > 1 and len(chunks[-1]) < 512:
            chunks.pop()
        out = 0
        for c in chunks if len(chunks) > 1 else []:
            least = bands.chunk[0] if len(c) == 2048 else min(bands.chunk[0], band(len(c))[0])
            out += len(c) * (not least <= len(c) / size(c) <= bands.chunk[1])
        return low <= len(raw) / size(raw) <= high and out <= 0.3 * sum(map(len, chunks))

    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {x.doc_id: x.verdict.kept for x in quality_rules.compression_bands(df).collect()}
    assert got == {i: keeps(t) for i, t in enumerate(data)} and set(got.values()) == {True, False}


def test_slots_by_hand(spark, tmp_path):
    r = random.Random(43)
    data = [(i, prose(r, r.randint(0, 120)) or None) for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    training_order.write_shards(df, str(tmp_path / "s"), BPE, queries.BPE_PATTERN, length=50, per_shard=16, key=5)
    with open(BPE, "rb") as f:
        bpe = training_order.ByteBpe(f.read(), queries.BPE_PATTERN)
    windows = []
    for i, t in df.collect():  # the rows of the one partition, in order
        ids = [*bpe.encoding.encode_ordinary(t), bpe.end] if t else []
        windows += [(i, w // 50, tuple(ids[w : w + 50])) for w in range(0, len(ids), 50)]
    order = training_order.Feistel(len(windows), 5)
    want = {int(order.slot(np.array([k]))[0]): x for k, x in enumerate(windows)}
    got = {x.slot: (x.doc_id, x.window, tuple(np.frombuffer(x.tokens, "<u2").tolist())) for x in training_order.read_shards(spark, str(tmp_path / "s")).collect()}
    assert got == want
    for slot in range(len(windows)):  # a slot's place in the files needs no index
        (file,) = (tmp_path / f"s/data/shard={slot // 16}").glob("part-*")
        stride = training_order.HEADER.itemsize + 101
        assert np.frombuffer(file.read_bytes()[slot % 16 * stride :][:8], "<i8")[0] == want[slot][0]


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    lang = {x.doc_id: x.lang for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op10_language_id(spark, folder).collect()
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    known = [x for x in held if lang[x.doc_id] is not None and x.lang_pred != "und"]
    assert len(known) > 100 and np.mean([x.lang_pred == lang[x.doc_id] for x in known]) >= 0.95
    letterless = spark.read.parquet(f"{folder}/documents.parquet").where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    assert {x.doc_id for x in letterless.collect()} == {x.doc_id for x in got if x.lang_pred == "und"}
