import base64
import hashlib
import itertools
import random
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import time
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.llm import importance, jaccard, language_id, mixing, pieces, quality_rules, queries, topk, training_order, url_filters, warc

WORDS = "the of and to in that was it for on with as his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other about out many then them these so".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def texts():
    """Texts of every awkward kind, by id; ids repeat and are null."""
    r = random.Random(1)
    base = [prose(r, 120) for _ in range(6)]
    near = [" ".join(w if r.random() > 0.02 else "x" + w for w in b.split()) for b in base for _ in range(4)]
    odd = [None, "", " \n\t ", "a▁b", "▁" * 700, "one", "One two", "one two", "\u00a0", "é" * 300, "###", "a\u2003b", prose(r, 30_000)]
    rows = [(i, t) for i, t in enumerate(base + near + base[:2] + odd)]
    return [*rows, rows[0], rows[3], (None, base[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", "fr", None]
    return spark.createDataFrame([(i, t, langs[k % 3], [None, "a", "b", "null"][k % 4]) for k, (i, t) in enumerate(texts)], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Word hashes


def test_word_hashes(texts):
    from linkweave.llm import shared

    of = {}
    r = random.Random(13)
    for raw in [(t or "").encode() for _, t in texts] + ["".join(r.choice("ab \n\t\x0b\x00\x85é") for _ in range(n)).encode() for n in (1, 7, 300_000)] + [b"a" * 600_000 + b" b"]:
        words, hashes = raw.split(), shared.word_hashes(raw)
        assert len(words) == len(hashes)
        for w, h in zip(words, hashes.tolist(), strict=True):
            assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


# Compression bands


def base_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, windows = {}, [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for i, x in enumerate(windows):
        seen.setdefault(x, []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines, dup, old = (text or "").split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in old
            old.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


@given(st.text("ab é#\n\t", max_size=60))
@settings(max_examples=300, deadline=None)
def test_base_counts(text):
    got = quality_rules.judge(text.encode(), quality_rules.Bands(), __import__("zstandard").ZstdCompressor())
    assert got[:5] == base_counts(text)


def test_quality_rules(spark, docs, texts):
    out = quality_rules.compression_bands(docs.withColumn("verdict", F.lit(1)).withColumn("kept", F.lit("mine")))
    assert out.columns == ["doc_id", "text", "lang", "source", "verdict", "kept"]
    got = out.select("doc_id", "text", "verdict.*").collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, rep = base_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    rnd = random.Random(2)
    junk = {
        "good": prose(rnd, 300),
        "same": "\n".join(f"{'and so on ' * 8} {i}" for i in range(200)),
        "random": base64.b85encode(rnd.randbytes(4000)).decode() + " " + " ".join(base64.b85encode(rnd.randbytes(9)).decode() for _ in range(80)),
    }
    kept = quality_rules.keep_good(spark.createDataFrame(list(junk.items()), "name string, text string"))
    assert [r.name for r in kept.collect()] == ["good"]
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def random_words(r, letters, n):
    text = " ".join("".join(r.choices(letters, k=r.randint(3, 10))) for _ in range(n // 4))
    return text.encode()[:n]


def test_incompressible_texts_of_any_length():
    r, lower = random.Random(7), string.ascii_lowercase
    base64_letters, base85_letters = lower + lower.upper() + string.digits + "+/", "".join(map(chr, range(33, 118)))
    verdict = lambda raw: quality_rules.judge(raw, quality_rules.Bands(), zstandard.ZstdCompressor(level=3))
    for n in (336, 500, 702, 1000, 1100, 1430, 2000, 3000, 10_000, 70_000):
        for letters in (base64_letters, base85_letters, *([lower] if n > 1024 else [])):
            for _ in range(20):
                got = verdict(random_words(r, letters, n))
                assert not got[8] and got[9] in ("incompressible", "too_short"), (n, letters, got)
        assert verdict(prose(r, n // 3).encode()[:n])[8], n


def test_mixed_texts_and_chunks():
    r = random.Random(8)
    encode = lambda kind, n: getattr(base64, kind)(r.randbytes(n))[:n]
    for kind in ("b64encode", "b85encode"):
        for n in (2048, 5000, 10_000, 40_000):
            clean = prose(r, n).encode()[:n]
            for part in (0.4, 0.6, 0.9):
                got = quality_rules.judge(clean[: int(n * (1 - part))] + b" " + encode(kind, int(n * part)), quality_rules.Bands(), zstandard.ZstdCompressor(level=3))
                assert not got[8], (kind, n, part, got)
            assert quality_rules.judge(clean, quality_rules.Bands(), zstandard.ZstdCompressor(level=3))[8], n


# Mixing


def water_fill(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > most * sizes[s]]
        if not full:
            return target | share
        target |= {s: float(most * sizes[s]) for s in full}
        open_ -= set(full)


def test_mixing(spark):
    r = random.Random(3)
    data = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "B", "é", None, "null", "tiny"] + ["big"] * 4)) for i in range(1500) if i]
    data = [x for x in data if x[2] != "tiny" or x[0] % 40 == 0] + data[:5] + [(None, "w w", "a"), (7, None, "empty")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = water_fill(sizes)
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert {x.source_size for x in mine} == {sizes[s]} and all(abs(x.target - target[s]) < 1e-6 for x in mine)
        assert all(0 <= x.copies <= 3 for x in mine)
        assert abs(sum(x.copies * x.size for x in mine) - target[s]) <= 130
    again = mixing.mix(df.repartition(7)).collect()
    assert rows_of(again) == rows_of(got)
    out = mixing.mixed_documents(df.withColumn("size", F.lit("clash")))
    assert out.columns == ["doc_id", "text", "source", "size"] and out.count() == sum(x.copies for x in got)
    assert mixing.mix(df.limit(0)).count() == 0


def rows_of(got):
    return sorted(map(repr, got))


# URL filters


def test_url_filters(spark):
    urls = [None, "", "no scheme casino", "http://a.com/en/1", "HTTP://X.Example.COM/en/7?x", "http://example.com/en/6", "https://net/de/", "http://q.example.net/de/8", "ftp://notorg/es/", "http://org/es/x#y", "http://u/casino?x#z", "http://u/casinos", "http://u/a_casino", "x://?q", "http://Ünet/de/", "http://a/?phpsessid=1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(0))
    got = {r.url: (r.judged.host, r.judged.path, r.judged.rule, r.judged.verdict) for r in url_filters.filter_urls(df, rules=queries.HOST_RULES).collect()}
    assert got[None] == got[""] == ("", "", None, "allow")
    assert got["no scheme casino"] == ("", "", None, "block")
    assert got["http://a.com/en/1"] == ("a.com", "/en/1", "com/en/", "block")
    assert got["HTTP://X.Example.COM/en/7?x"] == ("x.example.com", "/en/7", "example.com/en/7", "allow")
    assert got["http://example.com/en/6"][2:] == ("com/en/", "block")
    assert got["https://net/de/"][2:] == ("net/de/", "allow")
    assert got["http://q.example.net/de/8"][2:] == ("example.net/de/8", "block")
    assert got["ftp://notorg/es/"][2:] == (None, "allow")
    assert got["http://org/es/x#y"] == ("org", "/es/x", "org/es/", "block")
    assert got["http://u/casino?x#z"][1:] == ("/casino", None, "block") and got["http://u/casinos"][3] == "allow"
    assert got["http://Ünet/de/"][2] is None and got["http://a/?phpsessid=1"][3] == "block"
    assert url_filters.filter_urls(df.limit(0)).count() == 0


def test_index_finds_what_patterns_match():
    import re

    r = random.Random(4)
    patterns = [r"\bab\b", r"/a-b[./]", r"[?&]ab=1", r"ab", r"\ba(?:b|c)d\b", r"^ab\b", r"\bab$", r"\bx?ab-\b"]
    assert url_filters.literal_tokens(r"\bx?ab-\b") == [] and url_filters.literal_tokens(r"/a-b[./]") == ["a", "b"]
    for counts in ({}, {"a": 5, "ab": 9}):
        first = url_filters.Index(patterns, counts).matcher()
        for _ in range(3000):
            u = "".join(r.choice("ab/-.?=1_x") for _ in range(7))
            assert first(u) == next((p for p in patterns if re.search(p, u, re.ASCII)), None)


def test_only_fetched_rules_run(spark):
    r = random.Random(14)
    names = sorted({"".join(r.choices(string.ascii_lowercase, k=6)) for _ in range(5000)})
    patterns = [rf"\b{x}\b[/?]id={i % 9}" for i, x in enumerate(names)]
    ran = []
    first = url_filters.Index(patterns, {}).matcher(ran)
    urls = [f"http://x.org/{names[i]}/id={i % 9 if i % 2 else 'z'}" for i in range(0, 4000, 7)] + ["http://x.org/none"] * 50
    assert [first(u) for u in urls] == [patterns[i] if i % 2 else None for i in range(0, 4000, 7)] + [None] * 50
    assert sorted(ran) == list(range(0, 4000, 7))
    text = ["# a list", "", *(f"pattern {p}" for p in patterns[:40]), "block x.org/a", " allow x.org/a/b "]
    hosts, got = url_filters.read_rules(text)
    assert hosts == ("block x.org/a", "allow x.org/a/b") and got == tuple(patterns[:40])
    for bad in ("pattern (", "deny x.org/", "block"):
        with pytest.raises(ValueError, match="line 2"):
            url_filters.read_rules(["", bad])
    data = [None, "http://x.org/a/b", "http://x.org/a", *urls[:40]]
    df = spark.createDataFrame([(x,) for x in data], "url string").withColumn("judged0", F.lit(1))
    whole = url_filters.filter_urls(df, rules=hosts, patterns=got)
    parts = url_filters.filter_urls(df, rules=hosts, patterns=got, block=7)
    assert parts.columns == whole.columns == ["url", "judged0", "judged"] and rows(parts) == rows(whole)


# WARC


def test_warc(spark):
    tricky = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny"
    data = [(3, "http://a/1", "same é"), (2, "http://b/2 3\r\n", "same é"), (9, None, None), (8, "u", ""), (5, "http://c", tricky), (6, "http://c", tricky), (7, "http://d", "z" * 100_000), (7, "http://d", "z" * 100_000), (None, "http://e", "none")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    got = warc.captured(df)
    first = {}
    for i, _, h in data:
        first[h or ""] = min(x for x in (first.get(h or ""), i) if x is not None) if (first.get(h or ""), i) != (None, None) else None
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        f = first[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    assert rows(got.drop("target_uri")) == sorted(want, key=repr)
    assert warc.captured(df.limit(0)).count() == 0
    small = warc.captured(df, min_revisit_bytes=10).where("record_type = 'revisit'")
    assert {r.payload_bytes for r in small.collect()} == {len(tricky)}


def test_assembly_in_any_direction(spark):
    fields = "warc_type string, record_id string, concurrent_to array<string>, payload_bytes long"
    data = [("response", "r1", ["q1"], 1), ("request", "q1", [], 2), ("metadata", "m1", ["q1"], 3), ("response", "r2", [], 4), ("metadata", "m2", ["r2"], 5), ("request", "q9", ["gone"], 6)]
    got = warc.assemble(spark.createDataFrame(data, fields)).select("capture_id", "request.record_id", "metadata.record_id")
    assert rows(got) == [("r1", "q1", "m1"), ("r2", None, "m2")]
    # One record of several captures, named directly or reached by way of another.
    data = [("response", "r1", [], 1), ("response", "r2", [], 1), ("request", "q1", ["r1"], 2), ("metadata", "m1", ["r1", "r2"], 3), ("metadata", "m0", None, 3)]
    got = warc.assemble(spark.createDataFrame(data, fields)).select("capture_id", "request.record_id", "metadata.record_id")
    assert rows(got) == [("r1", "q1", "m1"), ("r2", None, "m1")]
    data += [("request", "q0", ["m1"], 4), ("response", "r3", ["m0", "m1"], 1), (None, "x", ["r1"], 0), ("response", None, [], 0)]
    got = warc.assemble(spark.createDataFrame(data, fields)).select("capture_id", "request.record_id", "metadata.record_id")
    assert rows(got) == [("r1", "q1", "m1"), ("r2", "q0", "m1"), ("r3", "q0", "m0")]
    assert warc.assemble(spark.createDataFrame([], fields)).count() == 0


def test_content_length_must_be_a_number():
    with pytest.raises(ValueError, match="Content-Length 'many'"):
        warc.parse_record(b"WARC-Type: response\r\nContent-Length: many\r\n\r\nx")


def test_cut_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")
    with pytest.raises(Exception, match="within a record"):
        warc.read_archives(spark, str(tmp_path)).collect()


# Importance resampling


def test_importance(spark):
    r = random.Random(5)
    good = [(i, prose(r, r.randint(30, 200))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"@{r.randint(0, 9)}!{r.choice(WORDS)}" for _ in range(r.randint(30, 200)))) for i in range(100)]
    data = good + bad + [(5000, None), (5001, ""), (None, good[0][1]), good[1]]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("key", F.lit(0))
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in (good + bad)[::2]], "doc_id long, quality int, toxic int")
    out = importance.resample(df, labels)
    got = {x.doc_id: x.kept for x in out.collect()}
    assert out.count() == len(data)
    assert np.mean([got[i] for i, _ in good]) > 0.97 and np.mean([got[i] for i, _ in bad]) < 0.05
    assert rows(out) == rows(importance.resample(df.repartition(5), labels))
    kept = importance.selected_documents(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(x.kept for x in out.collect())
    assert importance.resample(df.limit(0), labels).count() == 0
    assert importance.resample(df, labels.limit(0)).where("not kept").count() == 0


def test_toxic_documents_are_not_good(spark):
    r = random.Random(6)
    clean = [(i, prose(r, r.randint(30, 200))) for i in range(300)]
    toxic = [(1000 + i, " ".join(r.choice(WORDS) + "!" for _ in range(r.randint(30, 200)))) for i in range(100)]
    df = spark.createDataFrame(clean + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in (clean + toxic)[::2]], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in importance.resample(df, labels).collect()}
    assert sum(got.values()) == 300
    assert np.mean([got[i] for i, _ in clean]) > 0.97 and np.mean([got[i] for i, _ in toxic]) < 0.05


@pytest.mark.parametrize("values", [[5], [1, 1, 1, 1], [-9, 3, 3, 7, 7, 7, 10**15], list(range(-50, 50))])
def test_kth_greatest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in range(1, len(values) + 1):
        kth, need = importance.kth_greatest(df, "x", k, bins=8)
        order = sorted(values, reverse=True)
        assert kth == order[k - 1] and need == k - sum(v > kth for v in values)


# Top-k


def test_topk(spark):
    r = np.random.default_rng(6)
    v = [[float(x) for x in r.normal(size=5)] for _ in range(200)]
    v[10:60] = [v[3]] * 50
    v += [None, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [], [1.0, 2.0], [1e4] * 5]
    data = [(i, x) for i, x in enumerate(v)] + [(5, v[7]), (None, v[8])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    ok = [(i, [int(np.floor(256 * y)) for y in x]) for i, x in data if x is not None and all(y is not None and np.isfinite(y) for y in x)]
    qs = [x for x in ok if x[0] is not None and x[0] % 3 == 0]
    want = []
    low = np.iinfo(np.int64).min
    for qi, q in qs:
        s = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), low if i is None else i) for i, x in ok if i != qi)[:4]
        want += [(qi, n + 1, i, -k) for n, (k, i) in enumerate(s)]
    for block in (7, None):
        got = topk.top_k(df, df.where("vec_id % 3 = 0"), k=4, block=block)
        assert rows(got) == sorted(((q, n, None if i == low else i, k) for q, n, i, k in want), key=repr)
        assert any(i == low for _, _, i, _ in want)
    for x in (1e300, -1e160):
        with pytest.raises(ValueError, match="do not fit"):
            topk.top_k(df.unionByName(spark.createDataFrame([(900, [x], "x")], df.schema)), df.where("vec_id = 0"))
    few = df.where("vec_id in (0, 1, 3)")
    assert topk.top_k(few, few, k=5).count() == 6
    assert topk.top_k(df.limit(0), df, k=5).count() == 0 == topk.top_k(df, df.limit(0), k=5).count()


# Jaccard join


def brute_classes(data, percent=75, width=5):
    import re

    sets = []
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [x for x in least[find(k)] if x is not None]
        out.append((i, len(s), (min(ids) if ids else None) if s else i))
    return sorted(out, key=repr)


def test_jaccard(docs, texts):
    got = jaccard.classes(docs.withColumn("n_shingles", F.lit("clash")))
    assert rows(got) == brute_classes(texts)
    assert jaccard.classes(docs.limit(0)).count() == 0


def family(r, base, n, rate):
    return [" ".join(w if r.random() > rate else f"{w}{r.randint(0, 99)}" for w in base) for _ in range(n)]


def test_jaccard_families(spark):
    """Variants about as far apart as the limit, in blocks cut in many parts."""
    r = random.Random(7)
    data = []
    for _ in range(4):
        data += family(r, prose(r, r.randint(20, 90)).split(), 45, 0.025)
    shared = prose(r, 12)
    data += [f"{shared} {prose(r, r.randint(2, 25))}" for _ in range(60)]
    data = list(enumerate(data))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for how in (jaccard.Join(), jaccard.Join(leaf_block=6, fanout=2)):
        told = {}
        assert rows(jaccard.classes(df, how, told)) == brute_classes(data)
        # All candidates are the trees', and their links alone span the classes.
        sizes = Counter(c for _, _, c in brute_classes(data))
        assert told["links of nodes"] > 0 and sum(v for k, v in told.items() if k.startswith("links")) >= sum(n - 1 for n in sizes.values())
        assert told["rows of distinct blocks"] < told["rows of blocks"]
    one = jaccard.one_of_each(df.withColumn("component_id", F.lit(1)))
    assert sorted(x.doc_id for x in one.collect()) == sorted({c for _, _, c in brute_classes(data)})


def test_a_large_group_costs_in_proportion(spark):
    """One group of near copies, in blocks of many leaves and several batches."""
    r = random.Random(17)
    base = prose(r, 60).split()
    data = [(i, " ".join(base[:55] + [f"{w}{i}" if k == i % 5 else w for k, w in enumerate(base[55:])])) for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        told = {}
        got = jaccard.classes(df, jaccard.Join(fanout=4), told)
        assert {x.component_id for x in got.collect()} == {0}
        assert told["candidates of nodes"] < 3 * 900 * 16
        assert rows(jaccard.classes(df.limit(200), jaccard.Join(fanout=4))) == brute_classes([tuple(x) for x in df.limit(200).collect()])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_stream_in_any_batches(spark):
    r = random.Random(18)
    size = {f: r.randint(20, 60) for f in range(60)}
    data = sorted({(r.randint(0, 40), r.randint(0, 9)) for _ in range(300)} | {(50, i) for i in range(60)} | {(51, i) for i in range(60)})
    small = {d: r.random() < 0.4 or d[0] > 49 for d in data}
    df = spark.createDataFrame([(*d, size[d[1]], small[d]) for d in data + data[::3]], "token long, fp long, n int, small boolean").repartition(3)
    pairs = {}
    for (t, f), (u, g) in itertools.permutations(data, 2):
        if t == u and (size[f], f) < (size[g], g) and small[t, f] and 100 * size[f] >= 75 * size[g]:
            pairs.setdefault(t, set()).add((f, g))
    sets = {}
    for t, f in data:
        sets.setdefault(t, set()).add(f)
    for batch in (1, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            out = jaccard.blocks(df)
            got = {}
            for t, f in rows(out.select("token", "fp")):
                got.setdefault(t, set()).add(f)
            assert set(got) == set(pairs)
            for t, fs in got.items():
                assert {f for p in pairs[t] for f in p} <= fs <= sets[t]
            kept = {}
            for t, f in rows(jaccard.distinct_blocks(out)):
                kept.setdefault(t, set()).add(f)
            assert sorted(map(sorted, kept.values())) == sorted(map(list, {tuple(sorted(fs)) for fs in got.values()}))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_tokens_that_may_be_shared_are_shuffled(spark, monkeypatch):
    """The filter leaves every block as it is, also if it is small and filled bit by bit."""
    r = random.Random(19)
    data = [x for _ in range(12) for x in family(r, prose(r, r.randint(20, 90)).split(), 4, 0.02)]
    data += ["".join(f" {r.random()}" for _ in range(r.randint(3, 120))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "doc long, text string").repartition(3)
    how = jaccard.Join()
    ranks = spark.sparkContext.broadcast(np.random.default_rng(20).permutation(1 << jaccard.BUCKET_BITS).astype(np.uint64))

    def taken(shared):
        rows_of = jaccard.prefixes(docs, ranks, spark.sparkContext.broadcast(shared), how)
        return rows_of.count(), rows(jaccard.blocks(rows_of).select("token", "fp"))

    everything, blocks = taken(np.full(128, 255, np.uint8))
    assert blocks
    total = everything
    few, same = taken(jaccard.shared_tokens(docs, ranks, how, total))
    assert same == blocks and 2 * few < everything
    monkeypatch.setattr(jaccard, "SHARED_BITS", 12)
    monkeypatch.setattr(jaccard, "GATHERED", 64)
    some, same = taken(jaccard.shared_tokens(docs, ranks, how, total))
    assert same == blocks and few < some < everything


def test_keys_are_packed_and_sizes_classed():
    r = np.random.default_rng(21)
    for top in (1, 300, 2**63):
        keys = np.sort(r.integers(0, top, 500).astype(np.uint64))
        assert (jaccard._unpacked(len(keys), *jaccard._packed(keys)) == keys).all()
    n = np.unique(np.concatenate([np.arange(1, 3000), r.integers(1, 10**8, 3000)]))
    for percent in (30, 75, 99, 100):
        c = jaccard.size_classes(n, jaccard.Join(percent=percent)).astype(int)
        d = jaccard.size_classes(100 * n // percent, jaccard.Join(percent=percent)).astype(int)
        assert (c <= d).all() and (d <= c + 1).all()


def test_shuffle_files_are_removed(spark, tmp_path):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before, old = spark.conf.get(jaccard.CLEANUP), files()
    with jaccard.shuffles_removed(spark):
        spark.range(1000).repartition(4, "id").write.parquet(f"{tmp_path}/x")
    assert spark.conf.get(jaccard.CLEANUP) == before
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.1)
    assert not files() - old


def test_bound_never_excludes_a_link():
    r = np.random.default_rng(8)
    how = jaccard.Join()
    for n in (3, 17, 60, 300, 2000):
        for _ in range(60):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: int(n * r.uniform(0.6, 1))], r.integers(0, 2**63, int(n * r.uniform(0, 0.4))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            k, both = len(np.intersect1d(a, b)), len(a) + len(b)
            p, q = (jaccard.count_vector(x) for x in (a, b))
            if 100 * k >= 75 * (both - k):
                assert jaccard.may_link(p, q, both, how)
                s, t = (a, b) if len(a) <= len(b) else (b, a)
                ranks = r.permutation(1 << jaccard.BUCKET_BITS).astype(np.uint64)
                s, t = jaccard.ordered(s, ranks), jaccard.ordered(t, ranks)
                assert len(np.intersect1d(s[: how.smaller_prefix(len(s))], t[: how.larger_prefix(len(t))]))
            g = min(jaccard.groups_of(p), jaccard.groups_of(q))
            assert np.minimum(jaccard.folded(p, g), jaccard.folded(q, g)).sum() >= k


# SentencePiece

MODEL = f"{queries.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return pieces.Model(f.read())


@given(st.lists(st.sampled_from(["a", "b", "the", "in", " ", "  ", "\n", "ing", "é", "梦", "ሴ", "tion", "x" * 9, "=", "▁", "...."]), max_size=25), st.sampled_from([None, 3, 7, 20]))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_the_library(model, parts, chunk):
    text = "".join(parts)
    ids = model.encode(text, chunk)
    assert np.frombuffer(ids, model.dtype).tolist() == model.sp.encode(text)
    assert model.decode(ids) == text.replace("▁", " ").encode()


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """A unigram model of the same pieces, with scores in few steps so that ties abound."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(MODEL, "rb") as f:
        m = pb.ModelProto.FromString(f.read())
    m.trainer_spec.model_type = 1
    r = random.Random(9)
    for p in m.pieces:
        p.score = -r.randint(4, 12) if p.type == 1 else p.score
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_scores_equal_the_library(unigram):
    with open(unigram, "rb") as f:
        u = pieces.Model(f.read())
    r = random.Random(9)
    for _ in range(150):
        text = "".join(r.choice(["a", "the", " ", "  ", "ing", "é", "梦", "tion", "xx", "\n"]) for _ in range(r.randint(1, 30)))
        ids = u.encode(text)
        score = lambda ids: sum(map(u.sp.get_score, ids))
        assert abs(score(np.frombuffer(ids, u.dtype).tolist()) - score(u.sp.encode(text))) < 1e-3
        assert u.decode(ids) == text.encode()
        assert all(u.encode(text, chunk) == ids for chunk in (3, 4, 11))


def test_encoding_does_not_depend_on_cuts(spark, unigram):
    r = random.Random(19)
    word = lambda: "".join(r.choice(["a", "b", "the", "in", "ing", "é", "梦", "tion"]) for _ in range(r.randint(1, 5)))
    data = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 300, 700])] + [(9, "aa" * 400), (10, None), (11, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = [rows(pieces.encode(df, unigram, giant=giant, chunk=chunk, fan=fan).select("doc_id", "pieces.ids")) for giant, chunk, fan in ((1 << 20, 1 << 20, 32), (0, 50, 2), (100, 333, 3))]
    assert got[0] == got[1] == got[2]


def test_a_giant_text_over_many_tasks(spark, model):
    r = random.Random(29)
    text = " ".join(r.choice(WORDS) + r.choice(["", "x", "梦", "ing\n"]) for _ in range(420_000))
    assert len(text) > 2_000_000
    df = spark.createDataFrame([(1, text), (2, text[:50_000])], "doc_id long, text string")
    for fan in (8, 32):
        got = {x.doc_id: x.pieces for x in pieces.encode(df, MODEL, fan=fan).collect()}
        assert got[1].chunks == -(-(len(text) + 1) // 8192) and got[1].round_trip and got[2].round_trip
        assert got[1].ids == model.encode(text) and got[2].ids == model.encode(text[:50_000])
    assert np.frombuffer(got[1].ids, "<u2").tolist() == model.sp.encode(text)


def test_products_are_associative(model):
    r = random.Random(10)
    s = pieces.BLANK + "".join(r.choice("theintion") for _ in range(90))
    cuts = [pieces.chunked(s, at, 10, model.longest) for at in range(0, len(s), 10)]
    ms = [model.transfer(c, left, size, 10 * i) for i, (c, left, size) in enumerate(cuts)]
    left = pieces.combined(ms)
    while len(ms) > 1:
        i = r.randrange(len(ms) - 1)
        ms[i : i + 2] = [pieces.product(ms[i], ms[i + 1])]
    assert ms[0] == left


def test_encode(docs, model):
    out = pieces.encode(docs.withColumn("pieces", F.lit(1)).withColumn("ids", F.lit(2)), MODEL, giant=500, chunk=64)
    assert out.columns == ["doc_id", "text", "lang", "source", "ids", "pieces"]
    got = out.collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r.pieces.ids, "<u2").tolist() == (model.sp.encode(r.text) if r.text else [])
        assert r.pieces.round_trip == ("▁" not in (r.text or "")) and r.pieces.n_tokens == len(r.pieces.ids) // 2
    assert max(r.pieces.chunks for r in got) > 1000
    back = pieces.decode(out.select("text", "pieces.*").where("text is not null"), MODEL, into="again")
    assert back.where("round_trip <> (text = again)").count() == 0
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


# Training order


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_feistel(n):
    f = training_order.Feistel(n, 9)
    s = f.slot(np.arange(n))
    assert sorted(s) == list(range(n)) and (f.index(s) == np.arange(n)).all()


BPE = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


def test_byte_bpe_equals_the_library():
    with open(BPE, "rb") as f:
        bpe = training_order.ByteBpe(f.read(), queries.BPE_PATTERN)
    r = random.Random(11)
    parts = ["a", "b", " the", "in", " ", "  ", "\n", "\t", " \n", "é", "'s", "梦", "12", "!", "\u00a0", "\x1c", "\u2009"]
    data = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [None]
    ids, counts = bpe.encode(pa.array(data))
    at = 0
    for t, n in zip(data, counts, strict=True):
        assert ids[at : at + n].tolist() == bpe.encoding.encode_ordinary(t or "")
        at += n


def test_training_order(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    m = training_order.write_shards(docs, path, BPE, queries.BPE_PATTERN, length=64, per_shard=50, key=3)
    assert training_order.read_manifest(spark, path) == m and m["shards"] == -(-m["sequences"] // 50)
    got = training_order.read_shards(spark, path).collect()
    assert sorted(r.slot for r in got) == list(range(m["sequences"]))
    with open(BPE, "rb") as f:
        bpe = training_order.ByteBpe(f.read(), queries.BPE_PATTERN)
    want = []
    for r in docs.collect():
        ids = [*bpe.encoding.encode_ordinary(r.text), bpe.end] if r.text else []
        want += [(r.doc_id, w, tuple(ids[64 * w : 64 * w + 64])) for w in range(-(-len(ids) // 64))]
    assert sorted(((r.doc_id, r.window, tuple(np.frombuffer(r.tokens, "<u2").tolist())) for r in got), key=repr) == sorted(want, key=repr)
    later = training_order.read_shards(spark, path, from_slot=75).collect()
    assert sorted(r.slot for r in later) == list(range(75, m["sequences"]))
    files = list((tmp_path / "out/data").glob("shard=*/part-*"))
    assert len(files) == m["shards"] and all(f.stat().st_size % m["stride"] == 0 for f in files)
    none = training_order.write_shards(docs.where("text is null"), f"{path}2", BPE, queries.BPE_PATTERN)
    assert none["sequences"] == 0 and training_order.read_shards(spark, f"{path}2").count() == 0


# Language ID


def test_gradients_by_differences():
    net = language_id.BiGru(3, 4, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (6, 5)), np.array([0, 1, 2, 0, 1])
    _, g = net.gradients(x, y)
    for k in net.p:
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in net.p[k].shape)
            at = (int(x[0, 0]), *at[1:]) if k[0] == "w" else at
            old, losses = net.p[k][at], []
            for d in (1e-3, -1e-3):
                net.p[k][at] = old + d
                losses.append(net.gradients(x, y)[0])
            net.p[k][at] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - g[k][at]) < 1e-3


def test_language_id(spark):
    r = random.Random(12)
    vocab = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["würde", "schön", "straße", "über"], "cc": ["ñandú", "año", "qué", "él"]}
    data = [(i, " ".join(r.choice(vocab[c]) for _ in range(r.randint(3, 200))), c) for i, c in enumerate(r.choice(list(vocab)) for _ in range(240))]
    extra = [(900, None, "aa"), (901, "", "aa"), (902, "123 ...", "bb"), (904, "\u00bd \u00b2 \u2460 \u2167", "aa"), (903, data[0][1], None), (None, data[0][1], "aa"), data[0]]
    df = spark.createDataFrame(data + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    how = language_id.Training(per_language=30, steps=80)
    out = language_id.identify(df, how).collect()
    assert len(out) == len(data) + len(extra)
    got = {x.doc_id: x for x in out}
    held = [(i, c) for i, _, c in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in data)
    assert np.mean([got[i].lang_pred == c for i, c in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 904))
    assert got[903].lang_pred == got[0].lang_pred and all(0 <= x.score <= 1 for x in out)
    # A prediction depends on the text alone.
    other = language_id.identify(df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang"))), how).collect()
    assert sorted(map(repr, other)) == sorted(map(repr, out))
    assert language_id.identify(df.limit(0), how).count() == 0
    assert {x.lang_pred for x in language_id.identify(df.withColumn("lang", F.lit(None).cast("string")), how).collect()} == {"und"}


def test_every_language_is_learned(spark):
    data = [(i, "".join(map(chr, (0x100 + 2 * (i % 70), 0x101 + 2 * (i % 70), 32))) * 30, f"l{i % 70:02}") for i in range(700)]
    net, langs = language_id.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), language_id.Training(steps=1, max_rows=140))
    assert langs == [f"l{i:02}" for i in range(70)] and len(net.p["c"]) == 70


def test_one_of_each_without_ids(spark):
    r = random.Random(9)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    data = [(1, a), (None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (7, ""), (7, ""), (None, None)]
    got = jaccard.one_of_each(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(got) == sorted([(1, a), (None, b), (5, c), (5, d), (7, ""), (None, None)], key=repr)
