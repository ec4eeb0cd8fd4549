import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkweave.functions import encode as E
from linkweave.functions import fields as P
from linkweave.functions import geo, phonetic, strings, vectors

URLS = ["http://www.google.com", "www.google.com", "http://google.com", "http://www.google.com/a", "http://www.google.com/a/b"]


@pytest.mark.parametrize(
    ("f", "text", "result"),
    [
        (E.normspace, " a  b  ", "a b"),
        (E.normspace, " a ", "a"),
        (E.alnumsp, " Joe (K) Ltd.  ", "joe k ltd"),
        (E.alnumcase, " Joe (K) Ltd.  ", "Joe K Ltd"),
        (E.nospace, " a  b  ", "ab"),
        (E.lowstrip, " A  b  ", "a b"),
        (E.digits, "+27 (21) 1234567", "27211234567"),
        (E.digits, "abc", ""),
        (E.sorted_words, "c a b", "a b c"),
        (E.sorted_words, "b  a ", "  a b"),
        (E.reverse, "abc", "cba"),
        *((E.urldomain, u, "google.com") for u in URLS),
        (E.urldomain, "https://x.com/a", "https:"),
        (E.urldomain, "http://", "http:"),
        (lambda c: E.urldomain(c, strict_http=False), "https://x.com/a", "x.com"),
        (E.emaildomain, "srtar@arst.com", "arst.com"),
        (E.emaildomain, "abc", "abc"),
        (P.wrap(E.sorted_words, E.reverse), "world hello", "dlrow olleh"),
        (P.wrap(), "x", "x"),
    ],
)
def test_encoders(ev, f, text, result):
    assert ev(f(F.lit(text))) == result


@pytest.mark.parametrize("f", [E.normspace, E.alnumsp, E.alnumcase, E.nospace, E.lowstrip, E.digits, E.sorted_words, E.reverse, E.urldomain, E.emaildomain, E.Normaliser({"a": ["b"]})])
@pytest.mark.parametrize("text", [None, ""])
def test_falsy_is_null(ev, f, text):
    assert ev(f(F.lit(text).cast("string"))) is None


def test_normaliser(ev):
    n = E.Normaliser({"parkway": ["parkwy", "pky", "pkway"], "": ["co", "company"], "street": ["str", "st$"], "promenade": ["prom"]})
    for text, result in [
        ("foo cooperative company", "foo cooperative"),
        ("foo str", "foo street"),
        ("foo St", "foo street"),
        ("St John Prom", "St John promenade"),
        ("Liesbeeck Pky pkWay", "Liesbeeck parkway parkway"),
    ]:
        assert ev(n(F.lit(text))) == result


def test_scale_of_values(ev):
    assert [ev(E.scale(F.lit(v).cast("double"), 1, 3, 9.0)) for v in (None, 0, 2, 4)] == [9.0, 0.0, 0.5, 1.0]


def test_fields(spark, ev):
    df = spark.createDataFrame([("a", "b", "c")], ["x", "y", "z"])
    assert df.select(P.getter(df, "x"), P.getter(df, 2), P.getter(df, lambda d: F.concat(d.x, d.y))).first()[:] == ("a", "c", "ab")
    with pytest.raises(TypeError):
        P.getter(df, 1.5)
    row = lambda *v: [F.lit(x).cast("string") for x in v]
    for values, result in [(("a", "c"), "a"), (("", "c"), "c"), ((None, None), "")]:
        assert ev(P.fallback(*row(*values))) == result
    assert ev(P.combine(*row("A", "C", "D", " "))) == ["A", "C", "D"]
    assert ev(P.multivalue(";", *row("a;b", "c;; d", None))) == ["a", "b", "c", "d"]
    assert ev(P.multivalue(".", *row("a.b"))) == ["a", "b"]
    assert ev(P.list_convert(F.split(F.lit("X;Y"), ";"), F.lower)) == ["x", "y"]
    assert ev(P.nullmax(F.array(F.lit(None), F.lit(3)))) == 3
    assert ev(P.delnone(F.array(F.lit(None).cast("string"), F.lit("")))) == [""]


def test_levenshtein(ev):
    for a, b, d in [("abcd", "ab", 2), ("abcd", "abdc", 2), ("dbca", "abcd", 2)]:
        assert ev(strings.levenshtein_distance(F.lit(a), F.lit(b))) == d == strings.levenshtein(a, b)
    for a, b, s in [("abcd", "abcd", 1.0), ("abcd", "abdc", 0.5), ("abcd", None, None), ("abcd", "", None)]:
        assert ev(strings.levenshtein_similarity(F.lit(a), F.lit(b).cast("string"))) == s


def test_osa(ev):
    for a, b, d in [("abcd", "ab", 2), ("abcd", "abdc", 1), ("dbca", "abcd", 2), ("ca", "abc", 3)]:
        assert strings.osa(a, b) == d
    for a, b, s in [("abcd", "abcd", 1.0), ("abcd", "abdc", 0.75), ("abcdef", "abcd", 4 / 6), ("abcd", None, None), ("abcd", "", None)]:
        got = ev(strings.osa_similarity(F.lit(a), F.lit(b).cast("string")))
        assert got == s if s is None else math.isclose(got, s)


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
@settings(max_examples=200, deadline=None)
def test_osa_is_symmetric_and_at_most_levenshtein(a, b):
    assert strings.osa(a, b) == strings.osa(b, a) <= strings.levenshtein(a, b)


def test_double_metaphone():
    for word, keys in {"Smith": ("SM0", "XMT"), "Schmidt": ("XMT", "SMT"), "Xavier": ("SF", "SFR"), "Michael": ("MKL", "MXL"), "Wagner": ("AKNR", "FKNR"), "Caesar": ("SSR", "SSR"), "Czerny": ("SRN", "XRN")}.items():
        assert phonetic.dmetaphone(word) == keys
    assert phonetic.dmetaphone("") is None


@given(st.text(max_size=12))
@settings(max_examples=300, deadline=None)
def test_double_metaphone_takes_anything(text):
    keys = phonetic.dmetaphone(text)
    assert keys is None or all(len(k) <= 4 for k in keys)


def _p(lat, lon):
    return F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon"))


def test_geo(ev):
    deg = 111.21237993706758
    assert ev(geo.point(F.lit("20.0"), F.lit("10.0")))[:] == (20.0, 10.0)
    assert ev(geo.point(F.lit("x"), F.lit("10.0"))) is None
    assert [ev(geo.valid(_p(*p))) for p in ((0, 0), (0, 90), (91, 0), (-1, -1), (None, 0), (float("nan"), 0))] == [True, True, False, True, False, False]
    assert ev(geo.distance(_p(0, 0), _p(1, 0))) == ev(geo.distance(_p(0, 0), _p(0, 1))) == deg
    assert math.isclose(ev(geo.distance(_p(60, 0), _p(60, 1))), 111.212, rel_tol=1e-4)
    assert math.isclose(ev(geo.distance(_p(60, 0), _p(60, 1), axis="latlon")), 55.6, rel_tol=1e-2)
    sims = [ev(geo.similarity(_p(0, 0), _p(1, 0), near, far)) for near, far in ((1.5 * deg, 2 * deg), (0, 0.5 * deg), (0, 1.5 * deg))]
    assert sims[:2] == [1.0, 0.0] and math.isclose(sims[2], 1 / 3)
    assert ev(geo.similarity(_p(0, 0), _p(None, 0))) is None


def _v(v):
    return F.array(*(F.lit(x).cast("double") for x in v))


def test_vectors(ev):
    N = None
    for a, b, d in [([2, N], [5, N], 3), ([2, N], [5, 1], 3), ([N, N], [1, 1], 0), ([2, 2], [3, 3], 2**0.5), ([3, 2], [3, 2], 0), ([4, 3, 2, 3], [4, 1, 3, 3], 5**0.5)]:
        assert math.isclose(ev(vectors.l2(_v(a), _v(b))), d)
    for a, b, s, d in [([2, N], [5, 1], [1, 1], 3), ([2, 2], [3, 3], [1, 1], 2**0.5), ([2, 2], [3, 3], [0.5, 1], 5**0.5)]:
        assert math.isclose(ev(vectors.norm_l2(_v(a), _v(b), _v(s))), d)
    with pytest.raises(Exception, match="different length"):
        ev(vectors.l2(_v([1]), _v([1, 2])))


def test_normaliser_templates(ev):
    n = E.Normaliser({r"<\1>": ["red", "bl(ue)"], r"\g<2>0 \\ $1": ["(x)y"]})
    assert ev(n(F.lit("a Red blue xy"))) == r"a <Red> <blue> x0 \ $1"


@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), min_size=1, max_size=12))
@settings(deadline=None)
def test_distances_of_many_pairs(pairs):
    a, b = zip(*pairs, strict=True)
    assert strings.edit_distances(a, b, True).tolist() == [strings.osa(x, y) for x, y in pairs]
    assert strings.edit_distances(a, b, False).tolist() == [strings.levenshtein(x, y) for x, y in pairs]
    lists = [[list(x) for x in side] for side in (a, b)]
    assert strings.edit_distances(*lists, True).tolist() == strings.edit_distances(a, b, True).tolist()
