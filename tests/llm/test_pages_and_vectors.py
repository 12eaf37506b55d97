"""URL filters and nearest neighbours against plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tidebar.llm import neighbours, url_filter
from tidebar.llm.queries import URL_RULES

# fmt: off
URLS = [
    None, "", "no scheme/org", "http://EXAMPLE.org/en/15?x=1", "https://sub.example.org/es/", "http://notexample.org/es/1", "ftp://a.com/fr/x#y", "http://a.com/de/",
    "http://org/", "http://a.org", "http://a.org?q=/", "http://cheap-pills.net/", "http://x.cheap-pills.org/", "http://xcheap-pills.net/", "http://a.net/free-bets/1", "http://É.com/de/ü",
]
# fmt: on


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for r in URL_RULES[:5]:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.name), r.name, r.action))
    other = "block" if any(re.search(r.regex, host + path) for r in URL_RULES[5:]) else "allow"
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else other


@pytest.mark.parametrize("in_row", [url_filter.IN_ROW, 0])
def test_url_verdicts(spark, in_row):
    pages = spark.createDataFrame([(i % 15, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = sorted(tuple(r) for r in url_filter.judge(pages, URL_RULES, in_row).fillna("-", ["rule"]).collect())
    assert got == sorted((i % 15, *(x if x is not None else "-" for x in plain(u))) for i, u in enumerate(URLS))
    assert url_filter.judge(pages.limit(0), URL_RULES, in_row).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}


def brute(vectors, every, k):
    fine = {i: v for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in fine.items():
        if q % every == 0:
            a = np.array(a, dtype=float)
            scores = [(-float(a @ np.array(b, dtype=float)) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in fine.items() if i != q]
            out[q] = sorted((round(s, 12), i) for s, i in scores)[:k]
    return out


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def test_odd_vectors(spark):
    odd = [(50, None), (100, [0.0, 0.0]), (None, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [-1.0, 0.5]), (150, [1.0, 2.0]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in odd], SCHEMA)
    got = neighbours.search(df).collect()
    want = brute(odd, 50, 5)
    assert {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in want} == {q: [i for _, i in v] for q, v in want.items()}
    assert sorted({r["query_id"] for r in got}) == sorted(want)
    assert neighbours.search(df.limit(0)).count() == 0


def recall_of(got, want):
    found = {q: {r["vec_id"] for r in got if r["query_id"] == q} for q in want}
    return np.mean([len(found[q] & {i for _, i in v}) / len(v) for q, v in want.items()])


@pytest.mark.parametrize("n", [500, 2500, 10_000])
def test_recall_at_every_size(spark, n):
    """The method itself, 64 parts; with columns of names that it uses, repeated rows and a repeated vec_id."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(60, 32))[rng.integers(60, size=n)] + 0.7 * rng.normal(size=(n, 32))
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame([*vectors, *vectors[:3]], "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score", "3 as part", "4 as q")
    u = np.array([v for _, v in vectors])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {q: [(0, int(i)) for i in np.argsort(-u @ u[q], kind="stable") if i != q][:5] for q in range(0, n, 50)}
    got = neighbours.search(df).collect()
    assert len(got) == 5 * len(want) and recall_of(got, want) >= 0.9
    exact = {i: np.array(v) for i, v in vectors}
    for r in got[:200]:
        a, b = exact[r["query_id"]], exact[r["vec_id"]]
        assert r["query_id"] != r["vec_id"] and r["score"] == pytest.approx(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-12)


def test_recall_with_a_common_vector(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    vectors = [(i, (centres[i % 30] + 0.6 * rng.normal(size=16)).tolist()) for i in range(3000)] + [(3000 + i, centres[0].tolist()) for i in range(1500)]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], SCHEMA)
    got, want = neighbours.search(df).collect(), brute(vectors, 50, 5)
    assert len(got) == 5 * len(want) and recall_of(got, want) >= 0.9
    for r in got:
        if r["query_id"] == 3000:
            assert (r["vec_id"], round(r["score"], 12)) == (3000 + r["rank"], 1.0)


def test_router_finds_rows_outside_a_small_sample():
    rng = np.random.default_rng(8)
    n, m = 204_800, 2048
    x = neighbours.unit(rng.normal(size=(200, 24))[rng.integers(200, size=n)] + 0.6 * rng.normal(size=(n, 24)))
    router = neighbours.learn(x[:m], 32, 5, 0.95)
    assert router.probes <= 16
    filed, asked = router.scores(x).argmax(1), np.arange(m, m + 100)
    s = x[asked] @ x.T
    s[np.arange(100), asked] = -2
    near = np.argpartition(-s, 4, axis=1)[:, :5]
    sent = np.argsort(-router.scores(x[asked]), axis=1)[:, : router.probes]
    assert (filed[near][:, :, None] == sent[:, None, :]).any(2).mean() >= 0.95
