"""The quality classifier's fit, the quality rules' verdict and long url rule lists against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.llm import quality_classifier as Q
from tidebar.llm import quality_rules, url_filter

from .conftest import corpus

K = len(Q.STATS)


def pooled(y, w):
    """The non-decreasing least-squares fit by its min-max formula."""
    n = len(y)
    mean = lambda a, b: np.dot(y[a : b + 1], w[a : b + 1]) / w[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_the_fit_equals_a_plain_one(spark):
    """Ridge over all rows in one matrix, and pooling of its binned scores."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, K)) * rng.uniform(0.1, 5, K) + rng.normal(size=K)
    x[:, 3] = 2.0  # a statistic that doesn't vary
    y = (x[:, 0] + np.sin(x[:, 1]) + rng.normal(size=400) * 0.5 > 0).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "stats array<double>, label int").repartition(5)
    model = Q.fit(df, features=32, bandwidth=2.0, penalty=0.05, bins=64, seed=9)

    draw = np.random.default_rng(9)
    weights, phases = draw.normal(size=(K, 32)) / 2.0, draw.uniform(0, 2 * np.pi, 32)
    spread = x.std(0)
    z = np.clip((x - x.mean(0)) / np.where(spread > 1e-9, spread, 1), -6, 6)
    a = np.column_stack([np.cos(z @ weights + phases) * math.sqrt(2 / 32), z / 6, np.ones(400)])
    ridge = np.linalg.lstsq(np.vstack([a, math.sqrt(0.05) * np.eye(a.shape[1])]), np.concatenate([y, np.zeros(a.shape[1])]), rcond=None)[0]
    raw = a @ ridge
    assert np.allclose(model.raw(x), raw, atol=1e-6)
    cell = np.clip(np.floor((raw + 0.5) / 2 * 64), 0, 63).astype(int)
    used = np.unique(cell)
    rate, count = np.array([y[cell == c].mean() for c in used]), np.array([(cell == c).sum() for c in used])
    levels = np.array(pooled(rate, count))
    assert np.allclose(model.score(x), np.clip(np.interp(raw, -0.5 + (used + 0.5) * 2 / 64, levels), 0, 1), atol=1e-6)
    assert (np.diff(model.levels) >= 0).all()


def test_odd_rows_of_the_classifier(spark):
    """Null ids, repeated rows and columns that are called like the operator's own."""
    texts = [(i, f"some plain words number {i} " * 8) if i % 2 else (i, "BUY!!! $$$ " * (5 + i % 7)) for i in range(120)]
    rows = [*texts, (None, texts[1][1]), (None, None), texts[3], texts[3]]
    docs = spark.createDataFrame([(*r, 1.0, 2, True, "x") for r in rows], "doc_id long, text string, stats double, label int, held_out boolean, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(5, None), (None, 0), (7, 0)], "doc_id long, quality int")
    got = Q.classify(docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None) and len({round(r["score"], 9) for r in got if r["doc_id"] == 3}) == 1
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["predicted"])


def plain_verdicts(rows, trusted, threshold=-0.35):
    """kept and log ratio of each text, counted gram by gram."""
    cell = lambda g: (int.from_bytes(g, "little") * 2654435761 % 2**32) >> 16
    of = [[cell(raw[i : i + 4]) for i in range(len(raw) - 3)] for raw in ((t or "").encode() for _, t in rows)]
    good = Counter(c for (d, _), cells in zip(rows, of) if d in trusted for c in cells)
    whole = Counter(c for cells in of for c in cells)
    n_good, n_whole = sum(good.values()), sum(whole.values())

    def ratio(c):
        q = max(whole[c], 1e-3) / n_whole
        return math.log((0.9 * good[c] / n_good + 0.1 * q) / q)

    out = []
    for (d, t), cells in zip(rows, of):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        llr = sum(map(ratio, cells)) / len(cells) if cells else 0.0
        out.append((d, len(w) >= 20 and 100 * len(repeated) <= 30 * len(w) and llr >= threshold, llr))
    return out


def test_verdicts_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(d, t) for d, t, _ in corpus() if t is None or len(t) < 8000]
    good = [(500 + i, " ".join(f"{a} {b}" for a, b in zip(rng.choice(["river", "stone", "morning", "people", "walked"], 15), rng.choice(["slowly", "under", "light", "again"], 15)))) for i in range(30)]
    bad = [(600 + i, " ".join("".join(rng.choice(list("qxzjkv#"), 6)) for _ in range(30))) for i in range(30)]
    rows += good + bad
    trusted = {500 + i for i in range(0, 30, 2)} | {1, 11}
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), sorted(trusted)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 4))
    want = sorted(plain_verdicts(rows, trusted), key=key)
    made = sorted(((r["doc_id"], r["kept"], r["llr"]) for r in got), key=key)
    assert [r[:2] for r in made] == [r[:2] for r in want] and {r[1] for r in made} == {True, False}
    assert all(a[2] == pytest.approx(b[2], abs=1e-4) for a, b in zip(made, want))


@pytest.mark.parametrize("in_row", [600, 100])
def test_hundreds_of_url_rules(spark, in_row):
    """Rules made by a rule, as a literal of the plan and by a join: each url meets the few that share its rarest token."""
    rules = [url_filter.pattern_rule("block", rf"(^|[./-])shop{i}-(sale|deal)s?([./-]|$)", f"shop{i}") for i in range(400)]
    rules += [url_filter.prefix_rule(("allow", "block")[i % 2], f"site{i % 60}.net/a{i}/") for i in range(120)]
    urls = [f"http://www.shop{i * 7 % 500}-{w}.com/x" for i, w in enumerate(["sale", "deals", "sold", "sales"] * 25)]
    urls += [f"https://site{i % 70}.net/a{i}/page?q=1" for i in range(130)] + [None, "", "shop1-sale", "http://x/" + "y" * 3_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules, in_row).collect()}
    for i, url in enumerate(urls):
        target = url.split("://", 1)[1].split("?")[0] if url and "://" in url else ""
        host, _, path = target.partition("/")
        fits = [(len(r.name), r.name, r.action) for r in rules if r.literal and host == r.name.split("/")[0] and f"/{path}".startswith(r.name[len(host) :])]
        blocked = any(re.search(r.regex, target) for r in rules if not r.literal)
        assert got[i] == (max(fits)[1:] if fits else (None, "block" if blocked else "allow")), url
    assert sum(v == "block" for _, v in got.values()) > 50


def test_a_sample_is_drawn_before_it_is_sorted(spark):
    """What is sorted in one task is a little more than the sample, whatever the number of partitions."""
    from tidebar.llm import neighbours

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8)
    got = neighbours.search(df, most_sample=500, parts=4)
    assert got.where(F.col("rank") == 1).count() == 60 and got.where("query_id = vec_id").count() == 0
