"""The window network and the leaf-wise trees against one-task versions; exact quantiles and ranks against plain ones."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.quantiles import matrices, quantiles
from tidebar.functions.ranks import rolling_percentile, window_ranks
from tidebar.functions.store import finished, keep
from tidebar.operators import leafwise as L
from tidebar.operators import sequence_training as S
from tidebar.operators.attention import Shape, loss_and_gradient, probabilities

SMALL = Shape(features=3, length=6, width=8, heads=2, layers=1, inner=8, dropout=0.0)


# ---------------------------------------------------------------- quantiles and ranks


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    n = 4001
    columns = {
        "normal": rng.normal(size=n),
        "wide": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n),
        "same": np.full(n, -2.5),
        "flag": rng.integers(0, 2, n).astype(float),
        "zeros": np.where(rng.random(n) < 0.5, -0.0, 0.0),
        "near": 1.0 + rng.integers(0, 3, n) * 2.0**-52,
    }
    df = spark.createDataFrame(list(zip(*(c.tolist() for c in columns.values()))), list(columns)).repartition(5)
    probs = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = quantiles(keep(df), matrices(list(columns)), 1, len(columns), probs)[0]
    want = np.array([np.quantile(c + 0.0, probs) for c in columns.values()])
    assert np.allclose(got, want, rtol=1e-12, atol=0) and np.isnan(quantiles(df.limit(0), matrices(["normal"]), 1, 1, (0.5,))).all()


def plain_ranks(x, window):
    out = []
    for i in range(len(x)):
        v = x[max(0, i - window + 1) : i + 1]
        full = len(v) == window and not np.isnan(v).any()
        out.append(((v < x[i]).sum() + ((v == x[i]).sum() + 1) / 2) / window if full else None)
    return out


@pytest.mark.parametrize(("window", "stretch"), [(37, 64), (500, 128), (64, 64), (1, 50), (65, 64)])
def test_ranks_over_many_tasks(spark, window, stretch):
    """Windows within a stretch, of its length, and over several."""
    rng = np.random.default_rng(window)
    x, y = rng.integers(0, 40, 1000).astype(float), rng.normal(size=90)
    x[[3, 700]] = np.nan
    rows = [("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, seq long, x double").repartition(4)
    got = {(r[0], r[1]): r[2] for r in rolling_percentile(df, "x", window, "p", stretch, block=16).select("series_id", "seq", "p").collect()}
    for name, values in (("a", x), ("b", y)):
        for i, want in enumerate(plain_ranks(values, window)):
            assert got[name, i] == (want if want is None else pytest.approx(want)), (name, i)


def test_ranks_in_one_array():
    rng = np.random.default_rng(1)
    for n, w, start, block in [(300, 37, 20, 5), (1000, 401, 37, 100), (500, 499, 400, 2048)]:
        x = rng.integers(0, 30, n).astype(float)
        x[rng.random(n) < 0.004] = np.nan
        want = np.array([np.nan if v is None else v for v in plain_ranks(x, w)])[start:]
        assert np.allclose(window_ranks(x, start, w, block), want, equal_nan=True)


# ---------------------------------------------------------------- the window network


def table(spark, n=700, seed=0, series=("s",)):
    """Bars whose class is told by a's signs one and two bars before, not by the bar itself."""
    rows = []
    for k, s in enumerate(series):
        rng = np.random.default_rng(seed + k)
        a = rng.choice([-1.0, 1.0], n)
        x = np.column_stack([a, rng.normal(size=n), rng.normal(size=n) * 5 + 3])
        y = (np.roll(a, 1) + np.roll(a, 2)) / 2 + 1
        rows += [(s, i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "series_id string, seq long, a double, b double, c double, y int")


def one_task(rows, shape, parts, how):
    """Training in plain numpy: every model alone, all windows of its parts in one array."""
    x, y = rows[:, :-1], rows[:, -1].astype(int)
    out = []
    for (lo, hi), (vlo, vhi) in parts(len(rows)):
        q = np.quantile(x[lo:hi], [0.25, 0.5, 0.75], axis=0)
        z = (x - q[1]) / np.where(q[2] == q[0], 1, q[2] - q[0])
        cut = lambda a, b: (np.stack([z[e - shape.length + 1 : e + 1] for e in range(a + shape.length - 1, b)]), y[a + shape.length - 1 : b])
        (tx, ty), (vx, vy) = cut(lo, hi), cut(vlo, vhi)
        weights = S.class_weights(np.bincount(ty, minlength=3).astype(float))
        v = shape.start(how.seed)
        m1, m2, best, least, waited = np.zeros_like(v), np.zeros_like(v), v.copy(), np.inf, 0
        for epoch in range(1, how.epochs + 1):
            rate = how.least_rate + (how.rate - how.least_rate) * (1 + np.cos(np.pi * (epoch - 1) / how.period)) / 2
            g = np.zeros_like(v)
            seen = loss_and_gradient(shape, v, tx, ty, weights, None, g)
            g /= seen[1]
            g *= min(1.0, how.clip / (np.linalg.norm(g) + 1e-6))
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g**2
            v = v * (1 - rate * how.decay) - rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.999**epoch)) + 1e-8)
            held = loss_and_gradient(shape, v, vx, vy, weights)
            if held[0] / held[1] < least:
                least, waited, best = held[0] / held[1], 0, v.copy()
            else:
                waited += 1
                if waited >= how.patience:
                    break
        out.append((best, least))
    return out


def test_gradient_is_that_of_the_loss():
    shape = Shape(5, 7, 8, 2, 2, 12, 0.0)
    rng = np.random.default_rng(0)
    v = shape.start(1) + rng.normal(size=shape.size) * 0.05
    x, y, w, g = rng.normal(size=(6, 7, 5)), rng.integers(0, 3, 6), np.array([1.0, 2.0, 0.5]), np.zeros(shape.size)
    loss_and_gradient(shape, v, x, y, w, None, g)
    for i in rng.choice(shape.size, 150, replace=False):
        e = np.zeros_like(v)
        e[i] = 1e-5
        slope = (loss_and_gradient(shape, v + e, x, y, w)[0] - loss_and_gradient(shape, v - e, x, y, w)[0]) / 2e-5
        assert slope == pytest.approx(g[i], rel=1e-4, abs=1e-7)
    dropped = Shape(5, 7, 8, 2, 2, 12, 0.5)
    a, b = (loss_and_gradient(dropped, v, x, y, w, np.random.default_rng(s))[0] for s in (1, 2))
    assert a != b and np.allclose(probabilities(dropped, v, x).sum(-1), 1)


@pytest.fixture(scope="module")
def stored(spark):
    return S.blocks(table(spark).repartition(3), ["a", "b", "c"], length=6, rows=64)


def test_models_equal_those_of_one_task(spark, stored):
    """The model and its folds, trained together over blocks, are those trained alone over all windows."""
    parts, how = S.with_folds(0.7, 0.15, 2), S.Training(epochs=6, patience=2, rate=0.02, least_rate=0.001, period=5)
    fitted = S.fit(stored, ["a", "b", "c"], SMALL, parts, how)
    rows = np.array([tuple(r) for r in table(spark).orderBy("seq").select("a", "b", "c", "y").collect()])
    for k, (best, least) in enumerate(one_task(rows, SMALL, parts, how)):
        assert np.abs(fitted.vectors[k] - best).max() < 1e-6
        assert min(h["val_loss"] for h in fitted.history if h["model"] == k) == pytest.approx(least, abs=1e-8)


def test_training_goes_on_where_it_was_stopped(spark, stored, tmp_path, monkeypatch):
    parts, how = S.with_folds(0.7, 0.15, 1), S.Training(epochs=4, rate=0.01, steps=2)
    dropping = Shape(**{**SMALL.__dict__, "dropout": 0.2})
    whole = S.fit(stored, ["a", "b", "c"], dropping, parts, how)
    folder, step, jobs = f"file://{tmp_path}/run", S._step, []

    def stops(*args):
        jobs.append(1)
        if len(jobs) > 7:  # within the third epoch
            raise KeyboardInterrupt
        return step(*args)

    monkeypatch.setattr(S, "_step", stops)
    with pytest.raises(KeyboardInterrupt):
        S.fit(stored, ["a", "b", "c"], dropping, parts, how, folder)
    monkeypatch.setattr(S, "_step", step)
    assert finished(spark, folder, "epoch-") == [1, 2]
    again = S.fit(stored, ["a", "b", "c"], dropping, parts, how, folder)
    assert np.allclose(again.vectors, whole.vectors, rtol=0, atol=1e-9) and [h["epoch"] for h in again.history if not h["model"]] == [1, 2, 3, 4]
    again.save(spark, f"file://{tmp_path}/model")
    loaded = S.Fitted.load(spark, f"file://{tmp_path}/model")
    assert (loaded.vectors == again.vectors).all() and loaded.names == again.names and loaded.shape == again.shape and loaded.history_table(spark).count() == 8


def test_windows_tell_what_one_bar_does_not(spark):
    """Planted: the class hangs on earlier bars. The network's loss falls well below that of windows of one bar."""
    parts = S.with_folds(0.7, 0.15, 0)
    df = table(spark, 1200)
    losses = {}
    for length, epochs in ((4, 16), (1, 4)):
        how = S.Training(epochs=epochs, patience=epochs, rate=0.01, least_rate=0.002, period=epochs)
        shape = Shape(3, length, 32, 2, 1, 32, 0.0)
        fitted = S.fit(S.blocks(df, ["a", "b", "c"], length=length, rows=128), ["a", "b", "c"], shape, parts, how)
        losses[length] = min(h["val_loss"] for h in fitted.history)
    assert losses[4] < 0.6 * losses[1]


def test_predictions_are_of_whole_windows(spark, stored):
    parts = S.with_folds(0.7, 0.15, 2)
    fitted = S.Fitted(SMALL, ["a", "b", "c"], np.stack([SMALL.start(k) for k in range(3)]), np.stack([[[0.0] * 3, [1.0] * 3]] * 3))
    everything = fitted.predict(stored, models=[0]).orderBy("seq").collect()
    assert [r["seq"] for r in everything] == list(range(5, 700))
    rows = np.array([tuple(r) for r in table(spark).orderBy("seq").select("a", "b", "c").collect()])
    p = probabilities(SMALL, fitted.vectors[0], np.stack([rows[e - 5 : e + 1] for e in range(5, 700)]))
    assert np.allclose([[r["p_short"], r["p_flat"], r["p_long"]] for r in everything], p) and [r["pred"] for r in everything] == p.argmax(1).tolist()
    held = {k: sorted(r["seq"] for r in fitted.predict(stored, parts).where(F.col("model") == k).collect()) for k in range(3)}
    for k, (_, (low, high)) in enumerate(parts(700)):
        assert held[k] == list(range(low + 5, high))


# ---------------------------------------------------------------- leaf-wise trees


def meta_rows(n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(2)
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 1] > 0) - x[:, 2])))
    return x, (rng.random(n) < p).astype(int), np.arange(n) >= n * 0.8


def plain_trees(codes, y, w, held, trees, how):
    """Best-first trees, every split found by trying all cuts on the rows themselves; losses of the held rows."""
    score, out, losses = np.zeros(len(y)), [], []
    for _ in range(trees):
        losses.append(np.logaddexp(0, np.where(y[held] > 0, -score[held], score[held])).mean())
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        worth = lambda m: max(abs(g[m].sum()) - how.alpha, 0) ** 2 / (h[m].sum() + how.shrink)

        def best(m):
            found = (0.0, -1, 0)
            for f in range(codes.shape[1]):
                for b in range(codes[:, f].max()):
                    left, right = m & (codes[:, f] <= b), m & (codes[:, f] > b)
                    if min(left.sum(), right.sum()) >= how.least_rows:
                        gain = round(worth(left) + worth(right) - worth(m), 9)
                        if gain > found[0]:
                            found = (gain, f, b)
            return found

        tree, masks = L.Tree(), {0: ~held}
        line = [(-best(masks[0])[0], 0, best(masks[0]))]
        while line and (len(tree.feature) + 1) // 2 < how.leaves:
            gain, node, (_, f, b) = heapq.heappop(line)
            if not gain:
                break
            for child, side in zip(tree.split(node, f, b), (codes[:, f] <= b, codes[:, f] > b)):
                masks[child] = masks[node] & side
                found = best(masks[child])
                heapq.heappush(line, (-found[0], child, found))
        for node, m in masks.items():
            tree.value[node] = -np.sign(g[m].sum()) * max(abs(g[m].sum()) - how.alpha, 0) / (h[m].sum() + how.shrink) * how.rate
        score = score + np.array(tree.value)[tree.leaf_of(codes)]
        out.append(tree)
    return out, losses, score


def test_trees_equal_brute_force(spark, monkeypatch):
    x, y, held = meta_rows()
    df = spark.createDataFrame([(*map(float, v), int(c), bool(k)) for v, c, k in zip(x, y, held)], "a double, b double, c double, d double, y_meta int, held boolean").repartition(3)
    how = L.Growth(trees=5, rate=0.3, leaves=9, least_rows=15, feature_share=1.0, row_share=1.0, patience=50, bins=16)
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, 16) / 16, method="lower")).tolist() for i in range(4)]
    monkeypatch.setattr(L, "REFRESH", 2)  # stored scores as well as trees on the way
    made = L.fit(df, ["a", "b", "c", "d"], how=how, edges=edges)
    n, ones = (~held).sum(), y[~held].sum()
    w = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    trees, losses, score = plain_trees(L.coded(x, edges), y, w, held, 5, how)
    assert len(made.trees) == 5 and np.allclose(made.losses[:5], losses)
    for a, b in zip(made.trees, trees):
        split = lambda t: sorted((f, c, round(v, 6)) for f, c, v in zip(t.feature, t.bin, t.value))
        assert split(a) == split(b)
    got = {tuple(r[c] for c in "abcd"): r["meta_prob"] for r in made.predict(df).collect()}
    assert all(got[tuple(v)] == pytest.approx(1 / (1 + np.exp(-s))) for v, s in zip(x.tolist(), score))


def test_trees_stop_and_learn(spark, tmp_path):
    x, y, held = meta_rows(1500, 3)
    df = spark.createDataFrame([(*map(float, v), int(c), bool(k), "own") for v, c, k in zip(x, y, held)], "a double, b double, c double, d double, y_meta int, held boolean, score string").repartition(2)
    how = L.Growth(trees=14, rate=1.2, leaves=6, least_rows=10, patience=3, bins=32)
    made = L.fit(df, ["a", "b", "c", "d"], how=how)
    assert 0 < len(made.trees) < 14 and made.losses[len(made.trees)] == min(made.losses) < 0.6
    assert made.importance(2)[0][0] in "abc" and len(made.importance()) == 4
    made.save(spark, f"file://{tmp_path}/trees")
    again = L.Boosted.load(spark, f"file://{tmp_path}/trees")
    assert np.allclose(again.scores(x), made.scores(x))
    one = L.fit(df.where("y_meta = 1"), ["a"], how=how)
    assert not one.trees and one.predict(df).where("meta_prob > 0.99").count() == 1500
    assert L.fit(df.limit(0), ["a"], how=how).trees == []
