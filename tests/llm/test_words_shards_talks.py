"""Spelling variants, sharding and conversation repair against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
import xxhash
from pyspark.sql import functions as F

from tidebar.llm import conversations as C
from tidebar.llm import sharding, spelling
from tidebar.llm.common import keep

# ---------------------------------------------------------------- spelling


def plain_counts(rows, every, least):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= least}


def plain_edit(a, b):
    cuts = lambda x: {x[:i] + x[i + 1 :] for i in range(len(x))}
    return b in cuts(a) or a in cuts(b) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def plain_variants(counts, times=5):
    near = {w: [x for x in counts if abs(len(x) - len(w)) < 2 and plain_edit(w, x)] for w in counts}
    form = {}
    for w, of in near.items():
        if of:
            best = min(of, key=lambda x: (-counts[x], x))
            if counts[best] >= times * counts[w]:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts.get(form.get(w))))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_equal_plain_ones(spark):
    rng = random.Random(1)
    base = ["station", "nations", "größere", "thinking", "straße", "nation", "banana", "aaaaaaa", "aaaaaab", "ÀÉÎÕÜÿ", "tionen"]
    words = [w for i, w in enumerate(base) for _ in range(3 ** min(i, 5))]
    for _ in range(1500):
        w = rng.choice(base)
        at, c = rng.randrange(len(w)), rng.choice("abté")
        words += [rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])] * rng.choice([1, 2, 6])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "\n", "東", "Ā", "1"]).join(words[i * 60 : i * 60 + 60])) for i in range(120)]
    rows += [(None, "Station STATION sTation " * 30), (5, None), (6, ""), (7, "x" * 70_000), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "mine", 1, "x") for r in rows], "doc_id long, text string, word string, n long, form string").repartition(4)
    for every in (199, 3):
        counts = plain_counts(rows, every, 5)
        got = spelling.variants(docs, every=every)
        assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == plain_variants(counts) and got.count() == len(counts) > 100
    assert spelling.variants(docs.limit(0)).count() == 0


def test_lots_lose_no_pair(spark):
    """A group far larger than a lot: all words share their first half."""
    rng = random.Random(2)
    words = sorted({"abcd" + "".join(rng.choice("xyz") for _ in range(rng.choice([3, 4, 5]))) for _ in range(500)})
    df = spark.createDataFrame([(w, rng.randrange(5, 500)) for w in words], "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(keep(df), lot=40).collect()}
    counts = {r["word"]: r["n"] for r in df.collect()}
    for w in words:
        near = [x for x in words if plain_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-counts[x], x))
            assert got[w] == (len(near), counts[best], best)
        else:
            assert w not in got


def test_long_texts_are_cut_between_words():
    text = ("Ünïted states " * 200_000).encode()
    words = Counter(w for piece in spelling._pieces(text) for w in piece)
    assert words == {"Ünïted".encode(): 200_000, b"states": 200_000}


def test_roots_follow_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w3"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{i}": "w13" for i in range(13)} | {"x": "w13", "y": "z"}


# ---------------------------------------------------------------- sharding


def plain_shards(rows, count, seed=12):
    """doc_id, size, crc, source in their order of fractional rank."""
    made, copies = [], Counter()
    for doc_id, text, source in rows:
        raw = (text or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        copy = f":{n}" if (n := copies[doc_id, size, crc, source]) else ""
        copies[doc_id, size, crc, source] += 1
        chance = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{size}:{crc}{copy}".encode()).hexdigest()
        made.append((chance, doc_id, size, crc, source))
    by_source = defaultdict(list)
    for x in made:
        by_source[x[4]].append(x)
    ranked = []
    for source, of in by_source.items():
        of.sort(key=lambda x: (x[0], str(x[1])))
        ranked += [((i + 0.5) / len(of), x[0], "" if source is None else "=" + source, x) for i, x in enumerate(of)]
    ranked.sort(key=lambda r: r[:3])
    out, slots = [], Counter()
    for place, (*_, x) in enumerate(ranked):
        shard = place * count // len(ranked)
        out.append((x[1], x[2], x[3], x[4], shard, slots[shard]))
        slots[shard] += 1
    return out


@pytest.mark.parametrize(("count", "bucket"), [(8, 4096), (3, 16), (64, 7)])
def test_shards_equal_plain_ones(spark, docs, count, bucket):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] + [(i, "same" * (i % 3), f"s{i % 4 and 1}") for i in range(1000, 1300)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, shard int, key string").repartition(5)
    got = sharding.shards(df, count, bucket=bucket)
    assert got.columns == ["doc_id", "size", "text_crc32", "source", "shard", "slot"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_shards(rows, count))


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i % 7}", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(6000)] + [(None, "copy", "hot")] * 3000
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8, bucket=100).collect()
    sizes, mix, whole = Counter(r["shard"] for r in got), Counter((r["shard"], r["source"]) for r in got), Counter(r[2] for r in rows)
    assert len(got) == 9000 and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k]))
        for s, n in whole.items():
            assert abs(mix[k, s] - n / 8) <= 3
        assert abs(sum(r["shard"] == k and r["doc_id"] is None for r in got) - 375) < 75
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_sharding_needs_no_python(spark, docs):
    plans = []
    sharding_keep, sharding.keep = sharding.keep, lambda df: plans.append(df._jdf.queryExecution().toString()) or keep(df)
    try:
        sharding.shards(docs)
    finally:
        sharding.keep = sharding_keep
    assert plans and not any("Python" in p or "Arrow" in p for p in plans)


# ---------------------------------------------------------------- conversations


def damaged(rows):
    space = lambda x: " " if x is None else str(x)
    out = []
    for conv_id, turn, role, text in rows:
        h = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(conv_id, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), (xxhash.xxh64_intdigest(r[3].encode(), 42) ^ 1 << 63)))


def plain_repair(rows):
    """The report of one conversation, by a search from the end; rows as by_turn() has them."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initial = [r[2][:1] for r in rows]
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @cache
    def best(i, state, run):
        """(cost, audit, lines) from turn i on; run: inserts in a row so far."""
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if run < 2:
            for role in ("user", "assistant"):
                if (state, role[0]) in go:
                    c, a, out = best(i, go[state, role[0]], run + 1)
                    ways.append((c + 5, "I" + a, (role + ":", *out)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, a, out = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                for name, edit in ((role, "K"), ("user", "R"), ("assistant", "R")):
                    if (state, name[:1]) in go:
                        c, a, out = best(i + 1, go[state, name[:1]], 0)
                        ways.append((c + more + (edit == "R"), edit + a, (f"{name}:{text}", *out)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def talks(seed, conversations=150, most=9):
    rng, rows = random.Random(seed), []
    for k in range(conversations):
        roles = ["system"] * rng.randrange(2) + ["user", "assistant"] * rng.randrange(5)
        for t, role in enumerate(roles[:most]):
            role = rng.choice(["user", "assistant", "system", "tool", "usher", "", None]) if rng.random() < 0.15 else role
            text = rng.choice(["Fine.", "Good!", "cut off", " \n", "", "So? \t"]) + (str(rng.randrange(40)) + "." if rng.random() < 0.5 else "") if rng.random() < 0.9 else None
            rows.append((k, None if rng.random() < 0.02 else t + rng.randrange(2), role, text))
    rows += [(None, 0, "user", "Who?"), (None, 1, "assistant", "Me."), (None, None, "system", "Be kind."), (5000, None, None, None), (7, 1, "user", "Same."), (7, 1, "user", "Same.")]
    return rows


def compare(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, code string, place long").repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in REPORT) for r in C.report_of_damaged(df).collect()}
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    want = {k: plain_repair(by_turn(by[k])) for k in {r[0] for r in rows}}
    assert got == want


def test_repairs_equal_plain_ones(spark):
    compare(spark, talks(3))


def test_long_conversations_cross_partitions(spark):
    """One conversation holds most rows; it lies in all partitions, and in many blocks."""
    rng = random.Random(4)
    long = []
    for t in range(6000):
        role = ("user", "assistant")[t % 2] if rng.random() < 0.9 else rng.choice(["user", "assistant", "system", "tool"])
        long.append((10**6, t, role, rng.choice(["Yes.", "No!", "it was cut"]) if rng.random() < 0.1 else f"Turn {t}."))
    by = by_turn(damaged(long))
    parts = C.block_matrix  # the same matrices from another grouping: associativity
    coded = "".join(random.Random(5).choices("suaoSUAOwxyz", k=300))
    assert C.times(parts(coded[:123]), parts(coded[123:])) == parts(coded)
    short = talks(6, 30)
    df = spark.createDataFrame([(*r, "x") for r in short + long], "conv_id long, turn long, role string, text string, acts string").repartition(4)
    got = {r["conv_id"]: tuple(r[c] for c in REPORT) for r in C.report_of_damaged(df).collect()}
    want = plain_forward(by)
    assert got[10**6] == want and len(got) == len({r[0] for r in short}) + 1


def plain_forward(rows):
    """plain_repair() for a conversation too long to search from its end: the same steps from its beginning."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def insert(states):
        for _ in range(2):
            for state, (c, a, out) in list(states.items()):
                for role in ("user", "assistant"):
                    if (to := go.get((state, role[0]))) is not None:
                        way = (c + 5, a + "I", (out, role + ":"))
                        if to not in states or way[:2] < states[to][:2]:
                            states[to] = way
        return states

    states = insert({"": (0, "", None)})
    for (_, _, role, text), fault in zip(rows, faults):
        after = {}
        for state, (c, a, out) in states.items():
            ways = [(state, (c + 2, a + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                ways += [(go.get((state, n[:1])), (c + more + (e == "R"), a + e, (out, f"{n}:{text}"))) for n, e in ((role, "K"), ("user", "R"), ("assistant", "R"))]
            for to, way in ways:
                if to is not None and (to not in after or way[:2] < after[to][:2]):
                    after[to] = way
        states = insert(after)
    cost, audit, chain = min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])
    lines = []
    while chain:
        chain, line = chain
        lines.append(line)
    turns = [r[1] for r in rows]
    initial = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(reversed(lines)).encode()).hexdigest())


def test_repaired_turns_alternate(spark):
    rows = [(k, t, r, x) for k, t, r, x in talks(8, 60)]
    made = C.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = defaultdict(str)
    for r in made.turns().orderBy("conv_id", "place", "step").collect():
        by[r["conv_id"]] += r["role"][:1]
    assert by and all(re.fullmatch("s?(ua)+", x) for x in by.values())
    assert made.report.where(F.col("cost") == 0).join(made.turns().where("edit != 'keep'"), "conv_id").count() == 0


def test_no_conversations(spark):
    assert C.report_of_damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
