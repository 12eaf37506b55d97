"""The corpus pipeline: each stage against plain Python on a small corpus with odd rows."""

from collections import Counter, defaultdict

import corpus_pipeline
from tokenizers import Tokenizer

from tidebar.llm import quality_classifier, secrets
from tidebar.llm.common import keep
from tidebar.llm.queries import TOKENIZER

from .test_text_operators import components_of, targets, words


def test_stages(spark, tmp_path):
    good = [(i, " ".join(f"word{i}x{k % 40}y{k}" for k in range(60)) + ".", f"s{i % 3}") for i in range(60)]
    bad = [(100 + i, "JUNK!! " * 50, "s0") for i in range(20)]
    copies = [(200 + i, good[0][1] + f" tail{i}", "s1") for i in range(5)]
    leak = [(300, good[1][1].replace("word1", "other") + " token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\"", "s2")]
    odd = [(None, good[2][1].replace("word2", "null"), None), (None, None, "s1"), (400, None, None), (401, "", "s1"), (402, " \n\t", "s9"), (5, good[5][1], "s2"), (403, good[3][1].replace("word3", "long") + " filler" * 20_000, "s1")]
    rows = [(d, t, "en", s, None if t is None else len(t), "mine") for d, t, s in good + bad + copies + leak + odd]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, rank string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1 if d < 100 else 0, 0) for d, *_ in good + bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    judged = Counter((r["doc_id"], r["predicted"]) for r in quality_classifier.classify(docs, labels).collect())
    seen, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, str(tmp_path)))
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "pack":
            assert docs.columns == columns
    one = {n: [(r[0], r[1], r[3]) for r in seen[n]] for n in seen if n != "pack"}
    ids = {n: Counter(r[0] for r in part) for n, part in one.items()}

    assert ids["quality"] == Counter({d: n for (d, fine), n in judged.items() if fine})
    assert all(ids["quality"][d] for d, *_ in good + copies + leak) and not any(ids["quality"][d] for d, *_ in bad)

    roots = components_of([(d, t) for d, t, _ in one["quality"]])
    want = Counter(d for d, n, _ in roots if not n)  # wordless rows all stay
    want += Counter({c: 1 for _, n, c in roots if n and c is not None})
    want += Counter({None: sum(1 for d, n, c in roots if n and c is None)})
    assert ids["deduplicate"] == want and ids["deduplicate"][0] == 1 and not ids["deduplicate"][200]

    assert ids["redact"] == ids["deduplicate"]
    before = {d: t for d, t, _ in one["deduplicate"] if d is not None}
    for r in seen["redact"]:
        text = before.get(r[0])
        if r[0] is not None and text and not secrets.base_spans(text):
            assert r[1] == text
        assert r[4] == (None if r[1] is None else len(r[1])) and r[5] == "mine"
    assert "f3ef4d6b" not in next(t for d, t, _ in one["redact"] if d == 300)

    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in one["redact"]:
        sizes[s] += len(words(t))
    for _, t, s in one["mix"]:
        taken[s] += len(words(t))
    goal = targets(sizes)
    assert set(ids["mix"]) <= set(ids["redact"]) and all(n <= 2 * ids["redact"][d] for d, n in ids["mix"].items())
    assert all(abs(taken[s] - goal[s]) <= max(60, 0.5 * max(len(words(t)) for _, t, o in one["redact"] if o == s)) for s in goal)

    tokenizer = Tokenizer.from_file(TOKENIZER)
    lengths = Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, _ in one["mix"])
    pieces = seen["pack"]
    assert Counter((r[0], r[4]) for r in pieces if r[1] == 0) == lengths and sum(r[2] for r in pieces) == sum(n * k for (_, n), k in lengths.items())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
