"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, jaccard_join, mixing, neighbours, packing, quality_classifier, quality_rules, secrets, sharding, spelling, substring_dedup, token_counts, url_filter
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, size=4096, end_id=2)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.judge(docs, quality_rules.trusted_ids(labels))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
win AS (SELECT doc_id, s, hash(array_to_string(w[s : s + 19], ' ')) AS h, hash('b' || array_to_string(w[s : s + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY h, g ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM late, range(20) r(i)),
cut AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE [x for x, i in w if NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), shingle=5, percent=75)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id,
    [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=50, k=5, parts=64)


URL_RULES = [
    url_filter.prefix_rule("allow", "org/"),
    url_filter.prefix_rule("block", "example.org/es/"),
    url_filter.prefix_rule("block", "example.org/en/1"),
    url_filter.prefix_rule("allow", "com/fr/"),
    url_filter.prefix_rule("block", "com/de/"),
    # pattern rules: hosts and paths of link farms, gambling, counterfeit goods and trackers
    url_filter.pattern_rule("block", r"(^|[./-])cheap-pills([./-]|$)", "cheap", "pills"),
    url_filter.pattern_rule("block", r"(^|[./-])casino-win([./-]|$)", "casino", "win"),
    url_filter.pattern_rule("block", r"(^|[./-])free-bets([./-]|$)", "free", "bets"),
    url_filter.pattern_rule("block", r"(^|[./-])spam-farm([./-]|$)", "spam", "farm"),
    url_filter.pattern_rule("block", r"(^|[./-])ads-track([./-]|$)", "ads", "track"),
    url_filter.pattern_rule("block", r"(^|[./-])(online|best|mega)-casino([./-]|$)", "casino"),
    url_filter.pattern_rule("block", r"(^|[./-])replica-watch(es)?([./-]|$)", "replica"),
    url_filter.pattern_rule("block", r"(^|[./-])payday-loans?([./-]|$)", "payday"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP8_SQL = r"""
WITH rules(action, name) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'),
  ('allow', 'com/fr/'), ('block', 'com/de/')),
patterns(regex) AS (VALUES ('(^|[./-])cheap-pills([./-]|$)'), ('(^|[./-])casino-win([./-]|$)'),
  ('(^|[./-])free-bets([./-]|$)'), ('(^|[./-])spam-farm([./-]|$)'), ('(^|[./-])ads-track([./-]|$)'),
  ('(^|[./-])(online|best|mega)-casino([./-]|$)'), ('(^|[./-])replica-watch(es)?([./-]|$)'),
  ('(^|[./-])payday-loans?([./-]|$)')),
urls AS (SELECT page_id,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
targets AS (SELECT DISTINCT host, path FROM urls),
best AS (SELECT t.host, t.path, arg_max(r.name, length(r.name)) AS rule, arg_max(r.action, length(r.name)) AS action
  FROM targets t JOIN rules r ON (t.host = split_part(r.name, '/', 1) OR ends_with(t.host, '.' || split_part(r.name, '/', 1)))
    AND starts_with(t.path, substr(r.name, strpos(r.name, '/')))
  GROUP BY ALL),
bad AS (SELECT DISTINCT t.host, t.path FROM targets t JOIN patterns p ON regexp_matches(t.host || t.path, p.regex))
SELECT u.page_id, u.host, u.path, b.rule,
  coalesce(b.action, CASE WHEN x.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON u.host = b.host AND u.path = b.path LEFT JOIN bad x ON u.host = x.host AND u.path = x.path
"""


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), RANKS)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=199, least_n=5, times=5)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shards(table(spark, sf_dir, "documents"), count=8)
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report_of_damaged(table(spark, sf_dir, "conversations"))


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a string's UTF-8 bytes."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {octets}), lambda c, b: {bits}), 4294967295::UBIGINT)::BIGINT"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS w FROM documents),
h AS (SELECT w, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL)),
c AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM c GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, c.word FROM words w JOIN cuts c ON w.word = c.rest UNION SELECT c.word, w.word FROM words w JOIN cuts c ON w.word = c.rest),
best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM near JOIN words ON word = b),
f AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN x.n >= 5 * w.n THEN b END AS form, CASE WHEN x.n >= 5 * w.n THEN x.n END AS form_n
  FROM words w LEFT JOIN best x ON a = word AND k = 1),
walk AS (SELECT word, word AS at, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(walk.at, step) FROM walk WHERE walk.word = f.word) AS root, f.n, f.n_near, f.form_n FROM f
"""

OP12_SQL = rf"""
WITH r AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, text_crc32) - 1 AS copy, coalesce('=' || source, '') AS key FROM r),
m AS (SELECT *, md5(concat_ws(':', 12, coalesce(doc_id::VARCHAR, ''), size, text_crc32, CASE WHEN copy > 0 THEN copy END)) AS chance FROM c),
p AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY chance, doc_id, size, text_crc32) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY key) AS part FROM m),
o AS (SELECT *, row_number() OVER (ORDER BY part, chance, key, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 8 // total)::INTEGER AS shard, place - ((place * 8 // total) * total + 7) // 8 AS slot, NULL::INTEGER AS grown_shard, source FROM o
"""


def _op13_sql() -> str:
    """The repair as a recursion over turns, which carries the best way to each of the four states."""

    def way(of: str, cost: str, edit: str, line: str | None = None, when: str = "true") -> str:
        text = f"{of}.t" if line is None else f"{of}.t || chr(10) || {line}"
        return f"CASE WHEN {of} IS NOT NULL AND {when} THEN {{'c': {of}.c + {cost}, 'a': {of}.a || '{edit}', 't': {text}}} END"

    def become(of: str, role: str) -> list[str]:
        keep = way(of, "more", "K", "role || ':' || text", f"fine AND first = '{role[0]}'")
        return [keep] if role == "system" else [keep, way(of, "more + 1", "R", f"'{role}:' || text", "fine")]

    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    user = [x for s in ("s0", "s1", "s3") for x in become(s, "user")]
    insert_user, insert_both = (lambda s: way(s, "5", "I", "'user:'")), (lambda s: way(s, "10", "II", "'user:' || chr(10) || 'assistant:'"))
    kind = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    return rf"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) FROM h WHERE h <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
q AS MATERIALIZED (SELECT *, left(role, 1) AS first, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
      WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
r AS MATERIALIZED (SELECT conv_id, pos, role, text, first, fault NOT IN ('blank', 'duplicate') AS fine, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM q),
e AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM q GROUP BY conv_id),
w(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': ''}}::{kind}, NULL::{kind}, {{'c': 5, 'a': 'I', 't': chr(10) || 'user:'}}::{kind}, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}::{kind} FROM e
  UNION ALL SELECT conv_id, pos, n0, n1, {least("n2", *map(insert_user, ("n0", "n1", "n3")))}, {least("n3", way("n2", "5", "I", "'assistant:'"), *map(insert_both, ("n0", "n1")))}
  FROM (SELECT w.conv_id, r.pos, {way("s0", "2", "D")} AS n0, {least(way("s1", "2", "D"), *become("s0", "system"))} AS n1, {least(way("s2", "2", "D"), *user)} AS n2,
    {least(way("s3", "2", "D"), *become("s2", "assistant"))} AS n3 FROM w JOIN r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.pos = w.pos + 1)),
b AS (SELECT e.*, list_min([s0, s3]) AS x FROM e JOIN w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.pos = e.n)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(x.c, 0) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(substr(x.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_packing": op2_packing,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_quality_rules": op5_quality_rules,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_url_filters": op8_url_filters,
        "op9_secret_scans": op9_secret_scans,
        "op10_token_counts": op10_token_counts,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_sharding": op12_sharding,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_jaccard_join": OP4_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op8_url_filters": OP8_SQL,
        "op11_spelling_variants": OP11_SQL,
        "op12_sharding": OP12_SQL,
        "op13_conversation_repair": _op13_sql(),
    }
