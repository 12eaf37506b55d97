"""URL filter rules indexed by their rarest literal token (operator 8); DataFrame functions only.

Each rule is filed under one literal token that every url it matches must hold. A url's tokens fetch the rules
filed under them, and only these rules' regular expressions run. The index is part of the row expression, so a
table of any size is judged where it is read, without a shuffle; rule lists longer than IN_ROW go through a join
on the token instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many rules the index is a literal of the plan.
IN_ROW = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A pattern over `host` + `path`. literal: a host and path prefix, which beats every pattern rule."""

    action: str
    name: str
    regex: str
    tokens: tuple[str, ...]
    literal: bool = False


def prefix_rule(action: str, name: str) -> Rule:
    """`host/path` fits the host and its subdomains, if the url's path starts with `/path`."""
    host, _, path = name.partition("/")
    inner = re.split("[^a-z0-9]+", f"{host}/{path}")[:-1]  # the last token may go on in the url
    return Rule(action, name, rf"^([^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(t for t in inner if t), True)


def pattern_rule(action: str, regex: str, *tokens: str) -> Rule:
    """A regular expression (searched) and the literal tokens that any match holds whole."""
    return Rule(action, regex, regex, tokens)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^([^/?#]*)", 1))
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.lower(target), "[^a-z0-9]+"))


def _index(pages: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """token -> rules filed under it: of each rule's tokens the one in the fewest urls of the table."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    seen = pages.select(F.explode(_tokens(F.col("target"))).alias("t"))
    among = seen.where(F.col("t").isin(wanted)) if len(wanted) <= IN_ROW else seen.join(pages.sparkSession.createDataFrame([(t,) for t in wanted], "t string"), "t")
    often = {r["t"]: r["n"] for r in among.groupBy("t").agg(F.count("*").alias("n")).collect()}  # at most one row a rule token
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (often.get(t, 0), t)), []).append(r)
    return out


def _as_struct(r: Rule) -> Column:
    return F.struct(F.lit(r.regex).alias("regex"), F.lit(r.action).alias("action"), F.lit(r.name).alias("name"), F.lit(r.literal).alias("literal"), F.lit(len(r.name)).alias("size"))


def _verdict(best: Column, other: Column) -> tuple[Column, Column]:
    """rule, verdict: the longest literal rule's, else block if any pattern rule blocks, else allow."""
    return best["name"].alias("rule"), F.coalesce(best["action"], F.when(other, "block"), F.lit("allow")).alias("verdict")


def judge(pages: DataFrame, rules: list[Rule], in_row: int = IN_ROW) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict.

    A null url, or one without `://`, has an empty host and path; no rule fits it and it is allowed. Repeated rows
    are judged once each; a null page_id stays null; other columns are ignored; an empty table gives no rows. Of
    literal rules of the same length the larger name wins; a url is blocked without a literal rule when any
    pattern rule that blocks matches.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("target", F.concat("host", "path"))
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    index = _index(urls, rules)
    if len(rules) <= in_row:
        filed = F.map_from_arrays(F.array(*map(F.lit, index)), F.array(*(F.array(*map(_as_struct, v)) for v in index.values())))
        found = F.flatten(F.transform(F.filter(_tokens(F.col("target")), lambda t: F.map_contains_key(filed, t)), lambda t: F.element_at(filed, t)))
        found = F.filter(found, lambda r: F.rlike(F.col("target"), r["regex"]))
        urls = urls.withColumn("found", found)
        best = F.array_max(F.transform(F.filter("found", lambda r: r["literal"]), lambda r: F.struct(r["size"].alias("size"), r["name"].alias("name"), r["action"].alias("action"))))
        urls = urls.select("*", best.alias("best"), F.exists("found", lambda r: ~r["literal"] & (r["action"] == "block")).alias("other"))
        return urls.select("page_id", "host", "path", *_verdict(F.col("best"), F.col("other")))
    flat = [(t, r.regex, r.action, r.name, r.literal, len(r.name)) for t, rs in index.items() for r in rs]
    filed = pages.sparkSession.createDataFrame(flat, "t string, regex string, action string, name string, literal boolean, size int")
    hits = (
        urls.select("target").distinct().select("target", F.explode(_tokens(F.col("target"))).alias("t"))
        .join(filed, "t").where(F.rlike(F.col("target"), F.col("regex")))
        .groupBy("target")
        .agg(F.max(F.when(F.col("literal"), F.struct("size", "name", "action"))).alias("best"), F.max(~F.col("literal") & (F.col("action") == "block")).alias("other"))
    )
    return urls.join(hits, "target", "left").select("page_id", "host", "path", *_verdict(F.col("best"), F.coalesce("other", F.lit(False))))

