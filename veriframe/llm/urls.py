"""URL filter: host/path rules, then a weighted vocabulary counted by an Aho-Corasick automaton.

A URL is blocked on one strict term or on ``soft_limit`` distinct soft terms; a hit counts only if
the characters on both sides are not ASCII letters or digits. Null or scheme-less URLs have an empty
host and path, fit no rule, and are still scanned for terms; a null URL is allowed. Rows repeat as
given; other columns do not matter. The automaton is as large as the vocabulary, not the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
STRICT = ("porn", "xxx", "spam-farm", "cheap-pills", "casino-bonus", "viagra", "warez", "malware", "phishing", "escort")
SOFT = ("casino", "poker", "bet", "pills", "spam", "farm", "cheap", "free", "win", "bonus", "sex", "adult", "hot", "deal", "loan", "crack", "torrent", "click", "download")


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; the scheme ends at the first '://'."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_columns(rules: tuple = RULES):
    """(rule, verdict) of the longest rule whose host and path fit, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: len(r[0])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def term_counter(strict: tuple = STRICT, soft: tuple = SOFT):
    """An Arrow-batched function: URL -> (strict hits, distinct soft hits)."""

    @F.pandas_udf("strict int, soft int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = ahocorasick.Automaton()
        for t in soft:
            find.add_word(t, (t, False))
        for t in strict:
            find.add_word(t, (t, True))
        find.make_automaton()
        inner = set("abcdefghijklmnopqrstuvwxyz0123456789")
        for urls in batches:
            out = []
            for url in urls:
                s = (url or "").lower()
                hard, mild = 0, set()
                for end, (t, is_strict) in find.iter(s):
                    a, b = end - len(t), end + 1
                    if (a < 0 or s[a] not in inner) and (b >= len(s) or s[b] not in inner):
                        if is_strict:
                            hard += 1
                        else:
                            mild.add(t)
                out.append((hard, len(mild)))
            yield pd.DataFrame(out, columns=["strict", "soft"])

    return count


def judge(pages: DataFrame, soft_limit: int = 2, rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits for every row."""
    hits = term_counter(strict, soft)(F.col("url"))
    df = host_and_path(pages.select("page_id", "url")).withColumn("hits", hits)
    rule, verdict = rule_columns(rules)
    method = F.when((F.col("hits.strict") > 0) | (F.col("hits.soft") >= soft_limit), "block").otherwise("allow")
    return df.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("hits.strict").alias("strict_hits"), F.col("hits.soft").alias("soft_hits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", (F.col("strict_hits") > 0).alias("strict"), "soft_hits")


def oracle() -> str:
    """The query in SQL, from the same rules and terms."""
    term = lambda t: f"regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    fits = lambda r: "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))".format(*r.split("/", 1))
    choose = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[k]}'" for r in longest) + " END"
    soft = " + ".join(f"CAST({term(t)} AS INTEGER)" for t in SOFT)
    return f"""WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT page_id, host, path, {choose(0)} AS rule, {choose(1)} AS said, {" OR ".join(map(term, STRICT))} AS strict, CAST({soft} AS INTEGER) AS soft_hits FROM b)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN strict OR soft_hits >= 2 THEN 'block' ELSE 'allow' END) AS verdict, strict, soft_hits FROM c"""
