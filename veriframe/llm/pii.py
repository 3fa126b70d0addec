"""Personal data: fixed base patterns, then bootstrapped contextual extraction. DataFrame functions only.

Base matches (email, ip, card, phone) seed the extraction. Lexical patterns of a match are the word before it, the two
words before it and the word after it, however far off; a match within a longer token has none. Patterns and the instances they stand at form a graph that is
scored in rounds: a pattern by the share of trusted instances among all it stands at, an instance by its best pattern. A
pattern takes part once the trust of its distinct instances adds up to SUPPORT in a round, so instances found in one round
can make patterns of the next. Candidates are unlabelled digit groups (card, phone), addresses without a dot or with "at"
and "dot" written out (email), and IPv6 or bracketed addresses (ip); at a pattern of high confidence they become spans of
that pattern's kind. Counts cover the whole corpus and are summed before they are shuffled.

Null texts count as empty; repeated rows give repeated results; rows are told apart by id and text, so a null id or one id
with several texts is no matter; an empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

KINDS = ("email", "ip", "card", "phone")
# Possessive runs and a start at the head of a run (or where the last match ended) keep matching linear and unchanged.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = r"(?<![\p{L}0-9])[0-9](?:[\x20().-]?[0-9])++(?!\p{L})"
DOT = r"(?:\.|\x20?[\[({](?:dot|\.)[\])}]\x20?)"
LOOSE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:@|\x20?[\[({](?:at|@)[\])}]\x20?)[A-Za-z0-9-]++(?:" + DOT + r"[A-Za-z0-9-]++)*+|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)"
LOOSE_IP = r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}+(?:" + DOT + r"[0-9]{1,3}+){3}|(?:[0-9A-Fa-f]{1,4}+)?+(?:::?[0-9A-Fa-f]{1,4}+){2,7}+)(?![0-9A-Za-z:])"
ROUNDS, CONFIDENT, SUPPORT = 3, 0.8, 3


SPAN = "array<struct<start: int, end: int, m: string, before: string, after: string>>"


def matches(text: Column, pattern: str, sign: str = "") -> Column:
    """array<struct<start, end, m, before, after>> of non-overlapping matches, in code points, with what stands around them."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(SPAN)
    both = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after")))

    def step(acc, x):
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        hit = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    out = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.instr(text, sign) > 0, out).otherwise(none) if sign else out


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits(m))
    values = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.lit(False)) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(m)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def contexts(s: Column) -> Column:
    """Patterns at a match: '<' and the word before, '<' and the two words before, '>' and the word after; in lower case."""
    back = F.reverse(s["before"])
    near, far = (F.reverse(F.regexp_extract(back, r"^[^\p{L}]*+(\p{L}++)(?:[^\p{L}]++(\p{L}++))?", i)) for i in (1, 2))
    after = F.regexp_extract(s["after"], r"^[^\p{L}]*+(\p{L}++)", 1)
    said = F.array(F.when(near != "", F.concat(F.lit("<"), near)), F.when(far != "", F.concat(F.lit("<"), far, F.lit(" "), near)), F.when(after != "", F.concat(F.lit(">"), after)))
    inside = s["before"].rlike(r"\p{L}$") | s["after"].rlike(r"^\p{L}")  # a part of a longer token says nothing of its surroundings
    return F.when(inside, F.array().cast("array<string>")).otherwise(F.transform(F.array_compact(said), F.lower))


def base(docs: DataFrame) -> DataFrame:
    """Adds base and loose: arrays of struct<start, kind (its order), end, m, at (patterns)>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    signs = {"email": "@", "ip": ".", "card": "", "phone": "+"}
    typed = lambda a, k: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["m"].alias("m"), contexts(s).alias("at")))
    checked = lambda k: F.filter(matches(text, PATTERNS[k], signs[k]), lambda s: valid(k, s["m"]))
    lists = [typed(checked(k), i) for i, k in enumerate(KINDS)]
    df = docs.withColumn("base", F.array_sort(F.concat(*lists)))
    loose = F.filter(matches(text, LOOSE), lambda s: F.length(digits(s["m"])).between(9, 19))
    # the patterns need one of these signs; texts without them are not searched
    spelt = F.when(text.rlike(r"@|[\[({]at[\])}]|\x20dot\x20"), matches(text, LOOSE_EMAIL)).otherwise(F.array().cast(SPAN))
    others = F.when(text.rlike(r"[\[({](?:dot|\.)[\])}]|:[0-9A-Fa-f]{1,4}+:"), matches(text, LOOSE_IP)).otherwise(F.array().cast(SPAN))
    return df.withColumn("loose", F.concat(typed(loose, len(KINDS)), typed(spelt, 0), typed(others, 1)))


def clear(loose: Column, spans: Column) -> Column:
    """Of loose, what overlaps none of the spans."""
    return F.filter(loose, lambda c: ~F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))


def shape_kind(s: Column) -> Column:
    """Kinds that a candidate may be of: its own, or for a digit group card from 12 digits on and phone up to 15."""
    n = F.length(digits(s["m"]))
    return F.when(s["kind"] < len(KINDS), F.array(s["kind"])).otherwise(F.array_compact(F.array(F.when(n >= 12, F.lit(2)), F.when(n <= 15, F.lit(3)))))


def confident(rows: DataFrame) -> DataFrame:
    """(pattern, kind) of high confidence, by rounds on the pattern-instance graph."""
    seeds = rows.select(F.explode("base").alias("s")).select(F.explode("s.at").alias("pattern"), "s.kind", "s.m").withColumn("seed", F.lit(1.0))
    others = rows.select(F.explode("loose").alias("s")).select("s.m", "s.at", F.explode(shape_kind(F.col("s"))).alias("kind")).select(F.explode("at").alias("pattern"), "kind", "m").withColumn("seed", F.lit(0.0))
    edges = cut(seeds.union(others).groupBy("pattern", "kind", "m").agg(F.max("seed").alias("seed")))
    trust = edges.groupBy("kind", "m").agg(F.max("seed").alias("trust"))
    for _ in range(ROUNDS):
        scored = edges.join(trust, ["kind", "m"]).groupBy("pattern", "kind").agg((F.sum("trust") / (F.count("*") + 1)).alias("score"), F.sum("trust").alias("support"))
        scored = cut(scored.where(F.col("support") >= SUPPORT))  # both sides of the next join are exchanged: hot patterns can be split
        best = edges.join(scored, ["pattern", "kind"], "left")
        trust = cut(best.groupBy("kind", "m").agg(F.greatest(F.max("seed"), F.coalesce(F.max("score"), F.lit(0.0))).alias("trust")))
    return scored.where(F.col("score") >= CONFIDENT).select("pattern", "kind")


def find(docs: DataFrame) -> DataFrame:
    """__id, __mark, base and spans (base and discovered, sorted) of every row: arrays of struct<start, kind, end>."""
    keys = [F.col("doc_id").cast("long").alias("__id"), F.md5(F.coalesce("text", F.lit(""))).alias("__mark")]
    found = base(docs.select(*keys, "text"))
    rows = cut(found.withColumn("loose", clear(F.col("loose"), F.col("base"))).select("__id", "__mark", "base", "loose"))
    patterns = confident(rows)
    new = rows.where(F.size("loose") > 0).select("__id", "__mark", F.explode("loose").alias("s")).select("__id", "__mark", "s.start", "s.end", "s.at", F.explode(shape_kind(F.col("s"))).alias("kind"))
    new = new.select("__id", "__mark", "start", "end", "kind", F.explode("at").alias("pattern")).join(patterns, ["pattern", "kind"])
    new = new.groupBy("__id", "__mark", "start", "end").agg(F.min("kind").alias("kind")).groupBy("__id", "__mark").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    new = new.toDF("i", "m", "new")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    joined_ = rows.select("__id", "__mark", plain.alias("base")).join(new, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__mark") == F.col("m")), "left")
    return joined_.select("__id", "__mark", "base", F.array_sort(F.when(F.col("new").isNull(), F.col("base")).otherwise(F.concat("base", "new"))).alias("spans"))


def joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("__id").alias("doc_id"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become <KIND>; overlapping spans are replaced once, as the first of them.

    All rows stay. Null and empty texts stay as they are, equal rows are treated alike, n_chars follows the new text where it
    is a column; other columns pass through, whatever their names. An empty table gives an empty one.
    """
    found = find(docs).where(F.size("spans") > 0).groupBy("__id", "__mark").agg(F.first("spans").alias("spans"))
    id_, mark, spans = (fresh(docs, x) for x in ("i", "m", "spans"))
    found = found.toDF(id_, mark, spans)
    name, text = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), F.col("text")

    def step(acc, s):
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(name, s["kind"] + 1))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.md5(F.coalesce("text", F.lit(""))) == F.col(mark))
    marked = docs.join(found, same, "left").withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(clean))
    marked = marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else marked
    return marked.select(*docs.columns)
