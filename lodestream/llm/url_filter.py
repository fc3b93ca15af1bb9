"""URL filtering by host rules and by association rules mined from labelled URLs.

Spark's FP-growth finds URL token sets that go with the class item in labelled URLs; rules that pass
support, confidence and lift become a block list, matched through an index on each rule's rarest token.
A host rule that fits decides first; the longest one wins.

Defined results: a null url or one without `://` has an empty host and path, no tokens, and is allowed.
Repeated pages give repeated rows. Without usable labels there are no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch

#: Fixed values: (rule, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
BAD = "class:bad"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct host labels, path words and query names; numbers stand as one token."""
    words = lambda c, pattern, mark: F.transform(F.filter(F.split(c, pattern), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.when(x.rlike("^[0-9]+$"), "0").otherwise(x)))
    names = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1)
    return F.array_distinct(F.concat(words(host, r"\.", "h:"), words(F.lower(path), r"[/._-]", "p:"), F.transform(names, lambda x: F.concat(F.lit("q:"), F.lower(x)))))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7, min_lift: float = 1.5, max_rows: int = 50_000) -> DataFrame:
    """labelled (page_id, tokens, bad) -> (rule_id, tokens, confidence, support). The fit takes at most max_rows
    rows, by hash of page_id."""
    sample = labelled.orderBy(F.xxhash64("page_id"), "page_id").limit(max_rows)
    items = sample.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=16).fit(items)
    rules = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= min_lift))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    return rules.withColumn("rule_id", F.xxhash64("tokens"))


def shortest(rules: DataFrame) -> DataFrame:
    """Without the rules that are another rule and one token more. What is left fits the same urls: of the rules that fit
    one, a smallest is left."""
    fewer = F.transform("tokens", lambda x: F.array_remove("tokens", x))
    longer = rules.select(F.col("tokens").alias("longer"), F.explode(fewer).alias("tokens")).join(rules, "tokens", "left_semi")
    return rules.join(longer.select(F.col("longer").alias("tokens")).distinct(), "tokens", "left_anti")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url, tokens) -> the distinct urls that some rule fits, through an inverted index on each rule's rarest token."""
    freq = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    index = rules.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(freq, "token")
    index = index.groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("needed"))
    hits = pages.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return hits.filter(F.size(F.array_except("needed", "tokens")) == 0).select("url").distinct()


def host_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, **options) -> DataFrame:
    """pages (page_id, url), labels (doc_id, quality, toxic) -> page_id, host, path, rule, verdict.
    A label of the same id marks a page: bad if toxic or of no quality."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    pages = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    bad = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path"))
    scratch = Scratch(pages.sparkSession, "urls")
    mined = scratch.cut(mine(pages.join(bad, "page_id").select("page_id", tokens.alias("tokens"), "bad"), **options), "mined")
    rules_left = scratch.cut(shortest(mined), "rules")
    urls = pages.filter("host <> ''").select("url", "host", "path").distinct().select("url", tokens.alias("tokens"))
    blocked = match(urls, rules_left).withColumn("_blocked", F.lit(True))
    rule = host_rule(F.col("host"), F.col("path"), rules)
    out = pages.join(blocked, "url", "left").withColumn("_rule", rule)
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"))
