"""URL filtering by explicit rules and by mined association rules; DataFrame operations only.

Explicit (host, path) rules come first: a rule fits its host and all subdomains where the URL's path starts with the
rule's, and the longest wins. Other URLs are judged by rules that Spark's FP-growth mines from labelled pages: token
combinations that imply the label "bad" with enough support and confidence. A mined rule is indexed under its rarest
token; a URL meets the rules of its own tokens there, and those whose tokens it all has block it.

Null URLs and URLs without "://" have an empty host and path, no tokens, and are allowed. Repeated rows are judged
alike. Labels that repeat an id count once (bad wins); null labels are not bad. Without labels, nothing is mined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, stored

#: Support as a share of the labelled pages, and least as a number of them, which bounds what FP-growth can find.
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE = 0.002, 20, 0.5
#: Parts that pages of one token are dealt over.
SALTS = 16
BAD = "=bad"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host and its parent domains, path segments (numbers as #), file ending, query names."""
    labels = F.split(host_of(url), "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda i: F.concat(F.lit("host="), F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    words = F.transform(labels, lambda x: F.concat(F.lit("label="), x))
    segments = F.transform(F.filter(F.split(path_of(url), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.regexp_extract(x, "^[^=]*", 0)))
    scheme = F.array(F.concat(F.lit("scheme="), ascii_lower(F.substring_index(url, "://", 1))))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(scheme, domains, words, segments, names))).otherwise(F.array().cast("array<string>"))


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting (verdict, host, path) rule; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest last, outermost
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, confidence, support) that imply a bad page; ``labels`` has doc_id, quality and toxic."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    items = pages.select("page_id", "url").join(known, F.col("page_id") == F.col("doc_id")) \
        .select(F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")).where(F.size("items") > 0)
    items = stored(items, "transactions")
    n = items.count()
    none = items.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double")
    if n < MIN_PAGES:
        return none
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_PAGES / n), minConfidence=min_confidence).fit(items)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select("antecedent", "confidence", "support")
    return stored(found, "rules")


def blocked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` of ``urls`` (url, tokens) that have all tokens of some rule."""
    numbered = rules.withColumn("rule", F.sort_array("antecedent"))
    # indexed under the token that the fewest rules share
    shared = numbered.select("rule", F.explode("rule").alias("token"))
    often = shared.groupBy("token").agg(F.count("*").alias("often"))
    index = shared.join(often, "token").groupBy("rule").agg(F.min(F.struct("often", "token")).alias("least")).select("rule", F.col("least.token").alias("token"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    posted = urls.select("url", "tokens", F.explode("tokens").alias("token")).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    met = posted.join(index, ["token", "salt"]).where(F.size(F.array_except("rule", "tokens")) == 0)
    return met.select("url").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], mined: DataFrame) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict."""
    url = F.col("url")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumns({"rule": rule, "listed": verdict})
    open_urls = rows.where("listed IS NULL AND url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(url))
    bad = blocked(open_urls, mined).withColumn("mined", F.lit("block"))
    return rows.join(bad, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"))
