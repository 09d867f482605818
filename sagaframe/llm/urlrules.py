"""URL filters by association rules, with DataFrame operations only.

Spark's FP-growth mines combinations of URL tokens that go with bad labels; rules pruned by support
and confidence are indexed under their rarest token and matched against each url's tokens. A fixed
list of host and path rules goes first.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import cut

#: (verdict, host, path). A rule fits its host and all subdomains, where the path starts with the rule's.
BASE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "=bad"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """The set of a url's tokens: labels of its host, words of its path, keys of its query; digits don't count."""
    rest = F.concat(path_of(url), F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")))
    listed = lambda kind, text, by: F.transform(F.filter(F.split(F.lower(text), by), lambda x: x.rlike("[^0-9]")), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(listed("h:", host_of(url), r"\."), listed("p:", F.regexp_replace(rest, r"=[^&#]*", ""), r"[/?#&._-]+")))


def base_rule(host: Column, path: Column, rules=BASE_RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def mine(labelled: DataFrame, min_support: float = 0.005, min_count: int = 20, min_confidence: float = 0.8) -> DataFrame | None:
    """(antecedent, confidence, lift, support) of rules token set => bad, from (tokens, bad); None without rows.

    A rule is kept if it holds for ``min_count`` rows, predicts with ``min_confidence`` and no shorter
    rule with the same or a higher confidence is part of it.
    """
    rows = cut(labelled.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items")))
    n = rows.count()
    if not n:
        return None
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(rows)
    rules = cut(model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") > 1)).select("antecedent", "confidence", "lift", "support"))
    a, b = rules.alias("a"), rules.alias("b")
    part = (F.size("b.antecedent") < F.size("a.antecedent")) & (F.size(F.array_except("b.antecedent", "a.antecedent")) == 0) & (F.col("b.confidence") >= F.col("a.confidence"))
    exploded = a.select("a.*", F.explode("a.antecedent").alias("token")).alias("a")
    keyed = b.select("b.*", F.get("b.antecedent", F.lit(0)).alias("token")).alias("b")
    implied = exploded.join(keyed, (F.col("a.token") == F.col("b.token")) & part).select(F.col("a.antecedent").alias("antecedent")).distinct()
    return rules.join(implied, "antecedent", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` values of which some rule's tokens are all tokens."""
    every = urls.select("url").distinct().withColumn("tokens", tokens_of(F.col("url"))).withColumn("token", F.explode("tokens"))
    often = every.groupBy("token").agg(F.count("*").alias("n"))
    spread = rules.select("antecedent", F.explode("antecedent").alias("token")).join(often, "token", "left")
    index = spread.groupBy("antecedent").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"].alias("token"))
    return every.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=BASE_RULES, min_support: float = 0.005, min_count: int = 20, min_confidence: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for each row of ``pages``.

    Rules are mined from the pages whose verdict is known: by the fixed rules where one fits, else by
    ``labels`` (doc_id, quality, toxic), which mark pages of the same id; such a page is bad if any of its
    labels has quality 0 or toxic 1. The fixed rule decides where one fits, else a mined rule blocks, else
    the url is allowed. Null urls and urls without :// have an empty host and path and are allowed; repeated urls
    and ids are judged alike; where no verdict is known nothing is mined. Other columns aren't read.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    bad = F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    ruled = base_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    known = slim.join(marks, "page_id", "left").withColumn("bad", F.coalesce(ruled["verdict"] == "block", "bad")).where("bad IS NOT NULL")
    mined = mine(known.select(tokens_of(F.col("url")).alias("tokens"), "bad"), min_support, min_count, min_confidence)
    if mined is not None:
        mined = cut(mined)
    if mined is None or mined.isEmpty():
        told = slim.withColumn("mined", F.lit(False))
    else:
        told = slim.join(matched(slim, mined).withColumn("mined", F.lit(True)), "url", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    judged = told.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "mined")
    judged = judged.withColumn("fixed", base_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined"), F.lit("block")).otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), "mined")
