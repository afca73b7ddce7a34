"""URL filters by association rules mined with FP-growth.

A URL becomes a set of tokens: the parts of its host, the segments of its path
(digits written #), and the names of its query's parameters.  FP-growth over the
token sets of labelled URLs, with one more item on those to be blocked, gives
rules ``tokens -> block``.  Kept are rules with enough support and confidence
that block more often than URLs at large, by more than chance would give any of
the token sets looked at, and more often than the same rule with one token less.  Rules are matched through an inverted index: each is filed under
its rarest token, and a URL that has that token is tested against the rule.
Explicit host and path rules go before mined ones.

Defined results: a null URL or one without ``://`` has an empty host and path and
no token, fits no rule and is allowed; labels other than 0 and 1 teach nothing;
without labelled URLs to block, or with fewer than ``min_count`` labelled URLs,
there is no mined rule; repeated URLs are judged
once and alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, checked_broadcast

BLOCK = "=block"  # the label's item; no URL token starts with =
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #; A-Z lower-cased; empty if there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL."""
    def named(kind: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    segments = F.split(F.regexp_replace(ascii_lower(path_of(url)), "[0-9]+", "#"), "/")
    query = F.split(ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))), "&")
    names = F.transform(query, lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    return F.array_distinct(F.concat(named("h", F.split(host_of(url), "[.-]")), named("p", segments), named("q", names)))


def unlikely(n: Column, share: Column, base: float, most: float) -> Column:
    """Whether ``share`` or more of ``n`` draws at rate ``base`` has a probability bounded by ``most``."""
    if base >= 1:
        return F.lit(False)
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return (share > base) & (n * (share * F.log(share / base) + rest) >= -math.log(most))


def mine_rules(labelled: DataFrame, scratch: Scratch, url_col: str = "url", label_col: str = "label",
               min_support: float = 0.0005, min_confidence: float = 0.6, min_count: int = 8, alpha: float = 0.05) -> DataFrame:
    """Rules (tokens, key, confidence, support, lift) of labelled URLs (label 1: block, 0: allow).

    ``min_support`` counts the URLs that have the tokens and are to be blocked,
    as a part of all labelled URLs; there must be ``min_count`` of them at least.
    ``key`` is the rule's rarest token.

    Were labels dealt out at random, k or more of a rule's n URLs would be to be
    blocked with probability at most exp(-n KL(k / n, base rate)) (Hoeffding's
    bound, which holds for draws without replacement).  That times the number of
    token sets on as many URLs must not exceed ``alpha``.
    """
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(
        tokens_of(F.col(url_col)).alias("tokens"), F.col(label_col).alias("label"))
    rows = scratch.write(rows.filter(F.size("tokens") > 0), "urls")
    items = rows.select(F.when(F.col("label") == 1, F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    empty = "tokens array<string>, confidence double, lift double, support double"
    size, bad = rows.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    if not bad or size < min_count:
        found = rows.sparkSession.createDataFrame([], empty)
    else:
        # half a URL less, so that rounding does not raise the bar above min_count
        model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_count - 0.5) / size), minConfidence=min_confidence).fit(items)
        found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(BLOCK))).select(
            F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support")
        tried = model.freqItemsets.filter(~F.array_contains("items", BLOCK)).count()
        found = found.filter(unlikely(F.col("support") * size / F.col("confidence"), F.col("confidence"), bad / size, alpha / max(1, tried)))
    found = scratch.write(found.filter("lift > 1"), "rules")
    shorter = found.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode("tokens").alias("less"))
    shorter = shorter.select("tokens", "confidence", F.array_remove("tokens", F.col("less")).alias("part"))
    parts = found.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    idle = shorter.join(parts, "part").filter("c >= confidence").select("tokens").distinct()
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").count()
    kept = found.join(idle, "tokens", "left_anti")
    rarest = kept.select("tokens", F.explode("tokens").alias("token")).join(counts, "token")
    rarest = rarest.groupBy("tokens").agg(F.min(F.struct("count", "token")).alias("k"))
    return scratch.write(kept.join(rarest, "tokens").select("tokens", F.col("k.token").alias("key"), "confidence", "support", "lift"), "kept")


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, mined): distinct URLs that fit a mined rule, with the best one's tokens joined by spaces.

    Best: the highest confidence, then the highest support, then the tokens' order.
    """
    own = urls.select(F.col(url_col).alias("url")).filter(F.col("url").isNotNull()).distinct().withColumn("own", tokens_of(F.col("url")))
    near = own.select("url", "own", F.explode("own").alias("key")).join(checked_broadcast(rules), "key")
    fits = near.filter(F.size(F.array_except("tokens", "own")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.array_join("tokens", " ").alias("t")))
    return fits.groupBy("url").agg(best.alias("b")).select("url", F.col("b.t").alias("mined"))


def explicit_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting (verdict, host, path) rule, or null.

    A rule fits its host and all subdomains when the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(spark: SparkSession, pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]],
          id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict, mined.  A written table.

    ``labelled`` has columns url and label (1: block).  ``rule`` is the explicit
    rule that decides, ``mined`` the tokens of a fitting mined rule; without
    either a URL is allowed.
    """
    with Scratch(spark) as scratch:
        own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
        found = scratch.write(match_rules(own, mine_rules(labelled, scratch, **mining)), "matches")
        rows = own.join(checked_broadcast(found), "url", "left").select(
            "id", "mined", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        rows = rows.withColumn("e", explicit_rule(F.col("host"), F.col("path"), rules))
        verdict = F.coalesce("e.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
        return scratch.write(rows.select(F.col("id").alias(id_col), "host", "path", F.col("e.rule").alias("rule"),
                                         verdict.alias("verdict"), "mined"), "judged", keep=True)
