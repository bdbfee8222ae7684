"""URL filtering: host and path rules, then association rules mined from labelled URLs. DataFrame operations only."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut

BLOCK = "=block"  # the label's item; no URL token starts with an equals sign
RULES_SENT = 20_000  # mined rules up to so many are broadcast; more are joined by shuffle


def host_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to a slash, question mark or hash, A-Z lower-cased; then what is left up to
    a question mark or hash. Both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule of (verdict, host, path) as struct(_length, rule, verdict), else null.

    A rule fits its host and all subdomains where the path starts with the rule's. Equal lengths: the later by code point.
    """
    if not rules:
        return F.lit(None).cast("struct<_length:int,rule:string,verdict:string>")
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("_length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits))


def tokens(url: Column) -> Column:
    """Distinct items of a URL: scheme, words of the host, path segments, extension (if any), query keys."""
    host, path = host_path(url)
    words = F.transform(F.split(host, r"[.-]"), lambda x: F.concat(F.lit("word:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    kind = F.array(F.concat(F.lit("ext:"), F.nullif(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1), F.lit(""))), F.concat(F.lit("scheme:"), F.substring_index(url, "://", 1)))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)="), 1), lambda x: F.concat(F.lit("key:"), x))
    return F.coalesce(F.array_distinct(F.array_compact(F.concat(words, parts, kind, keys))), F.array().cast("array<string>"))


def mine(urls: DataFrame, labels: DataFrame, support: float = 0.01, confidence: float = 0.6, lift: float = 1.5, pages: int = 20) -> DataFrame:
    """Rules (antecedent, confidence, token) from labelled URLs (id, url) and (id, bad): FP-growth over tokens and label.

    A rule needs the support as a share of the labelled URLs and as a number of ``pages``: fewer prove nothing, and
    at a support of a few URLs nearly every combination would be frequent. Kept are rules that lead to the bad label
    with the least confidence and lift, and of those none that holds a kept rule's tokens and is no surer: what the
    shorter one blocks needs no longer one. ``token`` is the rule's rarest, under which it is indexed.
    """
    marked = urls.join(labels.groupBy("id").agg(F.max("bad").alias("bad")), "id").select(tokens(F.col("url")).alias("t"), "bad")
    baskets = cut(marked.select(F.when(F.col("bad"), F.array_append("t", F.lit(BLOCK))).otherwise(F.col("t")).alias("items")))
    total = baskets.count()
    if total < pages:
        return baskets.where("false").select(F.col("items").alias("antecedent"), F.lit(1.0).alias("confidence"), F.lit("").alias("token"))
    model = FPGrowth(itemsCol="items", minSupport=max(support, pages / total), minConfidence=confidence).fit(baskets)
    sure = model.associationRules.where((F.col("consequent") == F.array(F.lit(BLOCK))) & (F.col("lift") >= lift)).select(F.array_sort("antecedent").alias("antecedent"), "confidence")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), "freq")
    # a rule falls to a shorter one that shares a token with it: found over tokens, not by pairing all rules
    parts = cut(sure.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(often, "item"))
    indexed = parts.groupBy("antecedent").agg(F.max("confidence").alias("confidence"), F.min_by("item", F.struct("freq", "item")).alias("token"))
    short = indexed.select(F.col("antecedent").alias("short"), F.col("confidence").alias("surer"), F.col("token").alias("item"))
    fallen = parts.join(short, "item").where((F.size("short") < F.size("antecedent")) & (F.col("surer") >= F.col("confidence")) & (F.size(F.array_except("short", "antecedent")) == 0))
    return indexed.join(fallen.select("antecedent").distinct(), "antecedent", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct ``url`` that hold all tokens of a rule, by an inverted index on each rule's ``token``."""
    index = cut(rules.select("token", "antecedent", "confidence"))
    if index.count() <= RULES_SENT:
        index = F.broadcast(index)
    held = urls.select("url", tokens(F.col("url")).alias("t"))
    found = held.select("url", "t", F.explode("t").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "t")) == 0)
    return found.groupBy("url").agg(F.max("confidence").alias("confidence"))


def document_in(url: Column) -> Column:
    """The number that a URL's path ends with, an ending like ``.html`` and a slash apart; null if there is none."""
    return F.regexp_extract(host_path(url)[1], r"/([0-9]+)(?:\.[A-Za-z0-9]{1,8})?/?$", 1).try_cast("bigint")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", label: str = "doc_id", labelled: Column | None = None, **how) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every row.

    ``labels`` has ``label``, ``quality`` and ``toxic``; ``labelled`` is what of a page its labels go by, the page's
    id if not given. A page is bad if toxic or of quality 0, null labels say nothing. URLs are matched once however often they recur. Null URLs have empty host and path, fit
    no rule and are allowed; without labels, or with labels that no tokens foretell, the method allows. Repeated rows
    are each judged; without pages there are no rows.
    """
    rows = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), (pages[key] if labelled is None else labelled).alias("_said"))
    bad = (F.coalesce(labels["toxic"], F.lit(0)) == 1) | (F.coalesce(labels["quality"], F.lit(1)) == 0)
    said = labels.where(labels["toxic"].isNotNull() | labels["quality"].isNotNull()).select(labels[label].alias("id"), bad.alias("bad"))
    learnt = mine(rows.where("url is not null").select(F.col("_said").alias("id"), "url"), said, **how)
    hits = matched(rows.select("url").where("url is not null").distinct(), learnt)
    host, path = host_path(F.col("url"))
    parsed = rows.join(hits, "url", "left").withColumn("host", host).withColumn("path", path).withColumn("_r", first_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return parsed.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "confidence")
