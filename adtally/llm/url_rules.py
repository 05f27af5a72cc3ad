"""URL filter: fixed rules by host and path, and association rules for all other URLs.

Tokens are made of every label and suffix of a host, every segment of a path, every key of
a query and its value. Frequent combinations of them and a label are mined by FP-growth from
pages whose document is labelled: tokens below the support are in none, and tokens that the
very same URLs hold are one item, which a URL has with any of them. Combinations that predict
a label with enough support and confidence become rules. A rule is found by its rarest item
(an inverted index), and holds if a URL has all of its items; of those that hold, the most
confident decides.

Each item may be a rule of its own, and all items of a URL may combine. A URL of m items has
2^m combinations, so while some URL has more than ``MOST_TOGETHER``, the pages are projected
as FP-growth itself does it: for each item, the pages that have it, with their later items.
What cannot change a verdict goes in each projection: items whose combination has neither
label often enough, items that all of its pages have, and items whose pages there have one
label (a longer rule is then no better than the shorter one, which holds wherever it does).
Projections without a long URL are mined by FP-growth. The number of combinations that are
left bounds the work; none is dropped for being many. Hosts beyond ``HOST_CHARS``, which no
name system has, give no suffixes but the whole.

Rows: a null URL, or one without ``://``, has empty host and path, no tokens, and is
allowed. Repeated rows all stay. Without labels, or without pages, there are no rules and
URLs that no fixed rule covers are allowed. Documents with several labels are blocked if
any of them says so; null labels say nothing. Of the tables only page_id, url, doc_id,
quality and toxic are read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.common import stored, table

# --- Fixed values: the rules given for this table, as (verdict, host, path) --------------
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least share of the labelled pages in a rule, and least share of them with its label.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Items of a URL up to which FP-growth mines it whole, and the longest name that hosts can have.
MOST_TOGETHER, HOST_CHARS = 10, 253


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text and verdict; nulls if none does."""
    text = verdict = None
    for said, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        if text is None:
            text = F.when(fits, rule_host + rule_path)
            verdict = F.when(fits, said)
        else:
            text, verdict = text.when(fits, rule_host + rule_path), verdict.when(fits, said)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Tokens of all parts of a URL; runs of digits in a path or a value are one zero."""

    def tokens(kind: str, values: Column) -> Column:
        return F.transform(
            F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind + ":"), v)
        )

    def one(kind: str, value: Column) -> Column:
        return tokens(kind, F.array(value))

    url = F.coalesce(url, F.lit(""))
    names = F.split(host, r"\.")
    n_names = F.size(names)
    suffixes = F.when(
        F.length(host) <= HOST_CHARS,
        F.transform(F.sequence(F.lit(1), n_names), lambda i: F.array_join(F.slice(names, i, n_names), ".")),
    ).otherwise(F.array(host))
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda v: v != "")
    query = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                one("scheme", F.regexp_extract(url, "^([A-Za-z]+)://", 1)),
                tokens("host", suffixes),
                tokens("label", names),
                tokens("segment", segments),
                tokens("first", F.slice(segments, 1, 1)),
                tokens("second", F.slice(segments, 2, 1)),
                tokens("key", F.transform(query, lambda v: F.regexp_extract(v, "^[^=]*", 0))),
                tokens("pair", F.transform(query, lambda v: F.regexp_replace(v, "[0-9]+", "0"))),
                one("mark", F.regexp_extract(url, "#(.*)$", 1)),
            )
        )
    )


def with_tokens(pages: DataFrame) -> DataFrame:
    """``(page_id, url, host, path, tokens)``."""
    host, path = url_parts(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return cut.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens of pages with a label; the number that ends a page's path names its document."""
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:[^0-9/][^/]*)?/?$", 1)
    number = F.when(number != "", number).cast("bigint")
    said = (
        labels.select("doc_id", "quality", "toxic")
        .where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy("doc_id")
        .agg(F.max(F.expr("coalesce(quality = 0, false) OR coalesce(toxic = 1, false)")).alias("bad"))
    )
    return (
        pages.withColumn("doc_id", number)
        .join(said, "doc_id")
        .select("tokens", F.when(F.col("bad"), "block").otherwise("allow").alias("label"))
    )


def mine(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``(antecedent, label, confidence, support, token)``; token is the index key."""
    items = labelled.select(
        F.concat("tokens", F.array(F.concat(F.lit("="), "label"))).alias("items")
    )
    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(
        itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=n
    ).fit(items)
    sets = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "sets")
    labels = F.array(F.lit("=allow"), F.lit("=block"))
    both = sets.where(F.arrays_overlap("items", labels) & (F.size("items") > 1)).select(
        F.array_except("items", labels).alias("antecedent"),
        F.substring(F.element_at(F.array_intersect("items", labels), 1), 2, 9).alias("label"),
        F.col("freq").alias("support"),
    )
    total = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("total"))
    rules = (
        both.join(total, "antecedent")
        .withColumn("confidence", F.col("support") / F.col("total"))
        .where(F.col("confidence") >= min_confidence)
    )
    single = sets.where(F.size("items") == 1).select(
        F.element_at("items", 1).alias("token"), F.col("freq").alias("seen")
    )
    return with_rarest(rules, single)


def with_rarest(rules: DataFrame, single: DataFrame) -> DataFrame:
    """``rules`` with the rarest item of each as its ``token``, by ``single (token, seen)``."""
    rarest = (
        rules.select("antecedent", F.explode("antecedent").alias("token"))
        .join(single, "token")
        .groupBy("antecedent")
        .agg(F.min_by("token", F.struct("seen", "token")).alias("token"))
    )
    return rules.join(rarest, "antecedent").select(
        "antecedent", "label", "confidence", "support", "token"
    )


def totals(labelled: DataFrame) -> tuple[int, int]:
    """Labelled pages, and bad ones among them."""
    row = labelled.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "block").alias("bad")
    ).first()
    return row.n, row.bad


def vocabulary(labelled: DataFrame, n: int, bad: int, min_support: float = MIN_SUPPORT) -> DataFrame:
    """``(token, item, seen, bad, tells)`` of the tokens that reach the support.

    Tokens that the very same token sets hold are one item, named by the first of them. It
    tells the more, the further its bad pages are from their share of all ``n``.
    """
    sets = labelled.groupBy("tokens").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "block").alias("n_bad")
    )
    held = (
        sets.withColumn("hash", F.xxhash64("tokens"))
        .select("n", "n_bad", "hash", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(
            F.sum("n").alias("seen"),
            F.sum("n_bad").alias("bad"),
            F.sum(F.col("hash").cast("decimal(38,0)")).alias("sum"),
            F.bit_xor(F.xxhash64("hash", F.lit(1))).alias("bits"),
        )
        .where(F.col("seen") >= min_support * n)
    )
    held = stored(held, "tokens")
    same = ["seen", "bad", "sum", "bits"]
    items = held.groupBy(*same).agg(F.min("token").alias("item"))
    tells = F.abs(F.col("bad") - F.col("seen") * (bad / max(1, n))) / F.sqrt("seen")
    return held.join(items, same).select("token", "item", "seen", "bad", tells.alias("tells"))


def with_items(token_sets: DataFrame, known: DataFrame) -> DataFrame:
    """``(tokens, items)`` of the distinct ``tokens`` that have an item.

    Items come in the order of what they tell.
    """
    tells = F.struct((-F.col("tells")).alias("tells"), "item")
    return (
        token_sets.select("tokens", F.explode("tokens").alias("token"))
        .join(known, "token")
        .groupBy("tokens")
        .agg(F.array_sort(F.collect_set(tells)).alias("told"))
        .select("tokens", F.col("told.item").alias("items"))
    )


def as_rules(counts: DataFrame, least: float, min_confidence: float) -> DataFrame:
    """Rules from ``(antecedent, seen, bad)`` with the support and the confidence."""
    says = F.array(
        F.struct(F.lit("block").alias("label"), F.col("bad").alias("support")),
        F.struct(F.lit("allow").alias("label"), (F.col("seen") - F.col("bad")).alias("support")),
    )
    return (
        counts.withColumn("says", F.explode(says))
        .withColumn("confidence", F.col("says.support") / F.col("seen"))
        .where((F.col("says.support") >= least) & (F.col("confidence") >= min_confidence))
        .select("antecedent", "says.label", "confidence", "says.support")
    )


def projected(sets: DataFrame, n: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Combinations of ``sets (items, n, n_bad)``: those counted, and the pages left to mine.

    The first are ``(antecedent, seen, bad)``. The others are ``(prefix, held, n, n_bad)``, the
    items ``held`` by the pages that have all of ``prefix``; whole prefixes are in it.
    """
    none = F.array().cast("array<string>")
    rows = sets.select(
        none.alias("prefix"), F.lit(n).cast("bigint").alias("whole"), "items", "n", "n_bad"
    )
    counted, left = [], []
    while True:
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "projected")
        each = rows.select(
            "prefix", "whole", "row", "n", "n_bad", F.posexplode("items").alias("at", "item")
        )
        counts = each.groupBy("prefix", "whole", "item").agg(
            F.sum("n").alias("seen"), F.sum("n_bad").alias("bad")
        )
        often = F.greatest(F.col("bad"), F.col("seen") - F.col("bad")) >= least
        counts = stored(counts.where(often & (F.col("seen") < F.col("whole"))), "counts")
        counted.append(
            counts.where(F.size("prefix") > 0).select(
                F.concat("prefix", F.array("item")).alias("antecedent"), "seen", "bad"
            )
        )
        mixed = counts.where("0 < bad AND bad < seen").select("prefix", "item", "seen")
        held = F.array_sort(F.collect_list(F.struct("at", "item", "seen")))
        kept = (
            each.join(mixed, ["prefix", "item"])
            .groupBy("prefix", "row", "n", "n_bad")
            .agg(held.alias("held"))
            .where(F.size("held") > 1)
        )
        kept = stored(kept, "kept")
        longest = kept.groupBy("prefix").agg(F.max(F.size("held")).alias("longest"))
        kept = kept.join(longest, "prefix")
        short = F.col("longest") <= MOST_TOGETHER
        left.append(kept.where(short).select("prefix", "held.item", "n", "n_bad"))
        long = kept.where(~short)
        if not long.limit(1).count():
            break
        parts = F.transform(
            "held",
            lambda x, i: F.struct(
                F.concat("prefix", F.array(x["item"])).alias("prefix"),
                x["seen"].alias("whole"),
                F.slice("held", i + 2, F.size("held"))["item"].alias("items"),
            ),
        )
        rows = (
            long.select(F.explode(parts).alias("part"), "n", "n_bad")
            .select("part.*", "n", "n_bad")
            .where(F.size("items") > 0)
            .groupBy("prefix", "whole", "items")
            .agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
        )
    return reduce(DataFrame.unionAll, counted), reduce(DataFrame.unionAll, left)


def one_row_a_page(sets: DataFrame) -> DataFrame:
    """``(tokens, label)``, a row for each page of ``(tokens, n, n_bad)``; no array is long."""
    return (
        sets.withColumn("part", F.explode(F.expr("sequence(0L, (n - 1) div 1000)")))
        .withColumn(
            "place",
            F.explode(F.expr("sequence(1000 * part + 1, least(1000 * part + 1000, n))")),
        )
        .select(
            "tokens",
            F.when(F.col("place") <= F.col("n_bad"), "block").otherwise("allow").alias("label"),
        )
    )


def rules_of(
    labelled: DataFrame,
    known: DataFrame,
    n: int,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Rules of single items and of combinations, counted over all labelled pages.

    Combinations that cannot change a verdict are left out.
    """
    items = with_items(labelled.select("tokens").distinct(), known)
    sets = labelled.join(items, "tokens").groupBy("items").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "block").alias("n_bad")
    )
    least = min_support * n
    counted, left = projected(sets, n, least)
    # An item's name tells its prefix too, so that all projections are mined at once.
    named = F.transform(
        "item",
        lambda x: F.concat_ws(",", F.transform(F.concat("prefix", F.array(x)), lambda y: F.hex(y))),
    )
    pages = stored(one_row_a_page(left.select(named.alias("tokens"), "n", "n_bad")), "pages")
    # The share that stands for the least whole number of pages, whatever its rounding.
    share = (max(1, math.ceil(least)) - 0.5) / max(1, pages.count())
    mined = mine(pages, min(1.0, share), min_confidence).where(F.size("antecedent") > 1)
    parts = F.transform(
        "antecedent",
        lambda x: F.transform(F.split(x, ","), lambda y: F.unhex(y).cast("string")),
    )
    mined = mined.withColumn("antecedent", F.array_distinct(F.flatten(parts))).drop("token")
    single = known.select("item", "seen", "bad").distinct()
    alone = single.select(F.array("item").alias("antecedent"), "seen", "bad")
    rules = as_rules(counted.unionByName(alone), least, min_confidence).unionByName(mined)
    return with_rarest(stored(rules, "found"), single.select(F.col("item").alias("token"), "seen"))


def judge(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, label, confidence)`` of the distinct token sets that some rule holds for."""
    found = (
        token_sets.select("tokens", F.explode("tokens").alias("token"))
        .join(rules, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
    )
    best = F.max_by(
        F.struct("label", "confidence"),
        F.struct("confidence", "support", F.col("label") == "block", F.size("antecedent")),
    )
    return found.groupBy("tokens").agg(best.alias("best")).select("tokens", "best.*")


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(page_id, host, path, rule, verdict, confidence)`` for every page."""
    cut = stored(with_tokens(pages), "urls")
    labelled = stored(page_labels(cut, labels), "labelled")
    n, bad = totals(labelled)
    known = stored(vocabulary(labelled, n, bad), "vocabulary")
    rules = stored(rules_of(labelled, known, n), "rules")
    owned = stored(with_items(cut.select("tokens").distinct(), known), "owned")
    items = owned.select(F.col("items").alias("tokens")).distinct()
    found = judge(items, rules).withColumnRenamed("tokens", "items")
    said = owned.join(found, "items").select("tokens", "label", "confidence")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    return cut.join(said, "tokens", "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, "label", F.lit("allow")).alias("verdict"),
        F.when(verdict.isNull(), F.col("confidence")).alias("confidence"),
    )


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
