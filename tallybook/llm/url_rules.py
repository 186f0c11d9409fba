"""URL filters by association rules: listed rules first, then rules that FP-growth mines from labelled URLs.

A URL is a set of tokens: host labels, path segments and names of query parameters. The labelled URLs, here those that a
listed rule decides, are mined with Spark's FP-growth, the label being one more item. A frequent set with a label becomes
a rule tokens -> label if it holds for ``min_count`` URLs and the lower end of the Wilson interval of its confidence
reaches ``min_confidence``; both mean the same for a small host and a large one, and for a small table and a large one.
For matching, every rule stands in an inverted index under its rarest item; a URL meets only the rules under its own
items and fits those all of whose items it has. The rule of the highest bound decides, then the most URLs, then ``block``
before ``allow`` (the greater label), then the name; a URL that no rule fits is allowed.

Tokens that occur in the very same labelled URLs are one item, so parameters that always come together do not double
the frequent sets. Nothing is lost: rules on any of them have equal counts, and a URL with any of them has the item. What
is rarer than ``min_count`` cannot be in a rule and is left out by its count, ids included, whatever they look like.
Beyond that the frequent sets are as many as the URLs have: tokens that occur together often, but not always, multiply them.

Matching runs on distinct token sets: a host with a third of all rows is a few sets. FP-growth keeps the list of frequent
items on the driver: at most the tokens of all labelled URLs divided by ``min_count``, so raise it with the number of
labelled URLs if their hosts are very many. Only built-in functions are used.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no tokens; an empty token set is allowed;
rows that repeat get the same verdict; without labelled URLs there are no mined rules; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.sources.scratch import stored_once

MIN_COUNT = 20
MIN_CONFIDENCE = 0.6
#: Normal quantile of the confidence bound.
Z = 1.96
LABEL = "label:"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> Column:
    """Struct of host (A-Z in lower case), path and query of a URL."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    form = r"^([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    piece = lambda i: F.regexp_extract(rest, form, i)
    return F.struct(F.translate(piece(1), _UPPER, _LOWER).alias("host"), piece(2).alias("path"), piece(3).alias("query"))


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens in order."""
    some = lambda texts, mark: F.transform(
        F.filter(texts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x)
    )
    names = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    return F.array_sort(
        F.array_distinct(F.concat(some(F.split(host, "[.]"), "host:"), some(F.split(path, "/"), "path:"), some(names, "query:")))
    )


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct of the longest listed rule that fits, as ``rule`` and ``verdict``; both null if none fits."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if out is None else out


def set_key(tokens: Column) -> Column:
    return F.md5(F.to_json(tokens))


def token_items(labelled: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(token, item, members, freq) of the frequent tokens: tokens of the same labelled URLs share an item, the least of them.

    Sets of URLs are compared by their size and two 64-bit sums (exclusive or) of the codes of their distinct token sets.
    """
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("n"))
    held = sets.select("n", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"), F.explode("tokens").alias("token"))
    found = held.groupBy("token").agg(F.sum("n").alias("freq"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    same = found.where(F.col("freq") >= min_count).groupBy("freq", "a", "b").agg(F.sort_array(F.collect_list("token")).alias("members"))
    return same.select(F.explode("members").alias("token"), F.col("members")[0].alias("item"), "members", "freq")


def itemised(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(set_key, items) of the distinct token sets (set_key, tokens) that have an item."""
    pairs = sets.select("set_key", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token")
    return pairs.groupBy("set_key").agg(F.sort_array(F.collect_set("item")).alias("items"))


def bound(held: Column, n: Column, z: float = Z) -> Column:
    """Lower end of the Wilson interval of ``held`` of ``n``."""
    p = held / n
    root = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (p + z * z / (2 * n) - z * root) / (1 + z * z / n)


def mined_rules(
    labelled: DataFrame, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, z: float = Z, items: DataFrame | None = None
) -> DataFrame:
    """(rule, antecedent, label, held, confidence, bound, anchor) from (tokens, label); the antecedent is an array of items."""
    labelled = labelled.where(F.size("tokens") > 0).withColumn("set_key", set_key(F.col("tokens")))
    items = stored_once(token_items(labelled, min_count), "url-items") if items is None else items
    sets = itemised(labelled.groupBy("set_key").agg(F.first("tokens").alias("tokens")), items)
    marked = labelled.join(sets, "set_key").select(F.array_append("items", F.concat(F.lit(LABEL), "label")).alias("items"))
    rows = stored_once(marked, "url-baskets")
    total = rows.count()
    # The half keeps a share of the rows from being rounded up to one more than the count.
    share = (min_count - 0.5) / total if total >= min_count else 1.0
    found = FPGrowth(itemsCol="items", minSupport=share).fit(rows if total >= min_count else rows.limit(0)).freqItemsets
    is_label = lambda x: x.startswith(LABEL)
    frequent = stored_once(
        found.select(
            F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("antecedent"),
            F.filter("items", is_label).alias("labels"),
            "freq",
        ).where(F.size("antecedent") > 0),
        "url-frequent",
    )
    alone = frequent.where(F.size("labels") == 0).select("antecedent", F.col("freq").alias("n"))
    named = frequent.where(F.size("labels") == 1).select(
        "antecedent", F.substring(F.col("labels")[0], len(LABEL) + 1, 1000).alias("label"), F.col("freq").alias("held")
    )
    rules = (
        named.join(alone, "antecedent")
        .withColumn("confidence", F.col("held") / F.col("n"))
        .withColumn("bound", bound(F.col("held"), F.col("n"), z))
        .where(F.col("bound") >= min_confidence)
    )
    groups = items.where(F.col("token") == F.col("item")).select("item", "freq", F.array_join("members", "|").alias("name"))
    index = (
        rules.select("antecedent", F.explode("antecedent").alias("item"))
        .distinct()
        .join(groups, "item")
        .groupBy("antecedent")
        .agg(
            F.min(F.struct("freq", "item"))["item"].alias("anchor"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item", "name"))), lambda x: x["name"]), " ").alias("rule"),
        )
    )
    return rules.join(index, "antecedent").select("rule", "antecedent", "label", "held", "confidence", "bound", "anchor")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set_key, label, mined_rule, confidence) of the best rule for each (set_key, items) that some rule fits."""
    best = F.max(F.struct("bound", "held", "label", "rule", "confidence")).alias("best")
    return (
        sets.select("set_key", "items", F.explode("items").alias("anchor"))
        .join(rules, "anchor")
        .where(F.size(F.array_except("antecedent", "items")) == 0)
        .groupBy("set_key")
        .agg(best)
        .select("set_key", "best.label", F.col("best.rule").alias("mined_rule"), "best.confidence")
    )


def judged(
    pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url",
    min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, z: float = Z,
) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, mined_rule, confidence."""
    cut = pages.select(F.col(key).alias("page_id"), parts(F.col(url)).alias("u"))
    found = cut.select(
        "page_id", "u.host", "u.path",
        listed_rule(F.col("u.host"), F.col("u.path"), rules).alias("listed"),
        tokens(F.col("u.host"), F.col("u.path"), F.col("u.query")).alias("tokens"),
    ).withColumn("set_key", set_key(F.col("tokens")))
    stored = stored_once(found, "url-tokens")
    labelled = stored.where(F.col("listed").isNotNull() & (F.size("tokens") > 0)).select("tokens", F.col("listed.verdict").alias("label"))
    items = stored_once(token_items(labelled, min_count), "url-items")
    mined = stored_once(mined_rules(labelled, min_count, min_confidence, z, items), "url-mined")
    open_ = stored.where(F.col("listed").isNull() & (F.size("tokens") > 0))
    sets = itemised(open_.groupBy("set_key").agg(F.first("tokens").alias("tokens")), items)
    out = stored.join(matched(sets, mined), "set_key", "left")
    mine = lambda c: F.when(F.col("listed").isNull(), F.col(c)).alias(c)
    return out.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "label", F.lit("allow")).alias("verdict"), mine("mined_rule"), mine("confidence"),
    )
