"""URL filters: explicit host and path rules, and association rules mined from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

#: Fixed values: (verdict, host, path) of the query's rules.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BAD = "label=bad"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both are empty for a null URL or one without ://."""
    u = F.col(url)
    at = F.coalesce(F.instr(u, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    d = pages.drop("host", "path").withColumn("_u_rest", rest)
    d = d.withColumn("host", ascii_lower(F.regexp_extract("_u_rest", r"\A([^/?#]*)", 1)))
    return d.withColumn("path", F.regexp_extract(F.substring(F.col("_u_rest"), F.length("host") + 1, F.length("_u_rest")), r"\A([^?#]*)", 1)).drop("_u_rest")


def best_rule(rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, host length first where totals tie; null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):  # the longest ends outermost
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a URL with its parts: scheme, host labels with their place, path words, query keys, fragment.

    Digits collapse to 0, so tokens describe shapes rather than single pages.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    tag = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    labels = F.split("host", r"\.", -1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            tag("scheme=", F.array(F.regexp_extract(u, r"\A([^:/?#]*)://", 1))),
            tag("host=", F.transform(labels, lambda x: F.regexp_replace(x, r"[0-9]+", "0"))),
            tag("hostword=", F.flatten(F.transform(labels, lambda x: F.split(x, "[-_]", -1)))),
            tag("path=", F.transform(F.split("path", r"[/.]", -1), lambda x: F.regexp_replace(x, r"[0-9]+", "0"))),
            tag("key=", F.transform(F.split(query, "&", -1), lambda x: F.regexp_extract(x, r"\A([^=]*)", 1))),
            tag("fragment=", F.array(F.regexp_extract(u, r"#(.*)", 1))),
        )
    )


def mine(transactions: DataFrame, least_count: int = 20, least_confidence: float = 0.5, least_lift: float = 1.5, least_z: float = 4.0) -> DataFrame:
    """(rule_id, antecedent, confidence, support) of the rules `tokens => label=bad`, from the itemsets of Spark's FP-growth.

    transactions: an array column `items`. A rule needs `least_count` bad rows, whatever their share, `least_confidence`,
    `least_lift` over the share of bad rows, and a count of bad rows `least_z` standard deviations above what that share gives
    its rows by chance, as many itemsets are tried. It may have any number of tokens. A rule whose subset already reaches the
    confidence is pruned as redundant; all others stay. No rows give no rules.
    """
    bad = F.array_contains("items", BAD)
    n, n_bad = transactions.agg(F.count("*"), F.count(F.when(bad, 1))).first()
    base = n_bad / max(1, n)
    itemsets = FPGrowth(itemsCol="items", minSupport=min(1.0, least_count / max(1, n))).fit(transactions).freqItemsets
    named = itemsets.select(F.array_sort(F.array_remove("items", BAD)).alias("antecedent"), "freq", bad.alias("bad"))
    named = named.where("freq >= %d AND size(antecedent) > 0" % least_count).withColumn("rule_id", F.md5(F.array_join("antecedent", "\n")))
    all_rows = named.where("NOT bad").select("rule_id", F.col("freq").alias("rows"))
    r = named.where("bad").select("rule_id", "antecedent", "freq").join(all_rows, "rule_id").withColumn("confidence", F.col("freq") / F.col("rows"))
    chance = F.sqrt(base * (1 - base) * F.col("rows"))
    clear = (F.col("confidence") >= max(least_confidence, least_lift * base)) & (F.col("freq") - base * F.col("rows") >= least_z * chance)
    rest = cut(r.where(clear).select("rule_id", "antecedent", "confidence", (F.col("freq") / F.lit(max(1, n))).alias("support")))
    kept = rest.limit(0)
    # what no smaller kept rule makes redundant is kept; as many rounds as a rule has tokens at most
    while (s := rest.agg(F.min(F.size("antecedent"))).first()[0]) is not None:
        new, rest = rest.where(F.size("antecedent") == s), rest.where(F.size("antecedent") > s)
        kept = kept.unionByName(new)
        pairs = match(rest.select(F.col("rule_id").alias("_u_big"), F.col("antecedent").alias("items"), "confidence"), new, "_u_big")
        sure = pairs.join(new.select("rule_id", F.col("confidence").alias("_u_c")), "rule_id").groupBy("_u_big").agg(F.max("_u_c").alias("_u_c"))
        rest = rest.join(sure, F.col("rule_id") == F.col("_u_big"), "left").where(F.col("_u_c").isNull() | (F.col("_u_c") < F.col("confidence")))
        rest = cut(rest.select("rule_id", "antecedent", "confidence", "support"))
    return kept


def match(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, rule_id): rules all of whose tokens a page has. pages: key and `items`; a null key matches nothing.

    Inverted index: each rule is listed under its rarest token only (by the pages' own counts), so a token that nearly
    every URL holds brings no candidates unless a rule has nothing rarer. Only pages under a listed token bring their items.
    """
    posted = pages.select(key, F.explode("items").alias("token"))
    wanted = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
    counts = posted.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    listed = wanted.join(counts, "token", "left").groupBy("rule_id", "antecedent").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    under = posted.join(listed, "token").select(key, "rule_id", "antecedent")
    alone = under.where(F.size("antecedent") == 1).select(key, "rule_id")
    several = under.where(F.size("antecedent") > 1).join(pages.select(key, "items"), key)
    return alone.unionByName(several.where(F.size(F.array_except("antecedent", "items")) == 0).select(key, "rule_id")).where(F.col(key).isNotNull()).distinct()


def url_filters(pages: DataFrame, labels: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", **mining) -> DataFrame:
    """(key, host, path, rule, verdict, n_mined) for every row of pages; n_mined counts the mined rules that match.

    labels: (key, bad boolean) of some pages; rows with a null in either are not learnt from. Explicit rules decide where
    one fits; elsewhere a page that any mined rule matches is blocked and the rest are allowed. Null and malformed URLs
    have empty parts and no tokens. Rows that repeat a key are judged one by one, but share the mined rules that any of them
    matches; a null key has none. Extra columns are ignored.
    """
    d = with_parts(pages.select(key, url), url)
    items = d.select(key, tokens(url).alias("items"))
    known = labels.select(F.col(key).alias("_u_key"), "bad").where(F.col("bad").isNotNull()).groupBy("_u_key").agg(F.max("bad").alias("bad"))
    baskets = items.join(known, F.col(key) == F.col("_u_key")).select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    hits = match(items, mine(baskets, **mining), key).groupBy(F.col(key).alias("_u_hit")).agg(F.count("*").alias("n_mined"))
    d = d.join(hits, F.col(key) == F.col("_u_hit"), "left").withColumn("_u_rule", best_rule(rules))
    mined = F.coalesce("n_mined", F.lit(0).cast("long"))
    return d.select(key, "host", "path", F.col("_u_rule.rule").alias("rule"), F.coalesce("_u_rule.verdict", F.when(mined > 0, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), mined.alias("n_mined"))


def query(spark, sf_dir: str) -> DataFrame:
    """A labelled page is the document of the same number; either fault (low quality or toxic) makes it bad."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filters(table(spark, sf_dir, "pages"), labels)
