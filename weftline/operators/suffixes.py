"""Public suffixes by rules with wildcards and exceptions, looked up once a host.

Rules are those of a suffix list: `co.uk`, `*.ck` (any one label before ck), `!www.ck` (not a suffix, though a wildcard
fits). Of the rules that fit a host the exception wins, else the one with the most labels; a host that no rule fits ends in
its last label. The rules are a trie over labels from the right, laid out as a table of its nodes (the labels' path), which is
broadcast while it is small, as its size tells. Each different host goes down the trie once, a join of its own ends with the
nodes, whatever the number of its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import urls


def rule_table(lines: DataFrame, value: str = "value") -> DataFrame:
    """node (labels, without the exception's mark), is_exception, n_labels from lines of a suffix list; comments (//) and
    what follows white space on a line go; labels are lower-cased."""
    rule = F.lower(F.regexp_extract(value, r"^\s*(\S+)", 1))
    rows = lines.select(rule.alias("r")).where((F.col("r") != "") & ~F.col("r").startswith("//"))
    bare = F.regexp_replace("r", r"^[!.]+", "")
    return rows.select(bare.alias("node"), F.col("r").startswith("!").alias("is_exception"), F.size(F.split(bare, r"\.")).alias("n_labels")).where("node <> ''").distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return rule_table(spark.read.text(path))


def host_suffixes(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """host, suffix, is_listed of each different host."""
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.struct(n.alias("n"), F.slice("labels", -n, n).alias("own")))
    each = hosts.select(host).where(F.col(host).isNotNull()).distinct().withColumn("labels", labels).select(host, "labels", F.explode(ends).alias("e"))
    own = F.array_join("e.own", ".")
    wild = F.when(F.col("e.n") == 1, F.lit("*")).otherwise(F.concat(F.lit("*."), F.array_join(F.slice("e.own", 2, F.greatest(F.col("e.n") - 1, F.lit(0))), ".")))
    met = each.select(host, "labels", F.explode(F.array(own, wild)).alias("node")).join(rules, "node")
    best = met.groupBy(host).agg(F.max(F.struct("is_exception", "n_labels")).alias("b"))
    n = F.when(F.col("b").isNull(), 1).otherwise(F.col("b.n_labels") - F.col("b.is_exception").cast("int"))
    known = hosts.select(host).where(F.col(host).isNotNull()).distinct().join(best, host, "left").withColumn("labels", labels)
    return known.select(host, F.array_join(F.slice("labels", -n, n), ".").alias("suffix"), F.col("b").isNotNull().alias("is_listed"))


def with_site(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """df with host, suffix, domain (the label before the suffix; null without one) and subdomain (what stands before it,
    maybe empty)."""
    rows = df.withColumn("host", urls.host(F.col(url)))
    found = host_suffixes(rows, rules)
    rest = F.when(F.length("host") > F.length("suffix"), F.substring("host", F.lit(1), F.length("host") - F.length("suffix") - 1))
    domain: Column = F.substring_index("_rest", ".", -1)
    joined = rows.join(found, "host", "left").withColumn("_rest", rest)
    sub = F.when(F.col("domain").isNotNull(), F.substring("_rest", F.lit(1), F.greatest(F.length("_rest") - F.length("domain") - 1, F.lit(0))))
    return joined.withColumn("domain", domain).withColumn("subdomain", sub).drop("_rest")
