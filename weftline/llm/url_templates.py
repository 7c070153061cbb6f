"""URL filters: listed rules first, then a tree of path templates per host.

Paths are cut at '/'. Digit runs become {n} at once. Level by level, below each (host, template so far),
a segment stays a branch of its own only if it has `min_pages` and its labelled pages differ from those of its
siblings (a two-proportion test); all other branches merge into the wildcard *. Levels go on as long as some host has
`min_pages` pages there, so a single long path costs no round; wildcards that end a path beyond the first `levels`
segments are written as one **. A template's purity is its share of good labelled pages, smoothed towards the share of all. It
is rejected where the purity is under `min_purity`, or `deviations` standard errors and more under the share of all. All steps run on one row a (host, path shape), counted by a
pre-aggregation; pages without a key never meet the labels. Pages get their templates back by a broadcast of the hot
shapes, fewer than 1,000 by definition, and a join with the others. So neither a hot host nor a hot path is a hot key.

Defined cases: a null URL, or one without ://, has empty host and path and is judged as such a template; an
empty segment ends a path; pages without a label count as support alone; repeated pages count once each;
an empty table gives an empty result; a very long path has as many levels as segments. Only the named columns are
read, so others may have any name. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


#: A path shape with more than one page in so many is hot; there are fewer hot shapes than this.
_HOT = 1000


@dataclass(frozen=True)
class TemplateParams:
    levels: int = 4
    min_pages: int = 5
    chi_square: float = 3.84
    smoothing: float = 10.0
    min_purity: float = 0.5
    deviations: float = 1.28  # a one-sided confidence of nine tenths


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host + path, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, kind in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _deepest(shapes: DataFrame, p: TemplateParams) -> int:
    """The last level at which some host has `min_pages` pages and two labelled ones with a segment there: below it no
    branch can be one of its own, however long the path."""
    cut = shapes.withColumn("depth", F.length("shape") - F.length(F.replace("shape", F.lit("/"), F.lit(""))))
    by_depth = cut.groupBy("host", "depth").agg(F.sum("n").alias("n"), F.sum("n_lab").alias("n_lab"))
    deeper = Window.partitionBy("host").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row a depth
    reached = by_depth.select("depth", F.sum("n").over(deeper).alias("n"), F.sum("n_lab").over(deeper).alias("n_lab"))
    return reached.where((F.col("n") >= p.min_pages) & (F.col("n_lab") > 1)).agg(F.max("depth")).first()[0] or 0


def templates(shapes: DataFrame, p: TemplateParams) -> DataFrame:
    """shapes (host, shape, n, n_lab, n_bad) with the template of each."""
    grown = shapes.withColumn("template", F.lit("")).withColumn("head", F.lit(""))
    depth = _deepest(shapes, p)
    for k in range(1, depth + 1):
        grown = grown.withColumn("seg", F.split_part("shape", F.lit("/"), F.lit(k + 1)))
        child = grown.where("seg <> ''").groupBy("host", "template", "seg").agg(*(F.sum(c).alias(c) for c in ("n", "n_lab", "n_bad")))
        parent = child.groupBy("host", "template").agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "n_lab", "n_bad")))
        rest_lab, rest_bad = F.col("all_n_lab") - F.col("n_lab"), F.col("all_n_bad") - F.col("n_bad")
        enough = (F.col("n") >= p.min_pages) & (F.col("n_lab") > 0) & (rest_lab > 0)
        share = F.col("all_n_bad") / F.nullif("all_n_lab", F.lit(0))
        gap = F.col("n_bad") / F.nullif("n_lab", F.lit(0)) - rest_bad / F.nullif(rest_lab, F.lit(0))
        differs = gap * gap > p.chi_square * share * (1 - share) * (F.lit(1.0) / F.nullif("n_lab", F.lit(0)) + F.lit(1.0) / F.nullif(rest_lab, F.lit(0)))
        own = child.join(parent, ["host", "template"]).where(enough & differs).select(F.col("host").alias("_host"), F.col("template").alias("_template"), F.col("seg").alias("_seg"))
        grown = grown.join(own, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")) & (F.col("seg") == F.col("_seg")), "left")
        step = F.when(F.col("seg") == "", "").when(F.col("_seg").isNotNull(), F.concat(F.lit("/"), F.col("seg"))).otherwise("/*")
        grown = grown.withColumn("template", F.concat("template", step)).drop("_host", "_template", "_seg", "seg")
        if k <= p.levels:
            grown = grown.withColumn("head", F.col("template"))
        grown = checkpoint(grown)  # one row a path shape; else each level would repeat all those above it

    def wild(first: int, last: int | None) -> Column:
        """A wildcard for each segment of these levels that is not empty."""
        segments = F.split("shape", "/")
        there = F.slice(segments, first + 1, F.greatest(F.size(segments) - first, F.lit(0)) if last is None else F.lit(last - first + 1))
        return F.expr("repeat('/*', 0)") if last is not None and last < first else F.repeat(F.lit("/*"), F.size(F.filter(there, lambda x: x != "")))

    grown = grown.withColumn("template", F.concat("template", wild(depth + 1, max(depth, p.levels))))
    grown = grown.withColumn("head", F.col("template") if depth < p.levels else F.col("head")).withColumn("template", F.concat("template", wild(max(depth, p.levels) + 1, None)))
    tail = F.regexp_replace(F.substring("template", F.length("head") + 1, F.length("template")), r"(/\*)+$", "/**")
    return grown.withColumn("template", F.concat("head", tail)).drop("head")


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, p: TemplateParams = TemplateParams(), id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id_column, host, path, rule, verdict, template. labels: `_key` and `bad` (boolean), joined on the
    key that `pages` has as `_key`."""
    url = F.col(url_column)
    rows = pages.select(id_column, "_key", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("shape", F.regexp_replace("path", "[0-9]+", "{n}"))
    counted = rows.groupBy("host", "shape").agg(F.count("*").alias("n"))
    keyed = rows.where("_key is not null").groupBy("host", "shape", "_key").agg(F.count("*").alias("k"))
    marked = keyed.join(labels.groupBy("_key").agg(F.max("bad").alias("bad")).where("bad is not null"), "_key")
    known = marked.groupBy("host", "shape").agg(F.sum("k").alias("n_lab"), F.sum(F.when(F.col("bad"), F.col("k")).otherwise(0)).alias("n_bad"))
    shapes = counted.join(known, ["host", "shape"], "left").select("host", "shape", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lab", "n_bad")))
    found = templates(checkpoint(shapes), p)
    by_template = found.groupBy("host", "template").agg(F.sum("n_lab").alias("n_lab"), F.sum("n_bad").alias("n_bad"))
    total = found.agg(F.sum("n_lab").alias("all_lab"), F.sum("n_bad").alias("all_bad"))
    prior = F.coalesce((F.col("all_lab") - F.col("all_bad")) / F.nullif("all_lab", F.lit(0)), F.lit(1.0))
    purity = (F.col("n_lab") - F.col("n_bad") + p.smoothing * prior) / (F.col("n_lab") + p.smoothing)
    error = F.sqrt(prior * (1 - prior) / (F.col("n_lab") + p.smoothing))
    bad = (purity < p.min_purity) | (prior - purity >= p.deviations * error) & (purity < prior)
    judged = by_template.join(F.broadcast(total)).select("host", "template", F.when(bad, "block").otherwise("allow").alias("own"))  # `total` is one row
    map_ = checkpoint(found.select("host", "shape", "template", "n").join(judged, ["host", "template"]))
    n_pages = map_.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * _HOT > n_pages
    hot, rest = (map_.where(c).select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), "template", "own") for c in (is_hot, ~is_hot))
    same = (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape"))
    usual = rows.join(F.broadcast(hot), same, "left_anti").join(rest, same)
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    return rows.join(F.broadcast(hot), same).unionByName(usual).select(id_column, "host", "path", rule.alias("rule"), F.coalesce(verdict, "own").alias("verdict"), "template")


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.expr("try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z][a-z]/([0-9]+)', 1), '') as bigint)").alias("_key"))
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("_key"), F.expr("quality = 0 or toxic = 1").alias("bad"))
    return url_filter(pages, labels)


def _oracle(p: TemplateParams = TemplateParams(), rules: list[tuple[str, str, str]] = RULES) -> str:
    """For tables whose paths have up to `levels` segments; a longer one is an error here, not another answer."""
    cases = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{s}')" for h, s, _ in cases]
    rule = "case " + " ".join(f"when {f} then '{h}{s}'" for f, (h, s, _) in zip(fits, cases)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{k}'" for f, (_, _, k) in zip(fits, cases)) + " end"
    sql = f"""
with cut as (
  select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path,
    try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z][a-z]/([0-9]+)', 1), '') as bigint) as k
  from pages),
shaped as (select *, case when length(path) - length(replace(path, '/', '')) > {p.levels} then error('path with more than {p.levels} slashes')
    else regexp_replace(path, '[0-9]+', '{{n}}', 'g') end as shape from cut),
lab as (select doc_id, bool_or(quality = 0 or toxic = 1) as bad from labels group by doc_id),
g0 as (select host, shape, count(*) as n, count(bad) as n_lab, count(case when bad then 1 end) as n_bad, '' as template
  from shaped left join lab on k = doc_id group by host, shape)"""
    for k in range(1, p.levels + 1):
        sql += f""",
s{k} as (select *, split_part(shape, '/', {k + 1}) as seg from g{k - 1}),
c{k} as (select host, template, seg, sum(n) as n, sum(n_lab) as n_lab, sum(n_bad) as n_bad from s{k} where seg <> '' group by all),
o{k} as (select host, template, seg from (select *, sum(n_lab) over w as al, sum(n_bad) over w as ab from c{k} window w as (partition by host, template))
  where n >= {p.min_pages} and n_lab > 0 and al - n_lab > 0
    and (n_bad::double / nullif(n_lab, 0) - (ab - n_bad)::double / nullif(al - n_lab, 0)) ** 2
      > {p.chi_square} * (ab::double / nullif(al, 0)) * (1 - ab::double / nullif(al, 0)) * (1.0::double / nullif(n_lab, 0) + 1.0::double / nullif(al - n_lab, 0))),
g{k} as (select s.host, s.shape, s.n, s.n_lab, s.n_bad,
    s.template || case when s.seg = '' then '' when o.seg is not null then '/' || s.seg else '/*' end as template
  from s{k} s left join o{k} o on s.host = o.host and s.template = o.template and s.seg = o.seg)"""
    return (
        sql
        + f""",
g as (select host, shape, n_lab, n_bad, template from g{p.levels}),
t as (select coalesce((sum(n_lab) - sum(n_bad))::double / nullif(sum(n_lab), 0), 1.0) as prior from g),
b as (select host, template, sum(n_lab) as n_lab, any_value(prior) as prior, (sum(n_lab) - sum(n_bad) + {p.smoothing} * any_value(prior)) / (sum(n_lab) + {p.smoothing}) as purity from g, t group by host, template),
j as (select host, template, case when purity < {p.min_purity} or prior - purity >= {p.deviations} * sqrt(prior * (1 - prior) / (n_lab + {p.smoothing})) and purity < prior then 'block' else 'allow' end as own from b)
select page_id, host, path, {rule} as rule, coalesce({verdict}, own) as verdict, template
from shaped join g using (host, shape) join j using (host, template)"""
    )


ORACLE = _oracle()
