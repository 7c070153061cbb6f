"""Crawl-index operators: parse, filter, dedupe, group and choose URLs; match them with fetched pages."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.plans.lineage import rank_rows, running_sum


def parse_index(lines: DataFrame, max_pages: int | None = None) -> DataFrame:
    """lines (file, line_no, value) to well-formed text/html records; of a file at most the first `max_pages`."""
    record = urls.cdx_record(F.col("value"))
    rows = lines.select("file", "line_no", record.alias("r")).where(urls.has_all_keys(F.col("r"))).where("r.mime = 'text/html'")
    if max_pages is not None:
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where(F.col("n") <= max_pages).drop("n")
    return rows.select("file", "line_no", "r.*")


def with_url_parts(df: DataFrame, url: str = "url", long_suffixes: list[str] = urls.LONG_SUFFIXES) -> DataFrame:
    sub, domain, tld = urls.split_host(F.col("_host"), long_suffixes)
    out = df.withColumn("_host", urls.host(F.col(url))).withColumns({"subdomain": sub, "domain": domain, "tld": tld, "path": urls.path(F.col(url))}).drop("_host")
    out = out.where(F.col("domain").isNotNull() & F.col("tld").isNotNull() & F.col("path").isNotNull())
    return out.withColumn("cleaned_url", urls.cleaned_url(F.col("subdomain"), F.col("domain"), F.col("tld"), F.col("path"))).withColumn("digest", F.md5("cleaned_url"))


def rule_flags(length: Column, rules: urls.CrawlRules = urls.CrawlRules()) -> dict[str, Column]:
    """The local filter's rules by name, over the columns of with_url_parts."""
    sub, domain, where = F.col("subdomain"), F.col("domain"), F.col("path")
    return {
        "is_html": urls.is_html_path(where),
        "is_long": urls.is_long(length, rules),
        "is_kept_tld": urls.is_kept_tld(F.col("tld")),
        "has_no_country": urls.has_no_country(where),
        "is_short_domain": urls.is_short_name(domain, rules),
        "has_no_dash": urls.has_no_dash(domain),
        "is_short_sub": urls.is_short_name(sub, rules),
    }


def local_filter(df: DataFrame, length: Column, rules: urls.CrawlRules = urls.CrawlRules(), skip: tuple[str, ...] = ()) -> DataFrame:
    keep = F.lit(True)
    for name, flag in rule_flags(length, rules).items():
        if name not in skip:
            keep = keep & flag
    return df.where(keep)


def first_seen(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each cleaned_url. The order columns are aggregated, so copies meet after the map side."""
    first = df.groupBy("cleaned_url").agg(F.min(F.struct(*order)).alias("_first"))
    keys = [F.col(f"_first.{c}").alias(c) for c in order]
    return df.join(first.select("cleaned_url", *keys), ["cleaned_url", *order], "left_semi").dropDuplicates(["cleaned_url"])


def site_paths(df: DataFrame, order: str) -> DataFrame:
    """Distinct (domain, subdomain, path) with the first place each was seen at."""
    return df.groupBy("domain", "subdomain", "path").agg(F.min(order).alias("first_seen"))


def top_subdomains(paths: DataFrame, rules: urls.CrawlRules = urls.CrawlRules()) -> DataFrame:
    """Per domain the first subdomains, in order of first sight, that have more than `min_paths` paths."""
    subs = paths.groupBy("domain", "subdomain").agg(F.count("*").alias("n_paths"), F.min("first_seen").alias("first_seen")).where(F.col("n_paths") > rules.min_paths)
    w = Window.partitionBy("domain").orderBy("first_seen", "subdomain")
    return subs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= rules.max_subdomains)


def _choose(paths: list[str], strict: bool) -> list[str]:
    """Two pages of one directory if there are such, else the two deepest paths."""
    ordered = sorted(paths, key=lambda p: (p.count("/"), p), reverse=True)

    def directory(p: str) -> str:
        last = p.rsplit("/", 1)[-1]
        return p.replace(last, "") if strict and last else p[: len(p) - len(last)]

    folders = [directory(p) for p in ordered]
    alone: set[str] = set()  # directories that are in no other path
    for i, folder in enumerate(folders):
        if folder in alone:
            continue
        if sum(1 for _ in itertools.islice((p for p in ordered if folder in p), 2)) < 2:
            alone.add(folder)
        else:
            same = sorted(p.rsplit("/", 1)[-1] for p, f in zip(ordered[i:], folders[i:]) if f == folder)
            if len(same) >= 2:
                return [folder + x for x in same[:2]]
            break
    return ordered[:2]


def path_pairs(paths: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Two paths of each site (domain, non-empty subdomain). One task holds the paths of one site."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _choose(pdf.path.tolist(), strict_reference)
        return pd.DataFrame({"domain": pdf.domain.iloc[0], "subdomain": pdf.subdomain.iloc[0], "path": found})

    rows = paths.where("subdomain <> ''").select("domain", "subdomain", "path").distinct()
    return rows.groupBy("domain", "subdomain").applyInPandas(choose, "domain string, subdomain string, path string")


def manifest(pairs: DataFrame, seen: DataFrame, index_file: str) -> DataFrame:
    """Chosen paths looked up among seen URLs: cleaned_url, digest, address, grp."""
    name = urls.group_name(F.col("subdomain"), F.col("domain"), F.col("tld"), F.lit(index_file))
    rows = seen.join(pairs, ["domain", "subdomain", "path"], "left_semi")
    address = F.concat(urls.byte_range(F.col("offset"), F.col("length")), F.lit(" https://data.example.org/"), F.col("filename"))
    return rows.select("cleaned_url", "digest", address.alias("address"), name.alias("grp"))


def not_yet_fetched(wanted: DataFrame, have: DataFrame, key: str = "digest") -> DataFrame:
    return wanted.join(have.select(key), key, "left_anti")


def already_fetched(wanted: DataFrame, have: DataFrame, key: str = "digest") -> DataFrame:
    return wanted.join(have.select(key), key, "left_semi")


def group_gate(pages: DataFrame, group: list[str], least: int = 2) -> DataFrame:
    """Rows of groups with at least `least` rows; the count is aggregated, so a hot group does not gather."""
    sizes = pages.groupBy(*group).agg(F.count("*").alias("n_in_group")).where(F.col("n_in_group") >= least)
    return pages.join(sizes, group)


def pick_groups(groups: DataFrame, max_groups: int, seed: int = 0) -> DataFrame:
    """groups (grp, n): groups in hashed order until half their pages reach max_groups."""
    rows = running_sum(groups, [F.md5(F.concat(F.lit(f"{seed}:"), "grp")), F.col("grp")], F.col("n"))
    return rows.where(F.floor(F.col("before") / 2) < max_groups).drop("before")


def task_slices(df: DataFrame, order: str, tasks: int) -> DataFrame:
    """A 1-based slice number for equal runs in order: row r (from 0) of n belongs to slice floor(r * tasks / n) + 1."""
    ranked = rank_rows(df, [F.col(order)], "r")
    return ranked.withColumn("slice", (F.floor(F.col("r") * tasks / F.lit(df.count())) + 1).cast("int")).drop("r")
