"""URL and crawl-index functions as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.types as T
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that a crawl-index line must have (fixed values).
CDX_KEYS = ["status", "url", "filename", "length", "mime", "offset", "digest"]
#: Top-level domains that a crawl keeps (fixed values).
KEPT_TLDS = ["edu", "org", "com"]
#: Country codes that, as a path segment, mark a translated page (fixed values).
COUNTRY_CODES = (
    "ac as at bd bg br ch cl cn de dk ee es eu fi fr gr gt hk ht hu id ie il in ir is it jp kr li lk lt lu lv my no nu "
    "pe pl pm pw re ro rs se sh si su tf th tm tn to tr tw vn wf ws yt nz be ca sa"
).split()
#: Public suffixes of more than one label; others are the last label. A parameter wherever it is used.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.za"]


@dataclass(frozen=True)
class CrawlRules:
    min_length: int = 5000
    max_name: int = 10
    min_content: int = 10_000
    max_subdomains: int = 4
    min_paths: int = 2


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(found, r"^[^@]*@", ""), r":\d+$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def suffix(name: Column, long_suffixes: list[str] = LONG_SUFFIXES) -> Column:
    out = F.substring_index(name, ".", -1)
    for labels in sorted({s.count(".") + 1 for s in long_suffixes}):
        end = F.substring_index(name, ".", -labels)
        out = F.when(end.isin([s for s in long_suffixes if s.count(".") + 1 == labels]) & (end != name), end).otherwise(out)
    return out


def split_host(name: Column, long_suffixes: list[str] = LONG_SUFFIXES) -> tuple[Column, Column, Column]:
    """(subdomain, domain, tld); the subdomain may be empty."""
    tld = suffix(name, long_suffixes)
    rest = F.substring(name, F.lit(1), F.greatest(F.length(name) - F.length(tld) - 1, F.lit(0)))
    domain = F.element_at(F.split(rest, r"\."), -1)
    sub = F.substring(rest, F.lit(1), F.greatest(F.length(rest) - F.length(domain) - 1, F.lit(0)))
    return sub, domain, tld


def cleaned_url(sub: Column, domain: Column, tld: Column, where: Column) -> Column:
    return F.concat(sub, F.lit("."), domain, F.lit("."), tld, where)


def group_name(sub: Column, domain: Column, tld: Column, index_file: Column) -> Column:
    """Site, year and index name of an index file .../<a>-<b>-<year>-<c>/<dir>/<name>.gz."""
    year = F.regexp_extract(index_file, r"([^/]*)/[^/]*/[^/]*$", 1)
    year = F.element_at(F.split(year, "-"), 3)
    name = F.regexp_replace(F.regexp_extract(index_file, r"([^/]*)$", 1), r"\.gz$", "")
    return F.concat(sub, F.lit("."), domain, F.lit("."), tld, F.lit("_"), year, F.lit("_"), name)


def archive_format(year: Column) -> Column:
    return F.when(year.cast("int") <= 2012, "ARC").otherwise("WARC")


def byte_range(offset: Column, length: Column) -> Column:
    start = offset.try_cast("bigint")
    return F.concat(start.cast("string"), F.lit("-"), (start + length.try_cast("bigint") - 1).cast("string"))


def group_of_id(page: Column) -> Column:
    """An id without what follows its last underscore; the underscore stays."""
    return F.regexp_replace(page, r"[^_]+$", "")


def is_html_path(where: Column) -> Column:
    return (F.right(where, F.lit(4)) == "html") | (F.right(where, F.lit(3)) == "htm")


def is_long(length: Column, rules: CrawlRules = CrawlRules()) -> Column:
    return F.coalesce(length.try_cast("bigint") > rules.min_length, F.lit(False))


def is_kept_tld(tld: Column) -> Column:
    return tld.isin(KEPT_TLDS)


def is_short_name(name: Column, rules: CrawlRules = CrawlRules()) -> Column:
    return F.length(name) < rules.max_name


def has_no_dash(name: Column) -> Column:
    return F.instr(name, "-") == 0


def has_no_comma(where: Column) -> Column:
    return F.instr(where, ",") == 0


def has_no_country(where: Column) -> Column:
    segments = F.transform(F.split(where, "/"), F.lower)
    return ~F.arrays_overlap(segments, F.array(*map(F.lit, COUNTRY_CODES)))


CDX_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in CDX_KEYS])


def cdx_record(line: Column) -> Column:
    """The JSON record that ends a crawl-index line; null fields where it is malformed."""
    return F.from_json(F.regexp_extract(line, r"(\{[^{}]*\})\s*$", 1), CDX_SCHEMA, {"mode": "PERMISSIVE"})


def has_all_keys(record: Column) -> Column:
    out = F.lit(True)
    for k in CDX_KEYS:
        out = out & record[k].isNotNull()
    return F.coalesce(record.isNotNull() & out, F.lit(False))
