"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it; the pattern means the same to Java and to RE2.
SPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Start tags that put a break between words (fixed values).
BLOCK_TAGS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "td", "dl", "pre", "hr", "blockquote", "address"]


def tokens(text: Column) -> Column:
    """Words of a text, in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def clean_gold(text: Column) -> Column:
    """A gold text without its URL lines and without the marks that open its lines."""
    return F.regexp_replace(F.regexp_replace(text, r"(^|\n)(URL:.*)", ""), r"(^|\n)[ \t]*(<.*?>)", "\n")


#: Bullets after <l>, marks <l> <h> <p>, ruler lines and leading blanks of gold texts (fixed pattern).
_GOLD_BLOCK_MARKS = r"(?i)(?m)^\s*<l>\s*(»|\*|\d{1,2}\.\s)\s*|<(l|h|p)>\s*|^\s*(_{10,}|-{10,})\s*$|^\s*"


def clean_gold_blocks(text: Column) -> Column:
    """A gold text as the block aligner takes it: first line dropped if it is a URL line, marks removed, trimmed."""
    body = F.when(text.startswith("URL:"), F.regexp_replace(text, r"^[^\n]*\n?", "")).otherwise(text)
    return F.trim(F.regexp_replace(body, _GOLD_BLOCK_MARKS, ""))


def strip_page_header(text: Column) -> Column:
    """Drops first and last line of a page that opens with a <text id= title= encoding=> line."""
    lines = F.split(text, "\n")
    has = text.rlike(r'(?i)^<text\s[^>\n]*(id|title|encoding)=')
    return F.when(has, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(text)


def page_encoding(text: Column) -> Column:
    """The encoding that a page's header line names, lower-cased; null without one."""
    return F.lower(F.nullif(F.regexp_extract(text, r'(?i)^<text\s[^>\n]*encoding="([^"]*)"', 1), F.lit("")))


def tidy_lines(text: Column) -> Column:
    """Runs of blanks and tabs become one blank, empty lines go."""
    squeezed = F.regexp_replace(text, r"(\s{2,}|\t)", " ")
    return F.array_join(F.filter(F.split(squeezed, "\n"), lambda x: F.trim(x) != ""), "\n")


def join_strings(strings: Column, boundaries: Column) -> Column:
    """Strings trimmed and joined, with a line break before each that opens a block."""
    return F.array_join(F.zip_with(strings, boundaries, lambda s, b: F.concat(F.when(b, "\n").otherwise(""), F.trim(s))), "")


#: Unicode's space separators, which are what the SQL's trim() takes off.
_SPACES = "".join(map(chr, [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))


def sentences(text: Column) -> Column:
    """Sentences by end marks, those of Chinese and Japanese among them, without spaces around them."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?！？。]+[.!?！？。]*"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.trim(s, F.lit(_SPACES))), lambda s: s != "")


def strip_markup(html: Column) -> Column:
    """The text of a page by patterns alone: comments, scripts, styles and tags become blanks."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


#: Some frequent words of each language, for the language filter.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "for", "it", "with"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "den", "von", "zu"],
    "fr": ["le", "la", "les", "des", "et", "une", "dans", "que", "pour", "qui"],
    "es": ["el", "los", "las", "que", "una", "con", "por", "para", "del", "se"],
}


def guess_language(text: Column) -> Column:
    """The language whose frequent words occur most often; null without any of them, ties by code."""
    codes = sorted(STOP_WORDS)
    numbers: dict[str, list[int]] = {}
    for k, code in enumerate(codes):
        for w in STOP_WORDS[code]:
            numbers.setdefault(w, []).append(k)
    languages = F.create_map(*[x for w, ks in sorted(numbers.items()) for x in (F.lit(w), F.array(*map(F.lit, ks)))])
    words = F.transform(tokens(text), lambda w: F.regexp_replace(F.lower(w), r"[.,;:!?]+$", ""))

    def add(counts: Column, word: Column) -> Column:
        found = F.coalesce(F.try_element_at(languages, word), F.array().cast("array<int>"))
        return F.transform(counts, lambda n, k: n + F.array_contains(found, k).cast("int"))

    def best(counts: Column) -> Column:
        place = F.array_position(counts, F.array_max(counts)).cast("int")
        return F.when(F.array_max(counts) > 0, F.element_at(F.array(*map(F.lit, codes)), place))

    return F.aggregate(words, F.array(*[F.lit(0)] * len(codes)), add, best)


def html_slice(content: Column) -> Column:
    """From the first <!DOCTYPE (else the start) up to the first </html>, without it."""
    start = F.greatest(F.instr(content, "<!DOCTYPE"), F.lit(1))
    end = F.instr(content, "</html>")
    return F.when(end > 0, F.substring(content, start, F.greatest(end - start, F.lit(0))))


def looks_like_html(content: Column) -> Column:
    return content.rlike(r"(?is)^\s*(<!doctype html|<html|<head|<title|<body)")


#: What Windows-1252 has at 0x80 to 0x9F, with its five unused codes left as they are (fixed values).
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decode_text(content: Column) -> Column:
    """Bytes as text: UTF-8 if they are valid, else Windows-1252 where it has all their codes, else ISO-8859-1."""
    latin = F.decode(content, "ISO-8859-1")
    western = F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), _CP1252)
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(latin.rlike(r"[\x81\x8d\x8f\x90\x9d]"), latin).otherwise(western)
