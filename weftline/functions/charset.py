"""Encodings of byte strings, told by their marks, declarations, automata and byte statistics.

In this order: a byte-order mark; escape sequences of ISO-2022-JP; zero bytes at every second place (UTF-16 without a
mark); valid UTF-8 with a byte beyond ASCII, or ASCII alone; an encoding that the bytes declare (XML, meta, or a page's
header line), if the bytes are valid in it; then the multi-byte encodings whose automaton accepts all bytes, rated by how
many of their characters lie in the frequent rows of that encoding; then the single-byte ones, rated by their letters'
frequencies and how letters and case follow each other. A cut-off character at the end of a sample is no error.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-order marks (fixed values), longer ones first.
MARKS = [(b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
_DECLARED = re.compile(rb"""(?:<\?xml[^>]{0,100}?encoding\s*=\s*["']?|<meta[^>]{0,200}?charset\s*=\s*["']?|<text\s[^>\n]{0,200}?encoding\s*=\s*["']?)([A-Za-z0-9_:.-]{2,40})""", re.I)
_JIS = re.compile(rb"\x1b(?:\$[@B]|\([BJ])")


@dataclass(frozen=True)
class MultiByte:
    """lead and trail: classes of bytes of a two-byte character; single: bytes beyond ASCII that stand alone; common: rows of
    lead bytes that hold the frequent characters; longer: whether a lead byte may open a four-byte character."""

    name: str
    lead: tuple[tuple[int, int], ...]
    trail: tuple[tuple[int, int], ...]
    common: tuple[tuple[int, int], ...]
    single: tuple[tuple[int, int], ...] = ()
    longer: bool = False


#: Byte classes of the encodings, and their rows of frequent characters (fixed values).
MULTI_BYTE = [
    MultiByte("shift_jis", ((0x81, 0x9F), (0xE0, 0xFC)), ((0x40, 0x7E), (0x80, 0xFC)), ((0x82, 0x83), (0x88, 0x97)), ((0xA1, 0xDF),)),
    MultiByte("euc-jp", ((0xA1, 0xFE), (0x8E, 0x8E)), ((0xA1, 0xFE),), ((0xA4, 0xA5), (0xB0, 0xCF))),
    MultiByte("gb18030", ((0x81, 0xFE),), ((0x40, 0x7E), (0x80, 0xFE)), ((0xB0, 0xD7),), longer=True),
    MultiByte("big5", ((0xA1, 0xF9),), ((0x40, 0x7E), (0xA1, 0xFE)), ((0xA4, 0xC6),)),
    MultiByte("euc-kr", ((0xA1, 0xFE),), ((0xA1, 0xFE),), ((0xB0, 0xC8),)),
]


def _class(ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


def multi_byte_rate(data: bytes, kind: MultiByte) -> float | None:
    """Share of the characters beyond ASCII in frequent rows, or None where the automaton rejects the bytes."""
    lead, trail, single, common = (_class(x).tolist() for x in (kind.lead, kind.trail, kind.single, kind.common))
    at, n, found, good = 0, len(data), 0, 0
    while at < n:
        b = data[at]
        if b < 0x80:
            at += 1
        elif single[b]:
            at, found = at + 1, found + 1
        elif not lead[b]:
            return None
        elif at + 1 == n:
            break
        elif kind.longer and 0x30 <= data[at + 1] <= 0x39:
            if at + 3 < n and not (0x81 <= data[at + 2] <= 0xFE and 0x30 <= data[at + 3] <= 0x39):
                return None
            at, found = at + 4, found + 1
        elif trail[data[at + 1]]:
            at, found, good = at + 2, found + 1, good + common[b]
        else:
            return None
    return good / found if found else None


#: Letters of languages that a single-byte encoding is used for, by falling frequency (fixed values).
_LETTERS = {
    "cyrillic": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфёъ",
    "greek": "ατοιενσρκπυμληςωχδθβγφξζψάέήίόύώ",
    "western": "éèàäüöñóíáçêôúßîûâùëïœæøå¿¡«»’“”–",
    "eastern": "ěščřžýáíéůťďňąćęłńóśźżőűăâîșț",
}
SINGLE_BYTE = [("windows-1251", "cyrillic"), ("koi8-r", "cyrillic"), ("iso-8859-5", "cyrillic"), ("iso-8859-7", "greek"), ("cp1252", "western"), ("cp1250", "eastern")]


def single_byte_rate(data: bytes, name: str, letters: str) -> float | None:
    """Mean rate of the characters beyond ASCII, or None where the encoding lacks a byte: 1 for the script's most frequent
    letter, falling to 0.3, half of it for a capital letter and less for one amid small letters; below 0 for what is no letter and
    for one of another script than the ASCII letter before it."""
    try:
        text = data.decode(name)
    except UnicodeDecodeError:
        return None
    rank = {c: 1 - 0.7 * k / len(letters) for k, c in enumerate(letters)}
    foreign = letters[0] >= "\u0370"  # Greek or Cyrillic
    total, n, before = 0.0, 0, ""
    for c in text:
        if c >= "\x80":
            n += 1
            small = c.lower()
            if foreign and before.isascii() and before.isalpha():
                total -= 0.5
            elif small in rank:
                total += rank[small] * (1 if c == small else -0.5 if before.islower() else 0.5)
            else:
                total -= 0.2 if c.isalpha() or c in "°§©®·№" else 0.5
        before = c
    return total / n if n else None


def _valid(data: bytes, name: str) -> bool:
    try:
        codecs.getincrementaldecoder(name)("strict").decode(data, False)
    except (UnicodeDecodeError, LookupError):
        return False
    return True


def _sixteen(data: bytes) -> str | None:
    """UTF-16 by zero bytes at every second place of a text that is mostly ASCII."""
    if len(data) < 4:
        return None
    raw = np.frombuffer(data[: len(data) // 2 * 2], np.uint8).reshape(-1, 2)
    first, second = (raw == 0).mean(axis=0)
    if second > 0.5 and first < 0.1:
        return "utf-16-le"
    return "utf-16-be" if first > 0.5 and second < 0.1 else None


def declared(data: bytes) -> str | None:
    """The declared encoding's own name, if Python knows it."""
    found = _DECLARED.search(data[:4096])
    try:
        return codecs.lookup(found[1].decode("ascii")).name if found else None
    except LookupError:
        return None


def detect(data: bytes, sample: int = 1 << 16, fallback: str = "iso-8859-1") -> str:
    """The name of the bytes' encoding. Statistics look at the first `sample` bytes, validity at all of them."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    if found := _sixteen(data[:sample]):
        return found
    if _JIS.search(data[:sample]) and _valid(data, "iso2022_jp"):
        return "iso2022_jp"
    if data.isascii():
        return "ascii"
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:  # a cut-off last character is no error behind a whole one
        if e.end == len(data) and e.reason == "unexpected end of data" and not data[: e.start].isascii():
            return "utf-8"
    name = declared(data)
    if name and name not in ("utf-8", "ascii", "utf-16", "utf-16-le", "utf-16-be") and _valid(data, name):
        return name
    head = data[:sample]
    multi = {k.name: r - _class(k.common).sum() / 94 for k in MULTI_BYTE if (r := multi_byte_rate(head, k)) is not None and r > 0.6 and _valid(data, k.name)}
    if multi:  # many characters in few rows say more than as many in many
        return max(multi, key=lambda k: (multi[k], -[m.name for m in MULTI_BYTE].index(k)))
    single = {name: r for name, script in SINGLE_BYTE if (r := single_byte_rate(head, name, _LETTERS[script])) is not None}
    if single and max(single.values()) > 0:
        return max(single, key=lambda k: (single[k], -[n for n, _ in SINGLE_BYTE].index(k)))
    return "cp1252" if _valid(data, "cp1252") else fallback


def decode(data: bytes, detector: Callable[[bytes], str] = detect) -> tuple[str, str]:
    """(text, encoding); bytes that are bad in it are replaced, which befalls only a cut-off last character."""
    name = detector(data)
    return data.decode("utf-8-sig" if name == "utf-8-sig" else name, "replace").removeprefix("\ufeff"), name


def decoded(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, text, encoding of byte strings; null bytes have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode(x.as_py()) if x.is_valid else (None, None) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], [key, "text", "encoding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(content).cast("binary")).mapInArrow(run, f"`{key}` {kind}, text string, encoding string")
