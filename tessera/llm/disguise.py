"""Text that looks the same but is written with other characters, brought to one form.

Each text is scanned with one pattern of characters that may be unstable: those that a
composition quick check answers with "no" or "maybe", forms of other width, ligatures,
invisible characters, unusual spaces and hyphens. Only the segments with such characters
are normalized, together with the letter before them that they may combine with, and
spliced into the text, which otherwise stays as it was. Words that mix look-alike
letters of several alphabets are then written in one.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look like Latin ones, by alphabet; each is followed by its Latin look-alike.
LOOKALIKES = {
    "CYRILLIC": "аa вb еe ѕs іi јj кk оo рp сc тt уy хx һh ԁd ԛq ԝw ӏl ѵv АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҺH ԌG ԚQ ԜW ҮY ѴV ӀI",
    "GREEK": "αa βb γy εe ηn ιi κk νv οo ρp σo τt υu χx ωw ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ",
    "ARMENIAN": "օo սu ցg հh ոn ռn զq աw ՕO ՍU ԼL յj",
    "CHEROKEE": "ᎪA ᏴB ᏟC ᎠD ᎬE ᎻH ᏆI ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ",
    "LATIN": "ɡg ɑa ıi",
}
# Invisible characters; joiners (200C, 200D) and variation selectors are judged by what is beside them.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁥⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯ㅤ﻿ﾠ￹￺￻"
SPACES = "                 　"
HYPHENS = "‐‑﹣－"
JOINERS = "‌‍"
#: Alphabets of which a word may use one only; other scripts mix freely (as in Japanese).
ALPHABETS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE")

_TO_LATIN = {pair[0]: pair[1] for pairs in LOOKALIKES.values() for pair in pairs.split()}
_FROM_LATIN: dict[str, dict[str, str]] = {a: {p[1]: p[0] for p in reversed(LOOKALIKES[a].split())} for a in ALPHABETS if a != "LATIN"}
_ALWAYS = {p[0]: p[1] for p in LOOKALIKES["LATIN"].split() if p[0] != "ı"}
# Numerals that are one Latin letter in another code, from Unicode's own data.
_ROMAN = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2160, 0x2180) if len(unicodedata.normalize("NFKC", chr(c))) == 1}
_WORD = re.compile(r"[^\W\d_]+")
_UNUSUAL = re.compile(r"[^\t\n\r -~]")


def _folds(cp: int) -> bool:
    """Whether a character is another form of plain text: of other width, a styled letter, a ligature, a radical used as a character."""
    kind = unicodedata.decomposition(chr(cp)).split(" ", 1)[0]
    if kind in ("<wide>", "<narrow>", "<small>"):
        return True
    return 0x1D400 <= cp <= 0x1D7FF and kind == "<font>" or 0xFB00 <= cp <= 0xFB17 or 0x2E80 <= cp <= 0x2FDF and kind == "<compat>"


@functools.cache
def _tables() -> tuple[frozenset[str], frozenset[str]]:
    """Characters that may be unstable, and those of them that may combine with one before them; made from Unicode's own data."""
    follows, alone = set(), set()
    for cp in range(0x80, 0x323B0):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x9FFF and cp not in (0x3164,):
            continue
        ch = chr(cp)
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<" and " " in parts:
            second = chr(int(parts.split()[1], 16))
            if unicodedata.normalize("NFC", parts and "".join(chr(int(p, 16)) for p in parts.split())) == ch:
                follows.add(second)
        if unicodedata.combining(ch):
            follows.add(ch)
        if not unicodedata.is_normalized("NFC", ch) or _folds(cp):
            alone.add(ch)
    follows |= {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    alone |= set(INVISIBLE + SPACES + HYPHENS + JOINERS) | {chr(c) for c in range(0xFE00, 0xFE10)} | {chr(c) for c in (*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0))} | {chr(c) for c in range(0xE0000, 0xE01F0)}
    return frozenset(follows | alone), frozenset(follows)


def _segments(text: str) -> Iterator[tuple[int, int]]:
    """Where unstable characters stand, with the one character before those that may combine with it."""
    unstable, follows = _tables()
    start = end = -1
    for m in _UNUSUAL.finditer(text):
        i = m.start()
        if text[i] not in unstable:
            continue
        if i != end:
            if end >= 0:
                yield start, end
            start = i - (i > max(end, 0) and text[i] in follows)
        end = i + 1
    if end >= 0:
        yield start, end


def _cjk(ch: str) -> bool:
    return bool(ch) and ("⺀" <= ch <= "鿿" or "가" <= ch <= "힯" or "豈" <= ch <= "﫿" or "\U00020000" <= ch <= "\U000323af") and ch != "　"


@functools.lru_cache(maxsize=65536)
def _script(ch: str) -> str:
    try:
        return unicodedata.name(ch).split(" ", 1)[0]
    except ValueError:
        return ""


def _joiner_needed(text: str, i: int) -> bool:
    """Whether the joiner at i has what it needs: letters of one joining script on both sides, or emoji."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if not before or not after:
        return False
    a, b = unicodedata.category(before), unicodedata.category(after)
    emoji = (a in ("So", "Sk") and not _folds(ord(before))) or before in "️⃣"
    if text[i] == "‍" and emoji and ((b == "So" and not _folds(ord(after))) or after in "♀♂"):
        return True
    joining = ("ARABIC", "SYRIAC", "MONGOLIAN", "NKO", "DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM", "SINHALA", "KHMER", "MYANMAR", "TIBETAN", "THAANA", "MANDAIC", "ADLAM")
    return _script(before) in joining and (_script(after) in joining or not after.isalnum())


def _segment(text: str, start: int, end: int) -> str:
    out = []
    for i in range(start, end):
        ch = text[i]
        if ch in INVISIBLE or "\U000e0000" <= ch <= "\U000e01ef":
            flag = "\U000e0000" <= ch <= "\U000e007f" and "\U0001f3f4" in text[max(0, i - 8) : i]
            out.append(ch if flag else "")
        elif ch in JOINERS:
            out.append(ch if _joiner_needed(text, i) else "")
        elif "︀" <= ch <= "️":
            before = text[i - 1 : i]
            out.append(ch if before and (not before.isalpha() or _cjk(before)) and not before.isspace() else "")
        elif ch in SPACES:
            out.append("\n" if ch in "  " else " ")
        elif ch in HYPHENS:
            out.append("-")
        elif unicodedata.category(ch) == "Cc" and ch not in "\t\n\r":
            out.append("")
        elif _folds(ord(ch)):
            # marks of full width are the plain ones beside Chinese, Japanese or Korean
            if not ch.isalnum() and "＀" <= ch <= "･" and (_cjk(text[i - 1 : i]) or _cjk(text[i + 1 : i + 2])):
                out.append(ch)
            else:
                out.append(unicodedata.normalize("NFKC", ch))
        else:
            out.append(ch)
    folded = "".join(out)
    composed = unicodedata.normalize("NFC", folded)
    return composed if len(composed) <= len(folded) else folded


def _one_alphabet(match: re.Match) -> str:
    word = match.group()
    if word.isascii():
        return word
    fixed = "".join(_ALWAYS.get(c, c) for c in word) if any(c in _ALWAYS for c in word) and any(c.isascii() for c in word) else word
    if any(c in _ROMAN for c in fixed) and any(c.isascii() for c in fixed):
        fixed = "".join(_ROMAN.get(c, c) for c in fixed)
    base = [unicodedata.normalize("NFD", c)[0] for c in fixed]
    scripts = [_script(c) for c in base]
    used = {s for s in scripts if s in ALPHABETS}
    if len(used) < 2:
        return fixed
    # the alphabet into which every letter of the others can be turned
    for target in sorted(used, key=ALPHABETS.index):
        out = []
        for c, s in zip(fixed, scripts, strict=True):
            if s == target or s not in ALPHABETS:
                out.append(c)
                continue
            latin = c if s == "LATIN" else _TO_LATIN.get(c)
            got = latin if target == "LATIN" else _FROM_LATIN[target].get(latin or "")
            if got is None:
                break
            out.append(got)
        else:
            return "".join(out)
    return fixed


def plain_form(text: str | None) -> str | None:
    """The text in its one consistent form; null stays null. A second time changes nothing.

    What one pass removes may bring together what a next pass joins, so passes are made
    until nothing changes; each leaves fewer unusual characters.
    """
    if text is None or (text.isascii() and text.isprintable()):
        return text
    for _ in range(len(text) + 1):
        once = _one_pass(text)
        if once == text:
            break
        text = once
    return text


def _one_pass(text: str) -> str:
    out, at = [], 0
    for start, end in _segments(text):
        out += [text[at:start], _segment(text, start, end)]
        at = end
    spliced = "".join(out) + text[at:]
    if not unicodedata.is_normalized("NFC", spliced) and at:
        # what was parted by something invisible may now combine
        spliced = "".join(_recombined(spliced))
    if spliced.isascii():
        return spliced
    out = _WORD.sub(_one_alphabet, spliced)
    # a letter of another alphabet may combine with the mark after it
    return out if out == spliced or unicodedata.is_normalized("NFC", out) else "".join(_recombined(out))


def _recombined(text: str) -> Iterator[str]:
    at = 0
    for start, end in _segments(text):
        yield text[at:start]
        s = text[start:end]
        c = unicodedata.normalize("NFC", s)
        yield c if len(c) <= len(s) else s
        at = end
    yield text[at:]


def suspicious(text: Column) -> Column:
    """Whether a text has any character outside printable ASCII, tabs and line ends; the rest needs no look."""
    return F.coalesce(text.rlike(r"[^\t\n\r -~]"), F.lit(False))


def normalize(text: Column) -> Column:
    """plain_form of a column; only texts with unusual characters leave the JVM with their content."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(plain_form, na_action="ignore")

    return F.when(suspicious(text), run(F.when(suspicious(text), text))).otherwise(text)


def disguised(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """field, row_key of each cell in columns (text, or lists of texts: one row a list) whose form is not the consistent one; nulls are sound."""
    kind = dict(df.dtypes)
    out = None
    for c in columns:
        cell = F.explode(c) if kind[c].startswith("array") else F.col(c)
        one = df.select(F.lit(c).alias("field"), F.col(key).alias("row_key"), cell.alias("text"))
        out = one if out is None else out.unionByName(one)
    cells = out.where(suspicious(F.col("text")))
    found = cells.where(normalize(F.col("text")) != F.col("text")).select("field", "row_key")
    return found.distinct() if any(kind[c].startswith("array") for c in columns) else found
