"""Titles from file names: what a downloader, a scanner or a slug added comes off, what a person typed stays."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Names of sites and formats, marks of a pipeline, extensions, vowels.
JUNK = frozenset("zlib zlibrary zlibraryorg libgen librarygenesis annasarchive bok bibliotik pdfdrive ebook ebooks retail ocr ocrd scan scanned compressed optimized dragged copy pdf epub djvu mobi azw3 cbz".split())
MARKS = frozenset("text ocr ocrd clean cleaned scan scanned compressed optimized copy".split())
EXTENSIONS = "pdf|epub|djvu|mobi|azw3|cbz|cbr|txt|md|doc|docx"
VOWELS = "aeiouyàáâäãåèéêëìíîïòóôöõùúûüæøœ"

_GROUP = re.compile(r"\(([^)]*)\)|\[([^\]]*)\]|[(\[].*", re.S)  # the last: an opener that nothing closes, with all that follows
_DOMAIN = re.compile(r"[A-Za-z0-9.-]+\.[a-z]{2,8}")
_SERIAL = re.compile(r"[0-9]{10}|[0-9]{13}|(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}")
_YEAR = re.compile(r"[12][0-9]{3}")
_COUNT = re.compile(r"[0-9]{1,2}")
_SOUND = re.compile(f"(?=.*[{VOWELS}])(?!.*[^{VOWELS}]{{4}}).{{2,}}", re.S)
_MARKED = re.compile(r"(.{2,})[_-]([^_-]*)", re.S)
_EDGE = re.compile(r"^[\s_.,;-]+|[\s_.,;-]+$")


def _key(s: str) -> str:
    return "".join(c for c in s if c.isalnum()).lower()


def _readable(s: str) -> bool:
    """A year, or letters with a vowel and no four consonants in a row."""
    low = s.lower()
    return bool(_YEAR.fullmatch(low) or low.isalpha() and _SOUND.fullmatch(low))


def opaque(name: str) -> bool:
    """No readable words: without blanks, and at most half of the parts of two characters or more can be read (a lone part: not)."""
    if any(c.isspace() for c in name):
        return False
    parts = [p for p in re.split("[-_.]", name) if len(p) > 1]
    read = sum(map(_readable, parts))
    return 2 * read <= len(parts) if len(parts) > 1 else len(name) > 1 and not read


def _without_groups(name: str) -> str:
    def junk(part: str) -> bool:
        k = _key(part)
        return bool(_DOMAIN.fullmatch(part)) or k in JUNK or bool(_COUNT.fullmatch(k))

    def keep(m: re.Match) -> str:
        inner = m[1] if m[1] is not None else m[2]
        parts = [p.strip() for p in (inner or "").split(",") if p.strip()]
        return "" if parts and all(map(junk, parts)) else m[0]

    return _GROUP.sub(keep, name)


def _without_marks(name: str) -> str:
    while (m := _MARKED.fullmatch(name)) and _key(m[2]) in MARKS:
        name = m[1].rstrip()
    return name


def _words(name: str, slug: bool) -> tuple[list[str], bool]:
    """The words, and whether separators other than blanks were taken for word breaks."""
    if any(c.isspace() for c in name):
        return name.split(), False
    dotted = name.count(".") > 1 and all(_readable(p) for p in name.split(".") if p)
    breaks = "_" * ("_" in name) + "." * dotted + "-" * (name.count("-") > (0 if slug else 1))
    if not breaks:
        return [name], False
    return [p for p in re.split(f"[{breaks}]", name) if p], True


def _trimmed(words: list[str]) -> list[str]:
    """Without the junk at both ends; one word always stays."""

    def junk(w: str) -> bool:
        k = _key(w)
        return not k or k in JUNK or bool(_SERIAL.fullmatch(k)) or bool(_DOMAIN.fullmatch(re.sub(r"^[\W_]+|[\W_]+$", "", w)))

    first, end = 0, len(words)
    while end - first > 1:
        if end - first > 2 and _COUNT.fullmatch(words[end - 1]) and _key(words[end - 2]) in JUNK:
            end -= 2
        elif junk(words[end - 1]):
            end -= 1
        elif junk(words[first]):
            first += 1
        else:
            break
    return words[first:end]


def clean(stem: str, slug: bool = False) -> str:
    """The title of a file name without its extension; of an identifier made from one, if ``slug``."""
    name = _without_marks(_without_groups(stem).strip()).strip()
    if not name:
        return stem
    if opaque(name):
        return name
    words, broken = _words(name, slug)
    words = _trimmed(words)
    if not words:
        return name
    if broken or len(words) == 1 and words[0].isalpha() and not any(c.isupper() for c in words[0]):
        words = [w[0].upper() + w[1:] if i == 0 or len(w) > 2 else w for i, w in enumerate(words)]
    return _EDGE.sub("", " ".join(words)) or name


@F.pandas_udf(StringType())
def _clean_names(stems: pd.Series) -> pd.Series:
    return stems.map(clean, na_action="ignore")


@F.pandas_udf(StringType())
def slug_title(slugs: pd.Series) -> pd.Series:
    """The title of an identifier that was made from a file name; null stays null."""
    return slugs.map(lambda s: clean(s, True), na_action="ignore")


@F.pandas_udf(BooleanType())
def is_opaque(names: pd.Series) -> pd.Series:
    return names.map(opaque, na_action="ignore")


def file_title(path):
    """The title of a file: its name without folders, the extension and a second extension of a document; null stays null."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"(?s)^(.+)\.[^.]*$", "$1")
    return _clean_names(F.regexp_replace(stem, rf"(?is)^(.+)\.({EXTENSIONS})$", "$1"))
