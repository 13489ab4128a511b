"""Recognised pages: checked edits of their words, lines and paragraphs, and the edition of a document."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import core_tokens
from ..sources.state import keep

# Bytes of an edit's two sides, vertical band of a line, gap and indent of a paragraph.
MOST_ORIGINAL, MOST_CORRECTED = 40, 48
LINE_BAND, PARAGRAPH_GAP, PARAGRAPH_INDENT = 0.6, 1.7, 0.015


_TEXTS = ArrayType(StringType())
_EDITED = StructType([StructField("t", _TEXTS), StructField("src", ArrayType(IntegerType())), StructField("verdicts", _TEXTS)])
_LAID = StructType([StructField("paras", ArrayType(_TEXTS)), StructField("asked", _TEXTS)])

# Edits.


def _distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
    return row[-1]


def _peel(word: str) -> tuple[str, str, str]:
    """What stands before the first letter or digit, what lies between, what follows the last."""
    at = [i for i, c in enumerate(word) if c.isalnum()]
    return (word[: at[0]], word[at[0] : at[-1] + 1], word[at[-1] + 1 :]) if at else (word, "", "")


def _anchor(texts: list[str], span: list[str]) -> tuple[int, str, str] | None:
    """First place of the span, and the marks around it. Only its two outer ends may carry marks that the span lacks."""
    n = len(span)
    for i in range(len(texts) - n + 1):
        if texts[i + 1 : i + n - 1] != span[1:-1]:
            continue
        before, first, inner = ("", span[0], "") if texts[i] == span[0] else _peel(texts[i])
        mid, last, after = ("", span[-1], "") if texts[i + n - 1] == span[-1] else _peel(texts[i + n - 1])
        if first == span[0] and last == span[-1] and (n == 1 or not inner and not mid):
            return i, before, after
    return None


def _judge(texts: list[str], old: str, new: str, verified: bool) -> tuple[str, tuple | None]:
    """Why an edit is refused, or 'applied' and (position, words replaced, word put there)."""
    if not verified:
        return "unverified", None
    if not old or not new or old == new:
        return "noop", None
    if len(old.encode()) > MOST_ORIGINAL or len(new.encode()) > MOST_CORRECTED:
        return "too long", None
    span, after = old.split(), new.split()
    place = _anchor(texts, span) if span else None
    if place is None:
        return "no anchor", None
    at, left, right = place
    a, b = (re.sub("[ -]", "", x).encode() for x in (old, new))
    if _distance(a, b) > max(2, len(a) // 4):
        return "edit distance", None
    n = len(span)
    if len(after) > n:
        if after[:n] == span and texts[at + n : at + n + 1] == [after[n]]:
            return "duplicates next word", None
        if after[-n:] == span and at and texts[at - 1] == after[0]:
            return "duplicates previous word", None
    return "applied", (at, n, f"{left}{new}{right}")


@F.pandas_udf(_EDITED)
def _edited(words: pd.Series, edits: pd.Series) -> pd.DataFrame:
    out = []
    for ws, es in zip(words, edits, strict=True):
        texts = [w or "" for w in ws] if ws is not None else []
        source, said = list(range(len(texts))), []
        for e in es if es is not None else ():
            verdict, change = _judge(texts, e["original"] or "", e["corrected"] or "", bool(e["verified"]))
            if change:
                at, n, new = change
                texts[at : at + n], source[at : at + n] = [new], [source[at]]
            said.append(verdict)
        out.append((texts, source, said))
    return pd.DataFrame(out, columns=["t", "src", "verdicts"])


def apply_edits(words: Column, edits: Column) -> Column:
    """``struct<words, verdicts>``: edits (original, corrected, verified) of one page, applied in their order.

    An edit needs verification, two different sides of at most 40 and 48 bytes, a
    place where its original stands as whole words (marks at the outer ends are
    kept), a byte distance without blanks and hyphens of at most 2 or a quarter of
    the original, and must not repeat the word beside it. The words replaced
    become one; ``src`` is the position of the word whose box it keeps. A verdict
    is 'applied' or the reason against. Null words or edits are empty lists.
    """
    done = _edited(words, edits)
    return F.struct(F.arrays_zip(done["t"].alias("t"), done["src"].alias("src")).alias("words"), done["verdicts"].alias("verdicts"))


# Lines and paragraphs.


def _lines(words) -> list[tuple[list[str], float, float]]:
    """(texts, top, left) of each line; a word that leaves the band about the mean centre of the line begins the next one."""
    lines: list[list] = []  # texts, sum of centres, sum of heights, left
    for text, x, y, height in words:
        centre = y + height / 2
        if lines:
            texts, c, h, _ = line = lines[-1]
            n = len(texts)
            if abs(centre - c / n) <= LINE_BAND * max(h / n, height):
                texts.append(text)
                line[1], line[2] = c + centre, h + height
                continue
        lines.append([[text], centre, height, x])
    return [(t, (c - h / 2) / len(t), x) for t, c, h, x in lines]


def _paragraphs(words) -> list[list[str]]:
    lines = _lines(words)
    if not lines:
        return []
    tops, lefts = np.array([x[1] for x in lines]), np.array([x[2] for x in lines])
    upper = lambda x: np.sort(x)[len(x) // 2] if len(x) else 0.0
    steps = np.diff(tops)
    usual = upper(steps)
    begins = lefts > upper(lefts) + PARAGRAPH_INDENT
    if usual > 0:
        begins[1:] |= steps > PARAGRAPH_GAP * usual
    begins[0] = True
    found: list[list[str]] = []
    for (texts, _, _), new in zip(lines, begins, strict=True):
        if new:
            found.append([])
        found[-1] += texts
    return found


def _pages(*columns: pd.Series):
    """The paragraphs of each page, from columns of arrays."""
    for page in zip(*columns, strict=True):
        yield _paragraphs(zip(*(c.tolist() for c in page), strict=True)) if page[0] is not None else []


@F.pandas_udf(ArrayType(_TEXTS))
def _page_paragraphs(t: pd.Series, x: pd.Series, y: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series(list(_pages(t, x, y, h)))


def paragraphs(words: Column) -> Column:
    """Paragraphs of a page, each a list of words, from words (t, x, y, w, h) in reading order.

    A line begins a paragraph if it stands further below the line before than 1.7
    times the page's median step, or is indented by 0.015 more than the median
    line. No words or null: no paragraphs. One page is one row, so no page meets another.
    """
    return _page_paragraphs(*(words[c] for c in "txyh"))


# Editions.


def _token(text: str) -> str:
    return "".join(c for c in text if c.isalnum()).lower()


def _join(words: list[str], whole) -> str:
    """Words with blanks between them; a word that ends in one hyphen takes a next one in lower case, without the hyphen where ``whole`` says so."""
    out: list[str] = []
    for w in words:
        if out and len(out[-1].encode()) > 1 and out[-1][-1] == "-" and out[-1][-2] != "-" and w[:1].islower():
            out[-1] = (out[-1][:-1] if whole(_token(out[-1] + w)) else out[-1]) + w
        else:
            out.append(w)
    return " ".join(out)


@F.pandas_udf(_LAID)
def _laid(t: pd.Series, x: pd.Series, y: pd.Series, h: pd.Series) -> pd.DataFrame:
    """Paragraphs, and the words that joining them asks the vocabulary for; the same whatever it answers."""
    out = []
    for paras in _pages(t, x, y, h):
        asked: set[str] = set()
        for p in paras:
            _join(p, lambda w: asked.add(w) or True)
        out.append((paras, sorted(asked)))
    return pd.DataFrame(out, columns=["paras", "asked"])


@F.pandas_udf(_TEXTS)
def _joined(paras: pd.Series, known: pd.Series) -> pd.Series:
    texts = []
    for ps, ks in zip(paras, known, strict=True):
        have = frozenset(ks) if ks is not None else frozenset()
        texts.append([_join(list(p), have.__contains__) for p in ps])
    return pd.Series(texts)


def editions(pages: DataFrame) -> DataFrame:
    """``doc, body``: one marked text per document from pages (doc, page, words).

    A heading, a marker per page and its paragraphs. A word broken at a hyphen is
    put together without it where the document has the whole word elsewhere, else
    with it. The vocabulary isn't collected: the words asked for meet those of the
    same document in a semi-join. Paragraphs are found once and written. The body is one cell per document, as the
    edition is one file.
    """
    laid = keep(pages.select("doc", "page", _laid(*(F.col("words")[c] for c in "txyh")).alias("laid")).select("doc", "page", "laid.*"))
    asked = laid.select("doc", "page", F.explode("asked").alias("term"))
    tokens = laid.select("doc", F.explode(F.array_distinct(core_tokens(F.array_join(F.flatten("paras"), " ")))).alias("term")).distinct()
    known = asked.join(tokens, ["doc", "term"], "left_semi").groupBy("doc", "page").agg(F.collect_set("term").alias("known"))
    joined = laid.select("doc", "page", "paras").join(known, ["doc", "page"], "left").select("doc", "page", _joined("paras", "known").alias("texts"))
    part = lambda s: F.concat(F.lit("\n<!-- page "), s.page.cast("string"), F.lit(" -->\n"), F.array_join(F.transform(s.texts, lambda t: F.concat(F.lit("\n"), t, F.lit("\n"))), ""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "texts"))), part), "")
    return joined.groupBy("doc").agg(F.concat(F.lit("# "), F.first("doc").cast("string"), F.lit("\n"), body).alias("body"))
