"""Word-level substring deduplication with suffix automata of reference shards.

The corpus is reduced to candidate fragments as in :mod:`repeats` and dealt into
reference shards by minimiser. A shard's generalised suffix automaton, with the
number of occurrences of every state, is built in the task that holds the shard;
the shard's document fragments are streamed through it for matching statistics:
the longest suffix at each word that occurs at least twice. Statistics of the
threshold or more mark words; maximal marked spans are removed. Every mark comes
from an automaton, those of fragments that occur many times included: such a
fragment is streamed once, with its weight, and its marks go to all its places.

Streaming every document through every shard would cost shards x words. A window
of a document can only match in a shard that has its minimiser, so the other
(document, shard) pairs are never formed; the result is the same.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import table, text_or_empty
from .repeats import Reader, covered, finish, mix, node_of, repeated_windows

WIDTH = 35
GRAMS = (8, 24, 32, 35)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


class Automaton:
    """Suffix automaton of several sequences with occurrence weights."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.weight = [-1], [0], [0]

    def _state(self, nxt: dict, length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.weight.append(0)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c) -> int:
        clone = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list, weight: int = 1) -> None:
        nxt, link, length, seen = self.next, self.link, self.length, self.weight
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
            else:
                new, p = len(nxt), last
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                seen.append(0)
                while q is None:
                    nxt[p][c] = new
                    p = link[p]
                    if p < 0:
                        break
                    q = nxt[p].get(c)
                else:
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
                last = new
            seen[last] += weight

    def close(self) -> None:
        """Add up occurrences along suffix links."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.weight[self.link[s]] += self.weight[s]

    def statistics(self, sequence: list, least: int = 2) -> list[int]:
        """For each position the length of the longest suffix there that occurs at least ``least`` times."""
        out, s, n = [], 0, 0
        nxt, link, length, weight = self.next, self.link, self.length, self.weight
        for c in sequence:
            while s and (c not in nxt[s] or weight[nxt[s][c]] < least):
                s = link[s]
                n = length[s]
            t = nxt[s].get(c)
            if t is not None and weight[t] >= least:
                s, n = t, n + 1
            out.append(n)
        return out


def match_shard(units: list[bytes], weights: np.ndarray, places: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """For each window of each fragment, whether its words occur a second time in the shard."""
    names: dict[bytes, int] = {}
    sequences = [[names.setdefault(w, len(names)) for w in u.split(b" ")] for u in units]
    automaton, collecting = Automaton(), gc.isenabled()
    gc.disable()  # hundreds of thousands of states and no cycle among them
    try:
        for sequence, weight in zip(sequences, weights.tolist(), strict=True):
            automaton.add(sequence, weight)
    finally:
        if collecting:
            gc.enable()
    automaton.close()
    return [np.array(automaton.statistics(s)[WIDTH - 1 :]) >= WIDTH for s in sequences]


def _hashed(found) -> tuple[np.ndarray, bytes]:
    u = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
    return u, u.tobytes()


def _cutter(text: str):
    found = words(text)
    joined = " ".join(found)
    at = [0, *itertools.accumulate(len(w) + 1 for w in found)]
    return lambda lo, hi: joined[at[lo] : at[hi] - 1].encode("utf-8", "surrogatepass")


def _range_cutter(data: bytes):
    raw = data.split(b" ")
    return lambda lo, hi: b" ".join(raw[lo:hi])


TEXTS = Reader(lambda text: _hashed(words(text)), _cutter)
RANGES = Reader(lambda data: _hashed(data.split(b" ")), _range_cutter)


def remove(text: str, spans: tuple | None) -> tuple[list[str], int]:
    """(kept words, number of words)."""
    found = words(text)
    if not spans:
        return found, len(found)
    gone = covered(spans, len(found), WIDTH).tolist()
    return [w for w, g in zip(found, gone, strict=True) if not g], len(found)


def _summary(text: str, spans: tuple | None) -> tuple:
    kept, n = remove(text, spans)
    return n, n - len(kept), hashlib.sha256(" ".join(kept).encode("utf-8", "surrogatepass")).hexdigest()


def _finish(docs: DataFrame, id_col: str, text, summarise, schema: str) -> DataFrame:
    rows = docs.select(node_of(text).alias("node"), text.alias("text"))
    return finish(docs, *repeated_windows(rows, WIDTH, GRAMS, TEXTS, RANGES, match_shard), id_col, text, summarise, schema)


def dedup_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256``.

    Every word covered by a window of ``WIDTH`` words whose sequence also starts
    anywhere else is removed, first occurrences too; windows are judged on the
    input.

    Defined cases: a null text has no words; texts of fewer than ``WIDTH`` words
    lose nothing; repeated rows are repeats of each other; null identifiers are
    passed on; an empty table gives an empty result; other columns are ignored.
    """
    text = text_or_empty(text_col)
    return _finish(docs, id_col, text, _summary, "n_words long, n_removed long, kept_sha256 string")


def kept_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row the words that stay, joined by one space."""
    text = text_or_empty(text_col)
    return _finish(docs, id_col, text, lambda t, s: (" ".join(remove(t, s)[0]),), "kept string")


def op5_automaton(spark, sf_dir):
    return dedup_words(table(spark, sf_dir, "documents"))
