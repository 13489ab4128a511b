"""Byte-level substring deduplication by blockwise suffix sorting with a difference cover.

Candidate suffixes are found as in :mod:`repeats` and dealt into buckets by
minimiser, so suffixes that could share 200 bytes meet. One bucket is sorted at a
time, a large one in parts by the place of the minimiser in the window, which bounds
the memory:

1. The bucket's fragments are laid out in one array. Positions whose residue
   modulo ``PERIOD`` is in ``COVER`` are the cover sample; any two residues have an
   offset at which both are in it.
2. The sample's ranks are computed first, by doubling from ``PERIOD`` bytes until
   they cover a window.
3. The bucket's suffixes are sorted by their first ``PREFIX`` bytes. Ties are
   resolved by the ranks of the sample positions at the offset their residues have
   in common, however long they are.
4. Neighbours in suffix order are compared byte by byte over a window; equal runs
   of a total weight above 1 are repeats.

Fragments are laid out with their minimiser at residue 0. Equal windows then have
one residue, so that most ties need one offset only.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import table, text_or_empty
from .repeats import Reader, covered, finish, mix, node_of, repeated_windows

WIDTH = 200
GRAMS = (32, 128, 184, 200)
#: A perfect difference set: every residue but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Bytes by which suffixes are sorted before ties go to the cover sample; at least ``PERIOD``.
PREFIX = 64
#: A bucket may hold so many times the fragments of one minimiser that others can: it is sorted in parts of about so many windows.
ROOM, SORTED = 10, 400_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

_NTH = np.full(PERIOD, -1)
_NTH[list(COVER)] = np.arange(len(COVER))
#: _OFFSET[a, b]: the least offset at which residues a and b are both in the cover.
_OFFSET = np.array([[next(d for d in range(PERIOD) if _NTH[(a + d) % PERIOD] >= 0 and _NTH[(b + d) % PERIOD] >= 0) for b in range(PERIOD)] for a in range(PERIOD)])


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the place where its run of equals begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _sorted_ranks(key: np.ndarray) -> np.ndarray:
    """The number of smaller keys, for each key."""
    order = np.argsort(key)
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = _starts(np.r_[True, s[1:] != s[:-1]][: len(s)])
    return out


def _tied(ranks: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(ranks, minlength=len(ranks))[ranks] > 1) if len(ranks) else ranks


def _refine(ranks: np.ndarray, tied: np.ndarray, key: np.ndarray) -> None:
    """Break ties of ``ranks`` at the places ``tied`` by a further key of ranks; they stay numbers of smaller elements."""
    base = ranks[tied] * (len(ranks) + 2)
    both = base + key + 1
    order = np.argsort(both)
    r, k = base[order], both[order]
    other = np.r_[True, r[1:] != r[:-1]][: len(r)]
    ranks[tied[order]] = ranks[tied][order] + _starts(other | np.r_[True, k[1:] != k[:-1]][: len(k)]) - _starts(other)


def _prefix_ranks(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Ranks of the ``size`` bytes at each place; only ties are read on."""
    first = words[at]
    ranks = _sorted_ranks(first if size >= 8 else first >> np.uint64(64 - 8 * size))
    for k in range(8, size, 8):
        tied = _tied(ranks)
        if not len(tied):
            break
        part = words[at[tied] + k]
        _refine(ranks, tied, _sorted_ranks(part >> np.uint64(8 * (k + 8 - size)) if k + 8 > size else part))
    return ranks


class Block:
    """Bytes laid out for sorting, with the ranks of their cover sample."""

    def __init__(self, data: np.ndarray, width: int):
        padded = np.r_[data, np.zeros(2 * PERIOD + width + 16, np.uint8)]
        self.words = np.zeros(len(padded) - 8, np.uint64)
        for i in range(8):
            self.words = self.words << np.uint64(8) | padded[i : i + len(self.words)].astype(np.uint64)
        rows = -(-len(data) // PERIOD) + 1
        at = (np.arange(rows)[:, None] * PERIOD + np.array(COVER)).ravel()
        ranks, reach, step = _prefix_ranks(self.words, at, PERIOD), PERIOD, len(COVER)
        while reach < width:
            tied = _tied(ranks)
            if not len(tied):
                break
            _refine(ranks, tied, np.r_[ranks, np.full(step, -1)][tied + step])
            reach, step = reach * 2, step * 2
        self.ranks, self.width = ranks, width

    def rank_at(self, at: np.ndarray) -> np.ndarray:
        return self.ranks[at // PERIOD * len(COVER) + _NTH[at % PERIOD]]

    def order(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(an order of the suffixes at ``at`` that is right for their first ``width`` bytes, ranks of their first ``PREFIX`` bytes)."""
        group = _prefix_ranks(self.words, at, min(PREFIX, self.width))
        residue = at % PERIOD
        tied = _tied(group)
        ranks, near = group.copy(), residue[tied]
        key = self.rank_at(at[tied] + _OFFSET[near, near])
        least, most = np.full(len(at), PERIOD), np.full(len(at), -1)
        np.minimum.at(least, group[tied], near)
        np.maximum.at(most, group[tied], near)
        mixed = np.flatnonzero((least < most)[group[tied]])
        if len(mixed):
            key[mixed] = self._places(group[tied[mixed]], at[tied[mixed]], near[mixed])
        _refine(ranks, tied, _sorted_ranks(key))
        return np.argsort(ranks, kind="stable"), group

    def _places(self, group: np.ndarray, at: np.ndarray, residue: np.ndarray) -> np.ndarray:
        """How many suffixes of the same group come before each, residue against residue."""
        before = np.zeros(len(at), np.int64)
        _, group = np.unique(group, return_inverse=True)
        of = {int(r): np.flatnonzero(residue == r) for r in np.unique(residue)}
        scale = len(self.ranks) + 1
        for b, other in of.items():
            lower = np.r_[0, np.cumsum(np.bincount(group[other], minlength=int(group.max()) + 1))]
            for a, mine in of.items():
                d = _OFFSET[a, b]
                keys = np.sort(group[other] * scale + self.rank_at(at[other] + d))
                before[mine] += np.searchsorted(keys, group[mine] * scale + self.rank_at(at[mine] + d)) - lower[group[mine]]
        return before

    def classes(self, at: np.ndarray) -> np.ndarray:
        """A number per suffix, equal for those with the same first ``width`` bytes: neighbours in order, compared in full."""
        order, group = self.order(at)
        a, b = at[order[:-1]], at[order[1:]]
        same = group[order[:-1]] == group[order[1:]]
        for k in range(0, self.width, 8):
            left = np.flatnonzero(same)
            k = min(k, max(0, self.width - 8))
            same[left] = self.words[a[left] + k] == self.words[b[left] + k]
        out = np.empty(len(at), np.int64)
        out[order] = np.cumsum(np.r_[0, ~same]) if len(at) else 0
        return out


def sort_bucket(units: list[bytes], weights: np.ndarray, places: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """For each window of each fragment, whether its string has a total weight above 1 in the bucket."""
    if not units:
        return []
    ahead = -places % PERIOD
    size = np.array([len(x) for x in units])
    slot = -(-(ahead + size) // PERIOD) * PERIOD
    start = np.r_[0, np.cumsum(slot)[:-1]]
    laid = b"".join(x for u, a, n, s in zip(units, ahead.tolist(), size.tolist(), slot.tolist(), strict=True) for x in (bytes(a), u, bytes(s - a - n)))
    block = Block(np.frombuffer(laid, np.uint8), WIDTH)
    owner = np.repeat(np.arange(len(units)), windows)
    at = (start + ahead)[owner] + np.arange(windows.sum()) - np.r_[0, np.cumsum(windows)[:-1]][owner]
    into = places[owner] - (at - (start + ahead)[owner])  # equal windows have their minimiser at one place
    repeated = np.zeros(len(at), bool)
    for part in _parts(into):
        classes = block.classes(at[part])
        repeated[part] = np.bincount(classes, weights=weights[owner[part]])[classes] > 1
    return np.split(repeated, np.cumsum(windows)[:-1])


def _parts(into: np.ndarray) -> list:
    """Windows in parts of about ``SORTED``, those with their minimiser at one place together."""
    if len(into) <= SORTED:
        return [slice(None)]
    number = (np.cumsum(np.bincount(into)) - 1) // SORTED
    return [x for i in range(int(number[-1]) + 1) if len(x := np.flatnonzero(number[into] == i))]


def _hashed(raw: bytes) -> tuple[np.ndarray, bytes]:
    return _BYTE[np.frombuffer(raw, np.uint8)], raw


def _cutter(raw: bytes):
    return lambda lo, hi: raw[lo:hi]


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


TEXTS = Reader(lambda text: _hashed(_utf8(text)), lambda text: _cutter(_utf8(text)))
RANGES = Reader(_hashed, _cutter)


def remove(text: str, spans: tuple | None) -> tuple[bytes, int, int, int]:
    """(kept bytes, bytes, removed bytes, maximal removed runs)."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not spans:
        return raw.tobytes(), len(raw), 0, 0
    gone = covered(spans, len(raw), WIDTH)
    return raw[~gone].tobytes(), len(raw), int(gone.sum()), int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))


def _summary(text: str, spans: tuple | None) -> tuple:
    kept, n, removed, runs = remove(text, spans)
    return n, removed, runs, hashlib.sha256(kept).hexdigest()


def _finish(docs: DataFrame, id_col: str, text, summarise, schema: str) -> DataFrame:
    rows = docs.select(node_of(text).alias("node"), text.alias("text"))
    return finish(docs, *repeated_windows(rows, WIDTH, GRAMS, TEXTS, RANGES, sort_bucket, ROOM), id_col, text, summarise, schema)


def dedup_bytes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Every byte covered by a ``WIDTH``-byte string that also starts anywhere else
    is removed, first occurrences too; strings are judged on the input.

    Defined cases: a null text is empty; texts shorter than ``WIDTH`` bytes lose
    nothing; repeated rows are repeats of each other; null identifiers are passed
    on; an empty table gives an empty result; other columns are ignored.
    """
    text = text_or_empty(text_col)
    return _finish(docs, id_col, text, _summary, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def kept_bytes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row what is left of its text; bytes of characters cut in half are replaced."""
    text = text_or_empty(text_col)
    return _finish(docs, id_col, text, lambda t, s: (remove(t, s)[0].decode("utf-8", "replace"),), "kept string")


def op7_suffix_array(spark, sf_dir):
    return dedup_bytes(table(spark, sf_dir, "documents"))
