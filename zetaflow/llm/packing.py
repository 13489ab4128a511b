"""Hierarchical multi-length packing of tokenised documents.

Each document's ids are cut into full windows and a rest. The rest is routed to
the smallest context tier that holds it. Within a tier, the gap behind a rest is
filled with rests of shorter tiers, largest first; what no whole rest fits is
filled by cutting one. A window that nothing is left to fill is cut at powers of
two, which need no padding. Sequences of one tier form step groups: every group but
the last of its tier and input partition holds the same number of tokens.

Every input partition is packed on its own in one pass over its rows, holding a
bounded pool of rests; only the pool's last few rests make short windows, so the
padding does not depend on how rows are dealt. No shuffle.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy

WINDOW = 4096
TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2
STEP_TOKENS = 1 << 20
#: Rests held by a task before they are packed; bounds its memory to about POOL x WINDOW x 4 bytes.
POOL = 2048
#: Words whose ids a worker remembers from task to task, some 30 MB; forgotten all at once beyond that.
CACHE_WORDS = 200_000

_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class WordIds:
    """Little-endian uint32 ids of a text.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its chunks between ASCII blanks, which are remembered.
    Chunks of Latin letters and ASCII are split and merged by a byte-pair encoder
    that holds the tokenizer's own vocabulary; all others go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = _byte_pairs(path)
        self.cache: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        chunks = _CHUNK.findall(text) if _ODD.search(text) else text.split()
        cache = self.cache
        try:
            return b"".join([cache[c] for c in chunks])
        except KeyError:
            pass
        if len(cache) > CACHE_WORDS:
            cache.clear()
        rest, merge = [], self.merge
        for c in chunks:
            if c not in cache:
                if merge and _SIMPLE.fullmatch(c) and "<|" not in c:
                    low = c.lower()  # such letters are composed already
                    ids: list[int] = []
                    for piece in (low,) if low.isalpha() else _PIECES.findall(low):
                        ids += merge(piece.encode() + _END_OF_WORD)
                    cache[c] = array("I", ids).tobytes()
                else:
                    cache[c] = b""
                    rest.append(c)
        for c, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            cache[c] = np.asarray(e.ids, dtype="<u4").tobytes()
        return b"".join([cache[c] for c in chunks])


@functools.cache
def _word_ids(path: str) -> WordIds:
    """One per Python worker: its words are remembered from task to task."""
    return WordIds(path)


#: Stands for the end of a word; no byte of UTF-8.
_END_OF_WORD = b"\xff"
#: ASCII and Latin letters; letters of Latin Extended have one lower case each.
_SIMPLE = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]+")
# Fixed value: the tokenizer's pattern of word pieces, for such chunks.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+|[0-9]|[^\\sa-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+")


def _byte_pairs(path: str):
    """An encoder of word bytes with the ids of a byte-level vocabulary with word ends, or None for another kind.

    It merges the adjacent pair whose joint has the lowest id; that equals the
    tokenizer's merges where ids follow the order of merges.
    """
    if sys.byteorder != "little":
        return None
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix")
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    vocab = model["vocab"]
    if not end or any(vocab.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {}
    for token, i in vocab.items():
        core = token.removesuffix(end)
        if i < 512 + len(merges) and all(c in letter for c in core):
            ranks[bytes(letter[c] for c in core) + (_END_OF_WORD if core != token else b"")] = i
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Packer:
    """Packs one stream of documents; ``emit`` gets (doc index, start, ids, doc tokens, sequence, offset, tier)."""

    def __init__(self, emit, window: int = WINDOW, tiers=TIERS, pool: int = POOL):
        self.emit, self.window, self.tiers, self.pool = emit, window, sorted(tiers), pool
        self.rests: list[tuple[int, int]] = []  # (length, index into held), sorted
        self.held: dict[int, tuple] = {}
        self.sequence = self.next = 0

    def add(self, doc, ids: bytes) -> None:
        total, step = len(ids) // 4, self.window
        full = total - total % step
        for at in range(0, full, step):
            self.emit(doc, at, ids[at * 4 : (at + step) * 4], total, self.sequence, 0, step)
            self.sequence += 1
        if full < total:
            self._hold((doc, full, ids[full * 4 :], total))
        if len(self.rests) >= self.pool:
            self.pack(self.pool // 8)

    def _hold(self, rest: tuple) -> None:
        self.held[self.next] = rest
        bisect.insort(self.rests, (len(rest[2]) // 4, self.next))
        self.next += 1

    def _take(self, i: int) -> tuple:
        return self.held.pop(self.rests.pop(i)[1])

    def pack(self, keep: int = 0) -> None:
        """Pack until ``keep`` rests remain; with 0, all of them."""
        while len(self.rests) > keep:
            first = self._take(-1)
            parts, used = [first], len(first[2]) // 4
            size = self.tiers[bisect.bisect_left(self.tiers, used)]
            while used < size and self.rests:
                gap = size - used
                i = bisect.bisect_right(self.rests, (gap, 1 << 62)) - 1
                if i >= 0:
                    parts.append(self._take(i))
                else:  # no rest is short enough: cut the shortest
                    doc, start, ids, total = self._take(0)
                    parts.append((doc, start, ids[: gap * 4], total))
                    self._hold((doc, start + gap, ids[gap * 4 :], total))
                used += len(parts[-1][2]) // 4
            self._close(parts, used)

    def _close(self, parts: list[tuple], used: int) -> None:
        """Write one sequence, or several cut at powers of two if the window stayed short."""
        room = at = 0
        tier = 0
        for doc, start, ids, total in parts:
            while ids:
                if not room:
                    room = tier = 1 << (used.bit_length() - 1)
                    at = 0
                n = min(room, len(ids) // 4)
                self.emit(doc, start, ids[: n * 4], total, self.sequence, at, tier)
                ids, start, at, room, used = ids[n * 4 :], start + n, at + n, room - n, used - n
                self.sequence += not room


def _step_group(partition: int, tier: int, nth: int, step_tokens: int) -> int:
    """Number of the group of a tier's ``nth`` sequence, unique over partitions and tiers."""
    return (partition << 5 | tier.bit_length()) << 32 | nth // max(1, step_tokens // tier)


def _pack_partition(path: str, window: int, tiers, step_tokens: int, end_id: int):
    def run(batches):
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        encode, end = _word_ids(path), np.array([end_id], dtype="<u4").tobytes()
        out: list[tuple] = []
        sequences: dict[int, int] = {}  # of each tier so far
        group = 0

        def emit(doc, start, ids, total, seq, at, tier):
            nonlocal group
            if not at:  # the pieces of a sequence follow each other
                nth = sequences[tier] = sequences.get(tier, -1) + 1
                group = _step_group(base >> 32, tier, nth, step_tokens)
            out.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + seq, at, tier, group))

        packer = Packer(emit, window, tiers)

        def flush():
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_SCHEMA)
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)
            out.clear()
            return batch

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(ids):
                packer.add(doc, encode(texts[i].as_py() or "") + end)
                if len(out) >= 20_000:
                    yield flush()
        packer.pack()
        yield flush()

    return run


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("step_group", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tokenizer_path: str | None = None, window: int = WINDOW, tiers=TIERS, step_tokens: int = STEP_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``.

    ``tier`` is the sequence's length. ``step_group`` numbers groups of
    ``step_tokens`` tokens in sequences of one tier; only the last group of a tier
    in an input partition is smaller.

    Defined cases: a null or empty text is the end id alone; null identifiers and
    repeated rows are documents like others; a text of any length is packed
    whole; an empty table gives an empty result; other columns are ignored.
    """
    path = tokenizer_path or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    return rows.mapInArrow(tidy(_pack_partition(path, window, tuple(tiers), step_tokens, end_id)), schema)


def op10_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
