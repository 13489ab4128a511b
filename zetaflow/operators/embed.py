"""Static text embeddings: wordpieces, table lookup, mean pooling, frequency weights, quantisation.

The vocabulary is a table (piece, v) and a parameter; :func:`hashed_vocabulary`
makes one from MD5 digests, the same in every engine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of a frequent piece, longest word that is split.
SIF_A = 1e-3
LONGEST_WORD = 100


def hashed_component(piece: Column, i: int) -> Column:
    """Component ``i`` of a piece's vector: 32 bits of an MD5 digest scaled to [-1, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat(piece, F.lit(f"|{i}"))), 1, 8), 16, 10).cast("long")
    return bits / 2147483648.0 - 1.0


def hashed_vocabulary(pieces: DataFrame, dim: int) -> DataFrame:
    return pieces.select("piece", F.array(*(hashed_component(F.col("piece"), i) for i in range(dim))).alias("v"))


def normalize(text: str) -> str:
    """Drop controls and replacement characters, blanks to spaces, CJK apart, lower case, no marks."""
    out = []
    for c in text:
        if c in "\x00�" or (unicodedata.category(c) == "Cc" and c not in "\t\n\r"):
            continue
        code = ord(c)
        if c.isspace():
            out.append(" ")
        elif 0x4E00 <= code <= 0x9FFF or 0x3400 <= code <= 0x4DBF or 0x20000 <= code <= 0x2CEAF or 0xF900 <= code <= 0xFAFF or 0x2F800 <= code <= 0x2FA1F:
            out.append(f" {c} ")
        else:
            out.append(c)
    low = unicodedata.normalize("NFD", "".join(out).lower())
    return "".join(c for c in low if unicodedata.category(c) not in ("Mn", "Mc", "Me"))


def pretokenize(text: str) -> list[str]:
    """Words between blanks, with every punctuation mark a token of its own."""
    out: list[str] = []
    word = ""
    for c in text + " ":
        mark = unicodedata.category(c).startswith("P") or (ord(c) < 128 and c.isprintable() and not c.isalnum() and not c.isspace())
        if (c.isspace() or mark) and word:
            out.append(word)
            word = ""
        if mark:
            out.append(c)
        elif not c.isspace():
            word += c
    return out


def wordpieces(word: str, vocabulary, unknown: str = "[UNK]") -> list[str]:
    """Greedy longest matches, continuations marked ``##``; a tail that matches nothing is one unknown after the pieces found."""
    if len(word) > LONGEST_WORD:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return [*out, unknown]
    return out


def encode(texts: DataFrame, vocabulary: dict[str, np.ndarray], id_col: str, text_col: str, classify: str | None = None, separate: str | None = None) -> DataFrame:
    """``id, v``: (start + sum of piece rows + end) / pieces; start and end don't count, no pieces divide by 1.

    The vocabulary goes to every task; its size is a parameter of the encoder,
    not of the data.
    """
    dim = len(next(iter(vocabulary.values())))
    edge = sum((vocabulary[x] for x in (classify, separate) if x), np.zeros(dim))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                pieces = [p for w in pretokenize(normalize(text or "")) for p in wordpieces(w, vocabulary)]
                known = [vocabulary[p] for p in pieces if p in vocabulary]
                rows.append(((edge + np.sum(known, axis=0) if known else edge) / max(1, len(pieces))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "v"])

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, v array<double>")


def pooled(tokens: DataFrame, vocabulary: DataFrame, dim: int) -> DataFrame:
    """``id, v`` by joining tokens (id, piece) to a vocabulary table and averaging; unknown pieces count but add nothing."""
    hit = tokens.groupBy("id", "piece").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "piece", "left")
    sums = [F.sum(F.coalesce(F.col("v")[i], F.lit(0.0)) * F.col("n")) for i in range(dim)]
    return hit.groupBy("id").agg(F.sum("n").alias("pieces"), F.array(*sums).alias("s")).select("id", F.transform("s", lambda x: x / F.col("pieces")).alias("v"))


def sif_weights(frequencies: DataFrame, a: float = SIF_A) -> DataFrame:
    """Weight a / (a + p) of each piece (piece, freq)."""
    total = frequencies.agg(F.sum("freq").alias("_total"))
    return frequencies.crossJoin(F.broadcast(total)).select("piece", (a / (a + F.col("freq") / F.col("_total"))).alias("w"))


def quantize(x: Column, low: Column, scale: Column) -> Column:
    return F.floor((x - low) / scale + 0.5).cast("int")


def dequantize(q: Column, low: Column, scale: Column) -> Column:
    return low + q * scale
