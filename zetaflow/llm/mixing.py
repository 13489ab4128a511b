"""Mixing sources to target weights with fixed-length blocks.

Every source's words form one stream (documents in hash order) cut into blocks
of ``block_words``. The mix consists of slots, each holding one block of one
source. Output shards draw their source counts from a multinomial over what each
source still has to give, so the totals are met exactly. Slot ``i`` of a source
reads block ``perm(i mod B)``, where ``perm`` is a keyed Feistel permutation of
the source's ``B`` blocks; a block repeats only
after all others were used, so a source repeated at most ``max_epochs`` times
gives no document more than that. Slots and document pieces are joined by
(source, block).

Word offsets are prefix sums in two levels of about sqrt(rows) each, so that no
task holds a whole source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, n_words, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK_WORDS = 256
MAX_EPOCHS = 3
N_SHARDS = 64
SEED = 20240607
_ROUNDS = 4


def targets(sizes: list[int], weights: list[float], max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Shares of all words by weight; a target stops at ``max_epochs`` times its source's size and the excess is reshared."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = sum(weights[i] for i in free)
        want = {i: left * weights[i] / share for i in free}
        over = [i for i in free if want[i] > max_epochs * sizes[i]]
        if not over:
            for i in free:
                out[i] = want[i]
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
        free -= set(over)
    return out


def _half_bits(blocks: int) -> int:
    return max(1, math.ceil(max(1, (blocks - 1).bit_length()) / 2))


def _keys(source_rank: int, seed: int) -> list[int]:
    return [int(x) for x in np.random.Generator(np.random.PCG64([seed, source_rank])).integers(1, 2**31, _ROUNDS)]


def _mixed(half_word: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (half_word.astype(np.uint64) * np.array([0x9E3779B97F4A7C15], np.uint64)) ^ np.uint64(key * 0xBF58476D1CE4E5B9 % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.array([0x94D049BB133111EB], np.uint64)
    return ((x >> np.uint64(29)) & np.uint64(mask)).astype(np.int64)


def permute(index: np.ndarray, blocks: int, keys: list[int], back: bool = False) -> np.ndarray:
    """Keyed Feistel permutation of range(blocks), walking the cycle while outside the range; ``back`` inverts it."""
    half = _half_bits(blocks)
    mask = (1 << half) - 1
    out = np.array(index, dtype=np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in reversed(keys) if back else keys:
            left, right = (right ^ _mixed(left, k, mask), left) if back else (right, left ^ _mixed(right, k, mask))
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= blocks]
    return out


def plan(sizes: list[int], goals: list[float], block: int, shards: int, seed: int) -> list[dict]:
    """Per source: blocks, slots, words of the last slot, permutation keys and slots per shard."""
    rows = []
    for rank, (size, goal) in enumerate(zip(sizes, goals, strict=True)):
        blocks = -(-size // block)
        keys = _keys(rank, seed)
        want = min(int(math.floor(goal + 0.5)), MAX_EPOCHS * size)
        slots, last = 0, 0
        if blocks and want:
            epochs, rest = divmod(want, size)
            slots = epochs * blocks
            if rest:
                short = size - (blocks - 1) * block
                at = int(permute(np.array([blocks - 1]), blocks, keys, back=True)[0])
                given = lambda m: m * block - (block - short if m > at else 0)
                m = max(1, -(-rest // block))
                while given(m) < rest:
                    m += 1
                slots, last = slots + m, rest - given(m - 1)
        rows.append({"rank": rank, "blocks": blocks, "slots": slots, "cut_slot": slots - 1 if last else -1, "cut_words": last, "keys": keys})
    left = np.array([r["slots"] for r in rows], dtype=np.int64)
    rng = np.random.Generator(np.random.PCG64([seed, 7]))
    draws = np.zeros((shards, len(rows)), dtype=np.int64)
    for s in range(shards):
        room = int(left.sum()) if s == shards - 1 else round(int(left.sum()) / (shards - s))
        while room:  # draws beyond what a source has left are drawn again among the others
            got = np.minimum(rng.multinomial(room, left / left.sum()), left)
            draws[s] += got
            left -= got
            room -= int(got.sum())
    for r in rows:
        r["per_shard"] = [int(x) for x in draws[:, r["rank"]]]
    return rows


def _two_level_offsets(rows: DataFrame) -> DataFrame:
    """``start``: words before the row in its source; ``pos``: a row number within (source, bucket)."""
    by = Window.partitionBy("rank", "bucket").orderBy("h", "id", "size")
    placed = rows.withColumn("pos", F.row_number().over(by)).withColumn("within", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("rank", "bucket", (F.sum("words").over(before) - F.col("words")).alias("base"))
    return placed.join(sums, ["rank", "bucket"]).withColumn("start", F.col("base") + F.col("within")).drop("base", "within")


def mix_plan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights=WEIGHTS, block_words: int = BLOCK_WORDS, shards: int = N_SHARDS, seed: int = SEED, payload: bool = False):
    """(slots, rows): ``slots`` has rank, shard, slot, block, epoch, take; ``rows`` has the documents with their word offsets.

    The list of sources (one row each, with a size) goes to the driver: it is the
    mixing table, as long as the list of weights someone would write down.
    """
    spark = docs.sparkSession
    count = max(1, docs.count())
    buckets = max(1, math.isqrt(count))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"), *([F.struct(*docs.columns).alias("row")] if payload else []))
    if not payload:
        rows = materialize(rows)  # without the texts: words are counted once
    sizes = rows.groupBy("src").agg(F.sum("size").alias("size")).collect()
    sizes = sorted(((r["src"], int(r["size"])) for r in sizes), key=lambda x: (x[0] is None, x[0] or ""))  # code points; null last
    goals = targets([s for _, s in sizes], [weights[i % len(weights)] for i in range(len(sizes))])
    planned = plan([s for _, s in sizes], goals, block_words, shards, seed)
    known = spark.createDataFrame([(r["rank"], src, size, goal) for r, (src, size), goal in zip(planned, sizes, goals, strict=True)], "rank int, known string, source_size long, target double")
    rows = rows.join(F.broadcast(known), F.col("src").eqNullSafe(F.col("known"))).drop("known")
    rows = rows.withColumn("bucket", F.expr(f"cast(pmod(h, {buckets}L) as int)"))
    rows = _two_level_offsets(rows)

    spec, given = [], [0] * len(planned)
    for s in range(shards):
        for r in planned:
            n = r["per_shard"][s]
            if n:
                spec.append((r["rank"], s, given[r["rank"]], n, r["blocks"], r["cut_slot"], r["cut_words"], r["keys"]))
                given[r["rank"]] += n
    slots = spark.createDataFrame(spec, "rank int, shard int, first long, n long, blocks long, cut_slot long, cut_words long, keys array<long>")
    slots = slots.repartition(max(1, min(len(spec), spark.sparkContext.defaultParallelism * 4))).mapInArrow(_draw(block_words), "rank int, shard int, slot long, block long, epoch int, take long")
    return slots, rows


def _draw(block_words: int):
    """Slots of (source, shard) draws: consecutive indices through the source's permutation, in bounded batches."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for lo in range(r["first"], r["first"] + r["n"], 1 << 16):
                    slot = np.arange(lo, min(lo + (1 << 16), r["first"] + r["n"]), dtype=np.int64)
                    take = np.where(slot == r["cut_slot"], r["cut_words"], block_words)
                    cols = [np.full(len(slot), r["rank"], np.int32), np.full(len(slot), r["shard"], np.int32), slot, permute(slot % r["blocks"], r["blocks"], r["keys"]), (slot // r["blocks"]).astype(np.int32), take]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rank", "shard", "slot", "block", "epoch", "take"])

    return run


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Explode each document over the blocks it covers: block, lo, hi (words within the block)."""
    spans = rows.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
    lo = F.expr(f"greatest(start - block * {block_words}L, 0L)")
    hi = F.expr(f"least(start + size - block * {block_words}L, {block_words}L)")
    return spans.withColumn("lo", lo).withColumn("hi", hi)


def mix_counts(docs: DataFrame, block_words: int = BLOCK_WORDS, **more) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` (words the mix takes, repeats counted) and its ``epochs_max``.

    Defined cases: a null text has size 0 and is never taken; a null source is a
    source of its own, ranked last; a null identifier is an identifier like any
    other; repeated rows are documents of their own; an empty table gives an
    empty result; columns other than those named are ignored.
    """
    if not docs.head(1):
        return docs.sparkSession.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long")
    slots, rows = mix_plan(docs, block_words=block_words, **more)
    used = slots.groupBy("rank", "block").agg(F.sum(F.when(F.col("take") == block_words, 1).otherwise(0)).alias("times"), F.max(F.when(F.col("take") < block_words, F.col("take")).otherwise(0)).alias("cut"))
    cover = pieces(rows.select("id", "rank", "bucket", "pos", "size", "start"), block_words)
    hit = cover.join(used.hint("merge"), ["rank", "block"])  # the blocks grow with the input; never broadcast
    got = hit.groupBy("rank", "bucket", "pos").agg(F.sum(F.expr("times * (hi - lo) + greatest(least(hi, cut) - lo, 0L)")).cast("long").alias("taken"))
    out = rows.join(got, ["rank", "bucket", "pos"], "left")
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, **more) -> DataFrame:
    """The mixed corpus itself: one row per slot piece with ``shard, slot, doc_id, text`` in mix order.

    The words of a piece are joined by one space. Same defined cases as :func:`mix_counts`.
    """
    text_col = more.get("text_col", "text")
    slots, rows = mix_plan(docs, block_words=block_words, payload=True, **more)
    piece = F.struct("shard", "slot", "lo", *_words_of_piece(block_words))
    of = _placed(slots, rows, block_words).groupBy("rank", "bucket", "pos").agg(F.collect_list(piece).alias("pieces"))
    out = rows.select("id", "rank", "bucket", "pos", F.col("row").getField(text_col).alias("t")).join(of, ["rank", "bucket", "pos"])
    cut = _with_words("t", lambda words: F.transform("pieces", lambda p: F.struct(p.shard.alias("shard"), p.slot.alias("slot"), p.lo.alias("lo"), F.array_join(F.slice(words, p.first + 1, p.n), " ").alias("text"))))
    out = out.select("id", "rank", F.explode(cut).alias("p"))
    return out.select("p.shard", "rank", "p.slot", "p.lo", F.col("id").alias("doc_id"), "p.text")


def _placed(slots: DataFrame, rows: DataFrame, block_words: int) -> DataFrame:
    """Pieces of documents that a slot takes; neither words nor other columns travel with them."""
    cover = pieces(rows.select("rank", "bucket", "pos", "size", "start"), block_words)
    return slots.hint("merge").join(cover, ["rank", "block"]).withColumn("hi", F.least("hi", "take")).filter("hi > lo")


def _words_of_piece(block_words: int) -> tuple[Column, Column]:
    """(first word of a piece within its document, number of words)."""
    return F.expr(f"int(block * {block_words}L + lo - start)").alias("first"), (F.col("hi") - F.col("lo")).cast("int").alias("n")


def _with_words(text: str, use) -> Column:
    """``use`` applied to the words of a text, which are split once a row however often they are used."""
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), 0)), use)[0]


def mixed_documents(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars", block_words: int = BLOCK_WORDS, **more) -> DataFrame:
    """The mix as documents: a row per document and epoch it is taken in, with the columns of ``docs``.

    A document taken whole keeps its text; of one taken in part, the taken words
    stay, in order, joined by one space, and ``n_chars_col`` (if there) is their
    length. Same defined cases as :func:`mix_counts`.
    """
    if not docs.head(1):
        return docs
    slots, rows = mix_plan(docs, text_col=text_col, block_words=block_words, payload=True, **more)
    first, n = _words_of_piece(block_words)
    spans = _placed(slots, rows, block_words).groupBy("rank", "bucket", "pos", "epoch").agg(F.sort_array(F.collect_list(F.struct(first, n))).alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("words"))
    out = rows.select("rank", "bucket", "pos", "size", "row").join(spans, ["rank", "bucket", "pos"])
    out = out.withColumn("t", F.col("row").getField(text_col))
    part = _with_words("t", lambda words: F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, s.first + 1, s.n))), " "))
    out = out.withColumn("t", F.when(F.col("words") == F.col("size"), F.col("t")).otherwise(part))
    new = {text_col: F.col("t")}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.length("t").cast(docs.schema[n_chars_col].dataType)
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op1_mixing(spark, sf_dir):
    return mix_counts(table(spark, sf_dir, "documents"))
