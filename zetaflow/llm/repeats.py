"""Exact repeats of fixed-length windows across a corpus, without moving every window.

A window of ``width`` units (bytes or words) is repeated if the same sequence
starts anywhere else. The minimiser of a window, the smallest hash of its
``gram``-unit grams, depends on its content alone, so equal windows share it.
Consecutive windows with one minimiser at one place form a fragment; every
window belongs to exactly one.

1. Fragments are written once and counted by minimiser. A window whose minimiser
   occurs once is unique; most of the corpus ends here.
2. Equal fragments (by a 128-bit digest of their units) become one with a weight,
   the number of its occurrences.
3. The units of all fragments that share a minimiser, repeated ones included, are
   fetched, gathered by minimiser and given to ``resolve``, which compares the
   units themselves and tells for each window whether it occurs a second time.
   Its answer is joined back to every occurrence of the fragment.
4. Minimisers with very many distinct fragments would fill one task. Their
   fragments are cut finer by a longer gram and go through the same steps, as
   parts of the fragments they come from; the last gram is the window itself.

Counts are combined before every shuffle. Keys that hold very many rows (their
number is bounded by ``HEAVY_KEYS``) are joined by broadcast, all others by
shuffle, so no task gathers more than ``HEAVY_ROWS`` rows of a key or a share of
the input, whichever is more. Tables lie in few files (:func:`common.few`), as each
costs processes that the executor's JVM starts.

Rows with the same text (128-bit digest) are one node; their fragments count once
per row.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE_ROWS, discard, few, materialize

_BASE = 0x9E3779B97F4A7C15
_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)
#: Units handled at once; longer texts are cut with an overlap of one window.
_PART = 1 << 23
#: Minimisers with more distinct fragments are cut finer.
HOT_FRAGMENTS = 1000
#: Distinct fragments in a bucket given to ``resolve``.
BUCKET_FRAGMENTS = 4000
#: Fragments with their units, and pairs of a minimiser and its count, to a written file: about 10 MB.
UNIT_ROWS, COUNT_ROWS = FILE_ROWS // 4, FILE_ROWS * 4
#: A key with more rows than this, and than one in ``HEAVY_KEYS`` of all, is joined by broadcast.
HEAVY_ROWS, HEAVY_KEYS = 10_000, 10_000

#: (units, weights, first window's offset from the minimiser, windows) of a bucket's fragments -> a mask per fragment.
Resolve = Callable[[list, np.ndarray, np.ndarray, np.ndarray], list]
#: Units hashed together: texts are handled in chunks of about this many.
_CHUNK = 1 << 14


class Reader(NamedTuple):
    """How units are read from a text, or from the bytes of a range of units."""

    hashes: Callable  # -> (a 64-bit hash per unit, bytes that stand for the units, as many for each)
    cutter: Callable  # -> a function (lo, hi) -> bytes of a range of units


_RANGES = "array<struct<lo: int, hi: int>>"


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(most: int) -> dict[int, np.uint64]:
    out, n, p = {}, 1, _BASE
    while n <= most:
        out[n] = np.uint64(p)
        p, n = p * p % 2**64, n * 2
    return out


def rolling(u: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` units, put together from runs of 1, 2, 4, ... units."""
    power, run, n = _powers(length), u, 1
    out, done = None, 0
    count = len(u) - length + 1
    while n <= length:
        if length & n:  # the runs are laid one behind the other, the shortest first
            part = run[done : done + count]
            out = part if out is None else out * power[n] + part
            done += n
        if n * 2 <= length:
            run = run[:-n] * power[n] + run[n:]
        n *= 2
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def fragments(us: list[np.ndarray], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(number of the sequence, minimiser, first window, windows, place of the minimiser after the first window) of each
    fragment of several sequences of at most 2^24 units together."""
    size = np.array([len(u) for u in us])
    u = np.concatenate(us)
    if len(u) < width:
        return (np.array([], np.int64),) * 5
    begin = np.r_[0, np.cumsum(size)]
    grams = mix(rolling(u, gram))
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_min(keys, width - gram + 1) & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(us)), size)[: len(place)]
    inside = np.arange(len(place)) + width <= begin[1:][owner]
    cut = np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1]), True]
    edge = np.flatnonzero(cut)
    first, n = edge[:-1], np.diff(edge)
    keep = inside[first]
    first, n = first[keep], n[keep]
    return owner[first], grams[place[first]].view(np.int64), first - begin[owner[first]], n, place[first] - first


def _chunk_fragments(read: list[tuple], width: int, gram: int) -> tuple:
    """(text, anchor, digests, span, more) of the fragments of several (hashes, bytes); equal fragments of one text are
    one row, ``more`` their other places."""
    pieces = [(i, lo) for i, (u, _) in enumerate(read) for lo in range(0, max(1, len(u) - width + 1), _PART)]
    found: list = []
    at = 0
    while at < len(pieces):  # as many pieces at once as 24 bits can number
        to, units = at, 0
        while to < len(pieces) and (to == at or units + _PART + width < 1 << _PLACE_BITS):
            units += min(_PART + width - 1, len(read[pieces[to][0]][0]) - pieces[to][1])
            to += 1
        some = pieces[at:to]
        piece, anchor, first, n, place = fragments([read[i][0][lo : lo + _PART + width - 1] for i, lo in some], width, gram)
        owner, low = np.array([i for i, _ in some])[piece], np.array([lo for _, lo in some])[piece]
        found.append((owner, anchor, first + low, n, place))
        at = to
    owner, anchor, first, n, place = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
    step = next((len(raw) // len(u) for u, raw in read if len(u)), 1)
    raw = memoryview(b"".join([r for _, r in read]))
    base = np.r_[0, np.cumsum([len(u) for u, _ in read])][owner]
    a, b = ((base + first) * step).tolist(), ((base + first + n + width - 1) * step).tolist()
    digest = xxhash.xxh3_128_digest
    digests = np.frombuffer(b"".join([digest(raw[i:j]) for i, j in zip(a, b, strict=True)]), np.int64).reshape(-1, 2)
    span = first << 20 | n << 10 | place
    more: list = [None] * len(span)
    if len(np.unique(digests[:, 0] + owner * 0x9E3779B97F4A7C1)) < len(span):
        order = np.lexsort((first, digests[:, 1], digests[:, 0], owner))
        d, o = digests[order], owner[order]
        starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]).any(axis=1) | (o[1:] != o[:-1])])
        ends = np.r_[starts[1:], len(order)]
        for x, y in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            more[order[x]] = first[order[x + 1 : y]].astype(np.int32)
        keep = np.sort(order[starts])
        owner, anchor, digests, span, more = owner[keep], anchor[keep], digests[keep], span[keep], [more[i] for i in keep.tolist()]
    return owner, anchor, digests, span, more


def _chunks(values: list, reader: Reader):
    """(first, read) of runs of consecutive values of about ``_CHUNK`` units."""
    read, units, first = [], 0, 0
    for i, x in enumerate(values):
        read.append(reader.hashes(x))
        units += len(read[-1][0])
        if units >= _CHUNK:
            yield first, read
            read, units, first = [], 0, i + 1
    if read:
        yield first, read


_MORE = pa.list_(pa.int32())


def _fragment_rows(reader: Reader, width: int, gram: int):
    def run(batches):
        for batch in batches:
            nodes = batch.column(0)
            for lo, read in _chunks(batch.column(1).to_pylist(), reader):
                owner, anchor, digests, span, more = _chunk_fragments(read, width, gram)
                cols = [nodes.take(pa.array(owner + lo, pa.int64())), pa.array(anchor), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(span), pa.array(more, _MORE)]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "anchor", "c1", "c2", "span", "more"])

    return run


def _cut(reader: Reader, width: int):
    """Fetch the units of a text's wanted fragments."""
    names = ["anchor", "c1", "c2", "span", "m", "hot", "units"]

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(0), batch.column(1)
            edge, wanted = lists.offsets.to_numpy().tolist(), lists.values
            span = wanted.field("span").to_numpy()
            a, b = (span >> 20).tolist(), ((span >> 20) + (span >> 10 & 1023) + width - 1).tolist()
            units, begin = [], edge[0]
            for i in range(batch.num_rows):
                part = reader.cutter(texts[i].as_py())
                units += [part(a[j], b[j]) for j in range(edge[i], edge[i + 1])]
                if len(units) > 5000 or i == batch.num_rows - 1:
                    rows = wanted.slice(begin, len(units))
                    yield pa.RecordBatch.from_arrays([*(rows.field(c) for c in names[:-1]), pa.array(units, pa.binary())], names=names)
                    begin, units = begin + len(units), []

    return run


def _finer(reader: Reader, width: int, gram: int):
    """Fragments of fragments by a longer gram, with their units; places are counted within the fragment they come from."""
    names = ["o1", "o2", "anchor", "c1", "c2", "span", "more", "w", "units"]

    def run(batches):
        for batch in batches:
            data, weight = batch.column("units").to_pylist(), batch.column("m").to_numpy()
            for lo, read in _chunks(data, reader):
                owner, anchor, digests, span, more = _chunk_fragments(read, width, gram)
                parts = [reader.cutter(x) for x in data[lo : lo + len(read)]]
                units = [parts[o](s >> 20, (s >> 20) + (s >> 10 & 1023) + width - 1) for o, s in zip(owner.tolist(), span.tolist(), strict=True)]
                places = np.array([1 if x is None else 1 + len(x) for x in more], np.int64)
                of = pa.array(owner + lo, pa.int64())
                cols = [batch.column("c1").take(of), batch.column("c2").take(of), pa.array(anchor), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(span), pa.array(more, _MORE), pa.array(weight[owner + lo] * places), pa.array(units, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _ranges(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RANGES_ARROW = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _resolve_bucket(resolve: Resolve):
    def run(group: pa.Table) -> pa.Table:
        span = group.column("span").to_numpy()
        masks = resolve(group.column("units").to_pylist(), group.column("m").to_numpy(), span & 1023, span >> 10 & 1023)
        some = np.array([bool(m.any()) for m in masks], bool)
        found = pa.array([_ranges(m) for m, s in zip(masks, some, strict=True) if s], _RANGES_ARROW)
        keep = pa.array(some)
        return pa.table([group.column("c1").filter(keep), group.column("c2").filter(keep), found], names=["c1", "c2", "ranges"])

    return run


def heavy(counts: DataFrame, key: list[str], total: int) -> DataFrame | None:
    """Keys of ``counts`` (key, of) that hold very many of ``total`` rows, at most ``HEAVY_KEYS``; None if there are none."""
    most = counts.filter(F.col("of") > max(HEAVY_ROWS, total // HEAVY_KEYS)).select(*key)
    got = most.collect()
    return F.broadcast(counts.sparkSession.createDataFrame(got, most.schema)) if got else None


def spread_join(rows: DataFrame, keyed: DataFrame, key: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed`` (one row a key): heavy keys by broadcast, where they lie; all others by shuffle."""
    if hot is None:
        return rows.join(keyed, key, how)
    there = rows.join(F.broadcast(keyed.join(hot, key, "left_semi")), key, how)
    if how != "inner":
        there = there.join(hot, key, "left_semi")
    return there.unionByName(rows.join(hot, key, "left_anti").join(keyed.join(hot, key, "left_anti"), key, how))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now, rather than at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_windows(texts: DataFrame, width: int, grams: tuple[int, ...], reader: Reader, ranges: Reader, resolve: Resolve, room: int = 1) -> tuple[DataFrame, DataFrame | None, int]:
    """(``node, spans``, heavy nodes, number of fragments): for each text with repeated windows, the ranges [lo, hi) of
    their first units.

    ``texts`` has ``node`` (binary) and ``text``. ``reader`` reads a text's units,
    ``ranges`` those of a range of units. ``grams`` grow up to ``width``. ``resolve``
    takes ``room`` times ``HOT_FRAGMENTS`` fragments of one minimiser.
    """
    spark = texts.sparkSession
    places = F.lit(1) + F.coalesce(F.size("more"), F.lit(0))
    rows = materialize(texts.mapInArrow(_fragment_rows(reader, width, grams[0]), "node binary, anchor long, c1 long, c2 long, span long, more array<int>"))
    copies = rows.filter(f"span < {1 << 20}").groupBy("node").agg(F.count(F.lit(1)).alias("of"))  # every text has a first fragment
    every = rows.count()
    crowded = heavy(copies, ["node"], every)

    def fetch(cut: DataFrame, n: int) -> DataFrame:
        wanted = materialize(few(cut.groupBy("node").agg(F.collect_list(F.struct("anchor", "c1", "c2", "span", "m", "hot")).alias("wanted")), n))
        release(spark)
        once = texts.groupBy("node").agg(F.first("text").alias("text"))
        cut = once.join(wanted, "node").select("text", "wanted").mapInArrow(_cut(reader, width), "anchor long, c1 long, c2 long, span long, m long, hot boolean, units binary")
        return few(cut, every)  # by the texts that it reads, of which fragments are the measure

    def solve(rows: DataFrame, owner: list[str], level: int) -> DataFrame:
        total = rows.count()
        each = UNIT_ROWS if level else FILE_ROWS
        shared = rows.groupBy("anchor").agg(F.sum("w").alias("c"), F.count(F.lit(1)).alias("of")).filter("c > 1").select("anchor", "of")
        shared = materialize(few(shared, total, COUNT_ROWS))
        kept = materialize(few(spread_join(rows, shared.select("anchor"), ["anchor"], heavy(shared, ["anchor"], total)), total, each))  # by the rows it reads
        discard(rows)
        rows, held = kept, kept.count()
        release(spark)
        at = F.struct(*owner, "span", *(["units"] if level else []))
        distinct = rows.groupBy("anchor", "c1", "c2").agg(F.sum("w").alias("m"), F.count(F.lit(1)).alias("holders"), F.min(at).alias("at")).select("anchor", "c1", "c2", "m", "holders", "at.*")
        distinct = materialize(few(distinct, held, each))
        n = distinct.count()
        release(spark)
        last = level == len(grams) - 1
        per = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("of")).select("anchor", "of", F.lit(False).alias("hot") if last else (F.col("of") > HOT_FRAGMENTS * room).alias("hot"))
        per = materialize(few(per, n, COUNT_ROWS))
        cut = spread_join(distinct.drop("holders"), per.select("anchor", "hot"), ["anchor"], heavy(per, ["anchor"], total))
        cut = materialize(few(cut, n, UNIT_ROWS) if level else fetch(cut, n))
        release(spark)
        calm, hot = cut.filter("not hot"), cut.filter("hot")
        buckets = max(1, -(-calm.count() // BUCKET_FRAGMENTS))
        marks = calm.withColumn("bucket", F.expr(f"cast(pmod(xxhash64(anchor), {buckets}) as int)")).groupBy("bucket").applyInArrow(_resolve_bucket(resolve), f"c1 long, c2 long, ranges {_RANGES}")
        if hot.head(1):
            finer = few(hot.select("c1", "c2", "m", "units"), hot.count(), UNIT_ROWS // 8, apart=True).mapInArrow(_finer(ranges, width, grams[level + 1]), "o1 long, o2 long, anchor long, c1 long, c2 long, span long, more array<int>, w long, units binary")
            below = solve(materialize(finer), ["o1", "o2"], level + 1)
            marks = marks.unionByName(below.select(F.col("o1").alias("c1"), F.col("o2").alias("c2"), F.col("spans").alias("ranges")))
        marks = materialize(few(marks, n, apart=True))
        busy = heavy(distinct.select("c1", "c2", F.col("holders").alias("of")), ["c1", "c2"], total)
        found = spread_join(rows.select(*owner, "c1", "c2", "span", "more"), marks, ["c1", "c2"], busy)
        first = F.explode(F.concat(F.array(F.expr("int(shiftright(span, 20))")), F.coalesce("more", F.array().cast("array<int>")))).alias("first")
        found = found.select(*owner, "ranges", first).select(*owner, F.transform("ranges", lambda r: F.struct((r.lo + F.col("first")).alias("lo"), (r.hi + F.col("first")).alias("hi"))).alias("ranges"))
        spans = materialize(few(found.groupBy(*owner).agg(F.flatten(F.collect_list("ranges")).alias("spans")), held))
        for done in (rows, distinct, cut, marks):
            discard(done)
        release(spark)
        return spans

    rows_w = rows.withColumn("w", places.cast("long"))
    rows_w.written = rows.written
    return solve(rows_w, ["node"], 0), crowded, every


def covered(spans: tuple[np.ndarray, np.ndarray], n: int, width: int) -> np.ndarray:
    """A mask over a text's ``n`` units: those in a window whose first unit is in a range [lo, hi) of ``spans``."""
    lo, hi = spans
    return np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi - 1 + width, minlength=n + 1))[:n] > 0


def finish(docs: DataFrame, spans: DataFrame, crowded: DataFrame | None, every: int, id_col: str, text, summarise, schema: str) -> DataFrame:
    """Per row of ``docs``, which holds ``every`` fragments, what ``summarise(text, spans)`` gives; ``summarise(text,
    None)`` serves texts without spans."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            edge, lo, hi = lists.offsets.to_numpy(), lists.values.field("lo").to_numpy(), lists.values.field("hi").to_numpy()
            rows = [summarise(texts[i].as_py(), (lo[a:b], hi[a:b]) if b > a else None) for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64() if c.endswith("long") else pa.string() for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), node_of(text).alias("node"))
    joined = spread_join(rows, spans, ["node"], crowded, "left").select("id", "text", "spans")
    kind = dict(rows.dtypes)["id"]
    return few(joined.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col), every)


def node_of(text):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))
