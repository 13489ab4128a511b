"""Near-duplicates by weighted MinHash over TF-IDF shingles.

1. Document frequencies of all shingles go into a count sketch of a fixed size.
   A weight is ``(1 + ln tf) * idf`` with an idf that is 1 up to a tenth of all
   documents and falls to a floor beyond; the sketch's error (its width against
   that tenth) doesn't depend on the size of the corpus. Where one group holds
   more than that tenth, its own shingles are the common ones, so a pair is also
   linked when it is similar with an idf of 1 throughout.
2. Improved consistent weighted sampling (Ioffe 2010) gives ``BANDS x ROWS``
   samples per document, and as many again with an idf of 1 where that differs.
   Its (r, c, beta) triples come from a table of 2^16 draws addressed by 16 hash
   bits per shingle and function; equal draws are told apart by the shingle, the
   same way in every document.
3. Texts that share a band are candidates. Pairs with a few pivots of each
   bucket are verified first, by exact weighted Jaccard similarity; they join
   most of a large group at the cost of one pair per member. Then, in buckets
   whose members are still apart, every member outside the largest class is held
   against all members of other classes, block by block inside a task, so no link
   is lost; only links that join classes are emitted.
4. Classes are the connected components, by rounds of distributed label passing.

Rows with the same text are one node throughout, and never expanded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, fresh, materialize, table, text_or_empty, tidy

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
IDF_SHARE, IDF_FLOOR = 0.1, 0.1
SKETCH_ROWS, SKETCH_BITS = 4, 15
SEED = 17
#: Written tables of nodes and labels up to this many rows (under 10 MB) are broadcast.
BROADCAST_ROWS = 100_000
#: Rounds in which every bucket's members are held against one pivot.
PIVOT_ROUNDS = 2
#: Members of a bucket handled in one task, on either side.
BLOCK = 2000
_CHUNKS = 8
_DRAWS = 1 << 16

_P = np.uint64(0x9E3779B97F4A7C15)



def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of a lower-cased text, and their counts.

    A text of fewer words has one shingle of all of them; one without words has none.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.array([], np.uint64), np.array([], np.int64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    h = w[: n - k + 1].copy()
    for i in range(1, k):
        h = h * _P + w[i : n - k + 1 + i]
    return np.unique(_mix(h), return_counts=True)


_rng = np.random.Generator(np.random.PCG64(SEED))
_SKETCH_MUL = _rng.integers(1, 2**63, SKETCH_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FUNCTION_MUL = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _rng.gamma(2.0, 1.0, _DRAWS)
_LN_C = np.log(_rng.gamma(2.0, 1.0, _DRAWS))
_BETA = _rng.random(_DRAWS)
_LN_A_ONE = (_LN_C + _R * _BETA - _R).astype(np.float32)  # ln a of a shingle of weight 1


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return (h * _SKETCH_MUL[row] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch_partition(batches):
    """Per task: how many documents hold a shingle of each cell, in compressed chunks."""
    counts = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), dtype=np.int64)
    docs = total = 0
    for batch in batches:
        texts = batch.column(0)
        for i in range(batch.num_rows):
            h, _ = shingles(texts[i].as_py() or "")
            docs += 1
            total += len(h)
            for r in range(SKETCH_ROWS):
                c = _cells(h, r)
                counts[r] += np.bincount(c, minlength=1 << SKETCH_BITS) if len(c) > 2000 else 0
                if len(c) <= 2000:
                    np.add.at(counts[r], c, 1)
    salt = TaskContext.get().partitionId() % 16
    width = (1 << SKETCH_BITS) // _CHUNKS
    rows = [(r * _CHUNKS + c, salt, zlib.compress(counts[r, c * width : (c + 1) * width].tobytes(), 1)) for r in range(SKETCH_ROWS) for c in range(_CHUNKS)] if docs else []
    if docs:
        rows.append((-1, salt, zlib.compress(np.array([docs, total], np.int64).tobytes())))
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "salt", "counts"])


def _add_up(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(b.as_py()), np.int64) for b in group.column("counts"))
    return pa.table({"chunk": group.column("chunk")[:1], "salt": group.column("salt")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


class Idf:
    """idf of shingle hashes from the sketch."""

    def __init__(self, docs: int, total: int, counts: np.ndarray):
        self.docs, self.noise, self.counts = docs, total / counts.shape[1] if counts.size else 0.0, counts

    def __call__(self, h: np.ndarray) -> np.ndarray:
        df = np.min([self.counts[r, _cells(h, r)] for r in range(SKETCH_ROWS)], axis=0) - self.noise
        share = np.maximum(df, 1.0) / max(1, self.docs)
        return np.where(share <= IDF_SHARE, 1.0, np.maximum(np.log(np.minimum(share, 1.0)) / np.log(IDF_SHARE), IDF_FLOOR))


def document_frequencies(texts: DataFrame) -> Idf:
    """Sketch over every row of a one-column frame of texts; what reaches the driver has a fixed size."""
    schema = "chunk int, salt int, counts binary"
    parts = texts.mapInArrow(tidy(_sketch_partition), schema)
    parts = parts.groupBy("chunk", "salt").applyInArrow(_add_up, schema).groupBy("chunk").applyInArrow(_add_up, schema).collect()
    counts = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), dtype=np.int64)
    docs = total = 0
    width = (1 << SKETCH_BITS) // _CHUNKS
    for p in parts:
        got = np.frombuffer(zlib.decompress(bytes(p["counts"])), np.int64)
        if p["chunk"] < 0:
            docs, total = int(got[0]), int(got[1])
        else:
            r, c = divmod(p["chunk"], _CHUNKS)
            counts[r, c * width : (c + 1) * width] = got
    return Idf(docs, total, counts)


def both_weights(text: str, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, their weights, and those with an idf of 1; the same array twice where they are equal."""
    h, tf = shingles(text)
    plain = 1.0 + np.log(tf)
    w = plain * idf(h) if len(h) else plain
    return h, w, w if (w == plain).all() else plain


def weights(text: str, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    return both_weights(text, idf)[:2]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity; two texts without words are equal."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (total - both))


def alike(a: tuple, b: tuple, least: float) -> bool:
    """Whether two texts of ``both_weights`` are linked: similar by weight, or with an idf of 1."""
    if similarity(a[:2], b[:2]) >= least:
        return True
    return (a[1] is not a[2] or b[1] is not b[2]) and similarity(a[::2], b[::2]) >= least


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One consistent weighted sample per function, as a hash of (shingle, quantised weight)."""
    return _samples(h, [w])[0]


def _samples(h: np.ndarray, weightings: list[np.ndarray]) -> np.ndarray:
    """The samples of each weighting of the same shingles; what holds at weight 1 is worked out once for all."""
    k = len(_FUNCTION_MUL)
    best, out = np.full((len(weightings), k), np.inf), np.zeros((len(weightings), k), np.uint64)
    for lo in range(0, len(h), 1 << 14):
        part = h[lo : lo + (1 << 14)]
        draw = (part[None, :] * _FUNCTION_MUL[:, None]) >> np.uint64(48)
        ones = _LN_A_ONE[draw.view(np.int64)]
        for m, w in enumerate(weightings):
            pw = w[lo : lo + (1 << 14)]
            ln_a = ones if m == len(weightings) - 1 else ones.copy()
            other = np.flatnonzero(pw != 1.0)
            if len(other):
                d = draw[:, other].view(np.int64) if len(other) == len(part) else draw[:, other].astype(np.int64)
                ln_w = np.log(pw[other])
                t = np.floor(ln_w / _R[d] + _BETA[d])
                ln_a[:, other] = (_LN_C[d] - _R[d] * (t - _BETA[d]) - _R[d]).astype(np.float32)
            at = np.argmin(ln_a, axis=1)
            low = ln_a[np.arange(k), at]
            d = draw[np.arange(k), at].astype(np.int64)
            t = np.floor(np.log(pw[at]) / _R[d] + _BETA[d]).astype(np.int64)
            found = _mix(part[at] + t.astype(np.uint64) * _P)
            better = low < best[m]
            best[m, better], out[m, better] = low[better], found[better]
    return out


def band_keys(h: np.ndarray, *weightings: np.ndarray) -> np.ndarray:
    """The bands of all weightings, in one key space: equal samples are equal whatever the weighting."""
    s = _samples(h, list(weightings)).reshape(len(weightings), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for r in range(ROWS):
        key = _mix((key ^ s[:, :, r]) * _P)
    return key.view(np.int64).ravel()


def _bands(idf: Idf):
    def run(batches):
        for batch in batches:
            texts, rows = batch.column(1), []
            for i in range(batch.num_rows):
                h, w, plain = both_weights(texts[i].as_py(), idf)
                rows.append(np.array([], np.int64) if not len(h) else band_keys(h, w) if plain is w else np.unique(band_keys(h, w, plain)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["node", "bands"])

    return run


def _verify(idf: Idf, least: float):
    def run(batches):
        known: dict[bytes, tuple] = {}

        def of(node: bytes, text) -> tuple:
            if node not in known:
                if len(known) >= 256:
                    known.clear()
                known[node] = both_weights(text.as_py(), idf)
            return known[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            good = [alike(of(a[i], ta[i]), of(b[i], tb[i]), least) for i in range(batch.num_rows)]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def small(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has at most ``BROADCAST_ROWS`` short rows; beyond that joins shuffle it."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node each node is connected to."""
    rows = 2 * edges.count()
    both = materialize(few(edges.select("a", "b").union(edges.select("b", "a")).distinct(), rows))
    labels = materialize(few(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), rows))
    while True:
        known = small(labels)
        near = both.join(known, both.b == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        step = near.join(known, near.a == F.col("node")).select("node", "comp", F.least("comp", "m").alias("next"))
        jump = small(labels.select(F.col("node").alias("at"), F.col("comp").alias("further")))  # the label of the label
        new = step.join(jump, F.col("next") == F.col("at"), "left")
        best = F.least("next", F.coalesce("further", "next"))
        new = materialize(few(new.select("node", best.alias("comp"), (F.col("comp") != best).alias("moved")), rows))
        if not new.filter("moved").head(1):
            return labels
        labels = new.select("node", "comp")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id`` (the smallest identifier of its class).

    Defined cases: a null text counts as empty, and texts without words are one
    class when equal; a text of fewer than five words is one shingle; repeated
    rows and equal texts share a class; a null identifier never names a class
    unless all its identifiers are null; an empty table gives an empty result;
    other columns are ignored.
    """
    ids = docs.select(F.col(id_col).alias("id"), _node(text_col).alias("node"))
    named, rows = _named(docs, text_col, id_col, least)
    return few(ids.join(named, "node").select(F.col("id").alias(id_col), "class_id"), rows)


def _node(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col)))


def _named(docs: DataFrame, text_col: str, id_col: str, least: float) -> tuple[DataFrame, int]:
    """(node, class_id, head): of each distinct text, its class and the first node that holds the class's identifier.
    With it, the number of rows of ``docs``."""
    text, node = text_or_empty(text_col), _node(text_col)
    idf = document_frequencies(docs.select(text.alias("t")))
    rows = docs.select(node.alias("node"), text.alias("t"))
    members = materialize(rows.mapInArrow(tidy(_bands(idf)), "node binary, bands array<long>")).select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min(F.xxhash64("node")).alias("lo"), F.max(F.xxhash64("node")).alias("hi")).filter("lo <> hi").select("band")
    members = materialize(few(members.join(shared, "band").distinct(), 2 * BANDS * idf.docs))
    most = members.count()
    texts = rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("t").alias("t"))
    texts = materialize(few(texts, min(most, idf.docs), BLOCK))

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
        full = left.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")
        return materialize(few(full.mapInArrow(tidy(_verify(idf, least)), "a binary, b binary"), most, apart=True))

    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    tested = edges = None
    for turn in range(PIVOT_ROUNDS):  # pivots: linear in the members; those already joined to their pivot leave the bucket
        left = members
        if edges is not None:
            left = _apart(members, components(edges), most)
        pick = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("p")))
        pivots = left.groupBy("band").agg(pick.alias("x")).select("band", F.col("x.p").alias("p"))
        pairs = left.join(materialize(few(pivots, most)), "band").filter("node <> p").select(*ordered("node", "p")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(few(pairs, most))
        tested = pairs if tested is None else tested.union(pairs)
        found = verified(pairs)
        edges = found if edges is None else edges.union(found)

    left = _apart(members, components(edges), most, keep_comp=True)
    edges = edges.union(_link_rest(left, texts, idf, least))

    labels = components(edges)
    ids = docs.select(F.col(id_col).alias("id"), node.alias("node"))
    nodes = ids.groupBy("node").agg(F.min("id").alias("low")).join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    nodes = materialize(few(nodes, idf.docs))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node")).alias("x")
    lowest = nodes.groupBy("comp").agg(first).select("comp", F.col("x.low").alias("class_id"), F.col("x.node").alias("head"))
    lowest = materialize(few(lowest, idf.docs))
    return materialize(few(nodes.join(lowest, "comp").select("node", "class_id", "head"), idf.docs)), idf.docs


def _link_rest(left: DataFrame, texts: DataFrame, idf: Idf, least: float) -> DataFrame:
    """Links that still join classes within buckets (band, node, comp): every member outside a bucket's largest
    class is held against all members of other classes, in blocks of at most ``BLOCK`` on either side."""
    left = materialize(left)
    most = left.count()
    per = left.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("band").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("size"))
    main = materialize(few(main.select("band", F.col("m.comp").alias("main"), "size", (F.col("size") - F.col("m.c")).alias("others")), most))
    bins = max(1, -(-most // BLOCK))
    rows = left.join(small(main), "band").withColumn("is_query", F.col("comp") != F.col("main"))
    near = rows.filter(F.col("size") <= BLOCK).select(F.expr(f"pmod(xxhash64(band), {bins}L)").alias("bin"), F.lit(0).alias("qb"), F.lit(0).alias("mb"), "band", "node", "comp", "is_query", F.lit(True).alias("is_member"))
    wide = rows.filter(F.col("size") > BLOCK).withColumn("nq", F.expr(f"cast(ceil(others / {BLOCK}) as int)")).withColumn("nm", F.expr(f"cast(ceil(size / {BLOCK}) as int)"))
    of = lambda n: F.expr(f"cast(pmod(xxhash64(7, node), {n}) as int)")
    asks = wide.filter("is_query").select(F.col("band").alias("bin"), of("nq").alias("qb"), F.explode(F.expr("sequence(0, nm - 1)")).alias("mb"), "band", "node", "comp", "is_query", F.lit(False).alias("is_member"))
    held = wide.select(F.col("band").alias("bin"), F.explode(F.expr("sequence(0, nq - 1)")).alias("qb"), of("nm").alias("mb"), "band", "node", "comp", F.lit(False).alias("is_query"), F.lit(True).alias("is_member"))
    work = near.union(asks).union(held).join(texts, "node")
    return materialize(few(work.groupBy("bin", "qb", "mb").applyInArrow(_links(idf, least), "a binary, b binary"), most, apart=True))


def _links(idf: Idf, least: float):
    """Links that join classes of one group, as few as join them: a class joined already is not compared again."""

    def band_links(nodes, comps, is_query, is_member, texts) -> list[tuple]:
        found = [both_weights(t, idf) for t in texts]
        size = np.array([len(h) for h, _, _ in found])
        words, ids = np.unique(np.concatenate([h for h, _, _ in found]), return_inverse=True)
        owner = np.repeat(np.arange(len(nodes)), size)
        weightings = [np.concatenate([x[1] for x in found])]
        if any(w is not plain for _, w, plain in found):
            weightings.append(np.concatenate([x[2] for x in found]))
        totals = [np.bincount(owner, w, len(nodes)) for w in weightings]
        begin = np.r_[0, np.cumsum(size)]
        _, root = np.unique(np.array(comps, dtype=object), return_inverse=True)
        out = []
        for q in np.flatnonzero(is_query):
            open_ = is_member & (root != root[q])
            if not open_.any():
                continue
            near = np.zeros(len(nodes), bool)
            for w, total in zip(weightings, totals, strict=True):
                dense = np.zeros(len(words))
                dense[ids[begin[q] : begin[q + 1]]] = w[begin[q] : begin[q + 1]]
                both = np.bincount(owner, np.minimum(w, dense[ids]), len(nodes))
                near |= both >= least * (total + total[q] - both)
            for y in np.flatnonzero(open_ & near):
                if root[y] != root[q]:
                    out.append((nodes[q], nodes[y]))
                    root[root == root[y]] = root[q]
        return out

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("band", "ascending"), ("node", "ascending")])
        band = group.column("band").to_numpy()
        nodes, comps, texts = (group.column(c).to_pylist() for c in ("node", "comp", "t"))
        is_query, is_member = (group.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_query", "is_member"))
        edge = np.flatnonzero(np.r_[True, band[1:] != band[:-1], True])
        out = [x for lo, hi in zip(edge[:-1], edge[1:], strict=True) for x in band_links(nodes[lo:hi], comps[lo:hi], is_query[lo:hi], is_member[lo:hi], texts[lo:hi])]
        cols = list(zip(*out, strict=True)) or [[], []]
        return pa.table({"a": pa.array(cols[0], pa.binary()), "b": pa.array(cols[1], pa.binary())})

    return run


def _apart(members: DataFrame, labels: DataFrame, most: int, keep_comp: bool = False) -> DataFrame:
    """Members of buckets whose members are in more than one class so far; all of those buckets' members (of ``most`` rows)."""
    placed = members.join(small(labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    placed = materialize(few(placed, most))
    split = placed.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
    out = placed.join(small(materialize(few(split, most))), "band")
    return out if keep_comp else out.drop("comp")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """One row of each class, all columns unchanged: one with its smallest identifier.

    Defined cases: rows are told apart by identifier and text, so a null or
    repeated identifier in one class says nothing about rows of another; where
    texts of a class share its identifier, the smallest digest stays, and of equal
    rows one; a class without any identifier keeps one row too.
    """
    named, most = _named(docs, text_col, id_col, least)
    id_, node_, row_ = fresh(docs, "of_id", "of_node", "of_row")
    rows = docs.select(F.col(id_col).alias(id_), _node(text_col).alias(node_)).groupBy(id_, node_).agg(F.count(F.lit(1)).alias("n"))
    is_head = F.col(id_).eqNullSafe(F.col("class_id")) & (F.col(node_) == F.col("head"))
    placed = rows.join(named, F.col(node_) == F.col("node")).select(id_, node_, is_head.alias("is_head"), "n")
    drop = materialize(few(placed.filter("not is_head or n > 1").drop("n"), most))
    same = docs[id_col].eqNullSafe(F.col(id_)) & (_node(text_col) == F.col(node_))
    kept = docs.join(small(drop.select(id_, node_)), same, "left_anti")
    repeated = drop.filter("is_head").select(id_, node_)
    if not repeated.head(1):
        return kept
    one = docs.join(small(repeated), same).groupBy(id_, node_).agg(F.first(F.struct(*(docs[c] for c in docs.columns))).alias(row_))
    return kept.union(one.select(f"{row_}.*"))


def op3_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
