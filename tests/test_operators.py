"""Operators on small hand-made inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zetaflow.functions import text as T
from zetaflow.functions import vector as V
from zetaflow.operators import atlas, bm25, embed, fusion, ingest, knn, metrics, zset
from zetaflow.sources import files


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_top_k_counts_copies(spark):
    feed = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (2, 1), (5, 1), (5, -1)], "t int, _delta long")
    top = lambda f, k: sorted(tuple(r) for r in zset.top_k(f, k, [F.desc("t")]).collect())
    assert top(feed, 3) == [(3, 1), (4, 1), (5, 1)]
    assert top(feed, 5) == [(2, 2), (3, 1), (4, 1), (5, 1)]
    assert top(feed, 4) == [(2, 1), (3, 1), (4, 1), (5, 1)]


def test_stats_and_histogram(spark):
    feed = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 1)], "x double, _delta long")
    r = zset.stats(feed, F.col("x")).first()
    assert (r.n, r.total, r["mean"]) == (3, 6.0, 2.0) and math.isclose(r.variance, 2 / 3)
    r = zset.stats(feed.union(spark.createDataFrame([(2.0, -1)], feed.schema)), F.col("x")).first()
    assert (r["mean"], r.variance) == (2.0, 1.0)
    h = zset.histogram(spark.createDataFrame([(5, 1), (15, 1), (25, 2)], "s int, _delta long"), F.expr("s div 10"))
    assert {q.q: q.bucket for q in zset.quantiles(h, [0.0, 0.5, 1.0]).collect()} == {0.0: 0, 0.5: 1, 1.0: 2}


def test_last_push_wins(spark):
    feed = spark.createDataFrame([("v", 1, 1, 0), ("v", 1, 1, 1), ("v", 1, -1, 2), ("v", 2, 1, 3)], "value string, key int, _delta int, _seq int")
    assert zset.inverted_index(feed, "value", "key").first()["keys"] == [2]


DOCS = [(1, "a grey heron stood in the cold shallow river all morning"), (2, "Grey Heron, River!"), (3, "copper kettles sing when copper is hot, copper")]


def ranked(spark, docs, terms):
    index = bm25.build(spark.createDataFrame(docs, "doc_id long, text string"))
    q = spark.createDataFrame([(0, t) for t in terms], "qid int, term string")
    return [r.doc for r in bm25.best(bm25.scores(index, q), 10).orderBy("rank").collect()]


def test_bm25_ranking_retraction_and_replacement(spark):
    assert ranked(spark, DOCS, ["heron"]) == [2, 1] and ranked(spark, DOCS, ["copper"]) == [3]
    assert ranked(spark, DOCS, ["copper", "heron"])[0] == 3
    assert ranked(spark, [DOCS[0], DOCS[2]], ["heron"]) == [1]
    new = [(1, "oar sail mast"), (2, "oar")]
    index = bm25.build(spark.createDataFrame(new, "doc_id long, text string"))
    assert {(r.term, r.doc): r.tf for r in index.postings.collect()} == {("oar", 1): 1, ("sail", 1): 1, ("mast", 1): 1, ("oar", 2): 1}


def test_term_dictionary(spark):
    docs = spark.createDataFrame([(1, "lanternfish lanternfish lanternfish"), (2, "lantern wick"), (3, "harbour light")], "doc_id long, text string")
    terms = bm25.term_dictionary(docs)
    assert [r.term for r in bm25.complete(terms, "lan", 5).collect()] == ["lantern", "lanternfish"]
    assert [r.term for r in bm25.complete_ranked(terms, "lan", 5).collect()] == ["lanternfish", "lantern"]
    assert [r.term for r in bm25.correct(terms, "lantrnfish", 3).collect()] == ["lanternfish"]
    assert bm25.correct(terms, "zanternfish", 3).count() == 0


@pytest.mark.parametrize(("text", "want"), [("A Light-Keeper's 3rd oar!", ["lightkeepers", "3rd", "oar"]), ("b Q z9 no", ["z9", "no"]), ("手 é a bc", ["手", "é", "bc"]), ("", [])])
def test_core_tokens(spark, text, want):
    assert one(spark, text).select(T.core_tokens(F.col("x")).alias("t")).first().t == want


def test_legibility_orders_prose_over_noise(spark):
    prose = "the house on the hill was built in the spring and it is one of the best that we have seen in the valley"
    noise = "xq zt ee ee cs vk rr tl qz pw lk jh gf ds zx cv bn mq wr ty"
    rows = spark.createDataFrame([(0, prose), (1, noise), (2, f"{prose} {prose} {noise} {noise} {noise} {prose}"), (3, "")], "i int, x string")
    words = T.words_of(F.col("x"))
    got = {r.i: r for r in rows.select("i", T.legibility(words).alias("l"), T.min_window(words).alias("m"), T.legible_excerpt(words).alias("e")).collect()}
    assert got[0].l > 0.6 > 0.45 > got[1].l and got[2].m < 0.45 and got[3].l == 0
    assert " … " in got[2].e and got[1].e == ""  # blocks at the boundary may bleed


def test_truncate_and_snippet(spark):
    r = one(spark, "héllo world again").select(T.truncate_bytes(F.col("x"), 3).alias("a"), T.snippet(F.col("x"), 13).alias("b"), T.truncate_bytes(F.col("x"), 99).alias("c")).first()
    assert (r.a, r.b, r.c) == ("hé…", "héllo world…", "héllo world again")


def test_fnv(spark):
    h = 2166136261
    for c in b"abc":
        h = (h ^ c) * 16777619 % 2**32
    assert one(spark, "abc").select(T.fnv1a(F.col("x"), F.lit(7)).alias("h")).first().h == (h ^ 7) * 16777619 % 2**32


def test_metrics_on_zero_vectors(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>").select(*(f(F.col("a"), F.col("b")).alias(n) for n, f in V.METRICS.items())).first()
    assert (r.cosine, r.unit_cosine, r.l2, r.l1, r.chebyshev, r.hamming) == (0.0, 1.0, 5.0, 3.0, 2.0, 2)


@pytest.mark.parametrize("metric", sorted(V.METRICS))
@pytest.mark.parametrize("shard", [9, 10_000])
def test_nearest_against_all_pairs(spark, monkeypatch, metric, shard):
    monkeypatch.setattr(knn, "SHARD_ROWS", shard)
    monkeypatch.setattr(knn, "BATCH", 3)
    x = np.random.default_rng(0).integers(-2, 3, (60, 4)).astype(float).tolist()  # many ties, and zero vectors
    x[5] = [0.0] * 4
    v = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    q = v.filter("id < 7").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    every = knn.pairs(v, q).select("qid", "id", F.round(V.METRICS[metric](F.col("v"), F.col("q")).cast("double"), 9).alias("d")).filter("qid <> id").collect()
    got = knn.nearest(v, q, 5, metric, skip_self=True).collect()
    for i in range(7):
        want = sorted((r.d, r.id) for r in every if r.qid == i)[:5]
        mine = [(round(r.dist, 9), r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.qid == i]
        assert [d for d, _ in mine] == [d for d, _ in want] and (metric in ("cosine", "unit_cosine") or mine == want)


def test_wordpieces_and_normalisation():
    vocab = {"un", "##aff", "##able", "the"}
    assert embed.wordpieces("unaffable", vocab) == ["un", "##aff", "##able"]
    assert embed.wordpieces("unx", vocab) == ["un", "[UNK]"] and embed.wordpieces("u" * 101, vocab) == ["[UNK]"]
    assert embed.normalize("É\x00中\ta") == "e 中  a" and embed.pretokenize("don't, stop") == ["don", "'", "t", ",", "stop"]


def test_encode(spark):
    vocab = {"a": np.array([1.0, 0.0]), "b": np.array([0.0, 2.0]), "[CLS]": np.array([1.0, 1.0])}
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.v for r in embed.encode(rows, vocab, "id", "t", classify="[CLS]").collect()}
    assert got == {1: [1.0, 1.5], 2: [1.0, 1.0], 3: [1.0, 1.0]}


def test_mmr_with_lambda_one_keeps_the_order(spark):
    rows = spark.createDataFrame([(0, i, 1.0 - i / 10, [float(i % 2), 1.0]) for i in range(6)], "qid int, doc long, fused double, v array<double>")
    assert [r.doc for r in fusion.mmr(rows, 1.0).orderBy("mmr_rank").collect()] == list(range(6))


def test_blend_slots():
    out = fusion.blend(list(range(20)), [100, 101, 102], lambda x: 2)
    assert [out.index(100 + i) for i in range(3)] == [2, 6, 10] and fusion.blend([], [1], lambda x: 0) == [1]


def test_reconcile_without_listing_is_no_news(spark):
    known = spark.createDataFrame([("a", 1, 1, 1, "present")], "path string, inode long, size long, mtime long, state string")
    assert ingest.reconcile(known, None).count() == 0
    found = spark.createDataFrame([("b", 1, 1, 1)], "path string, inode long, size long, mtime long")
    assert [tuple(r) for r in ingest.reconcile(known, found).collect()] == [("b", "moved", "a")]


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (200, 1), (201, 2), (360, 2), (361, 3)])
def test_chunk_counts(spark, n, want):
    rows = one(spark, " ".join(["w"] * n))
    assert ingest.chunks(rows, ["x"], T.words_of(F.col("x"))).count() == want


def test_spread_pages():
    assert metrics.spread_pages(1, 9) == [1] and metrics.spread_pages(3, 9) == [1, 5, 9] and metrics.spread_pages(9, 3) == [1, 2, 3] and metrics.spread_pages(2, 0) == []


def test_trail():
    near = {0: [(1, 0.9), (2, 0.8)], 1: [(0, 0.9), (3, 0.999), (2, 0.5)], 2: [(4, 0.4)]}
    base = {i: f"d{i}" for i in range(5)}
    assert atlas.trail(0, near, base, {0, 2}) == [0, 2, 4] and atlas.trail(3, near, base, set()) == []


def test_files(spark, tmp_path):
    (tmp_path / "in" / "shelf").mkdir(parents=True)
    for name in ("b.pdf", "shelf/a.MD", ".hidden.pdf", "c.exe"):
        (tmp_path / "in" / name).write_text("x")
    assert [r.relpath for r in files.folder(spark, str(tmp_path / "in")).collect()] == ["b.pdf", "shelf/a.MD"]
    assert files.folder(spark, str(tmp_path / "none")) is None
    np.array([2], "<i4").tofile(tmp_path / "v.fvecs")
    with open(tmp_path / "v.fvecs", "ab") as f:
        np.array([1.5, 2.5], "<f4").tofile(f)
    assert files.fvecs(spark, str(tmp_path / "v.fvecs")).first().v == [1.5, 2.5]
    rows = spark.createDataFrame([(1, "a")], "i long, s string")
    files.write_sidecar(rows, str(tmp_path / "side"))
    files.write_sidecar(rows, str(tmp_path / "side"))
    assert files.read_sidecar(spark, str(tmp_path / "side"), "i long, s string").count() == 1
    assert files.read_sidecar(spark, str(tmp_path / "nothing"), "i long") is None
    (tmp_path / "bad").write_text("{broken")
    assert files.read_sidecar(spark, str(tmp_path / "bad"), "i long") is None
    pages = files.marked_pages(spark.createDataFrame([(1, "pre<!-- page 1 -->one<!-- page 2 -->two")], "d long, b string"), "b")
    assert [(r.page, r.text) for r in pages.collect()] == [(1, "one"), (2, "two")]
