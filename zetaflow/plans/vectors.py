"""Vector search, encoders, hybrid ranking, metrics and the corpus map over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import atlas, bm25, embed, fusion, knn, metrics
from .base import load, query, r6, s6
from .text import BATCH, BATCH_SCORES, INDEX, TOK, batch_terms, index

DIM = 64


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def asks(spark, sf_dir, every=25):
    return vectors(spark, sf_dir).filter(f"id % {every} = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))


_D = "list_transform(list_zip(a.embedding, b.embedding), lambda z: {})"
_X = "z[1]::double, z[2]::double"
SQL_METRIC = {
    "l2": f"list_sum({_D.format('(z[1]::double-z[2]::double)*(z[1]::double-z[2]::double)')})",
    "l1": f"list_sum({_D.format('abs(z[1]::double-z[2]::double)')})",
    "chebyshev": f"list_max({_D.format('abs(z[1]::double-z[2]::double)')})",
    "neg_dot": f"-list_sum({_D.format('z[1]::double*z[2]::double')})",
    "hamming": f"len(list_filter({_D.format('z[1] <> z[2]')}, lambda t: t))::double",
}
_NORM = "sqrt(list_sum(list_transform({}.embedding, lambda x: x::double*x::double)))"
SQL_METRIC["euclidean"] = f"sqrt({SQL_METRIC['l2']})"
SQL_METRIC["cosine"] = f"CASE WHEN {_NORM.format('a')}*{_NORM.format('b')} > 0 THEN 1+({SQL_METRIC['neg_dot']})/({_NORM.format('a')}*{_NORM.format('b')}) ELSE 0 END"
SQL_METRIC["unit_cosine"] = f"CASE WHEN {_NORM.format('a')}*{_NORM.format('b')} > 0 THEN 1+({SQL_METRIC['neg_dot']})/({_NORM.format('a')}*{_NORM.format('b')}) ELSE 1 END"
# The last three differ from the engine's by rounding only; six decimals hide it.


def _metric(name):
    number = {"l2": 1, "euclidean": 2, "l1": 3, "chebyshev": 4, "neg_dot": 5, "cosine": 6, "unit_cosine": 7, "hamming": 8}[name]

    @query(
        f"v{number}_{name}",
        f"SELECT a.vec_id AS qid, b.vec_id AS id, {s6(SQL_METRIC[name])} AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0",
    )
    def run(spark, sf_dir):
        v, q, metric = vectors(spark, sf_dir), asks(spark, sf_dir, 100), V.METRICS[name]
        if name == "unit_cosine":  # each vector is normalised once, not in every pair
            v, q, metric = v.withColumn("v", V.unit(F.col("v"))), q.withColumn("q", V.unit(F.col("q"))), V.of_units
        return knn.pairs(v, q).select("qid", "id", r6(metric(F.col("v"), F.col("q")).cast("double")).alias("dist"))


for _name in V.METRICS:
    _metric(_name)


@query("v9_unequal_lengths", f"SELECT a.vec_id AS id, {s6('list_sum(list_transform(list_zip(a.embedding[1:40], a.embedding[21:64])[1:40], lambda z: z[1]::double*z[2]::double))')} AS d FROM embeddings a")
def v9(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", r6(V.dot(F.slice("v", 1, 40), F.slice("v", 21, 44))).alias("d"))


_DIST = SQL_METRIC["unit_cosine"]


def knn_sql(k: int, every: int, where: str = "true", alias: str = "dist") -> str:
    return f"""SELECT qid, id, {s6("d")} AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) - 1 AS rank FROM (
      SELECT a.vec_id AS qid, b.vec_id AS id, {_DIST} AS d FROM embeddings a, embeddings b WHERE a.vec_id % {every} = 0 AND {where})) WHERE rank < {k}"""


def _found(df):
    return df.select("qid", "id", r6(F.col("dist")).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query("v11_nearest", knn_sql(40, 25))
def v11(spark, sf_dir):
    return _found(knn.nearest(vectors(spark, sf_dir), asks(spark, sf_dir), 40))


@query("v12_filtered", knn_sql(10, 25, "b.label IN (1, 3)"))
def v12(spark, sf_dir):
    return _found(knn.nearest(vectors(spark, sf_dir).filter("label in (1, 3)"), asks(spark, sf_dir), 10))


@query("v13_among", knn_sql(5, 50, "b.vec_id IN (SELECT doc_id FROM labels WHERE toxic = 0)"))
def v13(spark, sf_dir):
    allowed = load(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("id"))
    return _found(knn.nearest(vectors(spark, sf_dir), asks(spark, sf_dir, 50), 5, allowed=allowed))


@query("v14_deleted", knn_sql(10, 25, "b.vec_id % 3 <> 0"))
def v14(spark, sf_dir):
    return _found(knn.nearest(vectors(spark, sf_dir).filter("id % 3 <> 0"), asks(spark, sf_dir), 10))


@query("v16_upsert_vectors", "SELECT vec_id AS id, CASE WHEN vec_id % 4 = 1 THEN list_reverse(embedding)[1] ELSE embedding[1] END::double AS first FROM embeddings WHERE vec_id % 4 <> 2")
def v16(spark, sf_dir):
    """A key re-embedded by a retraction and an insertion in one batch has its new vector."""
    v = vectors(spark, sf_dir).select("id", "v")
    old = v.filter("id % 4 in (1, 2)").withColumn("_delta", F.lit(-1)).withColumn("_seq", F.lit(1))
    new = v.filter("id % 4 = 1").withColumn("v", F.reverse("v")).withColumn("_delta", F.lit(1)).withColumn("_seq", F.lit(2))
    return knn.upsert_vectors(v, old.unionByName(new)).select("id", F.col("v")[0].cast("double").alias("first"))


@query("v19_sizes", "SELECT count(*) AS vectors, min(len(embedding)) AS least, max(len(embedding)) AS most FROM embeddings")
def v19(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("v")).cast("long").alias("least"), F.max(F.size("v")).cast("long").alias("most"))


@query("q8_recall", f"WITH t AS ({knn_sql(10, 25)}), c AS ({knn_sql(10, 25).replace('.embedding', '.embedding[1:32]')}) SELECT {s6('count(c.id)/count(*)::double')} AS recall FROM t LEFT JOIN c USING (qid, id)")
def q8(spark, sf_dir):
    """Recall of a search by the first half of the components against the whole vectors: hits over all returned."""
    v, q = vectors(spark, sf_dir), asks(spark, sf_dir)
    half = knn.nearest(v.withColumn("v", F.slice("v", 1, 32)), q.withColumn("q", F.slice("q", 1, 32)), 10)
    return knn.recall(half, knn.nearest(v, q, 10)).select(r6(F.col("recall")).alias("recall"))


# Encoders.

VOCAB = "voc AS (SELECT piece, " + "[" + ", ".join(f"('0x'||substr(md5(piece||'|{i}'),1,8))::bigint/2147483648.0::double-1" for i in range(8)) + f"] AS v FROM (SELECT DISTINCT unnest({TOK}) AS piece FROM documents))"


def vocabulary(spark, sf_dir, dim=8):
    pieces = load(spark, sf_dir, "documents").select(F.explode(T.default_tokens(F.col("text"))).alias("piece")).distinct()
    return embed.hashed_vocabulary(pieces, dim)


@query(
    "e1_encode",
    f"""WITH {VOCAB}, t AS (SELECT item_id, unnest({TOK}) AS piece FROM benchmark)
        SELECT item_id, {", ".join(f"{s6(f'sum(coalesce(v[{i + 1}],0))/count(*)')} AS v{i}" for i in range(8))} FROM t LEFT JOIN voc USING (piece) GROUP BY 1""",
)
def e1(spark, sf_dir):
    t = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(T.default_tokens(F.col("text"))).alias("piece"))
    p = embed.pooled(t, vocabulary(spark, sf_dir), 8)
    return p.select(F.col("id").alias("item_id"), *(r6(F.col("v")[i]).alias(f"v{i}") for i in range(8)))


@query("e3_token_vectors", f"WITH {VOCAB} SELECT piece, {s6('v[1]')} AS v0, {s6('v[8]')} AS v7 FROM voc WHERE starts_with(piece, 'th')")
def e3(spark, sf_dir):
    return vocabulary(spark, sf_dir).filter(F.startswith("piece", F.lit("th"))).select("piece", r6(F.col("v")[0]).alias("v0"), r6(F.col("v")[7]).alias("v7"))


@query("e4_quantized", f"WITH {VOCAB}, b AS (SELECT min(v[1]) lo, (max(v[1])-min(v[1]))/255 sc FROM voc) SELECT piece, floor((v[1]-lo)/sc+0.5::double)::int AS q, {s6('lo+floor((v[1]-lo)/sc+0.5::double)*sc')} AS back FROM voc, b")
def e4(spark, sf_dir):
    v = vocabulary(spark, sf_dir).select("piece", F.col("v")[0].alias("x"))
    b = v.agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / 255).alias("sc"))
    q = v.crossJoin(F.broadcast(b)).withColumn("q", embed.quantize(F.col("x"), F.col("lo"), F.col("sc")))
    return q.select("piece", "q", r6(embed.dequantize(F.col("q"), F.col("lo"), F.col("sc"))).alias("back"))


@query("e5_sif_weights", f"WITH f AS (SELECT piece, count(*) AS freq FROM (SELECT unnest({TOK}) AS piece FROM documents) GROUP BY 1) SELECT piece, {s6('0.001::double/(0.001::double+freq::double/(SELECT sum(freq) FROM f))')} AS w FROM f")
def e5(spark, sf_dir):
    f = load(spark, sf_dir, "documents").select(F.explode(T.default_tokens(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("freq"))
    return embed.sif_weights(f).select("piece", r6(F.col("w")).alias("w"))


@query("e7_truncated", f"SELECT vec_id AS id, {s6('list_sum(list_transform(embedding[1:16], lambda x: x::double*x::double))')} AS sq FROM embeddings")
def e7(spark, sf_dir):
    v = F.slice("v", 1, 16)
    return vectors(spark, sf_dir).select("id", r6(V.dot(v, v)).alias("sq"))


# Hybrid ranking: benchmark items ask words; their vectors are those of the embeddings with the same number.

LEX = f"{INDEX}, {BATCH}, {BATCH_SCORES}, lex AS (SELECT qid, doc, {s6('score')} AS score FROM sc)"
SEM = f"sem AS (SELECT qid, id, dist, rank FROM ({knn_sql(40, 1, 'a.vec_id IN (SELECT item_id FROM benchmark) AND b.vec_id IN (SELECT doc_id FROM documents)')}))"
FUSED = """n AS (SELECT qid, doc, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 1 END AS rel FROM lex WINDOW w AS (PARTITION BY qid)),
  m AS (SELECT qid, id, CASE WHEN max(greatest(1-dist,0)) OVER w > 0 THEN greatest(1-dist,0) / max(greatest(1-dist,0)) OVER w ELSE 0 END AS sim FROM sem WINDOW w AS (PARTITION BY qid)),
  fu AS (SELECT coalesce(n.qid, m.qid) AS qid, coalesce(doc, id) AS doc, rel, sim, 0.5::double*coalesce(rel,0)+0.5::double*coalesce(sim,0) AS fused FROM n FULL JOIN m ON n.qid = m.qid AND n.doc = m.id)"""


def lexical(spark, sf_dir):
    return bm25.scores(index(spark, sf_dir), batch_terms(spark, sf_dir)).withColumn("score", r6(F.col("score")))


def semantic(spark, sf_dir):
    items = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    q = asks(spark, sf_dir, 1).join(asked, "qid", "left_semi")
    return _found(knn.nearest(vectors(spark, sf_dir), q, 40, allowed=items))


@query("h5_h8_h9_fused", f"WITH {LEX}, {SEM}, {FUSED} SELECT qid, doc, {s6('rel')} AS rel, {s6('sim')} AS sim, {s6('fused')} AS fused FROM fu")
def h9(spark, sf_dir):
    f = fusion.fuse(lexical(spark, sf_dir), semantic(spark, sf_dir))
    return f.select("qid", "doc", r6(F.col("rel")).alias("rel"), r6(F.col("sim")).alias("sim"), r6(F.col("fused")).alias("fused"))


@query("h9_reserved_boost", f"WITH {LEX}, {SEM}, {FUSED} SELECT qid, doc, {s6('fused * CASE WHEN doc % 50 = 7 THEN 1.4::double ELSE 1 END')} AS fused FROM fu")
def h9r(spark, sf_dir):
    reserved = load(spark, sf_dir, "documents").filter("doc_id % 50 = 7").select(F.col("doc_id").alias("doc"))
    return fusion.fuse(lexical(spark, sf_dir), semantic(spark, sf_dir), reserved=reserved).select("qid", "doc", r6(F.col("fused")).alias("fused"))


_RANKS = "lr AS (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank FROM lex)"


@query("h10_reciprocal_rank", f"WITH {LEX}, {SEM}, {_RANKS}, u AS (SELECT qid, doc, rank FROM lr WHERE rank < 512 UNION ALL SELECT qid, id, rank FROM sem) SELECT qid, doc, {s6('sum(1.0::double/(60+rank+1))')} AS fused FROM u GROUP BY 1, 2")
def h10(spark, sf_dir):
    lex = bm25.best(lexical(spark, sf_dir), 512).select("qid", "doc", "rank")
    sem = semantic(spark, sf_dir).select("qid", F.col("id").alias("doc"), "rank")
    return fusion.reciprocal_rank([lex, sem]).select("qid", "doc", r6(F.col("fused")).alias("fused"))


@query("h11_weighted_rrf", f"WITH {LEX}, {SEM}, {_RANKS}, u AS (SELECT qid, doc, 0.7::double/(20+rank+1) s FROM lr WHERE rank < 100 UNION ALL SELECT qid, id, 0.3::double/(20+rank+1) FROM sem) SELECT qid, doc, {s6('sum(s)')} AS fused FROM u GROUP BY 1, 2")
def h11(spark, sf_dir):
    lex = bm25.best(lexical(spark, sf_dir), 100).select("qid", "doc", "rank")
    sem = semantic(spark, sf_dir).select("qid", F.col("id").alias("doc"), "rank")
    return fusion.reciprocal_rank([lex, sem], 20.0, [0.7, 0.3]).select("qid", "doc", r6(F.col("fused")).alias("fused"))


@query("h12_convex_sweep", "WITH " + f"{LEX}, {SEM}, {FUSED} SELECT a AS alpha, qid, {s6('max(a*coalesce(rel,0)+(1-a)*coalesce(sim,0))')} AS best FROM fu, (VALUES (0.0::double), (0.25::double), (0.75::double), (1.0::double)) t(a) GROUP BY 1, 2")
def h12(spark, sf_dir):
    """All blends in one pass over the joined lists."""
    f = fusion.fuse(lexical(spark, sf_dir), semantic(spark, sf_dir))
    a = F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.75, 1.0)))).alias("alpha")
    f = f.select("qid", "rel", "sim", a)
    return f.groupBy("alpha", "qid").agg(r6(F.max(F.col("alpha") * F.coalesce("rel", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("sim", F.lit(0.0)))).alias("best"))


@query("h16_cutoff_h19_page", f"WITH {LEX}, {SEM}, {FUSED}, c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {s6('fused')} DESC, doc) - 1 AS rank FROM fu WHERE sim IS NOT NULL OR rel >= 0.25) SELECT qid, doc, rank FROM c WHERE rank BETWEEN 20 AND 39")
def h16(spark, sf_dir):
    f = fusion.cutoff(fusion.fuse(lexical(spark, sf_dir), semantic(spark, sf_dir))).withColumn("fused", r6(F.col("fused")))
    return fusion.page(fusion.ranked(f), 20, 20).select("qid", "doc", F.col("rank").cast("long").alias("rank"))


@query("h15_resolve", f"WITH {LEX}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank FROM lex) SELECT qid, doc, source FROM r JOIN documents ON doc = doc_id WHERE rank < 5 AND doc_id % 3 > 0")
def h15(spark, sf_dir):
    """The page is cut before keys are resolved; a key without a record shrinks it."""
    docs = load(spark, sf_dir, "documents").filter("doc_id % 3 > 0").select(F.col("doc_id").alias("doc"), "source")
    return bm25.best(lexical(spark, sf_dir), 5).join(docs, "doc").select("qid", "doc", "source")


@query("h21_spread_cutoff", f"WITH {SEM}, s AS (SELECT qid, id, {s6('1-dist')} AS sim FROM sem) SELECT qid, id, sim FROM s WINDOW w AS (PARTITION BY qid) QUALIFY sim >= min(sim) OVER w + 0.35::double*(max(sim) OVER w - min(sim) OVER w)")
def h21(spark, sf_dir):
    return fusion.spread_cutoff(semantic(spark, sf_dir).select("qid", "id", r6(1.0 - F.col("dist")).alias("sim"))).select("qid", "id", "sim")


@query(
    "h28_copy_dedup",
    f"""WITH {LEX}, h AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank, source AS base, doc, doc % 3 AS page FROM lex JOIN documents ON doc = doc_id),
        p AS (SELECT * FROM h WHERE rank < 60), c AS (SELECT qid, base, count(DISTINCT doc) >= 2 AS multi FROM p GROUP BY 1, 2),
        u AS (SELECT p.*, multi, CASE WHEN multi THEN base ELSE doc::varchar END AS unit FROM p JOIN c USING (qid, base)),
        o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, unit, page ORDER BY rank) = 1)
        SELECT qid, rank, base, doc, page FROM o QUALIFY NOT multi OR row_number() OVER (PARTITION BY qid, unit ORDER BY rank) <= 2""",
)
def h28(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("base"))
    h = bm25.best(lexical(spark, sf_dir), 60).join(docs, "doc")
    return fusion.dedup_copies(h.select("qid", F.col("rank").cast("long").alias("rank"), "base", "doc", (F.col("doc") % 3).alias("page")))


@query("h14_mmr")
def h14(spark, sf_dir):
    f = fusion.fuse(lexical(spark, sf_dir), semantic(spark, sf_dir)).filter("sim is not null")
    v = vectors(spark, sf_dir).select(F.col("id").alias("doc"), F.col("v").cast("array<double>").alias("v"))
    return fusion.mmr(f.select("qid", "doc", "fused").join(v, "doc"))


@query("h13_max_sim")
def h13(spark, sf_dir):
    """Late interaction of each item's words, 32 at most as always, with the words of its 30 best documents."""
    pool = fusion.ranked(fusion.fuse(lexical(spark, sf_dir), semantic(spark, sf_dir))).filter("rank < 30")
    pieces = vocabulary(spark, sf_dir).select(F.col("piece").alias("word"), V.unit(F.col("v")).alias("v"))
    words = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(T.default_tokens(F.col("text"))).alias("word"))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(F.slice(T.default_tokens(F.col("text")), 1, 32)).alias("tok", "word"))
    queries = asked.join(pieces, "word").select("qid", "tok", "v", F.lit(1.0).alias("w"))
    return fusion.max_sim(pool, words, pieces, queries).select("qid", "doc", r6(F.col("reranked")).alias("reranked"))


# Metrics: neighbours that share the label are relevant.

GOLD = "gold AS (SELECT a.vec_id qid, b.vec_id id FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 25 = 0 AND a.vec_id <> b.vec_id)"
PERQ = f"""kn AS ({knn_sql(10, 25, 'a.vec_id <> b.vec_id')}), {GOLD}, sz AS (SELECT qid, count(*) g FROM gold GROUP BY 1),
  ht AS (SELECT qid, count(*) h, min(rank) AS f, sum(1/log2(rank+2)) dcg FROM kn JOIN gold USING (qid, id) GROUP BY 1),
  pq AS (SELECT qid, coalesce(h,0)/g::double AS recall, coalesce(1.0::double/(f+1),0) AS rr, coalesce(dcg,0)/list_sum(list_transform(range(0, least(g,10)), lambda i: 1/log2(i+2))) AS ndcg FROM sz LEFT JOIN ht USING (qid))"""


def per_query(spark, sf_dir, k=10):
    v = vectors(spark, sf_dir)
    found = knn.nearest(v, asks(spark, sf_dir), k, skip_self=True)
    gold = v.filter("id % 25 = 0").select(F.col("id").alias("qid"), "label").join(v.select("id", "label"), "label").filter("qid <> id").select("qid", "id")
    return metrics.per_query(found, gold, k)


@query("q1_q2_q3_per_query", f"WITH {PERQ} SELECT qid, {s6('recall')} AS recall, {s6('rr')} AS rr, {s6('ndcg')} AS ndcg FROM pq")
def q123(spark, sf_dir):
    return per_query(spark, sf_dir).select("qid", *(r6(F.col(c)).alias(c) for c in ("recall", "rr", "ndcg")))


@query("q4_macro", f"WITH {PERQ} SELECT count(*) AS queries, {s6('avg(recall)')} AS recall, {s6('avg(rr)')} AS rr, {s6('avg(ndcg)')} AS ndcg, {s6('stddev_pop(rr)')} AS sd_rr FROM pq")
def q4(spark, sf_dir):
    m = metrics.macro(per_query(spark, sf_dir))
    return m.select("queries", *(r6(F.col(c)).alias(c) for c in ("recall", "rr", "ndcg", "sd_rr")))


@query("q6_seeded_queries", "WITH d AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE trim(text) <> '' GROUP BY text) SELECT doc_id, row_number() OVER (ORDER BY md5('q|'||doc_id), doc_id) <= 10 AS is_query FROM d QUALIFY row_number() OVER (ORDER BY md5('q|'||doc_id), doc_id) <= 50")
def q6(spark, sf_dir):
    d = load(spark, sf_dir, "documents").filter(F.trim("text") != "").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    order = [F.md5(F.concat(F.lit("q|"), "doc_id")), F.col("doc_id")]
    d = d.select("doc_id").orderBy(*order).limit(50)
    return d.select("doc_id", (F.row_number().over(Window.orderBy(*order)) <= 10).alias("is_query"))


@query("q7_known_item", f"WITH w AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest({TOK}) w FROM benchmark) WHERE length(w) > 3) SELECT item_id, string_agg(w, ' ' ORDER BY length(w) DESC, w) AS q FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) <= 3) GROUP BY 1")
def q7(spark, sf_dir):
    words = F.filter(F.array_distinct(T.default_tokens(F.col("text"))), lambda w: F.length(w) > 3)
    keyed = F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    best = F.transform(F.slice(F.array_sort(keyed), 1, 3), lambda s: s.w)
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(best, " ").alias("q")).filter("q <> ''")


# Corpus map.

KNN12 = f"kn AS ({knn_sql(12, 1, 'a.vec_id <> b.vec_id')})"


def neighbours(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return knn.nearest(v, v.select(F.col("id").alias("qid"), F.col("v").alias("q")), 12, skip_self=True)


EDGES = "ed AS (SELECT x.qid AS a, x.id AS b, x.dist FROM kn x JOIN kn y ON x.qid = y.id AND x.id = y.qid WHERE x.qid < x.id)"


@query("a4_mutual_edges", f"WITH {KNN12}, {EDGES} SELECT a, b, {s6('1-dist')} AS sim FROM ed")
def a4(spark, sf_dir):
    return knn.mutual_edges(_found(neighbours(spark, sf_dir))).select("a", "b", r6(F.col("sim")).alias("sim"))


@query("a5_adjacency", f"WITH {KNN12}, {EDGES} SELECT a, count(*) AS degree FROM (SELECT a FROM ed UNION ALL SELECT b FROM ed) GROUP BY 1")
def a5(spark, sf_dir):
    return knn.adjacency(knn.mutual_edges(_found(neighbours(spark, sf_dir)))).groupBy("a").agg(F.count(F.lit(1)).alias("degree"))


@query("a3_diversity", f"WITH {KNN12} SELECT qid, count(DISTINCT CASE WHEN b.label <> a.label THEN b.label END) AS others FROM kn JOIN embeddings a ON a.vec_id = qid JOIN embeddings b ON b.vec_id = id GROUP BY 1")
def a3(spark, sf_dir):
    owner = vectors(spark, sf_dir).select("id", F.col("label").alias("doc"))
    return atlas.diversity(neighbours(spark, sf_dir), owner)


@query("a6_label_propagation")
def a6(spark, sf_dir):
    return atlas.label_propagation(knn.mutual_edges(neighbours(spark, sf_dir)))


@query("a7_communities", "SELECT label::bigint AS label, count(*) AS size, count(DISTINCT vec_id % 7) AS docs, min(vec_id) AS first FROM embeddings GROUP BY 1 HAVING count(*) >= 25 AND count(DISTINCT vec_id % 7) >= 3 ORDER BY size DESC, first LIMIT 24")
def a7(spark, sf_dir):
    return atlas.communities(vectors(spark, sf_dir).select(F.col("id").alias("node"), F.col("label").cast("long").alias("label"), (F.col("id") % 7).alias("doc")))


_TERM = "list_filter(list_filter(list_transform(regexp_split_to_array(text, '[^A-Za-z]'), lambda x: lower(x)), lambda x: length(x) BETWEEN 3 AND 20), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.THEME_STOPWORDS) + "], x))"


@query(
    "a8_theme_terms",
    f"""WITH t AS (SELECT lang AS theme, unnest({_TERM}) AS term FROM documents), o AS (SELECT theme, term, count(*)::double f FROM t GROUP BY 1, 2),
        c AS (SELECT theme, sum(f) ct FROM o GROUP BY 1), g AS (SELECT term, count(*)::double g FROM t GROUP BY 1), gt AS (SELECT sum(g) gt FROM g),
        p AS (SELECT *, 500.0::double*g/gt AS prior FROM o JOIN g USING (term) JOIN c USING (theme), gt WHERE f >= 4 AND g >= 8),
        z AS (SELECT theme, term, {s6("ln(((f+prior)/(ct+500-f-prior))/((g+prior)/(gt+500-g-prior)))/sqrt(1/(f+prior)+1/(g+prior))")} AS z FROM p)
        SELECT theme, term, z FROM z QUALIFY row_number() OVER (PARTITION BY theme ORDER BY z DESC, term) <= 9""",
)
def a8(spark, sf_dir):
    t = load(spark, sf_dir, "documents").select(F.col("lang").alias("theme"), F.explode(T.term_tokens(F.col("text"), T.THEME_STOPWORDS)).alias("term"))
    return atlas.theme_terms(t).select("theme", "term", r6(F.col("z")).alias("z"))


_CENTRE = f"s AS (SELECT label, {', '.join(f'sum(embedding[{i + 1}]::double) AS c{i}' for i in range(DIM))} FROM embeddings GROUP BY 1), ce AS (SELECT label, list_transform([{', '.join(f'c{i}' for i in range(DIM))}], lambda x: x/greatest(sqrt({'+'.join(f'c{i}*c{i}' for i in range(DIM))}), 1e-9)) AS centre FROM s)"


def members(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.col("label").alias("theme"), (F.col("id") % 40).alias("doc"), "v")


@query("a9_centroids", f"WITH {_CENTRE} SELECT label AS theme, {s6('centre[1]')} AS first, {s6('centre[64]')} AS last FROM ce")
def a9(spark, sf_dir):
    c = atlas.centroids(members(spark, sf_dir), DIM)
    return c.select("theme", r6(F.col("centre")[0]).alias("first"), r6(F.col("centre")[63]).alias("last"))


@query("a10_exemplars", f"WITH {_CENTRE}, m AS (SELECT label AS theme, vec_id AS id, vec_id % 40 AS doc, list_sum(list_transform(list_zip(embedding, centre), lambda z: z[1]::double*z[2])) AS sim FROM embeddings JOIN ce USING (label)), o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY theme, doc ORDER BY round(sim, 9) DESC, id) = 1) SELECT theme, id, {s6('sim')} AS sim FROM o QUALIFY row_number() OVER (PARTITION BY theme ORDER BY round(sim, 9) DESC, id) <= 5")
def a10(spark, sf_dir):
    m = members(spark, sf_dir)
    return atlas.exemplars(m, atlas.centroids(m, DIM)).select("theme", "id", r6(F.col("sim")).alias("sim"))


@query("a12_projection")
def a12(spark, sf_dir):
    v = vectors(spark, sf_dir)
    mean, axes = atlas.principal_axes(v, DIM)
    out = []
    for k, axis in enumerate(axes):
        a = F.array(*(F.lit(float(x)) for x in axis))
        out.append((V.dot(F.col("v"), a) - float(mean @ axis)).alias("xy"[k]))
    return v.select("id", *out)


@query("a13_sampled_points", "WITH o AS (SELECT vec_id AS id, vec_id AS i, CASE WHEN label = 2 THEN 2 END AS theme FROM embeddings), t AS (SELECT count(*) n FROM o) SELECT id FROM o, t WHERE floor((i+1)*70.0::double/n) > floor(i*70.0::double/n) OR theme IS NOT NULL")
def a13(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return atlas.sample_points(v.select("id", F.col("id").alias("i"), F.when(F.col("label") == 2, 2).alias("theme")), v.count(), 70.0).select("id")


@query("a1_fingerprint", "SELECT count(*) AS docs, sum(n)::bigint AS chunks, md5(string_agg(source || ':' || n, ',' ORDER BY source || ':' || n)) AS hash FROM (SELECT source, count(*) n FROM documents GROUP BY 1)")
def a1(spark, sf_dir):
    c = load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat("source", F.lit(":"), "n")  # one line a source: a short list
    return c.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chunks"), F.md5(F.array_join(F.array_sort(F.collect_list(line)), ",")).alias("hash"))
