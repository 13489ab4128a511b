"""Composed search, scopes, stored indexes, images, trails, samples, logs, shelves and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..operators import atlas, bm25, embed, fusion, ingest, knn, metrics, search
from ..operators.vector_index import VectorIndex
from ..sources.state import keep, scratch
from .base import MILLIS, load, query, r6, s6
from .text import INDEX, SQL_WORDS, TERMS, TOK, index, legibility_sql, terms, weight_sql
from .vectors import _found, asks, knn_sql, neighbours, vectors


def typed(spark, sf_dir, least: int = 3):
    """What a user types for every benchmark item: its first three words."""
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(F.slice(T.default_tokens(F.col("text")), 1, least)).alias("pos", "term"))
    return b


_TYPED = f"ty AS (SELECT item_id AS qid, ts[1:3] AS ts FROM (SELECT item_id, {TOK} AS ts FROM benchmark)), own AS (SELECT qid, unnest(ts) AS term FROM ty)"
_COMPLETED = "pre AS (SELECT qid, term FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY term) AS r FROM ty JOIN terms ON starts_with(term, ts[-1])) WHERE r <= 5), q AS (SELECT qid, term FROM own UNION SELECT qid, term FROM pre)"


@query(
    "h1_search_instant",
    f"""WITH {INDEX}, {TERMS}, {_TYPED}, {_COMPLETED}, sc AS (SELECT qid, doc_id AS doc, {s6(f"sum({weight_sql()})")} AS score FROM post JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2),
        cut AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) <= 512),
        f AS (SELECT qid, doc, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 1 END AS rel FROM cut WINDOW w AS (PARTITION BY qid)),
        g AS (SELECT qid, doc, {s6('0.5::double*rel')} AS fused FROM f WHERE rel >= 0.25)
        SELECT qid, doc, fused, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, doc) - 1 AS rank FROM g QUALIFY rank < 12""",
)
def h1(spark, sf_dir):
    """The page of twelve hits that appears while someone types: lexical, the last word completed."""
    return search.search(index(spark, sf_dir), terms(spark, sf_dir), typed(spark, sf_dir), 12)


@query("h1_h18_search_full")
def h1_full(spark, sf_dir):
    """Lexical and semantic lists, near spellings, late interaction on the first 30, diversified over the first 100."""
    words = typed(spark, sf_dir)
    v = vectors(spark, sf_dir).select("id", "v")
    asked = asks(spark, sf_dir, 1).join(words.select("qid").distinct(), "qid", "left_semi")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    known = keep(terms(spark, sf_dir))  # expansion reads the dictionary in several places, late interaction once more
    pieces = embed.hashed_vocabulary(known.select(F.col("term").alias("piece")), 8).select(F.col("piece").alias("word"), V.unit(F.col("v")).alias("v"))
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(T.default_tokens(F.col("text"))).alias("word"))
    tokens = words.select("qid", F.col("pos").alias("tok"), F.col("term").alias("word")).join(pieces, "word").select("qid", "tok", "v", F.lit(1.0).alias("w"))
    return search.search(index(spark, sf_dir), known, words, 12, search.FULL, v, asked, allowed=docs, late=(texts, pieces, tokens)).withColumn("fused", r6(F.col("fused")))


_ASKED = "a AS (SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN item_id END AS doc, 'src' || item_id % 30 AS collection FROM benchmark)"


@query("h17_scope", f"WITH {_ASKED} SELECT qid, count(*) AS docs FROM a, documents d WHERE CASE WHEN a.doc IS NOT NULL THEN d.doc_id = a.doc WHEN a.collection IN (SELECT source FROM documents) THEN d.source = a.collection ELSE true END GROUP BY 1")
def h17(spark, sf_dir):
    """How many documents a query may see: one, those of its collection, or all where the collection is unknown."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("collection"))
    qid = F.col("item_id")
    a = load(spark, sf_dir, "benchmark").select(qid.alias("qid"), F.when(qid % 3 == 0, qid).alias("doc"), F.concat(F.lit("src"), qid % 30).alias("collection"))
    some, free = search.scope(d, a)
    all_docs = F.broadcast(d.agg(F.count(F.lit(1)).alias("docs")))
    return some.groupBy("qid").agg(F.count(F.lit(1)).alias("docs")).unionByName(free.crossJoin(all_docs))


# Stored indexes.


@query("b9_stored_index", f"WITH {INDEX}, q(term) AS (VALUES ('then'), ('house'), ('erand')), s AS (SELECT doc_id AS doc, {s6(f'sum({weight_sql()})')} AS score FROM post JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1) SELECT * FROM s ORDER BY score DESC, doc LIMIT 10")
def b9(spark, sf_dir):
    """The index is written once, with document lengths; a query opens it and reads its own terms' folders."""
    root = scratch(spark)
    bm25.save(index(spark, sf_dir), root)
    q = spark.createDataFrame([(0, t) for t in ("then", "house", "erand")], "qid int, term string")
    s = bm25.scores(bm25.open_index(spark, root), q)
    return s.select("doc", r6(F.col("score")).alias("score")).orderBy(F.desc("score"), "doc").limit(10)


def stored(spark, sf_dir) -> VectorIndex:
    out = VectorIndex(spark, scratch(spark))
    out.build(vectors(spark, sf_dir).select("id", "v"), "embeddings")
    return out


@query("v10_v15_stored_index", knn_sql(10, 25))
def v10(spark, sf_dir):
    """Built, published, opened again by its folder, and searched in all cells."""
    built = stored(spark, sf_dir)
    return _found(VectorIndex(spark, built.state.root).search(asks(spark, sf_dir), 10, probes=None))


@query("v14_v18_index_changes", knn_sql(10, 25, "b.vec_id % 3 <> 0"))
def v14(spark, sf_dir):
    """Deleting a third and replacing another leaves an index equal to one built from the rows that stay."""
    built = stored(spark, sf_dir)
    v = vectors(spark, sf_dir).select("id", "v")
    built.change(v.filter("id % 3 = 1").withColumn("v", F.reverse("v")), v.filter("id % 3 = 0").select("id"))
    built.change(v.filter("id % 3 = 1"))
    return _found(built.search(asks(spark, sf_dir), 10, probes=None))


@query("v17_index_allowed", knn_sql(10, 25, "b.vec_id IN (SELECT doc_id FROM labels WHERE toxic = 0)"))
def v17(spark, sf_dir):
    """An allow-list is searched exactly, however long it is."""
    allowed = load(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("id")).distinct()
    return _found(stored(spark, sf_dir).search(asks(spark, sf_dir), 10, probes=4, allowed=allowed))


@query("v20_cosine_ranking", f"SELECT qid, id, {s6('1-dist')} AS sim, rank FROM ({knn_sql(10, 50, 'a.vec_id <> b.vec_id')})")
def v20(spark, sf_dir):
    """Brute-force cosine ranking of everything but the query."""
    return knn.nearest(vectors(spark, sf_dir), asks(spark, sf_dir, 50), 10, skip_self=True).select("qid", "id", r6(1.0 - r6(F.col("dist"))).alias("sim"), F.col("rank").cast("long").alias("rank"))


# Images: embeddings stand for figures, with a page and a box each.

_META = "me AS (SELECT vec_id AS id, vec_id % 40 AS doc, label AS page, (vec_id % 50)/100.0::double AS x, (vec_id % 30)/100.0::double AS y, 0.25::double AS w, 0.2::double AS h FROM embeddings)"


def figures(spark, sf_dir):
    i = F.col("id")
    return vectors(spark, sf_dir).select("id", (i % 40).alias("doc"), F.col("label").alias("page"), (i % 50 / 100.0).alias("x"), (i % 30 / 100.0).alias("y"), F.lit(0.25).alias("w"), F.lit(0.2).alias("h"))


@query("h20_image_hits", f"WITH k AS ({knn_sql(256, 50)}), {_META} SELECT qid, doc, page, id, {s6('1-dist')} AS sim, x, y FROM k JOIN me USING (id)")
def h20(spark, sf_dir):
    """The 256 nearest figures with the page and the box they lie in."""
    hits = knn.nearest(vectors(spark, sf_dir), asks(spark, sf_dir, 50), 256).join(figures(spark, sf_dir), "id")
    return hits.select("qid", "doc", "page", "id", r6(1.0 - r6(F.col("dist"))).alias("sim"), "x", "y")


@query(
    "h22_image_groups",
    f"""WITH k AS ({knn_sql(60, 50)}), {_META}, j AS (SELECT * FROM k JOIN me USING (id))
        SELECT qid, doc, page, min(rank) AS first, count(*) AS boxes, {s6('max(1-dist)')} AS best, string_agg(id::varchar, ',' ORDER BY rank) AS ids,
        {s6('greatest(min(x)-0.015::double,0)')} AS x0, {s6('greatest(min(y)-0.015::double,0)')} AS y0, {s6('least(max(x+w)+0.015::double,1)')} AS x1, {s6('least(max(y+h)+0.015::double,1)')} AS y1 FROM j GROUP BY 1, 2, 3""",
)
def h22(spark, sf_dir):
    hits = _found(knn.nearest(vectors(spark, sf_dir), asks(spark, sf_dir, 50), 60)).join(figures(spark, sf_dir), "id").withColumn("sim", 1.0 - F.col("dist"))
    g = fusion.group_images(hits)
    return g.select("qid", "doc", "page", F.col("first").cast("long").alias("first"), "boxes", r6(F.col("best")).alias("best"), F.array_join(F.transform("places", lambda p: p.id), ",").alias("ids"), *(r6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("h25_reserved_cards", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '~card/' || o_custkey ELSE 'doc/' || o_orderkey END AS doc, CASE WHEN o_orderkey % 4 = 0 THEN c_name END AS title FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def h25(spark, sf_dir):
    """Hits on cards carry the card's title; other hits stay as they are."""
    o = load(spark, sf_dir, "orders")
    hits = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("~card/"), "o_custkey")).otherwise(F.concat(F.lit("doc/"), "o_orderkey")).alias("doc"))
    cards = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"))
    return fusion.decorate(hits, cards)


@query("h27_agent_search")
def h27(spark, sf_dir):
    """What an agent is told about a query: at most six hits of different works, and how sure the search is."""
    page = h1(spark, sf_dir)
    source = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("base"))
    hits = fusion.dedup_copies(page.join(source, "doc").withColumn("page", F.col("doc"))).withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter("n <= 6")
    words = typed(spark, sf_dir).filter(F.length("term") >= 3)
    cover = bm25.coverage(index(spark, sf_dir), words.select("qid", "term")).join(hits.select("qid", "doc"), ["qid", "doc"], "left_semi")
    sure = cover.groupBy("qid").agg(F.max("coverage").alias("coverage"))
    top = bm25.scores(index(spark, sf_dir), words.select("qid", "term")).groupBy("qid").agg(F.max("score").alias("top"))
    told = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "doc"))), lambda s: s.doc).alias("docs"))
    out = typed(spark, sf_dir).select("qid").distinct().join(told, "qid", "left").join(sure, "qid", "left").join(top, "qid", "left")
    return out.select("qid", F.array_join(F.coalesce("docs", F.array().cast("array<bigint>")), ",").alias("docs"), r6(F.coalesce("coverage", F.lit(0.0))).alias("coverage"), fusion.confidence(F.col("top"), F.coalesce("coverage", F.lit(0.0))).alias("confidence"))


@query(
    "h31_sampled_pages",
    f"""WITH d AS (SELECT doc_id, source, {s6(legibility_sql('ws'))} AS score, row_number() OVER (PARTITION BY source ORDER BY md5('s|' || doc_id), doc_id) AS draw FROM (SELECT *, {SQL_WORDS} AS ws FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)))
        SELECT source, doc_id, score FROM d WHERE draw <= 10 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score >= 0.55 DESC, CASE WHEN score >= 0.55 THEN draw ELSE -score END, draw) = 1""",
)
def h31(spark, sf_dir):
    """A page of every work by at most ten seeded draws past an avoid-list: the first that reads like prose, else the best."""
    avoid = load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    d = load(spark, sf_dir, "documents").join(avoid, "doc_id", "left_anti")
    draws = ingest.draw_pages(d.select("source", "doc_id", "text"), "source", "doc_id", "s", 10)
    scored = draws.withColumn("score", r6(T.legibility(T.words_of(F.col("text")))))
    good = F.col("score") >= T.LEGIBLE_OK
    order = Window.partitionBy("source").orderBy(good.desc(), F.when(good, F.col("draw")).otherwise(-F.col("score")), "draw")
    return scored.withColumn("n", F.row_number().over(order)).filter("n = 1").select("source", "doc_id", "score")


@query("h34_search_log", "SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE event_type IN ('click', 'view') QUALIFY nth <= 200")
def h34(spark, sf_dir):
    """A ring of the last 200 searches, newest first, after a batch was appended."""
    e = load(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    log = ingest.ring(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), [F.desc("ts"), F.desc("event_id")], 200)
    return log.select("event_id", "event_type", F.col("nth").cast("long").alias("nth"))


# Documents and files.


@query("m4_reshelve", "WITH p AS (SELECT l_orderkey AS doc, l_linestatus AS root, l_returnflag || '/' || l_suppkey AS path FROM lineitem), o AS (SELECT DISTINCT doc FROM p WHERE root = 'O' AND doc NOT IN (SELECT doc FROM p WHERE root <> 'O')) SELECT doc, split_part(min(path), '/', 1) AS shelf FROM p WHERE doc IN (FROM o) GROUP BY 1")
def m4(spark, sf_dir):
    """Documents that only the renamed root holds take their shelf from their path again."""
    li = load(spark, sf_dir, "lineitem")
    files = li.select(F.col("l_orderkey").alias("doc"), F.col("l_linestatus").alias("root"), F.concat_ws("/", "l_returnflag", "l_suppkey").alias("path"))
    return ingest.reshelve(files, "O")


@query(
    "c3_figure_commit",
    """WITH pg AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem), inc AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem WHERE l_quantity > 10 OR l_orderkey % 2 = 0),
       full_ AS (SELECT doc FROM inc GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM pg WHERE pg.doc = inc.doc))
       SELECT doc, count(*) AS figures, max(CASE WHEN doc IN (FROM full_) THEN 'new' ELSE 'old' END) AS state FROM (SELECT doc, page FROM inc WHERE doc IN (FROM full_) UNION ALL SELECT doc, page FROM pg WHERE page = 1 AND doc NOT IN (FROM full_)) GROUP BY 1""",
)
def c3(spark, sf_dir):
    """Figures replace a document's old ones only if every page of it was read; a partial set is refused."""
    pages = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), "l_quantity")
    incoming = pages.filter("l_quantity > 10 or doc % 2 = 0").select("doc", "page").distinct().withColumn("state", F.lit("new"))
    pages = pages.select("doc", "page").distinct()
    current = pages.filter("page = 1").withColumn("state", F.lit("old"))
    out = ingest.commit_figures(current, incoming, pages, "doc", "page")
    return out.groupBy("doc").agg(F.count(F.lit(1)).alias("figures"), F.max("state").alias("state"))


@query("q10_overlap")
def q10(spark, sf_dir):
    """How much of an answer was copied: its longest run of words that its question has too."""
    c = load(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = c.filter("role = 'user'").join(b, ["conv_id", "turn"]).select("conv_id", "turn", "text", "answer")
    return metrics.copied_share(both, ["conv_id", "turn"], "answer", "text")


@query("x2_lex_tokens", "SELECT item_id, true AS same FROM benchmark")
def x2(spark, sf_dir):
    """The lexical form of the core tokenizer gives the same tokens."""
    t = load(spark, sf_dir, "benchmark")
    return t.select("item_id", (T.lex_tokens(F.col("text")) == T.core_tokens(F.col("text"))).alias("same"))


@query("x4_byte_levenshtein", "SELECT a.item_id, levenshtein(left(a.text, 24), left(b.text, 24))::bigint AS d FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def x4(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select("item_id", F.left("text", F.lit(24)).alias("t"))
    c = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return b.join(c, "item_id").select("item_id", T.byte_levenshtein(F.col("t"), F.col("u")).cast("long").alias("d"))


@query("x27_utf16_and_rounding", "SELECT doc_id, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::bigint AS units, floor((n_chars / 7.0::double) * 1e5 + 0.5::double) / 1e5 AS rounded FROM documents")
def x27(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", T.utf16_length(F.col("text")).alias("units"), T.round5(F.col("n_chars") / 7.0).alias("rounded"))


# Corpus map and telemetry.


@query("a11_trails")
def a11(spark, sf_dir):
    """From each theme's most central chunk through its nearest unvisited works."""
    v = vectors(spark, sf_dir)
    themes = v.select("id", F.col("label").alias("theme"))
    members = v.select("id", F.col("label").alias("theme"), F.col("id").alias("doc"), "v")
    seeds = atlas.exemplars(members, atlas.centroids(members, 64), 1).select("theme", F.col("id").alias("node"))
    base = v.select("id", (F.col("id") % 150).alias("base"))
    return atlas.trails(keep(neighbours(spark, sf_dir)), base, themes, seeds)


@query(
    "a15_view_fit",
    f"WITH p AS (SELECT vec_id AS id, embedding[1]::double AS x, embedding[2]::double AS y FROM embeddings), b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p), f AS (SELECT id, {s6('(x-x0)/(x1-x0)')} AS x, {s6('(y-y0)/(y1-y0)')} AS y FROM p, b) SELECT id, x, y, id = (SELECT id FROM f WHERE (x-0.5::double)*(x-0.5::double)+(y-0.5::double)*(y-0.5::double) <= 0.04::double ORDER BY (x-0.5::double)*(x-0.5::double)+(y-0.5::double)*(y-0.5::double), id LIMIT 1) AS hit FROM f",
)
def a15(spark, sf_dir):
    """Points fitted to the view, and the one nearest its middle within reach."""
    p = vectors(spark, sf_dir).select("id", F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"))
    fitted = atlas.fit_view(p).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))
    hit = atlas.hit_test(fitted, 0.5, 0.5, 0.2).select(F.col("id").alias("h"))
    return fitted.join(F.broadcast(hit), F.col("id") == F.col("h"), "left").select("id", "x", "y", F.col("h").isNotNull().alias("hit"))


@query("z4_breakdown", "WITH t AS (SELECT sum(strlen(text)) AS n FROM documents) SELECT lang AS part, sum(strlen(text))::bigint AS bytes FROM documents WHERE lang IN ('en', 'de') GROUP BY 1 UNION ALL SELECT 'unaccounted', (SELECT n FROM t)::bigint - sum(strlen(text))::bigint FROM documents WHERE lang IN ('en', 'de')")
def z4(spark, sf_dir):
    """Bytes of the parts one knows, and the rest of the whole."""
    d = load(spark, sf_dir, "documents").select("lang", F.octet_length("text").cast("long").alias("bytes"))
    parts = d.filter(F.col("lang").isin("en", "de")).groupBy(F.col("lang").alias("part")).agg(F.sum("bytes").alias("bytes"))
    return metrics.breakdown(parts, d.agg(F.sum("bytes").alias("bytes")))


@query(
    "z8_span_depths",
    f"WITH sp AS (SELECT o_custkey AS track, o_orderkey AS id, o_orderkey AS at, CASE o_orderkey % 3 WHEN 0 THEN 9000 WHEN 1 THEN 3000 ELSE 500 END AS us FROM orders) SELECT p.track, p.id, count(q.id) AS depth FROM sp p LEFT JOIN sp q ON p.track = q.track AND p.id <> q.id AND q.at <= p.at AND q.at + q.us >= p.at + p.us GROUP BY 1, 2",
)
def z8(spark, sf_dir):
    """How many spans of its track enclose each span."""
    o = load(spark, sf_dir, "orders")
    us = F.when(F.col("o_orderkey") % 3 == 0, 9000).when(F.col("o_orderkey") % 3 == 1, 3000).otherwise(500).cast("long")
    return metrics.span_depths(o.select(F.col("o_custkey").alias("track"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("at"), us.alias("us")))


@query("z7_span_summary", f"SELECT event_type AS name, count(*) AS spans, {s6('sum(value)')} AS total, {s6('median(value)')} AS median, min(epoch_us(ts)//1000) AS first FROM events GROUP BY 1")
def z7(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", F.expr(MILLIS).alias("ms"))
    return e.groupBy("name").agg(F.count(F.lit(1)).alias("spans"), r6(F.sum("value")).alias("total"), r6(F.median("value")).alias("median"), F.min("ms").alias("first"))
