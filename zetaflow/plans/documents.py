"""Chunking, reconciliation, shelves, caches, page geometry, audits, listings and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions import text as T
from ..operators import editing, fusion, ingest
from .base import MILLIS, load, query, r6, s6
from .text import SQL_WORDS, legibility_sql

_CH = f"""w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents), ch AS (SELECT doc_id, ws, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= 200 THEN 1 ELSE ceil((len(ws)-200)/160.0)::bigint+1 END)) AS idx FROM w)"""


@query("c1_chunks", f"WITH {_CH} SELECT doc_id, idx::int AS idx, md5(array_to_string(ws[idx*160+1:idx*160+200], ' ')) AS digest FROM ch")
def c1(spark, sf_dir):
    c = ingest.chunks(load(spark, sf_dir, "documents"), ["doc_id"], T.words_of(F.col("text")))
    return c.select("doc_id", "idx", F.md5(F.array_join("words", " ")).alias("digest"))


def order_lines(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    current = li.filter("l_orderkey % 2 = 0 and l_linenumber <= 4")
    incoming = li.filter("l_orderkey % 6 = 0 and l_linenumber >= 3").dropDuplicates(["l_orderkey", "l_linenumber"])
    return current, incoming


_INC = "inc AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 6 = 0 AND l_linenumber >= 3), cur AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 4), ow AS (SELECT DISTINCT l_orderkey FROM inc)"


@query(
    "c2_commit_counts",
    f"""WITH {_INC} SELECT l_orderkey, (SELECT count(*) FROM cur WHERE cur.l_orderkey = ow.l_orderkey AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM inc)) AS removed,
        (SELECT count(*) FROM inc WHERE inc.l_orderkey = ow.l_orderkey AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM cur)) AS added FROM ow""",
)
def c2(spark, sf_dir):
    current, incoming = order_lines(spark, sf_dir)
    current = current.dropDuplicates(["l_orderkey", "l_linenumber"])
    return ingest.commit_chunks(current, incoming, "l_orderkey", ["l_orderkey", "l_linenumber"])[1]


@query("c2_committed", f"WITH {_INC} SELECT l_orderkey, count(*) AS n FROM (SELECT * FROM cur WHERE l_orderkey NOT IN (FROM ow) UNION ALL SELECT * FROM inc) GROUP BY 1")
def c2t(spark, sf_dir):
    current, incoming = order_lines(spark, sf_dir)
    table, _ = ingest.commit_chunks(current.dropDuplicates(["l_orderkey", "l_linenumber"]), incoming, "l_orderkey", ["l_orderkey", "l_linenumber"])
    return table.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


# Files: orders stand for files, customers for inodes.


def files(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    base = o.select(F.concat(F.lit("f/"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("inode"), F.round("o_totalprice").cast("long").alias("size"), (F.col("o_orderkey") % 1000).alias("mtime"))
    known = base.filter("inode % 4 <> 3").withColumn("state", F.when(F.col("inode") % 8 == 0, "missing").otherwise("present"))
    found = base.filter("inode % 5 <> 0")
    moved = base.filter("inode % 5 = 0 and inode % 7 = 1").withColumn("path", F.concat(F.lit("g/"), "inode"))
    found = found.withColumn("size", F.when(F.col("inode") % 11 == 2, F.col("size") + 1).otherwise(F.col("size"))).unionByName(moved)
    return known, found


_FILES = """base AS (SELECT 'f/' || o_orderkey AS path, o_orderkey AS inode, round(o_totalprice)::bigint AS size, o_orderkey % 1000 AS mtime FROM orders),
  known AS (SELECT *, CASE WHEN inode % 8 = 0 THEN 'missing' ELSE 'present' END AS state FROM base WHERE inode % 4 <> 3),
  found AS (SELECT path, inode, CASE WHEN inode % 11 = 2 THEN size+1 ELSE size END AS size, mtime FROM base WHERE inode % 5 <> 0
    UNION ALL SELECT 'g/' || inode, inode, size, mtime FROM base WHERE inode % 5 = 0 AND inode % 7 = 1),
  bo AS (SELECT k.path kp, f.path fp, k.inode ki, f.inode fi, k.size ks, f.size fs, k.mtime km, f.mtime fm, state FROM known k FULL JOIN found f ON k.path = f.path),
  gone AS (SELECT kp, ki FROM bo WHERE fp IS NULL AND state = 'present'), nw AS (SELECT fp, fi FROM bo WHERE kp IS NULL),
  mv AS (SELECT fp, kp FROM nw JOIN gone ON fi = ki WHERE fi IN (SELECT fi FROM nw GROUP BY 1 HAVING count(*) = 1) AND ki IN (SELECT ki FROM gone GROUP BY 1 HAVING count(*) = 1)),
  rec AS (SELECT kp AS path, CASE WHEN state = 'missing' THEN 'returned' ELSE 'edited' END AS change, NULL::varchar AS old_path FROM bo WHERE kp IS NOT NULL AND fp IS NOT NULL AND (state = 'missing' OR ks <> fs OR km <> fm)
   UNION ALL SELECT fp, 'moved', kp FROM mv UNION ALL SELECT fp, 'added', NULL FROM nw WHERE fp NOT IN (SELECT fp FROM mv)
   UNION ALL SELECT kp, 'missing', NULL FROM gone WHERE kp NOT IN (SELECT kp FROM mv))"""


@query("m1_j9_reconcile", f"WITH {_FILES} SELECT * FROM rec")
def m1(spark, sf_dir):
    return ingest.reconcile(*files(spark, sf_dir))


@query("m2_mass_deletion_guard", f"WITH {_FILES} SELECT change, count(*) AS n FROM rec, (SELECT count(*) AS lost FROM rec WHERE change = 'missing') WHERE NOT (change = 'missing' AND lost > 0.2 * (SELECT count(*) FROM known WHERE state = 'present')) GROUP BY 1")
def m2(spark, sf_dir):
    known, found = files(spark, sf_dir)
    live = known.filter("state = 'present'").count()
    return ingest.guard_mass_deletion(ingest.reconcile(known, found), live).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("m3_hash_duplicates", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS kept FROM documents")
def m3(spark, sf_dir):
    """A file with known content keeps the document it duplicates."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("kept")), "h").select("doc_id", "kept")


@query("m5_shelves", "SELECT source AS shelf, count(*) AS docs, string_agg(doc_id::varchar, ',' ORDER BY doc_id) FILTER (r <= 3) AS first FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) r FROM documents WHERE lang <> 'es') GROUP BY 1")
def m5_h32(spark, sf_dir):
    """Documents per shelf and the first three of each; only three per shelf are ever listed."""
    d = load(spark, sf_dir, "documents").filter("lang <> 'es'").select("source", "doc_id")
    r = d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("r <= 3")
    first = r.groupBy(F.col("source").alias("shelf")).agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first"))
    return d.groupBy(F.col("source").alias("shelf")).agg(F.count(F.lit(1)).alias("docs")).join(first, "shelf")


@query("m6_read_order", "SELECT user_id, row_number() OVER (ORDER BY max(event_id), user_id) AS pos FROM events GROUP BY 1 ORDER BY pos LIMIT 50")
def m6(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last")).orderBy("last", "user_id").limit(50)
    return e.select("user_id", F.row_number().over(Window.orderBy("last", "user_id")).cast("long").alias("pos"))


def cache_pages(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 10 == 0, "dead").when(F.col("doc_id") % 10 == 1, "pinned").otherwise("live")
    return d.select(F.col("doc_id").alias("doc"), F.col("n_chars").alias("bytes"), kind.alias("kind"), (F.col("doc_id") * 7919 % 1009).alias("last_read"))


@query(
    "m7_cache_evictions",
    """WITH p AS (SELECT doc_id AS doc, n_chars AS bytes, CASE doc_id % 10 WHEN 0 THEN 'dead' WHEN 1 THEN 'pinned' ELSE 'live' END AS kind, doc_id*7919 % 1009 AS last_read FROM documents),
       h AS (SELECT sum(bytes) held FROM p WHERE kind <> 'dead'), l AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY last_read, bytes DESC, doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE kind = 'live')
       SELECT doc, bytes, kind FROM p WHERE kind = 'dead' UNION ALL SELECT doc, bytes, kind FROM l, h WHERE held - before > 0.9 * 1000000""",
)
def m7(spark, sf_dir):
    return ingest.evictions(cache_pages(spark, sf_dir), 1_000_000)


@query("m8_queue", "SELECT o_orderkey AS doc FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def m8(spark, sf_dir):
    claimed = load(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("doc"))
    return load(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P")).select(F.col("o_orderkey").alias("doc")).join(claimed, "doc", "left_anti")


@query("m10_stage_times", f"SELECT user_id, {s6('sum(value)')} AS summed, {s6('greatest(sum(value), ((max(epoch_us(ts))//1000)-(min(epoch_us(ts))//1000))::double)')} AS total FROM events GROUP BY 1")
def m10(spark, sf_dir):
    """Milliseconds of all stages, and the whole: the longer of their sum and the time from the first to the last."""
    e = load(spark, sf_dir, "events").select("user_id", "value", F.expr(MILLIS).alias("ms"))
    e = e.groupBy("user_id").agg(F.sum("value").alias("s"), (F.max("ms") - F.min("ms")).cast("double").alias("elapsed"))
    return e.select("user_id", r6(F.col("s")).alias("summed"), r6(F.greatest("s", "elapsed")).alias("total"))


@query("m11_timeline", "SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS pos FROM events WHERE event_type = 'signup' ORDER BY pos LIMIT 100")
def m11(spark, sf_dir):
    e = load(spark, sf_dir, "events").filter("event_type = 'signup'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return e.select("event_id", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("event_id"))).cast("long").alias("pos"))


@query("m12_evidence", "SELECT o_custkey AS card, count(DISTINCT l_partkey) AS docs, count(*) AS uses FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45 AND o_orderstatus = 'F' GROUP BY 1")
def m12(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    o = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("card"))
    return li.join(o, "o_orderkey").groupBy("card").agg(F.count_distinct("l_partkey").alias("docs"), F.count(F.lit(1)).alias("uses"))


@query("m13_grouped_caps", "SELECT p_brand, p_partkey, r AS nth FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 6")
def m13(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("nth")).filter("nth <= 6")


@query("m14_cards_to_chunks", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1 HAVING min(role) <> 'none'")
def m14(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("x", lambda s: s.text), "\n")).alias("digest"))


@query("m15_reading_order", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS pos FROM conversations")
def m15(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("pos"))


# Page geometry: line items stand for the vertical spans of words on a page.

_SPANS = "sp AS (SELECT l_suppkey AS page, (l_partkey*37 % 1000)/1000.0::double AS y0, (l_partkey*37 % 1000)/1000.0::double + 0.015::double AS y1 FROM lineitem WHERE l_quantity > 48)"


def spans(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").filter("l_quantity > 48")
    y = F.col("l_partkey") * 37 % 1000 / 1000.0
    return li.select(F.col("l_suppkey").alias("page"), y.alias("y0"), (y + 0.015).alias("y1"))


@query(
    "c7_gap_bands",
    f"""WITH {_SPANS}, e AS (SELECT * FROM sp UNION ALL SELECT DISTINCT page, 0.96::double, 0.96::double FROM sp),
        g AS (SELECT page, greatest(coalesce(max(y1) OVER (PARTITION BY page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.04::double), 0.04::double) a, least(y0, 0.96::double) b FROM e)
        SELECT page, {s6('a')} AS y0, {s6('b')} AS y1 FROM g WHERE b-a >= 0.07::double""",
)
def c7(spark, sf_dir):
    return ingest.gap_bands(spans(spark, sf_dir), ["page"]).select("page", r6(F.col("y0")).alias("y0"), r6(F.col("y1")).alias("y1"))


def boxes(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    box = [(F.col("l_partkey") % 80 / 100.0).alias("x"), (F.col("l_orderkey") % 80 / 100.0).alias("y"), (F.col("l_quantity") / 200.0).alias("w"), (F.col("l_quantity") / 250.0).alias("h")]
    rows = li.select(F.expr("l_orderkey div 8").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *box, (F.col("l_partkey") % 100 / 100.0).alias("score"), F.when(F.col("l_suppkey") % 3 == 0, "picture").otherwise("text").alias("cls"))
    return rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")


@query(
    "c9_c10_layout_filter",
    """WITH r AS (SELECT l_orderkey // 8 AS page, l_orderkey*10+l_linenumber AS id, l_partkey % 80/100.0::double AS x, l_orderkey % 80/100.0::double AS y, l_quantity/200.0::double AS w, l_quantity/250.0::double AS h,
         l_partkey % 100/100.0::double AS score, CASE WHEN l_suppkey % 3 = 0 THEN 'picture' ELSE 'text' END AS cls FROM lineitem),
       m AS (SELECT * FROM r WHERE id % 2 = 1 AND score >= 0.35::double AND cls = 'picture' AND w*h >= 0.01::double), k AS (SELECT * FROM r WHERE id % 2 = 0),
       bad AS (SELECT DISTINCT k.page, k.id FROM k JOIN m ON k.page = m.page AND greatest(least(k.x+k.w, m.x+m.w)-greatest(k.x, m.x), 0)*greatest(least(k.y+k.h, m.y+m.h)-greatest(k.y, m.y), 0) > 0.3::double*k.w*k.h)
       SELECT page, id FROM m UNION ALL SELECT page, id FROM k WHERE (page, id) NOT IN (SELECT page, id FROM bad)""",
)
def c9(spark, sf_dir):
    return ingest.keep_regions(*boxes(spark, sf_dir), ["page"]).select("page", "id")


_SPLIT = f"dw AS (SELECT source AS doc, doc_id AS page, strlen(text) AS bytes, {SQL_WORDS} AS ws FROM documents), win AS (SELECT page, ws, unnest(range(0, CASE WHEN len(ws) <= 40 THEN 1 ELSE ceil((len(ws)-40)/20.0)::bigint+1 END)) AS i FROM dw), wv AS (SELECT page, CASE WHEN len(ws) <= 40 THEN ws ELSE ws[i*20+1:i*20+40] END AS ws FROM win), mw AS (SELECT page, min({legibility_sql('ws')}) AS low FROM wv GROUP BY 1)"
_PAGES = f"{_SPLIT}, pg AS (SELECT doc, page, bytes, {s6(legibility_sql('ws'))} AS score, {s6('low')} AS low FROM dw JOIN mw USING (page))"


@query(
    "c11_text_audit",
    f"""WITH {_PAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score, page) n, count(*) OVER (PARTITION BY doc) c FROM pg WHERE bytes >= 40)
        SELECT doc, count(*) AS pages, {s6('avg(score)')} AS mean, max(score) FILTER (n = c//2+1) AS median, {s6('avg(CASE WHEN low < 0.45 THEN 1.0::double ELSE 0 END)')} AS noisy, string_agg(page::varchar, ',' ORDER BY page) FILTER (n <= 3) AS worst FROM o GROUP BY 1""",
)
def c11(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    score = T.let(T.words_of(F.col("text")), lambda w: F.struct(r6(T.legibility(w)).alias("score"), r6(T.min_window(w)).alias("min_score")))
    pages = d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.octet_length("text").alias("bytes"), score.alias("s")).select("doc", "page", "bytes", "s.*")
    a = ingest.audit(pages, "doc")
    return a.select("doc", "pages", r6(F.col("mean")).alias("mean"), "median", r6(F.col("noisy")).alias("noisy"), "worst")


@query("c12_word_sources", "SELECT source, count(*) FILTER (lang = 'en') AS layer, count(*) FILTER (lang <> 'en') AS vision, count(*) FILTER (n_chars > 2000) AS cached FROM documents GROUP BY 1")
def c12(spark, sf_dir):
    n = lambda c: F.count(F.when(c, 1))
    return load(spark, sf_dir, "documents").groupBy("source").agg(n(F.col("lang") == "en").alias("layer"), n(F.col("lang") != "en").alias("vision"), n(F.col("n_chars") > 2000).alias("cached"))


# Sources as tables.


@query("s10_overlay", "SELECT d.doc_id, coalesce(l.v, d.lang) AS words FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 'clean' || quality AS v FROM labels) l USING (doc_id)")
def s10(spark, sf_dir):
    """A sparse overlay replaces what it has."""
    from ..sources.files import overlay

    over = load(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("clean"), "quality").alias("words")).distinct()
    return overlay(load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("words")), over, ["doc_id"], "words")


_MARKED = "'preamble ' || string_agg('<!-- page ' || turn || ' -->' || text, '' ORDER BY turn)"


@query("s11_marked_pages", f"WITH m AS (SELECT conv_id, {_MARKED} AS body FROM conversations GROUP BY 1), p AS (SELECT conv_id, unnest(list_slice(string_split(body, '<!-- page '), 2, 10000)) AS part FROM m) SELECT conv_id, split_part(part, ' -->', 1)::bigint AS page, md5(substr(part, instr(part, ' -->') + 4)) AS digest FROM p")
def s11(spark, sf_dir):
    """Split a marked edition into pages; what stands before the first marker belongs to none."""
    from ..sources.files import marked_pages

    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    body = F.concat(F.lit("preamble "), F.array_join(F.transform("x", lambda s: F.concat(F.lit("<!-- page "), s.turn, F.lit(" -->"), s.text)), ""))
    return marked_pages(c.select("conv_id", body.alias("body")), "body").select("conv_id", "page", F.md5("text").alias("digest"))


@query("s12_pairs", "SELECT a.conv_id, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user'")
def s12(spark, sf_dir):
    from ..sources.files import pairs

    c = load(spark, sf_dir, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    both = c.filter("role = 'user'").join(b, ["conv_id", "turn"]).select("conv_id", F.col("text").alias("query"), F.col("answer").alias("passage"))
    return pairs(both, "conv_id")


@query("s17_metadata_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.title, a.title) AS title, coalesce(b.seen, a.seen) AS seen FROM (SELECT c_custkey k, c_name title, c_nationkey seen FROM customer) a FULL JOIN (SELECT o_custkey k, CASE WHEN max(o_orderkey) % 2 = 0 THEN max(o_orderpriority) END title, NULL::int seen FROM orders GROUP BY 1) b ON a.k = b.k")
def s17(spark, sf_dir):
    """Insert or update, keeping old values where the new row has none."""
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("t0"), F.col("c_nationkey").alias("s0"))
    b = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("o"), F.max("o_orderpriority").alias("p"))
    b = b.select("k", F.when(F.col("o") % 2 == 0, F.col("p")).alias("t1"))
    return a.join(b, "k", "full_outer").select("k", F.coalesce("t1", "t0").alias("title"), F.col("s0").alias("seen"))


# Listings and telemetry.


@query("z1_document_list", "WITH ids AS (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT page_id FROM pages) SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM ids LEFT JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def z1(spark, sf_dir):
    d, lab = load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels")
    ids = d.select("doc_id").union(lab.select("doc_id")).union(load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))).distinct()
    ids = ids.join(lab.filter("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    return ids.join(d, "doc_id", "left").join(lab.select("doc_id", "quality"), "doc_id", "left").withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("z2_ingest_rows", "SELECT o_orderkey, c_name, coalesce(n, 0) AS pages FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def z2(spark, sf_dir):
    n = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = load(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").join(n, "o_orderkey", "left").select("o_orderkey", "c_name", F.coalesce("n", F.lit(0)).alias("pages"))


@query("z3_page_count", "SELECT coalesce(a.k, b.k) AS doc, greatest(coalesce(x, 0), coalesce(y, 0)) AS pages FROM (SELECT c_nationkey k, count(*) x FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey k, count(*) y FROM supplier GROUP BY 1) b ON a.k = b.k")
def z3(spark, sf_dir):
    """Pages of a document by two counts, the text's and the scan's: the larger one."""
    a = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc")).agg(F.count(F.lit(1)).alias("x"))
    b = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc")).agg(F.count(F.lit(1)).alias("y"))
    return a.join(b, "doc", "full_outer").select("doc", F.greatest(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))).alias("pages"))


@query("z5_status_backfill", "SELECT doc_id, 'ready' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT page_id FROM pages)")
def z5(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    d = d.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").join(load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")), "doc_id", "left_semi")
    return d.withColumn("status", F.lit("ready"))


_TRACE = "sp AS (SELECT o_custkey AS track, o_orderkey AS id, o_orderkey % 3 AS depth, o_orderkey AS at, CASE o_orderkey % 3 WHEN 0 THEN 9000 WHEN 1 THEN 3000 ELSE 500 END AS us FROM orders)"


@query("z6_self_time", f"WITH {_TRACE} SELECT p.track, p.id, p.us - coalesce(sum(c.us), 0)::bigint AS self_us FROM sp p LEFT JOIN sp c ON c.track = p.track AND c.depth = p.depth + 1 AND c.at >= p.at AND c.at + c.us <= p.at + p.us GROUP BY p.track, p.id, p.us")
def z6(spark, sf_dir):
    """Time of a span without its direct children: an interval join within (track, depth)."""
    o = load(spark, sf_dir, "orders")
    us = F.when(F.col("o_orderkey") % 3 == 0, 9000).when(F.col("o_orderkey") % 3 == 1, 3000).otherwise(500).cast("long")
    s = o.select(F.col("o_custkey").alias("track"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3).alias("depth"), F.col("o_orderkey").alias("at"), us.alias("us"))
    c = s.select(F.col("track").alias("t"), (F.col("depth") - 1).alias("d"), F.col("at").alias("ca"), F.col("us").alias("cu"))
    j = s.join(c, (F.col("track") == F.col("t")) & (F.col("depth") == F.col("d")) & (F.col("ca") >= F.col("at")) & (F.col("ca") + F.col("cu") <= F.col("at") + F.col("us")), "left")
    return j.groupBy("track", "id", "us").agg(F.sum("cu").alias("c")).select("track", "id", (F.col("us") - F.coalesce("c", F.lit(0))).alias("self_us"))


@query(
    "z9_call_expectations",
    """WITH c AS (SELECT user_id, list(event_type ORDER BY event_id) AS calls FROM events GROUP BY 1)
       SELECT user_id, list_contains(calls, 'purchase') AS includes, NOT list_contains(calls, 'error') AS excludes,
       coalesce(list_position(calls, 'view') < list_position(calls, 'click') AND list_contains(calls, 'view') AND list_contains(calls, 'click'), false) AS ordered, len(list_distinct(calls)) = len(calls) AS once FROM c""",
)
def z9(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    e = e.select("user_id", F.transform("x", lambda s: s.event_type).alias("c"))
    has = lambda t: F.array_contains("c", t)
    ordered = has("view") & has("click") & (F.array_position("c", "view") < F.array_position("c", "click"))
    return e.select("user_id", has("purchase").alias("includes"), (~has("error")).alias("excludes"), ordered.alias("ordered"), (F.size(F.array_distinct("c")) == F.size("c")).alias("once"))


@query("h26_hit_dedupe", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def h26(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@query("h29_collection_match", "WITH q AS (SELECT DISTINCT p_type || ' ' || p_brand AS q FROM part), n AS (SELECT n_name AS name, n_nationkey AS k FROM nation UNION ALL SELECT DISTINCT p_type, 100 FROM part) SELECT q, arg_max(name, (CASE WHEN lower(q) = lower(name) THEN 1 ELSE 0 END, length(name), k, name)) AS name FROM q JOIN n ON contains(lower(q), lower(name)) OR contains(lower(name), lower(q)) GROUP BY 1")
def h29(spark, sf_dir):
    """The collection someone asks for: the same name, else the longest that overlaps, the last of equals. Collections are a short list."""
    p = load(spark, sf_dir, "part")
    q = p.select(F.concat_ws(" ", "p_type", "p_brand").alias("q")).distinct()
    names = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")).unionByName(p.select(F.col("p_type").alias("name"), F.lit(100).alias("k")).distinct())
    hit = q.join(F.broadcast(names), F.contains(F.lower("q"), F.lower("name")) | F.contains(F.lower("name"), F.lower("q")))
    same = (F.lower("q") == F.lower("name")).cast("int")
    return hit.groupBy("q").agg(F.max_by("name", F.struct(same, F.length("name"), "k", "name")).alias("name"))


@query("h30_read_pages", "SELECT doc_id, CASE WHEN strlen(text) < 40 THEN 'blank' ELSE 'ok' END AS state, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 2")
def h30(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    d = load(spark, sf_dir, "documents").select("doc_id", F.when(F.octet_length("text") < 40, "blank").otherwise("ok").alias("state"), F.row_number().over(w).cast("long").alias("n"))
    return d.filter("n <= 2")


@query("h23_blend")
def h23(spark, sf_dir):
    """Image hits dealt into the page of text hits of every item: 100 texts and 30 images a page at most."""
    from . import vectors

    texts = vectors.bm25.best(vectors.lexical(spark, sf_dir), 100).select("qid", F.col("doc").alias("hit"), "rank")
    images = vectors.semantic(spark, sf_dir).filter("rank < 30").select("qid", (-F.col("id") - 1).alias("hit"), "rank")
    return fusion.blend_hits(texts, images)


@query(
    "h24_shaped_hits",
    f"""WITH d AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents), p AS (SELECT *, list_position(list_transform(ws, lambda w: starts_with(lower(w), 'th')), true) AS first FROM d)
        SELECT doc_id, coalesce(first, 0)::bigint AS first, array_to_string(ws[greatest(coalesce(first, 1)-12, 1):coalesce(first, 1)+17], ' ') AS snippet FROM p""",
)
def h24(spark, sf_dir):
    """The first matching word and the words around it."""
    d = load(spark, sf_dir, "documents").select("doc_id", T.words_of(F.col("text")).alias("ws"))
    first = F.array_position(F.transform("ws", lambda w: F.startswith(F.lower(w), F.lit("th"))), True)
    d = d.withColumn("first", first.cast("long"))
    at = F.greatest(F.col("first"), F.lit(1))
    lo = F.greatest(at - 12, F.lit(1)).cast("int")
    return d.select("doc_id", "first", F.array_join(F.slice("ws", lo, (at + 18 - lo).cast("int")), " ").alias("snippet"))


@query("q9_spread_pages", "WITH n AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1) SELECT DISTINCT source, (1 + floor(i * (pages - 1) / 4.0::double + 0.5::double))::bigint AS page FROM n, (SELECT unnest(range(0, 5)) AS i)")
def q9(spark, sf_dir):
    """Five pages of every work, evenly spaced, the first and the last among them."""
    from ..operators.metrics import spread

    n = load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("pages"))
    return n.select("source", F.explode(spread(F.col("pages"), 5)).alias("page"))


_LAID = f"""l AS (SELECT doc_id, (pos - 1) // 300 AS page, (pos - 1) % 300 AS r, word FROM (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (SELECT doc_id, {SQL_WORDS} AS ws FROM documents)))"""
_BREAK = "CASE WHEN r = 0 THEN '' WHEN r % 10 = 0 AND (r // 10 % 5 = 0 OR r // 10 % 7 = 0) THEN {between} ELSE ' ' END || word"


def laid_pages(words: DataFrame) -> DataFrame:
    """Pages of 300 words (doc, words), ten a line: every fifth line is indented, every seventh stands further down, and words waver."""
    pages = words.filter(F.size("words") > 0).withColumn("page", F.explode(F.sequence(F.lit(0), F.expr("int((size(words) - 1) div 300)"))))
    box = lambda w, r: F.struct(
        w.alias("t"),
        (0.1 + 0.08 * (r % 10) + F.when(F.floor(r / 10) % 5 == 0, 0.03).otherwise(0.0)).alias("x"),
        (0.05 + 0.02 * F.floor(r / 10) + 0.03 * F.floor(r / 70) + 0.001 * (r % 3)).alias("y"),
        F.lit(0.07).alias("w"),
        F.lit(0.012).alias("h"),
    )
    return pages.select("doc", F.col("page").cast("long").alias("page"), F.transform(F.slice("words", F.col("page") * 300 + 1, 300), box).alias("words"))


@query("c5_paragraphs", f"""WITH {_LAID} SELECT doc_id, page, md5(string_agg({_BREAK.format(between="'|'")}, '' ORDER BY r)) AS digest FROM l GROUP BY 1, 2""")
def c5(spark, sf_dir):
    """Lines and paragraphs of all documents, set on pages."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.words_of(F.col("text")).alias("words"))
    paras = F.transform("paras", lambda p: F.array_join(p, " "))
    return laid_pages(d).select(F.col("doc").alias("doc_id"), "page", editing.paragraphs(F.col("words")).alias("paras")).select("doc_id", "page", F.md5(F.array_join(paras, "|")).alias("digest"))


@query(
    "c6_editions",
    f"""WITH {_LAID}, p AS (SELECT doc_id, page, string_agg({_BREAK.format(between="chr(10) || chr(10)")}, '' ORDER BY r) AS body FROM l GROUP BY 1, 2)
        SELECT doc_id, md5('# ' || doc_id || chr(10) || string_agg(chr(10) || '<!-- page ' || page || ' -->' || chr(10) || chr(10) || body || chr(10), '' ORDER BY page)) AS digest FROM p GROUP BY 1""",
)
def c6(spark, sf_dir):
    """Editions of all documents. Tests hold words broken at hyphens against a plain version."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.words_of(F.col("text")).alias("words"))
    return editing.editions(laid_pages(d)).select(F.col("doc").alias("doc_id"), F.md5("body").alias("digest"))


# Edits of a page that begins with "Thc (old, harbour of rest": two that apply, then one for each reason against.
_EDITS = [("Thc", "The", 1), ("old", "olde", 1), ("harbour", "harbour of", 1), ("rest", "of rest", 1), ("harbour", "tavern", 1), ("zqx", "zq", 1), ("rest", "best", 0), ("rest", "rest", 1), ("r" * 41, "rest", 1)]


@query(
    "c4_edits",
    f"""WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents) SELECT doc_id, md5(concat_ws(' ', 'The (olde, harbour of rest', nullif(array_to_string(ws, ' '), ''))) AS digest,
        'applied,applied,duplicates next word,duplicates previous word,edit distance,no anchor,unverified,noop,too long' AS verdicts FROM w WHERE NOT list_contains(ws, 'zqx')""",
)
def c4(spark, sf_dir):
    """Edits of the words of all documents, behind a first line that they are about."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.array(*map(F.lit, ["Thc", "(old,", "harbour", "of", "rest"])), T.words_of(F.col("text"))).alias("words"))
    edits = F.array(*(F.struct(F.lit(o).alias("original"), F.lit(c).alias("corrected"), F.lit(bool(v)).alias("verified")) for o, c, v in _EDITS))
    done = d.select("doc_id", editing.apply_edits(F.col("words"), edits).alias("e"))
    return done.select("doc_id", F.md5(F.array_join("e.words.t", " ")).alias("digest"), F.array_join("e.verdicts", ",").alias("verdicts"))


_AT = "0.463::double AS px, 0.2::double + (doc_id % 7) * 0.05::double AS py"
_AWAY = "greatest({lo} - {p}, 0, {p} - ({lo} + {size}::double))"


@query(
    "z10_selection",
    f"""WITH {_LAID}, b AS (SELECT doc_id, page, r, {_AT}, 0.1::double + 0.08::double * (r % 10) + CASE WHEN r // 10 % 5 = 0 THEN 0.03::double ELSE 0 END AS x,
          0.05::double + 0.02::double * (r // 10) + 0.03::double * (r // 70) + 0.001::double * (r % 3) AS y FROM l),
        d AS (SELECT *, {s6(f"sqrt({_AWAY.format(lo='x', p='px', size=0.07)}**2 + {_AWAY.format(lo='y', p='py', size=0.012)}**2)")} AS dist FROM b),
        g AS (SELECT doc_id, page, r // 10 AS line, max(y) + 0.012::double - min(y) AS h FROM b GROUP BY ALL)
        SELECT doc_id, page, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id AND g.page = d.page) AS lines,
          (SELECT {s6("list_sort(list(h))[count(*) // 2 + 1]")} FROM g WHERE g.doc_id = d.doc_id AND g.page = d.page) AS height, min(dist) AS dist FROM d GROUP BY 1, 2""",
)
def z10(spark, sf_dir):
    """Printed lines of every page, their height, and how far a point is from the nearest word."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.words_of(F.col("text")).alias("words"))
    p = laid_pages(d).withColumn("py", 0.2 + F.col("doc") % 7 * 0.05)
    near = geometry.nearest_word(F.col("words"), F.lit(0.463), F.col("py"))
    lines = geometry.let(geometry.line_boxes(F.col("words")), lambda b: F.struct(F.size(b).cast("long").alias("lines"), geometry.median_height(b).alias("height")))
    return p.select(F.col("doc").alias("doc_id"), "page", lines.alias("b"), near.dist.alias("dist")).select("doc_id", "page", "b.lines", r6(F.col("b.height")).alias("height"), r6(F.col("dist")).alias("dist"))


_TRIES = "o_custkey % 9 <> 0 AS claimed, CASE o_orderkey % 5 WHEN 0 THEN 'locked' WHEN 1 THEN 'unprepared' WHEN 2 THEN 'error' ELSE 'done' END AS text, CASE o_custkey % 5 WHEN 0 THEN 'locked' WHEN 1 THEN 'unprepared' WHEN 2 THEN 'error' ELSE 'done' END AS figures, CASE o_custkey % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'figures' END AS removed, CASE o_orderstatus WHEN 'F' THEN 'text_ready' WHEN 'P' THEN 'ready' ELSE 'queued' END AS state"


@query(
    "m9_attempts",
    f"""WITH t AS (SELECT o_orderkey, {_TRIES} FROM orders), o AS (SELECT *, CASE WHEN state = 'queued' AND text = 'unprepared' THEN 'failed text' WHEN state = 'queued' AND removed = 'text' THEN 'cancelled' WHEN state = 'queued' AND text = 'locked' THEN 'staged text'
          WHEN state = 'queued' AND text = 'error' THEN 'failed text' WHEN figures = 'unprepared' THEN 'failed figures' WHEN removed IS NOT NULL THEN 'cancelled' WHEN figures = 'locked' THEN 'staged figures' WHEN figures = 'error' THEN 'failed figures' ELSE 'ready' END AS went FROM t),
        r AS (SELECT *, claimed AND state <> 'ready' AS ran FROM o)
        SELECT o_orderkey, CASE WHEN NOT ran THEN state WHEN went = 'cancelled' THEN 'deleted' WHEN went = 'staged figures' THEN 'text_ready' ELSE split_part(went, ' ', 1) END AS state,
          CASE WHEN NOT claimed THEN 'skipped' WHEN NOT ran THEN 'ready' ELSE split_part(went, ' ', 1) END AS outcome, CASE WHEN ran AND starts_with(went, 'staged') THEN split_part(went, ' ', 2) END AS resume FROM r""",
)
def m9(spark, sf_dir):
    """One attempt at every order as if it were a document to ingest."""
    t = load(spark, sf_dir, "orders").selectExpr("o_orderkey", *_TRIES.split(", "))
    return t.select("o_orderkey", ingest.next_state(*(F.col(c) for c in ("state", "claimed", "text", "figures", "removed"))).alias("s")).select("o_orderkey", "s.*")
