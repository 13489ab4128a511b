"""Text functions, full-text search and the term dictionary over documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T
from ..operators import bm25, fusion, ingest
from .base import load, query, r6, s6

_TOK = "list_filter(list_transform(regexp_split_to_array({}, '\\s+'), lambda x: lower(regexp_replace(x,'[^A-Za-z0-9]','','g'))), lambda x: x <> '')"
TOK = _TOK.format("text")
_CORE = "list_filter(list_transform(regexp_split_to_array({}, '\\s+'), lambda x: lower(regexp_replace(x,'[^\\p{{L}}\\p{{N}}]','','g'))), lambda x: strlen(x) > 1)"
CORE = _CORE.format("text")
WORDS = ["then", "house", "erand"]

INDEX = f"""tok AS (SELECT doc_id, unnest({TOK}) term FROM documents),
  post AS (SELECT doc_id, term, count(*) tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, len({TOK}) dl FROM documents),
  st AS (SELECT count(*)::double n, sum(dl)::double/count(*) avgdl FROM dl), df AS (SELECT term, count(*)::double df FROM post GROUP BY 1)"""


def weight_sql(k1: float = 1.2, b: float = 0.75) -> str:
    return f"ln(1+(n-df+0.5::double)/(df+0.5::double))*tf*({k1}::double+1)/(tf+{k1}::double*(1-{b}::double+{b}::double*dl/avgdl))"


def search_sql(terms: list[str], k: int, where: str = "", **p) -> str:
    q = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH {INDEX}, q(term) AS (VALUES {q}), s AS (SELECT doc_id AS doc, {s6(f"sum({weight_sql(**p)})")} AS score
      FROM post JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st {where} GROUP BY 1)
      SELECT * FROM s ORDER BY score DESC, doc LIMIT {k}"""


def index(spark, sf_dir):
    return bm25.build(load(spark, sf_dir, "documents"))


def one_query(spark, terms):
    return spark.createDataFrame([(0, t) for t in terms], "qid int, term string")


def search(spark, sf_dir, terms, k, allowed=None, **p):
    s = bm25.scores(index(spark, sf_dir), one_query(spark, terms), allowed, **p)
    return s.select("doc", r6(F.col("score")).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


@query("b4_bm25", search_sql(WORDS, 10))
def b4(spark, sf_dir):
    return search(spark, sf_dir, WORDS, 10)


@query("b5_bm25_params", search_sql(["the", "and", "nont"], 25, k1=0.9, b=0.4))
def b5(spark, sf_dir):
    return search(spark, sf_dir, ["the", "and", "nont"], 25, k1=0.9, b=0.4)


@query("b8_bm25_filtered", search_sql(["the", "house"], 20, "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def b8(spark, sf_dir):
    allowed = load(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("doc"))
    return search(spark, sf_dir, ["the", "house"], 20, allowed)


@query("b2_postings", f"WITH {INDEX} SELECT term, count(*) AS df, sum(tf)::bigint AS cf FROM post GROUP BY 1 HAVING count(*) >= 5")
def b2(spark, sf_dir):
    return index(spark, sf_dir).postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).filter("df >= 5")


@query("b10_statistics", f"WITH {INDEX} SELECT n::bigint AS n, {s6('avgdl')} AS avgdl FROM st")
def b10(spark, sf_dir):
    return index(spark, sf_dir).stats.select("n", r6(F.col("avgdl")).alias("avgdl"))


@query("b3_idf", f"WITH {INDEX} SELECT term, {s6('ln(1+(n-df+0.5::double)/(df+0.5::double))')} AS idf FROM df, st WHERE df > 20")
def b3(spark, sf_dir):
    i = index(spark, sf_dir)
    df = i.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df > 20")
    return df.crossJoin(F.broadcast(i.stats)).select("term", r6(bm25.idf(F.col("n"), F.col("df"))).alias("idf"))


def batch_terms(spark, sf_dir):
    """Every benchmark item asks its words of six letters or more."""
    q = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(T.default_tokens(F.col("text"))).alias("term"))
    return q.filter(F.length("term") >= 6)


BATCH = f"q AS (SELECT DISTINCT item_id qid, term FROM (SELECT item_id, unnest({TOK}) term FROM benchmark) WHERE length(term) >= 6)"
BATCH_SCORES = f"sc AS (SELECT qid, doc_id AS doc, sum({weight_sql()}) score FROM post JOIN q USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"


@query(
    "b7_bm25_batch",
    f"""WITH {INDEX}, {BATCH}, {BATCH_SCORES}, r AS (SELECT qid, doc, {s6("score")} score FROM sc)
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) - 1 AS rank FROM r QUALIFY rank < 10""",
)
def b7(spark, sf_dir):
    s = bm25.scores(index(spark, sf_dir), batch_terms(spark, sf_dir)).withColumn("score", r6(F.col("score")))
    return bm25.best(s, 10).withColumn("rank", F.col("rank").cast("long"))


@query("b11_bm25_retracted", search_sql(["the", "house"], 15).replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 10 <> 3)"))
def b11(spark, sf_dir):
    """Retracting documents is indexing what stays."""
    i = bm25.build(load(spark, sf_dir, "documents").filter("doc_id % 10 <> 3"))
    s = bm25.scores(i, one_query(spark, ["the", "house"]))
    return s.select("doc", r6(F.col("score")).alias("score")).orderBy(F.desc("score"), "doc").limit(15)


@query(
    "h33_feedback",
    f"""WITH {INDEX}, q(qid, term) AS (VALUES (0, 'house'), (0, 'then'), (0, 'the')), {BATCH_SCORES},
        top AS (SELECT doc FROM sc ORDER BY {s6("score")} DESC, doc LIMIT 5),
        c AS (SELECT term, {s6("sum(tf*ln((n+1)/(df+1)))")} w FROM post JOIN top ON doc = doc_id JOIN df USING (term), st WHERE term NOT IN (SELECT term FROM q) GROUP BY 1)
        SELECT term, w AS weight FROM c ORDER BY w DESC, term LIMIT 10""",
)
def h33(spark, sf_dir):
    i, q = index(spark, sf_dir), one_query(spark, ["house", "then", "the"])
    ranked = bm25.best(bm25.scores(i, q).withColumn("score", r6(F.col("score"))), 5)
    found = bm25.feedback_terms(i, ranked, q, 5, 1 << 30).withColumn("weight", r6(F.col("weight")))
    return found.orderBy(F.desc("weight"), "term").limit(10).select("term", "weight")


# Tokenizers and scalars.


@query("x1_core_tokens", f"SELECT doc_id, len({CORE})::bigint AS n, md5(array_to_string({CORE}, ' ')) AS digest FROM documents")
def x1(spark, sf_dir):
    t = load(spark, sf_dir, "documents").select("doc_id", T.core_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("x13_squash", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM documents")
def x13(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(T.squash(F.col("text"))).alias("digest"))


@query("x11_punctuation", "SELECT item_id, array_to_string(regexp_extract_all(text, '[!-/:-@\\[-`{-~]|[^\\s!-/:-@\\[-`{-~]+'), '|') AS tokens FROM benchmark")
def x11(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.punctuation_tokens(F.col("text")), "|").alias("tokens"))


TERMS = f"terms AS (SELECT term, count(*) AS freq FROM (SELECT unnest({TOK}) term FROM documents) GROUP BY 1)"


def terms(spark, sf_dir):
    return bm25.term_dictionary(load(spark, sf_dir, "documents"))


@query("x9_term_dictionary", f"WITH {TERMS} SELECT * FROM terms WHERE freq > 3")
def x9(spark, sf_dir):
    return terms(spark, sf_dir).filter("freq > 3")


@query("x5_complete", f"WITH {TERMS} SELECT term FROM terms WHERE starts_with(term, 'tion') ORDER BY term LIMIT 12")
def x5(spark, sf_dir):
    return bm25.complete(terms(spark, sf_dir), "tion", 12).select("term")


@query("x6_complete_ranked", f"WITH {TERMS} SELECT * FROM (SELECT * FROM terms WHERE starts_with(term, 'th') ORDER BY term LIMIT 2000) ORDER BY freq DESC, term LIMIT 12")
def x6(spark, sf_dir):
    return bm25.complete_ranked(terms(spark, sf_dir), "th", 12)


@query("x7_contains", f"WITH {TERMS} SELECT term FROM terms WHERE term IN ('the', 'zzzz')")
def x7(spark, sf_dir):
    return terms(spark, sf_dir).filter(F.col("term").isin("the", "zzzz")).select("term")


_NEAR = "SELECT term, freq, levenshtein(term, '{0}') d FROM (SELECT * FROM terms WHERE starts_with(term, '{1}') ORDER BY term LIMIT 4000) WHERE term <> '{0}' AND levenshtein(term, '{0}') <= 2 ORDER BY d, freq DESC, term LIMIT {2}"


@query("x8_correct", f"WITH {TERMS} SELECT term, freq, d::bigint AS d FROM ({_NEAR.format('thone', 'th', 10)})")
def x8(spark, sf_dir):
    return bm25.correct(terms(spark, sf_dir), "thone", 10).select("term", "freq", F.col("d").cast("long").alias("d"))


@query("x3_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, least(levenshtein(a.n_name, b.n_name), 4)::bigint AS d FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey")
def x3(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a")), n.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").select("a", "b", T.bounded_levenshtein(F.col("a"), F.col("b"), 3).cast("long").alias("d"))


@query(
    "h2_h3_expansion",
    f"""WITH {TERMS}, w(term, i) AS (VALUES ('the', 0), ('thone', 1), ('hous', 2)),
        p AS (SELECT term, 1 why FROM terms WHERE starts_with(term, 'hous') ORDER BY term LIMIT 5),
        c1 AS (SELECT term, 2 why FROM ({_NEAR.format('thone', 'th', 3)}) WHERE 'thone' NOT IN (SELECT term FROM terms)),
        c2 AS (SELECT term, 2 why FROM ({_NEAR.format('hous', 'ho', 3)}) WHERE 'hous' NOT IN (SELECT term FROM terms)),
        c0 AS (SELECT term, 2 why FROM ({_NEAR.format('the', 'th', 3)}) WHERE 'the' NOT IN (SELECT term FROM terms))
        SELECT term, min(why)::int AS why FROM (SELECT term, 0 why FROM w UNION ALL FROM p UNION ALL FROM c1 UNION ALL FROM c2 UNION ALL FROM c0) GROUP BY 1""",
)
def h2(spark, sf_dir):
    return bm25.expand(terms(spark, sf_dir), ["the", "thone", "hous"])


# Legibility.


def legibility_sql(words: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in T.LEGIBLE_STOPWORDS) + "]"
    t = f"list_filter(list_transform({words}, lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))), lambda w: w <> '')"
    letters = "length(regexp_replace(w, '[^\\p{L}]', '', 'g'))"
    share = lambda cond: f"len(list_filter(t, lambda w: {cond}))::double/len(t)"
    mean = "list_sum(list_transform(t, lambda w: length(w)))::double/len(t)"
    usual = f"CASE WHEN {mean} BETWEEN 3 AND 9 THEN 1.0::double WHEN {mean} < 3 THEN {mean}/3 ELSE greatest(1-({mean}-9)/6, 0) END"
    score = f"""0.55::double*least({share(f"list_contains({stop}, w)")}/0.28::double,1)
      +0.20::double*{share(f"length(w) <= 20 AND {letters}*5 >= length(w)*4 AND regexp_matches(w, '[aeiouy]')")}
      +0.15::double*(1-least({share(f"length(w) <= 2 AND NOT list_contains({stop}, w) AND {letters} = length(w)")}/0.20::double,1))+0.10::double*{usual}"""
    return f"(SELECT CASE WHEN len(t) = 0 THEN 0.0::double ELSE greatest(least({score}, 1), 0) END FROM (SELECT {t} AS t))"


SQL_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query("x14_legibility", f"SELECT doc_id, {s6(legibility_sql('ws'))} AS legibility FROM (SELECT doc_id, {SQL_WORDS} ws FROM documents)")
def x14(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", r6(T.legibility(T.words_of(F.col("text")))).alias("legibility"))


_WINDOWS = f"""w AS (SELECT item_id, ws, unnest(range(0, CASE WHEN len(ws) <= 40 THEN 1 ELSE ceil((len(ws)-40)/20.0)::bigint+1 END)) i
   FROM (SELECT item_id, {SQL_WORDS} ws FROM benchmark)), v AS (SELECT item_id, CASE WHEN len(ws) <= 40 THEN ws ELSE ws[i*20+1:i*20+40] END ws FROM w)"""


@query("x15_min_window", f"WITH {_WINDOWS} SELECT item_id, {s6(f'min({legibility_sql("ws")})')} AS worst FROM v GROUP BY 1")
def x15(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", r6(T.min_window(T.words_of(F.col("text")))).alias("worst"))


@query(
    "x16_legible_excerpt",
    f"""WITH b AS (SELECT item_id, i, ws[i*20+1:i*20+20] AS ws FROM (SELECT item_id, ws, unnest(range(0, greatest(ceil(len(ws)/20.0)::bigint, 1))) i FROM (SELECT item_id, {SQL_WORDS} ws FROM benchmark))),
        k AS (SELECT *, {legibility_sql('ws')} >= 0.55 AS keep FROM b), g AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, keep ORDER BY i) AS island FROM k),
        r AS (SELECT item_id, min(i) AS pos, string_agg(array_to_string(ws, ' '), ' ' ORDER BY i) AS t FROM g WHERE keep GROUP BY item_id, island)
        SELECT item_id, coalesce(string_agg(t, ' … ' ORDER BY pos), '') AS excerpt FROM (SELECT item_id FROM benchmark) LEFT JOIN r USING (item_id) GROUP BY 1""",
)
def x16(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", T.legible_excerpt(T.words_of(F.col("text"))).alias("excerpt"))


@query("x17_truncate_bytes", "SELECT doc_id, CASE WHEN strlen(text) <= 37 THEN text ELSE left(text, list_max(list_filter(range(0, 38), lambda n: strlen(left(text, n)) <= 37))) || '…' END AS t FROM documents")
def x17(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.truncate_bytes(F.col("text"), 37).alias("t"))


@query("x18_snippet", "SELECT item_id, CASE WHEN length(text) <= 60 THEN text ELSE CASE WHEN contains(left(text,60), ' ') THEN regexp_replace(left(text,60), ' [^ ]*$', '') ELSE left(text,60) END || '…' END AS t FROM benchmark")
def x18(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", T.snippet(F.col("text"), 60).alias("t"))


_THEME = "list_filter(list_filter(list_transform(regexp_split_to_array(text, '[^A-Za-z]'), lambda x: lower(x)), lambda x: length(x) BETWEEN 3 AND 20), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in T.THEME_STOPWORDS) + "], x))"


@query("x19_term_tokens", f"SELECT doc_id, len({_THEME})::bigint AS n, md5(array_to_string({_THEME}, ' ')) AS digest FROM documents")
def x19(spark, sf_dir):
    t = load(spark, sf_dir, "documents").select("doc_id", T.term_tokens(F.col("text"), T.THEME_STOPWORDS).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("x20_x21_identifiers", "SELECT p_partkey, regexp_replace(p_brand || '-' || p_size, '-[0-9]+$', '') AS base, starts_with(p_type, 'S') AS reserved FROM part")
def x20(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", T.base_id(F.concat("p_brand", F.lit("-"), "p_size")).alias("base"), T.is_reserved(F.regexp_replace("p_type", "^S", "~")).alias("reserved"))


_PATH = "CASE WHEN page_id % 3 = 0 THEN 'top' ELSE 'shelf' || page_id % 5 || '/sub' END || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.md' ELSE '' END"


def paths(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.expr(_PATH.replace(" || ", " || ")).alias("path"))


@query(
    "x23_x24_kind_and_shelf",
    f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
        SELECT page_id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'jpeg' THEN 'image' WHEN 'md' THEN 'text' END AS kind,
        CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE 'Linked' END AS shelf FROM p""",
)
def x23(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", T.file_kind(F.col("path")).alias("kind"), T.shelf(F.col("path"), F.lit("Linked")).alias("shelf"))


@query(
    "x25_fnv_slots",
    """SELECT p_partkey, ((xor(list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_brand, ''), lambda c: ascii(c)::bigint)),
       lambda h, c: (xor(h, c) * 16777619) & 4294967295), p_size::bigint)) * 16777619) & 4294967295 AS slot FROM part""",
)
def x25(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", T.fnv1a(F.col("p_brand"), F.col("p_size")).alias("slot"))


@query("x26_seeded_sample", "SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def x26(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(F.md5(F.concat(F.lit("7|"), "doc_id")), "doc_id").limit(100)


@query("x32_ghost_prefix", "SELECT item_id, lower(regexp_extract(left(text, 40 + (item_id % 9)::int), '([A-Za-z0-9]{2,})$', 1)) AS prefix FROM benchmark")
def x32(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    return b.select("item_id", T.ghost_prefix(F.left("text", (40 + F.col("item_id") % 9).cast("int"))).alias("prefix"))


@query("x34_wiki_links", "SELECT item_id, array_to_string(regexp_extract_all(regexp_replace(text, '(\\w+) (\\w+)', '[[\\1]] \\2'), '\\[\\[([^\\[\\]]+)\\]\\]', 1), ',') AS links FROM benchmark")
def x34(spark, sf_dir):
    body = F.regexp_replace("text", r"(?s)^(.*?)(\w+) (\w+)", "$1[[$2]] $3")
    return load(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.wiki_links(body), ",").alias("links"))


def content_terms(spark, sf_dir):
    """The words of three letters or more of every benchmark item."""
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(T.default_tokens(F.col("text"))).alias("term"))
    return b.filter(F.length("term") >= 3).distinct()


@query("x30_query_coverage")
def x30(spark, sf_dir):
    """Best share of an item's content words that begin a word of one document, over all documents."""
    found = bm25.coverage(index(spark, sf_dir), content_terms(spark, sf_dir))
    return found.groupBy("qid").agg(r6(F.max("coverage")).alias("coverage"))


@query("j12_prefix", f"WITH {TERMS}, q AS (SELECT DISTINCT left(n_name, 3) AS p FROM nation), l AS (SELECT DISTINCT lower(p) AS p FROM q UNION SELECT 'tha' UNION SELECT 'ron') SELECT p AS prefix, count(*) AS terms, sum(freq)::bigint AS uses FROM l JOIN terms ON starts_with(term, p) GROUP BY 1")
def j12(spark, sf_dir):
    """A prefix join as an equi-join on prefixes of the lengths that are asked."""
    asked = load(spark, sf_dir, "nation").select(F.lower(F.left("n_name", F.lit(3))).alias("prefix"))
    asked = asked.union(spark.createDataFrame([("tha",), ("ron",)], "prefix string")).distinct()
    hit = bm25.prefix_matches(terms(spark, sf_dir), asked)
    return hit.groupBy("prefix").agg(F.count(F.lit(1)).alias("terms"), F.sum("freq").alias("uses"))


@query("x31_confidence", "SELECT event_id, CASE WHEN value IS NULL THEN 'none' WHEN value >= 6 AND (user_id % 100)/99.0::double >= 0.99::double THEN 'strong' ELSE 'weak' END AS confidence FROM events")
def x31(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_id", fusion.confidence(F.col("value"), F.col("user_id") % 100 / 99.0).alias("confidence"))


@query("s9_content_hash", "SELECT md5(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def s9(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query(
    "x29_hyphen_fusion",
    f"""WITH {TERMS}, l AS (SELECT item_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM (SELECT item_id, {SQL_WORDS} AS ws FROM benchmark)),
        h AS (SELECT item_id, pos*2-1 AS pos, left(w, 4) || '-' AS word, substr(w, 5) AS next FROM l WHERE length(w) >= 8 AND regexp_full_match(w, '[a-z]+')),
        r AS (SELECT item_id, pos, CASE WHEN replace(word, '-', '') || next IN (SELECT term FROM terms WHERE freq > 20) THEN replace(word, '-', '') || next ELSE word || next END AS word FROM h)
        SELECT item_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM r GROUP BY 1""",
)
def x29(spark, sf_dir):
    """Long words broken after four letters, as at the end of a line, and put together again where the vocabulary knows them."""
    w = load(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.words_of(F.col("text"))).alias("pos", "w")).filter("length(w) >= 8 and w rlike '^[a-z]+$'")
    halves = F.array(F.struct((F.col("pos") * 2).alias("pos"), F.concat(F.left("w", F.lit(4)), F.lit("-")).alias("word")), F.struct((F.col("pos") * 2 + 1).alias("pos"), F.expr("substr(w, 5)").alias("word")))
    lines = w.select("item_id", F.explode(halves).alias("h")).select("item_id", "h.*")
    known = terms(spark, sf_dir).filter("freq > 20").select("term")
    fused = ingest.fuse_hyphens(lines, known, ["item_id"])
    return fused.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s.word), " ")).alias("digest"))


ASKED = ["sh ra", "blm", "e m", "royal"]


@query(
    "x33_subsequence",
    f"""WITH RECURSIVE a AS (SELECT p_partkey, lower(p_name) AS l, length(p_name) AS n, q, replace(q, ' ', '') AS c FROM part, (VALUES {", ".join(f"('{q}')" for q in ASKED)}) v(q)),
        m AS (SELECT p_partkey, l, n, q, c, 0 AS i, 0 AS prev, 0 AS score, '' AS places FROM a
          UNION ALL
          SELECT p_partkey, l, n, q, c, i + 1, spot, score + CASE WHEN spot = 1 THEN 18 WHEN l[spot-1] IN (' ', '-', '_', '·', '/', '(', '[', '.', ',', ':', ';', '''', '"') THEN 12
              WHEN i > 0 AND spot = prev + 1 THEN 8 ELSE 1 - least(spot - prev - 1, 6) END, places || spot || ' '
            FROM (SELECT *, prev + instr(substr(l, prev + 1), c[i+1]) AS spot, instr(substr(l, prev + 1), c[i+1]) AS step FROM m WHERE i < length(c)) WHERE step > 0),
        r AS (SELECT p_partkey, q AS query, score + CASE WHEN contains(l, q) THEN 10 ELSE 0 END - n * 0.05::double AS score, string_split(trim(places), ' ')::int[] AS spot FROM m WHERE i = length(c))
        SELECT p_partkey, query, {s6("score")} AS score, len(list_filter(spot, lambda x: NOT list_contains(spot, x - 1))) AS runs, list_min(spot) - 1 AS first, list_max(spot) AS last FROM r""",
)
def x33(spark, sf_dir):
    """Parts whose names hold the characters of a few queries in order."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, ASKED))).alias("query"))
    hit = p.select("p_partkey", "query", T.subsequence(F.col("p_name"), F.col("query")).alias("m")).filter("m is not null")
    return hit.select("p_partkey", "query", r6(F.col("m.score")).alias("score"), F.size("m.spans").alias("runs"), F.array_min("m.spans.start").alias("first"), F.array_max("m.spans.end").alias("last"))


# File names of eight shapes about the first two long words of a document, and the titles they stand for.
_SHAPES = [
    ("shelf/Old {a} and {b} harbour (z-library.sk, 1lib.sk).pdf", "Old {a} and {b} harbour"),
    ("Old {a} {b} harbour_text.pdf", "Old {a} {b} harbour"),
    ("Old {a} {b} harbour 9780140449136.epub.pdf", "Old {a} {b} harbour"),
    ("a/b/Il {a} di {b} [libgen] (2nd ed.).djvu", "Il {a} di {b} (2nd ed.)"),
    ("Old {a} {b} harbour copy 2.pdf", "Old {a} {b} harbour"),
    ("the_art_of_{a}_harbour.pdf", "The Art of {A} Harbour"),
    ("a-harbour-of-{a}-and-tea.pdf", "A Harbour of {A} And Tea"),
    ("fringesof{a}w00unse.pdf", "fringesof{a}w00unse"),
]


def _shape(which: int) -> str:
    """SQL of the file names (0) or the titles (1), by doc_id."""
    fill = lambda s: "concat('" + s.replace("{a}", "', a, '").replace("{b}", "', b, '").replace("{A}", "', upper(left(a, 1)), substr(a, 2), '") + "')"
    return "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {fill(s[which])}" for i, s in enumerate(_SHAPES)) + " END"


_TITLE_WORDS = "SELECT doc_id, coalesce(nullif(regexp_extract({t}, '{first}', 1), ''), 'sail') AS a, coalesce(nullif(regexp_extract({t}, '{second}', 2), ''), 'mast') AS b FROM documents"
_TITLE_PATTERNS = {"t": "text", "first": "([a-z]{4,12})", "second": "([a-z]{4,12})[^a-z]+([a-z]{4,12})"}


@query("x22_titles", f"WITH w AS ({_TITLE_WORDS.format(**_TITLE_PATTERNS)}) SELECT doc_id, {_shape(1)} AS title FROM w")
def x22(spark, sf_dir):
    """Titles of the file names of all documents."""
    d = load(spark, sf_dir, "documents")
    word = lambda p, g, other: F.coalesce(F.nullif(F.regexp_extract("text", p, g), F.lit("")), F.lit(other))
    w = d.select("doc_id", word(_TITLE_PATTERNS["first"], 1, "sail").alias("a"), word(_TITLE_PATTERNS["second"], 2, "mast").alias("b"))
    return w.select("doc_id", names.file_title(F.expr(_shape(0))).alias("title"))
