"""Signed multisets over orders, events and parts: stateless operators, stateful ones, sinks and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import zset
from .base import MILLIS, load, query, r6, s6

#: Returned lines are retractions.
FEED = "SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS d FROM lineitem"
CUT = "1997-01-01"


def feed(spark, sf_dir):
    return zset.changes(load(spark, sf_dir, "lineitem"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).cast("long"))


@query("p1_filter", f"SELECT l_linestatus, sum(d)::bigint AS n FROM ({FEED}) WHERE l_quantity > 25 GROUP BY 1")
def p1(spark, sf_dir):
    return feed(spark, sf_dir).filter("l_quantity > 25").groupBy("l_linestatus").agg(F.sum("_delta").alias("n"))


@query("p2_map", f"SELECT (l_quantity*2)::bigint AS doubled, sum(d)::bigint AS n FROM ({FEED}) GROUP BY 1")
def p2(spark, sf_dir):
    return feed(spark, sf_dir).select((F.col("l_quantity") * 2).cast("long").alias("doubled"), "_delta").groupBy("doubled").agg(F.sum("_delta").alias("n"))


@query("p3_filter_map", "SELECT event_id, cast(regexp_extract(props, '\"k\": (\\d+)', 1) as bigint) AS k FROM events WHERE regexp_extract(props, '\"k\": (\\d+)', 1) <> ''")
def p3(spark, sf_dir):
    k = F.regexp_extract("props", r'"k": (\d+)', 1)
    return load(spark, sf_dir, "events").select("event_id", F.when(k != "", k).cast("long").alias("k")).filter("k is not null")


@query("p4_flat_map", "SELECT item_id, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM benchmark")
def p4(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", r"(?U)\s+")).alias("word"))


@query("p5_key_by_p6_unkey", "SELECT o_custkey AS key, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 3 = 0")
def p5(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    keyed = rows.select(F.col("o_custkey").alias("key"), F.struct("o_orderkey", "o_totalprice").alias("val")).filter("key % 3 = 0")
    return keyed.select("key", "val.*")


@query("p7_score_by_p8_unscore", "SELECT p_partkey, (p_retailprice*100)::bigint + p_size AS score FROM part")
def p7(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", ((F.col("p_retailprice") * 100).cast("long") + F.col("p_size")).alias("score"))


@query(
    "p9_fan_out",
    f"""SELECT 'status' AS branch, l_linestatus AS k, sum(d)::bigint AS n FROM ({FEED}) GROUP BY ALL
        UNION ALL SELECT 'flag', l_returnflag, sum(d)::bigint FROM ({FEED}) GROUP BY ALL""",
)
def p9(spark, sf_dir):
    """Two branches of one feed: one scan, one aggregation over both keys."""
    sets = F.explode(F.array(F.struct(F.lit("status").alias("branch"), F.col("l_linestatus").alias("k")), F.struct(F.lit("flag").alias("branch"), F.col("l_returnflag").alias("k"))))
    return feed(spark, sf_dir).select(sets.alias("s"), "_delta").select("s.*", "_delta").groupBy("branch", "k").agg(F.sum("_delta").alias("n"))


@query("k1_distinct", f"SELECT l_suppkey, l_linenumber, 1::bigint AS _delta FROM ({FEED}) GROUP BY 1, 2 HAVING sum(d) > 0")
def k1(spark, sf_dir):
    return zset.distinct(feed(spark, sf_dir), ["l_suppkey", "l_linenumber"])


@query("k2_aggregate", f"SELECT l_suppkey, sum(d)::bigint AS n, sum(l_quantity*d)::bigint AS qty FROM ({FEED}) GROUP BY 1 HAVING sum(d) > 0")
def k2(spark, sf_dir):
    return zset.aggregate(feed(spark, sf_dir), ["l_suppkey"], qty=F.col("l_quantity")).withColumn("qty", F.col("qty").cast("long"))


_AGG = "SELECT l_suppkey, sum(d)::bigint n, sum(l_quantity*d)::bigint qty FROM f {} GROUP BY 1 HAVING sum(d) > 0"


@query(
    "k2_aggregate_changelog",
    f"""WITH f AS ({FEED}), t AS (SELECT DISTINCT l_suppkey FROM f WHERE l_shipdate >= '{CUT}'),
        o AS ({_AGG.format(f"WHERE l_shipdate < '{CUT}'")}), w AS ({_AGG.format("")})
        SELECT l_suppkey, n, qty, -1::bigint AS _delta FROM o WHERE l_suppkey IN (FROM t)
        UNION ALL SELECT l_suppkey, n, qty, 1 FROM w WHERE l_suppkey IN (FROM t)""",
)
def k2_changes(spark, sf_dir):
    f = feed(spark, sf_dir)
    out = zset.aggregate_changes(f.filter(F.col("l_shipdate") < CUT), f.filter(F.col("l_shipdate") >= CUT), ["l_suppkey"], qty=F.col("l_quantity"))
    return out.withColumn("qty", F.col("qty").cast("long"))


_TOP = """SELECT {cols}, least(n, greatest({k}-(cum-n),0))::bigint AS _delta FROM (
  SELECT *, sum(n) OVER ({part} ORDER BY {order} ROWS UNBOUNDED PRECEDING) cum FROM (
    SELECT {cols}, sum(d) n FROM ({feed}) GROUP BY ALL HAVING sum(d) > 0)) WHERE greatest({k}-(cum-n),0) > 0"""


@query("k3_top_k", _TOP.format(cols="l_quantity, l_suppkey", k=100, part="", order="l_quantity DESC, l_suppkey DESC", feed=FEED))
def k3(spark, sf_dir):
    return zset.top_k(feed(spark, sf_dir), 100, [F.desc("l_quantity"), F.desc("l_suppkey")], ["l_quantity", "l_suppkey"])


_K3 = _TOP.format(cols="l_quantity, l_suppkey", k=50, part="", order="l_quantity DESC, l_suppkey DESC", feed="{}")


@query(
    "k3_top_k_changelog",
    f"""SELECT l_quantity, l_suppkey, sum(_delta)::bigint AS _delta FROM (
        SELECT * FROM ({_K3.format(FEED)}) UNION ALL
        SELECT l_quantity, l_suppkey, -_delta FROM ({_K3.format(f"SELECT * FROM ({FEED}) WHERE l_shipdate < '{CUT}'")}))
        GROUP BY 1, 2 HAVING sum(_delta) <> 0""",
)
def k3_changes(spark, sf_dir):
    f, order = feed(spark, sf_dir), [F.desc("l_quantity"), F.desc("l_suppkey")]
    old = zset.top_k(f.filter(F.col("l_shipdate") < CUT), 50, order, ["l_quantity", "l_suppkey"])
    return zset.diff(old, zset.top_k(f, 50, order, ["l_quantity", "l_suppkey"]))


@query(
    "k4_retain",
    """WITH a AS (SELECT user_id, event_type, (epoch_us(ts)//1000) AS ms FROM events WHERE event_type <> 'error'),
       g AS (SELECT user_id, count(*) AS gone FROM events WHERE event_type = 'error' GROUP BY 1),
       l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS nth FROM a WHERE ms >= 1706700000000 - 864000000)
       SELECT user_id, ms, event_type FROM l LEFT JOIN g USING (user_id) WHERE nth > coalesce(gone, 0)""",
)
def k4(spark, sf_dir):
    """Ten days of events; an error cancels its user's oldest live event."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", F.expr(MILLIS).alias("ms"))
    return zset.retain(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), ["user_id"], "ms", 1706700000000, 864000000).select("user_id", "ms", "event_type")


@query("t1_count", f"SELECT coalesce(sum(d),0)::bigint AS n FROM ({FEED})")
def t1(spark, sf_dir):
    return zset.count(feed(spark, sf_dir))


@query("t2_bag", f"SELECT l_partkey, l_suppkey, sum(d)::bigint AS _delta FROM ({FEED}) GROUP BY 1, 2 HAVING sum(d) > 0")
def t2(spark, sf_dir):
    return zset.consolidate(feed(spark, sf_dir), ["l_partkey", "l_suppkey"])


def pairs(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select("event_type", "user_id", F.when(F.col("value") < 10, -1).otherwise(1).cast("long").alias("_delta"), F.col("event_id").alias("_seq"))


_LAST = "SELECT event_type, user_id, arg_max(CASE WHEN value < 10 THEN -1 ELSE 1 END, event_id) d FROM events GROUP BY 1, 2 HAVING d > 0"


@query("t3_inverted_index", f"SELECT user_id FROM ({_LAST}) WHERE event_type = 'view'")
def t3(spark, sf_dir):
    return zset.inverted_index(pairs(spark, sf_dir), "event_type", "user_id").filter("event_type = 'view'").select(F.explode("keys").alias("user_id"))


@query("t4_multimap", f"SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS event_types FROM ({_LAST}) GROUP BY 1")
def t4(spark, sf_dir):
    return zset.multimap(pairs(spark, sf_dir), "user_id", "event_type").select("user_id", F.array_join("values", ",").alias("event_types"))


@query("t5_table", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'error'")
def t5(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "value", F.when(F.col("event_type") == "error", -1).otherwise(1).cast("long").alias("_delta"), F.col("event_id").alias("_seq"))
    return zset.last_push(e, ["user_id"]).select("user_id", "event_type", "value")


@query(
    "t6_stats",
    f"""SELECT l_returnflag, l_linestatus, n, {s6("t")} AS total, {s6("t/n")} AS mean, {s6("greatest(q/n-(t/n)*(t/n),0)")} AS variance FROM (
        SELECT l_returnflag, l_linestatus, count(*) n, sum(l_quantity) t, sum(l_quantity*l_quantity) q FROM lineitem GROUP BY 1, 2)""",
)
def t6(spark, sf_dir):
    f = zset.changes(load(spark, sf_dir, "lineitem"))
    out = zset.stats(f, F.col("l_quantity"), ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "n", r6(F.col("total")).alias("total"), r6(F.col("mean")).alias("mean"), r6(F.col("variance")).alias("variance"))


@query(
    "t6_stats_retracted",
    f"""SELECT l_linestatus, n, CASE WHEN n > 0 THEN {s6("t/n")} END AS mean FROM (
        SELECT l_linestatus, sum(d)::bigint n, sum(l_quantity*d) t FROM ({FEED}) GROUP BY 1)""",
)
def t6r(spark, sf_dir):
    return zset.stats(feed(spark, sf_dir), F.col("l_quantity"), ["l_linestatus"]).select("l_linestatus", "n", r6(F.col("mean")).alias("mean"))


@query("t7_histogram", f"SELECT (l_quantity::bigint//10) AS bucket, sum(d)::bigint AS n FROM ({FEED}) GROUP BY 1 HAVING sum(d) > 0")
def t7(spark, sf_dir):
    return zset.histogram(feed(spark, sf_dir), F.expr("cast(l_quantity as long) div 10"))


@query(
    "t7_quantiles",
    """WITH h AS (SELECT event_type, floor(value)::bigint AS bucket, count(*) n FROM events GROUP BY 1, 2),
       c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) cum, sum(n) OVER (PARTITION BY event_type) total FROM h),
       q(q) AS (VALUES (0.0::double), (0.5::double), (0.95::double), (1.0::double))
       SELECT event_type, q, min(bucket) AS bucket FROM c, q WHERE cum >= greatest(1, ceil(q*total)) GROUP BY 1, 2""",
)
def t7q(spark, sf_dir):
    h = zset.histogram(zset.changes(load(spark, sf_dir, "events")), F.floor("value"), ["event_type"])
    return zset.quantiles(h, [0.0, 0.5, 0.95, 1.0], ["event_type"])


@query("t8_ranked_top", _TOP.format(cols="l_quantity, l_partkey", k=40, part="", order="l_quantity, l_partkey", feed=FEED))
def t8(spark, sf_dir):
    return zset.top_k(feed(spark, sf_dir), 40, [F.asc("l_quantity"), F.asc("l_partkey")], ["l_quantity", "l_partkey"])


@query("t8_ranked_range", f"SELECT l_quantity AS score, l_partkey, sum(d)::bigint AS _delta FROM ({FEED}) WHERE l_quantity > 48 AND l_quantity <= 50 GROUP BY 1, 2 HAVING sum(d) > 0")
def t8r(spark, sf_dir):
    f = feed(spark, sf_dir).select(F.col("l_quantity").alias("score"), "l_partkey", "_delta")
    return zset.ranked_range(f, F.col("score") > 48, F.col("score") <= 50)


@query("t9_keyed_ranked", _TOP.format(cols="l_suppkey, l_quantity, l_partkey", k=3, part="PARTITION BY l_suppkey", order="l_quantity DESC, l_partkey DESC", feed=FEED))
def t9(spark, sf_dir):
    f = feed(spark, sf_dir).select("l_suppkey", "l_quantity", "l_partkey", "_delta")
    return zset.keyed_top(f, ["l_suppkey"], 3, [F.desc("l_quantity"), F.desc("l_partkey")])


@query(
    "t9_keyed_extremes",
    f"""WITH z AS (SELECT l_suppkey, l_quantity s, l_partkey v FROM ({FEED}) GROUP BY ALL HAVING sum(d) > 0)
        SELECT l_suppkey, min({{'s': s, 'v': v}}).s AS min_score, min({{'s': s, 'v': v}}).v AS min_value, max({{'s': s, 'v': v}}).s AS max_score, max({{'s': s, 'v': v}}).v AS max_value FROM z GROUP BY 1""",
)
def t9x(spark, sf_dir):
    f = feed(spark, sf_dir).select("l_suppkey", "l_quantity", "l_partkey", "_delta")
    return zset.keyed_extremes(f, ["l_suppkey"], "l_quantity", "l_partkey")


# Keyed sources: customers upserted by their later orders.


def customers(spark, sf_dir):
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))


def batch(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit("BUILDING")).alias("v"), F.when(F.col("o_orderstatus") == "P", "d").otherwise("u").alias("_op"), F.col("o_orderkey").alias("_seq"))


_UP = """WITH cur AS (SELECT c_custkey k, c_mktsegment v FROM customer),
  l AS (SELECT o_custkey k, arg_max(CASE WHEN o_orderkey%2=0 THEN o_orderpriority ELSE 'BUILDING' END, o_orderkey) v,
        arg_max(CASE WHEN o_orderstatus='P' THEN 'd' ELSE 'u' END, o_orderkey) op FROM orders GROUP BY 1),
  b AS (SELECT coalesce(cur.k, l.k) k, cur.v ov, CASE WHEN op='u' THEN l.v END nv, op FROM cur FULL JOIN l ON cur.k=l.k)"""


@query("s3_upsert_changes", _UP + " SELECT k, ov AS v, -1::bigint AS _delta FROM b WHERE op IS NOT NULL AND ov IS DISTINCT FROM nv AND ov IS NOT NULL UNION ALL SELECT k, nv, 1 FROM b WHERE op IS NOT NULL AND ov IS DISTINCT FROM nv AND nv IS NOT NULL")
def s3(spark, sf_dir):
    return zset.upsert_changes(customers(spark, sf_dir), batch(spark, sf_dir), ["k"])


@query("s3_s4_upsert_delete", _UP + " SELECT k, CASE WHEN op IS NULL THEN ov ELSE nv END AS v FROM b WHERE CASE WHEN op IS NULL THEN ov ELSE nv END IS NOT NULL")
def s4(spark, sf_dir):
    return zset.upsert(customers(spark, sf_dir), batch(spark, sf_dir), ["k"])


@query("s5_point_read", "SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey = 42")
def s5(spark, sf_dir):
    return customers(spark, sf_dir).filter("k = 42")


@query("s6_read_in_transaction", f"SELECT l_linestatus, sum(d)::bigint AS _delta FROM ({FEED}) WHERE l_shipdate < '{CUT}' OR l_shipdate >= '1998-01-01' GROUP BY 1 HAVING sum(d) > 0")
def s6_tx(spark, sf_dir):
    f = feed(spark, sf_dir).select("l_linestatus", "l_shipdate", "_delta")
    state = zset.consolidate(f.filter(F.col("l_shipdate") < CUT).drop("l_shipdate"), signed=True)
    return zset.consolidate(zset.push(state, f.filter(F.col("l_shipdate") >= "1998-01-01").select("l_linestatus", "_delta")))


@query("s1_signed_source", "SELECT event_type, sum(CASE WHEN user_id % 4 = 0 THEN 2 ELSE 1 END)::bigint - count(*) FILTER (value > 50) AS n FROM events GROUP BY 1")
def s1(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    f = zset.push(zset.changes(e, F.when(F.col("user_id") % 4 == 0, 2).otherwise(1).cast("long")), zset.changes(e.filter("value > 50"), -1))
    return f.groupBy("event_type").agg(F.sum("_delta").alias("n"))


# Time windows by key arithmetic, and the time series example.


@query("w1_tumbling_hours", f"SELECT ((epoch_us(ts)//1000)//3600000)::bigint AS hour, count(*) AS samples, {s6('sum(value)')} AS total FROM events GROUP BY 1")
def w1(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy(F.expr(f"{MILLIS} div 3600000").alias("hour")).agg(F.count(F.lit(1)).alias("samples"), r6(F.sum("value")).alias("total"))


@query("w2_daily_positive", f"SELECT ((epoch_us(ts)//1000)//86400000)::bigint AS day, event_type, {s6('sum(value)')} AS total FROM events WHERE value > 20 GROUP BY 1, 2")
def w2(spark, sf_dir):
    e = load(spark, sf_dir, "events").filter("value > 20")
    return e.groupBy(F.expr(f"{MILLIS} div 86400000").alias("day"), "event_type").agg(r6(F.sum("value")).alias("total"))


@query("w3_last_events", "SELECT event_id, (epoch_us(ts)//1000) AS ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def w3(spark, sf_dir):
    """Newest first, as a search log shows them."""
    return load(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", F.expr(MILLIS).alias("ms"))


# Joins.


@query("j1_full_outer", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n, coalesce(b.m, 0) AS m FROM (SELECT l_suppkey k, count(*) n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) a FULL JOIN (SELECT l_suppkey k, count(*) m FROM lineitem WHERE l_quantity < 2 GROUP BY 1) b ON a.k = b.k")
def j1(spark, sf_dir):
    """Two lists of scores put together by key: what one of them lacks counts as 0."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity")
    n = li.filter("l_quantity > 49").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    m = li.filter("l_quantity < 2").groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, "k", "full_outer").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))


@query("j2_resolve", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def j2(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("j3_scope_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j3(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("j4_unknown_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("j5_merge", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_custkey % 7 = 0 AND o_totalprice > 100000")
def j5(spark, sf_dir):
    """Replace the rows of some owners by incoming ones; rows that vanished go."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    incoming = o.filter("o_custkey % 7 = 0 and o_totalprice > 100000").withColumn("o_orderstatus", F.lit("X"))
    owners = load(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(owners, "o_custkey", "left_anti").select("o_orderkey", "o_orderstatus").unionByName(incoming.select("o_orderkey", "o_orderstatus"))


@query("j6_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j6(spark, sf_dir):
    n, r = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("j7_only_here", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'O')")
def j7(spark, sf_dir):
    """Documents of one root that no other root holds."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus")
    return li.filter("l_linestatus = 'O'").select("l_orderkey").distinct().join(li.filter("l_linestatus <> 'O'"), "l_orderkey", "left_anti")


@query("j8_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j8(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("j10_mutual_pairs", "SELECT DISTINCT a.l_partkey AS p, a.l_suppkey AS s FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_suppkey AND a.l_suppkey = b.l_partkey")
def j10(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    return e.join(e.select(F.col("s").alias("p"), F.col("p").alias("s")), ["p", "s"], "left_semi")


@query("j13_condition_or", "SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey AND (a.n_regionkey = b.n_nationkey OR contains(a.n_name, left(b.n_name, 4)))")
def j13(spark, sf_dir):
    """A join on either of two conditions, as the union of two joins."""
    n = load(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ka"), F.col("n_regionkey").alias("ra"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("kb"), F.col("n_name").alias("b"))
    one = a.join(b, F.col("ra") == F.col("kb"))
    grams = a.withColumn("g", F.explode(F.array_distinct(F.expr("transform(sequence(1, greatest(length(a) - 3, 1)), i -> substr(a, i, 4))"))))
    two = grams.join(b, F.col("g") == F.left("b", F.lit(4))).drop("g")
    return one.union(two).filter("ka <> kb").select("a", "b").distinct()


@query("j14_left_outer", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey")
def j14(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("q5_percentiles", "SELECT event_type, " + ", ".join(f"{s6(f'quantile_cont(value, {q})')} AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM events GROUP BY 1")
def q5(spark, sf_dir):
    ps = [r6(F.percentile("value", q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return load(spark, sf_dir, "events").groupBy("event_type").agg(*ps)


@query("agg_upper_median", "SELECT event_type, list_sort(list(floor(value)::bigint))[count(*)//2 + 1] AS median FROM events GROUP BY 1")
def upper_median(spark, sf_dir):
    """The upper of the two middles, by ranks: no list of a whole group."""
    e = load(spark, sf_dir, "events").select("event_type", F.floor("value").alias("bucket"))
    h = e.groupBy("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type")
    h = h.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    return h.filter(F.col("cum") >= F.expr("total div 2 + 1")).groupBy("event_type").agg(F.min("bucket").alias("median"))
