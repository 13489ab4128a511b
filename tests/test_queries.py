"""Every registered query against its SQL, and those without SQL against their invariants."""

import pytest
from oracle import SF, compare

from zetaflow import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_entry(spark):
    assert catalog.entry(spark, SF).count() > 0


def test_mmr_is_a_permutation(spark):
    got = QUERIES["h14_mmr"](spark, SF).toPandas()
    for _, g in got.groupby("qid"):
        assert sorted(g["mmr_rank"]) == list(range(len(g))) and g["doc"].is_unique


def test_max_sim_stays_in_the_pool_range(spark):
    got = QUERIES["h13_max_sim"](spark, SF).toPandas()
    assert got["reranked"].between(-1e-6, 1.5).all() and got.groupby("qid").size().max() <= 30


def test_label_propagation_labels_every_linked_node(spark):
    got = QUERIES["a6_label_propagation"](spark, SF).toPandas()
    assert got["node"].is_unique and set(got["label"]) <= set(got["node"])


def test_projection_is_centred(spark):
    got = QUERIES["a12_projection"](spark, SF).toPandas()
    assert abs(got["x"].mean()) < 1e-6 and got["x"].var() >= got["y"].var() > 0


def test_blend_keeps_all_hits(spark):
    got = QUERIES["h23_blend"](spark, SF).toPandas()
    for _, g in got.groupby("qid"):
        texts, images = (g["hit"] >= 0).sum(), (g["hit"] < 0).sum()
        assert g["hit"].is_unique and sorted(g["slot"]) == list(range(len(g))) and texts <= 100 and images <= 30
        assert (g[g["hit"] < 0]["slot"] < 124).all()
