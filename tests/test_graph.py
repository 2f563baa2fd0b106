"""Co-mention edges and centrality on small cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from talktrace.operators import centrality, comentions


def _sets(spark, *teams):
    """(message_id, day, entities) to mention sets."""
    data = [(i, d, [(e, 1) for e in sorted(es)]) for i, d, es in teams]
    return spark.createDataFrame(data, "message_id long, day int, found array<struct<entity string, n bigint>>")


def test_pairs_and_edges(spark, rows):
    sets = _sets(spark, (1, 1, "123"), (2, 1, "1"), (3, 1, "12"), (4, 2, "12"))
    pairs = rows(comentions.comention_pairs(sets), "message_id", "x", "y")
    assert {p[1:] for p in pairs if p[0] == 1} == set(itertools.permutations("123", 2))
    assert len(pairs) == 10 and all(p[0] != 2 for p in pairs)
    edges = comentions.edges_daily(sets)
    got = rows(edges, "day", "x", "y", "weight")
    assert (1, "1", "2", 2) in got and (1, "2", "1", 2) in got and (2, "1", "2", 1) in got
    assert {(d, y, x, w) for d, x, y, w in got} == got
    totals = comentions.edges_total(edges, 1, 2)
    assert ("1", "2", 3) in rows(totals, "x", "y", "weight")
    assert rows(comentions.edges_daily(sets, exclude="3"), "x", "y") == {("1", "2"), ("2", "1")}


def _graph(spark, **edges):
    data = [(a, b, w) for (a, b), w in edges.items()]
    return spark.createDataFrame(data + [(b, a, w) for a, b, w in data], "x string, y string, weight long")


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


def test_subgraph_nodes_and_partners(spark, rows):
    totals = _graph(spark, ab=5, ac=9, bc=2, bd=7)
    graph = comentions.picked_subgraph(totals, _names(spark, "abd"))
    assert rows(graph, "label") == {("a to b",), ("b to a",), ("b to d",), ("d to b",)}
    nearest = rows(comentions.closest_neighbors(graph), "name", "closest_neighbor")
    assert nearest == {("a", "b"), ("b", "d"), ("d", "b")}
    scores = spark.createDataFrame([("a", 0.12345), ("b", 0.5), ("d", 1.0)], "entity string, centrality double")
    shown = rows(comentions.graph_nodes(graph, scores), "name", "centrality")
    assert shown == {("a", "12.35%"), ("b", "50.00%"), ("d", "100.00%")}
    shares = rows(comentions.partner_breakdown(totals, "b"), "partner", "weight", "share", "rank")
    assert shares == {("d", 7, 0.5, 1), ("a", 5, 5 / 14, 2), ("c", 2, 2 / 14, 3)}
    assert comentions.comention_matrix(totals).count() == 8
    dense = comentions.dense_pairs(totals, "abcd")
    assert dense.count() == 12 and ("c", "d", 0) in rows(dense, "x", "y", "weight")
    assert comentions.picked_subgraph(totals, _names(spark, "cd")).count() == 0


def _expected(edges):
    names = sorted(set("".join(edges)))
    matrix = np.zeros((len(names), len(names)))
    for (a, b), w in edges.items():
        matrix[names.index(a), names.index(b)] = matrix[names.index(b), names.index(a)] = w
    values, vectors = np.linalg.eigh(matrix)
    return dict(zip(names, np.abs(vectors[:, np.argmax(values)])))


@pytest.mark.parametrize("edges", [dict(ab=5, ac=3, bc=2, cd=4, de=1), dict(ab=1, ac=2, ad=1)])
def test_centrality_is_the_leading_eigenvector(spark, edges):
    entities = _names(spark, "abcdez")
    scores = centrality.eigenvector_centrality(_graph(spark, **edges), entities, tolerance=1e-10, max_iterations=300)
    got = {r["entity"]: r["centrality"] for r in scores.collect()}
    expected = _expected(edges)
    assert {n: got[n] for n in expected} == pytest.approx(expected, abs=1e-6)
    assert got["z"] == 0 and sum(v * v for v in got.values()) == pytest.approx(1)
    top = centrality.most_central(scores, _names(spark, "dbz")).first()
    assert top["entity"] == "b"


def test_centrality_reports_missing_convergence_and_empty_graphs(spark):
    graph = _graph(spark, ab=5, ac=3, bc=2, cd=4, de=1)
    with pytest.raises(centrality.NoConvergence):
        centrality.eigenvector_centrality(graph, tolerance=1e-12, max_iterations=3)
    empty = centrality.eigenvector_centrality(graph.where(F.lit(False)), _names(spark, "ab"))
    assert {tuple(r) for r in empty.collect()} == {("a", 0.0), ("b", 0.0)}
