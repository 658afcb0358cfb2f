"""Walks in dense graphs, where Katz's series diverges, against the query's SQL in words."""

import numpy as np
import pytest

from tidemark.functions import graphs


def _complete(n: int) -> graphs.Graph:
    return graphs.Graph(*zip(*[(i, j) for i in range(n) for j in range(i + 1, n)]))


def _value(n: int, metric: str) -> float:
    return graphs.metrics(_complete(n), [metric], graphs.SERIES)[0][3]


def test_katz_beyond_the_radius_is_its_series():
    assert _value(25, "katz") == 0.0  # the solution of the equations was -0.2
    assert _value(11, "katz") == pytest.approx(1 / np.sqrt(11))  # these had none
    assert _value(5, "katz") == pytest.approx(graphs.metrics(_complete(5), ["katz"])[0][3])


def test_closed_walks_are_summed_to_the_sixtieth():
    # walks of i steps from a node of a complete graph back to it: (24^i + 24 (-1)^i) / 25
    want, f = 0.0, 1.0
    for i in range(61):
        f *= max(1, i)
        want += (24.0**i + 24 * (-1.0) ** i) / 25 / f
    assert _value(25, "subgraph") == pytest.approx(want, rel=1e-14)
    assert _value(25, "estrada_index") == pytest.approx(25 * want, rel=1e-14)


def test_the_query_takes_the_series(spark):
    from tidemark.operators import graph

    e = spark.createDataFrame([("g", i, j) for i in range(25) for j in range(i + 1, 25)], "graph string, src int, dst int")
    assert {r.value for r in graph.metrics(e, "graph", ["katz"], series=True).collect()} == {0.0}
