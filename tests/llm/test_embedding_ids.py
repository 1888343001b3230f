"""Near-duplicate vectors whose ids repeat, and vectors of extreme length."""

import numpy as np
import pytest

from tripstar.llm import embeddings

SCHEMA = "vec_id long, embedding array<double>, label long"


def unit(*x):
    return (np.array(x) / np.linalg.norm(x)).tolist()


@pytest.mark.parametrize("first", [embeddings.AT_ONCE, 0])     # by windows; by tiles
def test_an_id_of_several_vectors_hides_no_link(spark, first, monkeypatch):
    a, b, c = unit(1.0, 0.0, 0.0), unit(1.0, 0.2, 0.0), unit(0.0, 0.0, 1.0)
    rows = [(5, a, 1), (5, b, 1), (7, c, 1), (5, c, 2), (9, unit(0.0, 0.1, 1.0), 2)]
    if not first:
        monkeypatch.setattr(embeddings, "WINDOW", 1)
        monkeypatch.setattr(embeddings, "TILE", 1)
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [
        (5, 1, 5), (5, 1, 5), (5, 1, 5), (7, 0, 7), (9, 1, 5)]


def test_very_long_and_very_short_vectors_link(spark):
    rows = [(i, (np.array(unit(1.0, 0.1 * i)) * size).tolist(), 1) for i, size in enumerate([1e-200, 1.0, 1e200])]
    rows += [(8, [0.0, 0.0], 1), (9, [float("inf"), 1.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: (2, 0, True), 1: (2, 0, False), 2: (2, 0, False), 8: (0, 8, True), 9: (0, 9, True)}


def test_an_id_is_one_node_of_components_over_labels(spark):
    a, b = unit(1.0, 0.0), unit(1.0, 0.1)
    rows = [(3, a, 1), (5, b, 1), (5, a, 2), (9, b, 2)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(3, 1, 3), (5, 1, 3), (5, 1, 3), (9, 1, 3)]
