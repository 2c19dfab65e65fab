"""Exact neighbours over the inverted file against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import neighbours as nb
from lectern.operators import semantic


def _want(rows, asked, k):
    units = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            units.setdefault(key, []).append(np.asarray(v) / np.linalg.norm(v))
    out = {}
    for q in asked:
        u = units[q][0]
        scored = sorted((-round(float(u @ w), 9), key) for key, some in units.items() if key != q for w in some)
        out[q] = [(key, -s) for s, key in scored[:k]]
    return out


def _got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("kind", ["sphere", "clusters"])
def test_equals_all_pairs(spark, tmp_path, kind):
    r = np.random.default_rng(1)
    x = r.standard_normal((1500, 12))
    if kind == "clusters":
        x = r.standard_normal((25, 12))[r.integers(0, 25, 1500)] * 5 + 0.4 * x
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    path = str(tmp_path / "index")
    nb.build_vector_index(table, path, piece=100)
    found = nb.exact_neighbours(spark, path, table.where("vec_id % 50 = 0"), 10)
    got, want = _got(found), _want(rows, range(0, 1500, 50), 10)
    assert {q: [key for key, _ in v] for q, v in got.items()} == {q: [key for key, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 2e-9 for q in want for (_, a), (_, b) in zip(got[q], want[q]))
    lists, size = nb.index_size(spark, path)
    read = found.select("query", "lists").distinct().agg(F.avg("lists")).first()[0] / lists
    assert size == 1500 and (read < 0.5 if kind == "clusters" else read <= 1)


def test_odd_rows(spark, tmp_path):
    same = [3.0, 4.0]
    rows = [(i, same) for i in range(200)] + [(500, [3.0, 4.1]), (501, [-3.0, -4.0]), (502, [0.0, 0.0]), (503, None), (504, [float("nan"), 1.0]),
                                             (None, same), (505, [None, 1.0]), (500, [30.0, 41.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    path = str(tmp_path / "index")
    nb.build_vector_index(table, path, lists=3, piece=16)
    got = _got(nb.exact_neighbours(spark, path, table.where(F.col("vec_id").isin(0, 7, 150, 501)), 4))
    want = _want(rows, [0, 7, 150, 501], 4)
    assert {q: [key for key, _ in v] for q, v in got.items()} == {q: [key for key, _ in v] for q, v in want.items()}
    few = _got(nb.exact_neighbours(spark, path, table.where("vec_id = 501"), 1000))
    assert len(few[501]) == 202


def test_empty_and_uneven(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    nb.build_vector_index(empty, str(tmp_path / "empty"))
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert nb.exact_neighbours(spark, str(tmp_path / "empty"), one).count() == 0
    with pytest.raises(ValueError):
        nb.build_vector_index(one.union(spark.createDataFrame([(2, [1.0, 2.0])], "vec_id long, embedding array<float>")), str(tmp_path / "uneven"))


def test_assignment_to_given_centres(spark):
    r = np.random.default_rng(2)
    x, c = r.standard_normal((60, 3)).round(2), r.standard_normal((5, 3)).round(2)
    c[3] = c[1]  # a tie goes to the smaller key
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    centres = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "k int, centroid array<double>")
    got = {row.id: (row.cluster, row.distance) for row in semantic.assign_nearest(df, "v", centres, "k").collect()}
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert all(got[i][0] == d[i].argmin() and abs(got[i][1] - d[i].min()) < 1e-9 for i in range(60))
    assert semantic.assign_nearest(df, "v", centres.limit(0), "k").where("cluster IS NULL").count() == 60
    with pytest.raises(ValueError):
        semantic.assign_nearest(df, "v", centres, "k", most=2)


def test_a_piece_gives_only_rows_inside_the_bound():
    """Before, every query got k rows of every piece that it met, in a frame of its own."""
    around = [np.array([np.cos(t), np.sin(t)]) for t in np.linspace(0, 3, 40)]
    rows = [{"list": 0, "piece": 0, "asks": False, "q": None, "key": 100 - i, "v": v, "r": 1.0, "reach": np.nan} for i, v in enumerate(around)]
    rows += [{"list": 0, "piece": 0, "asks": True, "q": i, "key": 500 + i, "v": np.array([1.0, 0.0]), "r": 1.0, "reach": reach}
             for i, reach in enumerate([0.1, np.nan, 0.001])]
    got = pd.concat(nb._best(5)(iter([pd.DataFrame(rows)])))
    assert sorted(got.loc[got["q"] == 0, "key"]) == [99, 100] and sorted(got.loc[got["q"] == 2, "key"]) == [100]
    assert sorted(got.loc[got["q"] == 1, "key"]) == [96, 97, 98, 99, 100]
    same = pd.DataFrame([r | {"v": np.array([1.0, 0.0])} for r in rows])
    assert sorted(next(nb._best(5)(iter([same]))).query("q == 1")["key"]) == [61, 62, 63, 64, 65]
