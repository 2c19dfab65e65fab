"""Null keys keep their rows and match each other."""

from lectern.operators import profile, ranking, relational


def test_null_keys(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "dataset string, pos int")
    placed = ranking.dense_position(rows, "dataset", "pos", "at").collect()
    assert sorted((r.dataset or "", r.pos) for r in placed) == [("", 2), ("", 3), ("a", 1)]
    assert relational.remove_datasets(rows, substring="a").count() == 2
    assert relational.remove_datasets(rows, names=["a"]).count() == 2
    assert relational.add_if_absent(rows, rows.where("pos = 3")).count() == 3
    left = spark.createDataFrame([(None, 5), ("x", 1)], "value string, n long")
    right = spark.createDataFrame([(None, 9)], "value string, n long")
    assert sorted((r.value or "", r.n) for r in profile.merge_counters(left, right).collect()) == [("", 9), ("x", 1)]
    last = ranking.last_wins(spark.createDataFrame([("k", None, 7)], "key string, o int, v int"), "key", "o").collect()
    assert [(r.key, r.o, r.v) for r in last] == [("k", None, 7)]
