import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import profile as pf
from lectern.operators import relational as rel
from lectern.operators.ranking import dense_position


def test_dense_position_equals_row_number_on_skew(spark):
    rnd = random.Random(5)
    rows = [("hot", i) for i in range(3000)] + [(f"g{rnd.randint(0, 20)}", 10000 + i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = dense_position(df, "g", "k", num_partitions=7)
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert sorted(got.collect()) == sorted(want.select("g", "k", F.col("pos").cast("long")).collect())


def test_alias_merge_and_counters(spark):
    counts = spark.createDataFrame([("MIT", 3), ("Massachusetts Institute of Technology", 2), ("X", 1), (None, 4)],
                                   "value string, n long")
    aliases = spark.createDataFrame([("MIT", "Massachusetts Institute of Technology"), ("Stanford", "Stanford University")],
                                    "alias string, canonical string")
    got = {r.value: r.n for r in pf.alias_merge(counts, aliases).collect()}
    assert got == {"Massachusetts Institute of Technology": 5, "X": 1, None: 4}
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "value string, n long")
    b = spark.createDataFrame([("k2", 9), ("k3", 3)], "value string, n long")
    assert {r.value: r.n for r in pf.merge_counters(a, b).collect()} == {"k1": 1, "k2": 9, "k3": 3}


def test_distinct_item_frequency_and_share(spark):
    df = spark.createDataFrame([(1, "MIT"), (1, "MIT"), (1, None), (2, "MIT")], "paper long, inst string")
    got = {r.inst: r.n for r in pf.distinct_item_frequency(df, "paper", "inst").collect()}
    assert got == {"MIT": 2, None: 1}
    s = pf.with_share(spark.createDataFrame([("a", 1), ("b", 3)], "value string, n long"))
    assert {r.value: (r.share, r.pct) for r in s.collect()} == {"a": (0.25, 25), "b": (0.75, 75)}


def test_enrich_and_selection(spark):
    left = spark.createDataFrame([(1, "", "a"), (2, "", "b")], "k long, pdf string, t string")
    extras = spark.createDataFrame([(1, "x.pdf", "info")], "k long, pdf string, conf_info string")
    got = {r.k: (r.pdf, r.conf_info) for r in rel.enrich(left, extras, "k").collect()}
    assert got == {1: ("x.pdf", "info"), 2: ("", None)}
    cat = rel.catalog(spark.createDataFrame([("b", 0, 1), ("A", 0, 1), (".hidden", 0, 1), ("z", 1, 1)],
                                            "name string, folder_ord int, is_file int"))
    assert [(r.name, r.idx) for r in cat.orderBy("idx").collect()] == [("A", 0), ("b", 1), ("z", 2)]
    sel = spark.createDataFrame([(1,), (9,)], "idx long")
    res = {r.idx: r.status for r in rel.select_by_index(cat, sel).collect()}
    assert res == {1: "ok", 9: "invalid"}


def test_dataset_class(spark):
    df = spark.createDataFrame([("2023_ICML.json",), ("2022_AAAI",), ("cosine_title_x",)], "n string")
    assert [r[0] for r in df.select(rel.dataset_class("n")).collect()] == ["main", "sub", "other"]


def test_dense_position_after_spread_is_exact(spark):
    # the shape that lost rows before: round-robin spread upstream, AQE on, two branches
    rows = [(f"g{i % 3 if i % 4 else 0}", i) for i in range(20000)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(8)
    got = dense_position(df, "g", "k", num_partitions=6)
    want = df.withColumn("pos", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).cast("long"))
    assert got.count() == 20000
    assert sorted(got.collect()) == sorted(want.collect())
