import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import fuzzy as fz

TITLE = "Continual Causal Abstractions"


def test_goldens():
    assert fz.fuzzy_score("causal", TITLE) == 21.0
    assert round(fz.fuzzy_score("cca", TITLE), 3) == 7.222
    assert round(fz.fuzzy_score("cabs", TITLE), 3) == 9.375
    assert fz.fuzzy_score("causal", "causal") == 28.0
    assert fz.fuzzy_score("xyz", "causal") == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc _d", min_size=1, max_size=10), st.text(alphabet="abcd", min_size=1, max_size=4))
def test_dp_equals_bruteforce(c, q):
    assert fz.fuzzy_score(q, c) == pytest.approx(fz.fuzzy_score_bruteforce(q, c))


def test_spark_paths_equal_python(spark):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("ab c_dé") for _ in range(rnd.randint(0, 14)))) for i in range(300)]
    rows += [(1000, TITLE), (1001, "cab"), (1002, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    for q in ["ab", "cab", "c", "a_d", "é"]:
        got = {r.id: r.score for r in fz.score_fuzzy(df, q, F.col("t")).collect()}
        for i, t in rows:
            want = fz.fuzzy_score(q, t)
            if want > 0:
                assert got[i] == pytest.approx(want), (q, t)
            else:
                assert i not in got


def test_subsequence_pattern(spark):
    df = spark.createDataFrame([("a]b^c-d\\e",), ("abc",)], "t string")
    for q in ["]^", "-\\", "abc"]:
        pat = fz.subsequence_pattern(q)
        got = [r[0] for r in df.select(F.col("t").rlike(pat)).collect()]
        want = [fz.fuzzy_score(q, r[0]) > 0 for r in df.collect()]
        assert got == want


def test_lcs():
    assert fz.lcs_length("abcbdab", "bdcaba") == 4
    assert fz.lcs_length("", "abc") == 0
