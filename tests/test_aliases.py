"""Aliases found in the data against the distance of all pairs."""

import random

import pytest

from lectern.operators import aliases
from lectern.operators.profile import alias_merge


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _names(seed, n=70):
    r = random.Random(seed)
    base = ["MIT", "Univ. of Toronto", "ETH Zürich", "Google", "a", "", "日本大学"]
    out = list(base)
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(w) + 1)
            w[at:at + r.randrange(2)] = r.choice([[], ["x"], ["T"], [" "]])
        out.append("".join(w))
    return out


@pytest.mark.parametrize("distance", [1, 2])
def test_near_names_equal_all_pairs(spark, distance):
    names = _names(distance)
    df = spark.createDataFrame([(n, 1) for n in names + [None]], "name string, variant int").repartition(3)
    got = {tuple(r) for r in aliases.near_names(df, "name", distance).collect()}
    every = sorted(set(names), key=lambda s: s.encode())
    want = {(a, b, _distance(a, b)) for i, a in enumerate(every) for b in every[i + 1:] if _distance(a, b) <= distance}
    assert got == want and len(want) > 20


def test_found_aliases_merge_counts(spark):
    rows = [("Google", 50), ("Gogle", 3), ("Goggle", 2), ("Googles", 25), ("MIT", 10), ("MTI", 1), ("NIT", 6), (None, 9), ("Gogle", 1)]
    counts = spark.createDataFrame(rows, "name string, n long")
    found = aliases.find_aliases(counts)
    got = {tuple(r) for r in found.collect()}
    assert got == {("Gogle", "Google", 4, 50), ("Goggle", "Google", 2, 50), ("Googles", "Google", 25, 50)}
    merged = {r.name: r.n for r in alias_merge(counts, found, "name").collect()}
    assert merged == {"Google": 81, "MIT": 10, "MTI": 1, "NIT": 6, None: 9}
    with pytest.raises(ValueError):
        aliases.near_names(counts, "name", 0)


def test_variants_are_not_broadcast(spark, capsys):
    """The variants are many times the names: a join planned by the names' size sent them all to the driver."""
    counts = spark.createDataFrame([(f"name {i}", i + 1) for i in range(50)], "name string, n long")
    for found in (aliases.find_aliases(counts), aliases.near_names(counts)):
        assert found.count() > 0
        found.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
