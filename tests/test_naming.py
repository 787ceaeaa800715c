from __future__ import annotations

import random

import pytest

from jobloom.operators.naming import unique_names


def plain(bases: list[str]) -> list[str]:
    used, out = set(), []
    for b in bases:
        name, n = b, 2
        while name in used:
            name, n = f"{b}_{n}", n + 1
        used.add(name)
        out.append(name)
    return out


CASES = [
    ["x", "x", "x"],
    ["x", "x_2", "x"],
    ["x", "x", "x_2"],
    ["x", "x", "x_2", "x_2", "x_2_2", "x"],
    ["x_3", "x", "x", "x", "x_2", "x_3"],
    ["x_2", "x_3", "x_4", "x", "x", "x", "x"],
    ["x", "x", "x", "x", "x_4", "x_3", "x_2"],
    ["x_02", "x", "x", "x_1", "x_1"],
    ["x_2_2", "x_2", "x", "x", "x_2", "x_2"],
    ["a_2", "a_2", "a_2_2", "a"],
    ["_2", "_2", "", ""],
]


@pytest.mark.parametrize("bases", CASES)
def test_names_are_those_of_one_pass(spark, bases):
    df = spark.createDataFrame(list(enumerate(bases)), "at long, base string").repartition(3)
    assert [r.name for r in unique_names(df, "base", ["at"], "name").orderBy("at").collect()] == plain(bases)


def test_random_cascades(spark):
    rnd = random.Random(6)
    bases = [f"{rnd.choice('ab')}" + "".join(f"_{rnd.randint(1, 5)}" for _ in range(rnd.choice([0, 0, 0, 1, 1, 2]))) for _ in range(160)]
    df = spark.createDataFrame(list(enumerate(bases)), "at long, base string").repartition(3)
    got = [r.name for r in unique_names(df, "base", ["at"], "name").orderBy("at").collect()]
    assert got == plain(bases)
    assert len(set(got)) == len(got)


def test_no_rows(spark):
    assert unique_names(spark.createDataFrame([], "at long, base string"), "base", ["at"], "name").collect() == []


def test_null_bases_stay_null(spark):
    for more in ([], [(3, "x"), (4, "x_2"), (5, "x")]):
        df = spark.createDataFrame([(0, None), (1, None), (2, "x"), *more], "at long, base string")
        got = [r.name for r in unique_names(df, "base", ["at"], "name").orderBy("at").collect()]
        assert got == [None, None, *plain(["x", *(b for _, b in more)])]
