from __future__ import annotations

import random

import pytest
from tabulon.operators import similar
from tabulon.operators.similar import recommend

OUTPUT = ["id", "title"]


def run(df, titles, n=10):
    return recommend(
        df,
        titles,
        group="g",
        title="title",
        id_column="id",
        order=["vote", "pop"],
        output=OUTPUT,
        n=n,
    )


def brute_force(rows, titles, n):
    found = []
    for title in titles:
        homes = sorted(r for r in rows if r[1] is not None and r[1].lower() == title.lower())
        if not homes:
            continue
        others = [r for r in rows if r[2] == homes[0][2] and r[1] is not None and r[1].lower() != title.lower()]
        others.sort(key=lambda r: (-r[3], -r[4], r[0]))
        found += [(title, r[0], r[1], place) for place, r in enumerate(others[:n], 1)]
    return sorted(found)


def table(seed: int, size: int = 400):
    chance = random.Random(seed)
    titles = ["Hot", "hot", "HOT"] * 20 + [f"t{i}" for i in range(30)] + [None]
    return [
        (
            i,
            chance.choice(titles),
            chance.choice(["a", "a", "b", "c", None]),
            float(chance.randint(1, 4)),
            float(chance.randint(1, 3)),
        )
        for i in range(size)
    ]


SCHEMA = "id int, title string, g string, vote double, pop double"


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("n", [1, 3, 10])
def test_agrees_with_one_query_per_title(spark, seed, n):
    rows = table(seed)
    # A probe whose first row has no group has no similar rows; keep such rows out of this comparison.
    rows = [r for r in rows if r[2] is not None]
    titles = ["hot", "Hot", "t1", "T2", "t3", "unknown"]
    found = run(spark.createDataFrame(rows, SCHEMA).repartition(5), titles, n).collect()
    assert sorted((r.because, r.id, r.title, r.place) for r in found) == brute_force(rows, titles, n)


@pytest.mark.parametrize("n", [501, 1001])
def test_long_lists_with_a_hot_group(spark, n):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"g{i}", float(i % 7), 1.0) for i in range(6000)]
    found = run(spark.createDataFrame(rows, SCHEMA), ["t1", "t2"], n).collect()
    assert sorted((r.because, r.id, r.title, r.place) for r in found) == brute_force(rows, ["t1", "t2"], n)


def test_equal_titles_are_all_left_out_and_the_smallest_id_decides(spark):
    rows = [(1, "Shrek", "a", 1.0, 1.0), (2, "shrek", "b", 9.0, 9.0), (3, "x", "a", 5.0, 5.0), (4, "y", "b", 5.0, 5.0)]
    found = run(spark.createDataFrame(rows, SCHEMA), ["SHREK"]).collect()
    assert [(r.because, r.id) for r in found] == [("SHREK", 3)]


def test_unknown_title_gives_no_rows(spark):
    df = spark.createDataFrame([(1, "a", "g", 1.0, 1.0)], SCHEMA)
    assert run(df, ["nope"]).count() == 0


def test_a_title_with_most_rows_of_its_group(spark):
    """All better rows have the probe's own title, so a plain top list of the group would hold nothing."""
    rows = [(i, "Big", "a", 9.0, 9.0) for i in range(300)] + [(1000 + i, f"t{i}", "a", 1.0, 1.0) for i in range(12)]
    found = run(spark.createDataFrame(rows, SCHEMA), ["big", "t0"], 10).collect()
    assert [r.id for r in found if r.because == "big"] == list(range(1000, 1010))
    assert [r.id for r in found if r.because == "t0"] == list(range(10))
