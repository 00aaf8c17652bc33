"""Queries on vectors write only the columns that they read again."""

import pytest

from workload import learning


@pytest.mark.parametrize("columns", [("item_id",), ("item_id", "title", "vote_average")])
def test_items_are_written_without_columns_that_no_step_reads(spark, small, monkeypatch, columns):
    written = []
    monkeypatch.setattr(learning, "materialize", lambda df, name: written.append(df.columns) or df)
    found = learning._features(spark, small, columns)
    assert written == [list(dict.fromkeys([*columns, "genre_array", *learning.NUMERICS]))]
    assert found.columns == [*written[0], "features"]
