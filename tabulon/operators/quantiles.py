"""Exact quantiles of very large columns.

Spark's exact percentile keeps every distinct value of a column in one task. Here the data are scanned twice, for any number of columns:

* in the first scan a mergeable KLL sketch gives a bracket around each quantile (about 1 % of the rows);
* the second scan counts exactly the rows below, at the ends of and inside each bracket, and writes those inside to a table as it goes;
* an end is the answer, or the counts tell which rank inside is wanted, and it is looked for in that table: while a bracket holds more than
  SMALL rows, a sketch of its rows gives the next, narrower one; the rows of small brackets are counted per value and put in order.

Sketches only choose where to look. Ranks come from exact counts, and a bracket that misses its rank is
replaced by the side that holds it and looked for in the data again, so the result is always the exact order statistic.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from tabulon.functions import clean_double
from tabulon.sources.shared import materialize, release

SKETCH_SIZE = 2000  # rank error about 0.0014 at 99 %
MARGIN = 0.005  # half width of the first bracket, over three times that error
GRID = 200  # cut points read from the sketch of a bracket
SMALL = 1_000_000  # values that one task may put in order


@dataclass(frozen=True)
class _Search:
    """State of one wanted rank: the value is looked for in [low, high]; ranks count from 1."""

    metric: str
    rank: int
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    inside: int = 0

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.metric, self.low, self.high


def _inside(bracket: tuple[str, float, float]) -> Column:
    metric, low, high = bracket
    return (F.col(metric) >= F.lit(low)) & (F.col(metric) <= F.lit(high))


def _brackets(searches: Sequence[_Search]) -> list[tuple[str, float, float]]:
    """The distinct brackets; neighbouring ranks of one quantile share theirs."""
    return list(dict.fromkeys(s.bracket for s in searches))


def _grid(sketch: Column, size: Column, ranks: Sequence[float]) -> Column:
    return F.when(size > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(list(ranks))))


def _ranks(n: int, p: float, linear: bool) -> tuple[int, int, float]:
    """The one or two wanted ranks of a quantile and the weight of the upper one."""
    if not linear:
        rank = max(1, math.ceil(n * p))
        return rank, rank, 0.0
    position = (n - 1) * p
    return math.floor(position) + 1, math.ceil(position) + 1, position - math.floor(position)


def _ends(brackets: Sequence[tuple[str, float, float]]) -> list[tuple[str, float]]:
    """The different ends of all brackets."""
    return list(dict.fromkeys((metric, end) for metric, *ends in brackets for end in ends))


def _count_columns(brackets: Sequence[tuple[str, float, float]]) -> list[Column]:
    """Rows below and up to each end; brackets share ends, and what is between two of them is a difference."""
    aggregates = []
    for i, (metric, end) in enumerate(_ends(brackets)):
        aggregates += [F.count_if(F.col(metric) < F.lit(end)).alias(f"below{i}"), F.count_if(F.col(metric) <= F.lit(end)).alias(f"upto{i}")]
    return aggregates


def _listed(brackets: Sequence[tuple[str, float, float]], row: dict) -> dict[tuple, tuple[int, int, int, int]]:
    """Rows below, at the low end of, strictly inside and at the high end of each bracket."""
    counts = {end: (row[f"below{i}"], row[f"upto{i}"]) for i, end in enumerate(_ends(brackets))}
    found = {}
    for metric, low, high in brackets:
        below, upto = counts[metric, low]
        before, end = counts[metric, high]
        found[metric, low, high] = (below, upto - below, max(before - upto, 0), end - before if low < high else 0)
    return found


def _counts(doubles: DataFrame, searches: Sequence[_Search]) -> dict[tuple, tuple[int, int, int, int]]:
    """One pass: rows below, at the low end of, inside and at the high end of each bracket."""
    brackets = _brackets(searches)
    return _listed(brackets, doubles.agg(*_count_columns(brackets)).first().asDict())


def _counted_and_kept(doubles: DataFrame, searches: Sequence[_Search]) -> tuple[dict[tuple, tuple[int, int, int, int]], DataFrame]:
    """One pass: the counts, and a table of the values strictly inside the brackets, a column inside<i> for each bracket.

    The counts are observed while the table is written.
    """
    brackets = _brackets(searches)
    seen = Observation()
    strictly = [(F.col(m) > F.lit(low)) & (F.col(m) < F.lit(high)) for m, low, high in brackets]
    columns = [F.when(inside, F.col(m)).alias(f"inside{i}") for i, (inside, (m, _, _)) in enumerate(zip(strictly, brackets, strict=True))]
    kept = materialize(doubles.observe(seen, *_count_columns(brackets)).where(reduce(or_, strictly)).select(*columns), "bracketed-values")
    return _listed(brackets, seen.get), kept


def _cut_points(doubles: DataFrame, searches: Sequence[_Search]) -> dict[tuple, list[float]]:
    """One pass over the bracketed rows: evenly spaced quantiles of the values of each bracket."""
    brackets = _brackets(searches)
    cut_ranks = [i / GRID for i in range(GRID + 1)]
    aggregates = []
    for i, bracket in enumerate(brackets):
        value = F.when(_inside(bracket), F.col(bracket[0]))
        sketch = F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE))
        aggregates.append(_grid(sketch, F.count(value), cut_ranks).alias(f"cuts{i}"))
    row = doubles.where(reduce(or_, map(_inside, brackets))).agg(*aggregates).first()
    return {bracket: row[f"cuts{i}"] for i, bracket in enumerate(brackets)}


def _after_counts(search: _Search, below: int, at_low: int, inside: int, at_high: int) -> _Search | float:
    """The value, if an end of the bracket is it, or the search in the part that holds the rank."""
    low, high = search.low, search.high
    if search.rank <= below:
        return replace(search, low=-math.inf, high=math.nextafter(low, -math.inf), inside=0)
    if search.rank <= below + at_low:
        return low
    if search.rank <= below + at_low + inside:
        return replace(
            search,
            low=math.nextafter(low, math.inf),
            high=math.nextafter(high, -math.inf),
            below=below + at_low,
            inside=inside,
        )
    if search.rank <= below + at_low + inside + at_high:
        return high
    return replace(search, low=math.nextafter(high, math.inf), high=math.inf, inside=0)


def _narrowed(search: _Search, cuts: list[float]) -> _Search:
    """The search between the cut points around its rank, two cells to each side.

    That is far more than the error of the sketch; a miss would only cost a further pass.
    """
    cell = int((search.rank - search.below) / search.inside * GRID)
    return replace(
        search,
        low=cuts[cell - 2] if cell >= 2 else search.low,
        high=cuts[cell + 2] if cell + 2 <= GRID else search.high,
        inside=0,
    )


def _order_statistics(doubles: DataFrame, searches: Sequence[_Search]) -> dict[tuple[str, int], float]:
    values: dict[tuple[str, int], float] = {}
    # Counts of a bracket are known once inside is set.
    small = [s for s in searches if 0 < s.inside <= SMALL]
    open_searches = [s for s in searches if not 0 < s.inside <= SMALL]
    while open_searches:
        counts = _counts(doubles, open_searches)
        large, unknown = [], []
        for search in open_searches:
            found = _after_counts(search, *counts[search.bracket])
            if isinstance(found, float):
                values[search.metric, search.rank] = found
            elif found.inside == 0:
                unknown.append(found)
            else:
                (small if found.inside <= SMALL else large).append(found)
        cuts = _cut_points(doubles, large) if large else {}
        open_searches = unknown + [_narrowed(s, cuts[s.bracket]) for s in large]
    if small:
        values |= {(s.metric, s.rank): value for s, value in _select(doubles, small).items()}
    return values


def _select(doubles: DataFrame, searches: Sequence[_Search]) -> dict[_Search, float]:
    """Values of searches whose bracket is small, from one pass over the bracketed rows."""
    brackets = _brackets(searches)
    inside = [_inside(bracket) for bracket in brackets]
    entries = [
        F.when(inside[i], F.struct(F.lit(i).alias("bracket"), F.col(metric).alias("value")))
        for i, (metric, _, _) in enumerate(brackets)
    ]
    # One row per bracket that holds the value.
    counted = (
        doubles.where(reduce(or_, inside))
        .select(F.inline(F.array(*entries)))
        .where(F.col("bracket").isNotNull())
        .groupBy("bracket", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    ordered = Window.partitionBy("bracket").orderBy("value")
    reached = F.sum("rows").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    wanted = [
        F.when(
            (F.col("bracket") == brackets.index(s.bracket))
            & (F.col("reached") >= s.rank - s.below)
            & (F.col("reached") - F.col("rows") < s.rank - s.below),
            F.struct(F.lit(i).alias("search"), F.col("value")),
        )
        for i, s in enumerate(searches)
    ]
    found = (
        counted.withColumn("reached", reached)
        .select(F.inline(F.array(*wanted)))
        .where(F.col("search").isNotNull())
        .collect()  # one row per search
    )
    return {searches[row["search"]]: row["value"] for row in found}


def quantiles(
    df: DataFrame,
    metrics: Sequence[str],
    probs: Sequence[float],
    linear: bool = False,
    rel_error: float | None = None,
) -> dict[tuple[str, float], float | None]:
    """{(metric, p): value}; null and NaN cells are left out, a metric without values gives None.

    linear=False gives an actual value of the column (percentile_disc), linear=True interpolates between
    neighbours (percentile_cont). With rel_error the values come from one approximate pass, each within
    rel_error * rows ranks of the exact one. Runs jobs, two scans of the data if they are exact; only the listed numbers come to the driver.
    """
    return quantiles_and(df, metrics, probs, (), linear, rel_error)[0]


def quantiles_and(
    df: DataFrame,
    metrics: Sequence[str],
    probs: Sequence[float],
    also: Sequence[Column],
    linear: bool = False,
    rel_error: float | None = None,
) -> tuple[dict[tuple[str, float], float | None], Row]:
    """The quantiles, and a row with other aggregates of the metrics, cleaned of NaN, that the first scan takes along."""
    doubles = df.select(*[clean_double(F.col(m)).alias(m) for m in metrics])
    if rel_error is not None:
        accuracy = max(1, round(1 / rel_error))
        row = doubles.agg(*[F.percentile_approx(m, list(probs), accuracy).alias(f"q_{m}") for m in metrics], *also).first()
        return {(m, p): row[f"q_{m}"][j] if row[f"q_{m}"] else None for m in metrics for j, p in enumerate(probs)}, row

    bracket_ranks = [min(1.0, max(0.0, p + side)) for p in probs for side in (-MARGIN, MARGIN)]
    first = doubles.agg(
        *[F.count(m).alias(f"n_{m}") for m in metrics],
        *[
            _grid(F.kll_sketch_agg_double(m, F.lit(SKETCH_SIZE)), F.count(m), bracket_ranks).alias(f"q_{m}")
            for m in metrics
        ],
        *also,
    ).first()

    searches: dict[tuple[str, int], _Search] = {}
    plan: dict[tuple[str, float], tuple[int, int, float]] = {}
    for metric in metrics:
        n = first[f"n_{metric}"]
        for j, p in enumerate(probs):
            if n == 0:
                continue
            plan[metric, p] = _ranks(n, p, linear)
            ends = first[f"q_{metric}"][2 * j : 2 * j + 2]
            bracket = {
                "low": ends[0] if p > MARGIN else -math.inf,
                "high": ends[1] if p < 1 - MARGIN else math.inf,
            }
            for rank in plan[metric, p][:2]:
                searches.setdefault((metric, rank), _Search(metric, rank, **bracket))
    values = _found(doubles, list(searches.values())) if searches else {}

    result: dict[tuple[str, float], float | None] = {}
    for metric in metrics:
        for p in probs:
            if (metric, p) not in plan:
                result[metric, p] = None
                continue
            low_rank, high_rank, weight = plan[metric, p]
            low, high = values[metric, low_rank], values[metric, high_rank]
            result[metric, p] = low if weight == 0.0 else low + weight * (high - low)
    return result, first


def _found(doubles: DataFrame, searches: Sequence[_Search]) -> dict[tuple[str, int], float]:
    """The values of the wanted ranks from one scan of the rows, and what the table of bracketed values needs."""
    counts, kept = _counted_and_kept(doubles, searches)
    numbers = {bracket: i for i, bracket in enumerate(_brackets(searches))}
    values: dict[tuple[str, int], float] = {}
    missed: list[_Search] = []
    inside: dict[tuple[str, int], _Search] = {}
    for search in searches:
        found = _after_counts(search, *counts[search.bracket])
        if isinstance(found, float):
            values[search.metric, search.rank] = found
        elif found.inside == 0:
            missed.append(found)
        else:
            # In the table the bracket's values are a column of their own, in which ranks begin anew.
            inside[search.metric, search.rank] = replace(found, metric=f"inside{numbers[search.bracket]}", rank=search.rank - found.below, below=0)
    try:
        ranked = _order_statistics(kept, list(dict.fromkeys(inside.values()))) if inside else {}
        values |= {key: ranked[s.metric, s.rank] for key, s in inside.items()}
    finally:
        release(kept)
    return values | (_order_statistics(doubles, missed) if missed else {})
