"""Exploration of match telemetry: inventories, counts, means, crosstabs, shares and correlation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import map_values
from tabulon.operators.matrix import correlation, crosstab_of_counts, pivot_values, top_share_of_counts
from tabulon.operators.profiles import numeric_profile, profile_of_counts
from tabulon.operators.quality import null_counts, schema_report
from tabulon.operators.reports import counts_by_sets, non_null_counts_by, outside_range, rolled_up, stack_by_name
from tabulon.sources.shared import materialize

# The band of round durations and the labels of the result column.
DURATION_BAND = (180.0, 190.0)
RESULT_LABELS = {0: "Lost", 1: "Won"}

_NUMERIC_TYPES = {"byte", "short", "integer", "long", "float", "double", "decimal"}


@dataclass(frozen=True)
class TelemetryColumns:
    """Column names of the fact table."""

    ids: tuple[str, ...] = ("dateid", "matchid")
    mode: str = "gamemode"
    map: str = "mapname"
    role: str = "winrole"
    operator: str = "operator"
    duration: str = "roundduration"
    objective: str = "objectivelocation"
    reason: str = "endroundreason"
    weapon_type: str = "primaryweapontype"
    primary: str = "primaryweapon"
    secondary: str = "secondaryweapon"
    kills: str = "nbkills"
    rank: str = "skillrank"
    result: str = "haswon"


def telemetry_report(
    df: DataFrame,
    columns: TelemetryColumns = TelemetryColumns(),
    share_reasons: Sequence[str] = ("TimeExpired", "AttackersSurrendered", "DefendersSurrendered"),
    paired_reasons: Sequence[str] = ("AttackersKilledHostage", "DefendersKilledHostage"),
    reasons: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """The results of the exploration by name.

    The rows are written once, and every report reads its own columns of that table. All counts by one key or two, and what is made of them, come from one
    scan with grouping sets, those by a key of a pair from the groups of the pair; the scan runs while the job is put together, as do the two scans for
    the quartiles. Give the list of reasons to save the look at their values.
    """
    df = materialize(df, "telemetry-rows")
    c = columns
    numerics = [f.name for f in df.schema if f.dataType.typeName() in _NUMERIC_TYPES]
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    distinct = [c.mode, c.map, c.rank, c.result]
    pairs = {
        "mode_map": [c.mode, c.map],
        "mode_role": [c.mode, c.role],
        "map_objective": [c.map, c.objective],
        "objective_reason": [c.objective, c.reason],
        "weapons": [c.primary, c.secondary],
        "rank_result": [c.rank, c.result],
    }
    singles = list(dict.fromkeys([c.operator, c.weapon_type, c.map, *texts, *distinct]))
    # A column of a pair is added up from the groups of the pair, so that a row is not entered once more for it.
    parents = {name: pair for pair, names in pairs.items() for name in names}
    sets = pairs | {f"one:{name}": [name] for name in singles}
    scanned = [name for name in sets if name in pairs or sets[name][0] not in parents]
    duration = F.col(c.duration).cast("double")
    measures = {"duration": F.sum(duration), "durations": F.count(duration), "kills": F.sum(c.kills)}
    found = dict(zip(scanned, counts_by_sets(df, [sets[s] for s in scanned], measures, range(len(scanned))), strict=True))
    for name in singles:
        if name in parents:
            found[f"one:{name}"] = rolled_up(found[parents[name]], [name], ["row_count", *measures])
    found = {name: frame.withColumn("mean_duration", F.try_divide("duration", "durations")) for name, frame in found.items()}

    def counts(name: str) -> DataFrame:
        keys = sets[name]
        return found[name].dropna(subset=keys).select(*keys, "row_count").orderBy(F.desc("row_count"), *keys)

    def measured(name: str, measure: str) -> DataFrame:
        keys = sets[name]
        return found[name].dropna(subset=keys).select(*keys, measure).orderBy(F.desc(measure), *keys)

    def values(names: Sequence[str], *more: str) -> DataFrame:
        listed = [found[f"one:{n}"].select(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value"), *more) for n in names]
        return stack_by_name(listed)

    reason_counts = found["objective_reason"].dropna(subset=sets["objective_reason"]).select(c.objective, c.reason, "row_count")
    results = found["rank_result"].select(c.rank, map_values(F.col(c.result), RESULT_LABELS).alias(c.result), "row_count")
    if reasons is None:
        reasons = pivot_values(reason_counts, c.reason)
    mean_duration = measured("map_objective", "mean_duration")
    reports = {
        "schema": schema_report(df),
        "null_counts": null_counts(df),
        "numeric_profile": numeric_profile(df, numerics),
        "text_profile": profile_of_counts(values(texts, "row_count").withColumnRenamed("row_count", "rows").where(F.col("value").isNotNull())),
        "distinct_values": values(distinct),
        "count_by_mode_and_map": counts("mode_map"),
        "count_by_mode_and_role": counts("mode_role"),
        "non_null_counts_by_operator": non_null_counts_by(df, c.operator),
        "picks_by_operator": counts(f"one:{c.operator}"),
        "duration_by_map": measured(f"one:{c.map}", "mean_duration"),
        "duration_by_map_and_objective": mean_duration,
        "durations_outside_band": outside_range(mean_duration, "mean_duration", *DURATION_BAND),
        "objective_by_reason": crosstab_of_counts(reason_counts, c.objective, c.reason, reasons),
        "paired_reasons": crosstab_of_counts(reason_counts, c.objective, c.reason, paired_reasons),
        "correlation": correlation(df, [n for n in numerics if n not in c.ids], full=True),
        "weapon_types": counts(f"one:{c.weapon_type}"),
        "kills_by_weapons": measured("weapons", "kills"),
        "won_lost_by_rank": crosstab_of_counts(results.dropna(), c.rank, c.result, list(RESULT_LABELS.values())),
    }
    for reason in share_reasons:
        reports[f"top_objectives_{reason}"] = top_share_of_counts(reason_counts, c.objective, c.reason, reason)
    return reports
