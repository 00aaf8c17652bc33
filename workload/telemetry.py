"""Telemetry queries: inventories, counts, means, crosstabs, shares and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import map_values as mapped
from tabulon.operators import matrix, profiles, quality, reports
from tabulon.operators.quantiles import quantiles
from tabulon.plans.output import write_reports
from tabulon.plans.telemetry import DURATION_BAND, RESULT_LABELS, telemetry_report
from tabulon.sources import literal_table as literal
from tabulon.sources import read_delimited
from tabulon.sources.shared import new_path
from workload import fixtures as fx
from workload.fixtures import ROUNDS_SQL

REASONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
NUMERICS = ["roundduration", "nbkills", "haswon"]
TEXTS = (
    "gamemode mapname objectivelocation winrole endroundreason primaryweapontype primaryweapon secondaryweapon"
    " skillrank operator"
).split()
LINE_NUMERICS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax"
).split()
DISTINCT = ["gamemode", "mapname", "skillrank", "haswon"]
PAIRED = ["1-URGENT", "5-LOW"]
QUARTILES = [0.25, 0.5, 0.75]
RANK_ERROR = 0.01
MODES = {"mode": ["A", "N", "R"], "label": ["area", "bomb", "hostage"]}


def count_mode_map(spark, folder):
    return reports.count_by(fx.rounds(spark, folder), ["gamemode", "mapname"], drop_null_keys=True)


def count_mode_role(spark, folder):
    return reports.count_by(fx.rounds(spark, folder), ["gamemode", "winrole"], drop_null_keys=True)


def nonnull_counts_by_key(spark, folder):
    return reports.non_null_counts_by(fx.rounds(spark, folder), "operator")


def pick_count(spark, folder):
    return reports.count_by(fx.rounds(spark, folder), ["operator"], drop_null_keys=True)


def weapon_type_count(spark, folder):
    return reports.count_by(fx.rounds(spark, folder), ["primaryweapontype"], drop_null_keys=True)


def _mean_duration(spark, folder, keys):
    return reports.aggregate_by(
        fx.rounds(spark, folder),
        keys,
        {"mean_duration": F.round(F.avg("roundduration"), 9)},
        order=[F.desc("mean_duration"), *keys],
        drop_null_keys=True,
    )


def avg_duration_by_map(spark, folder):
    return _mean_duration(spark, folder, ["mapname"])


def pivot_mean(spark, folder):
    return _mean_duration(spark, folder, ["mapname", "objectivelocation"])


def pivot_outside_range(spark, folder):
    return reports.outside_range(pivot_mean(spark, folder), "mean_duration", *DURATION_BAND)


def saved_pivot(spark, folder):
    """The means outside the band, saved with their keys and read back."""
    target = new_path(spark, "pivot")
    write_reports({"durations_outside_band": pivot_outside_range(spark, folder)}, target)
    saved = read_delimited(spark, f"{target}/durations_outside_band", ["mapname", "objectivelocation", "mean_duration"])
    return saved.withColumn("mean_duration", F.col("mean_duration").cast("double"))


def approximate_quartiles(spark, folder):
    """Quartiles of every numeric column with a given rank error: whether each value's exact ranks lie within it."""
    lines = fx.table(spark, folder, "lineitem").select(*[F.col(c).cast("double") for c in LINE_NUMERICS])
    found = quantiles(lines, LINE_NUMERICS, QUARTILES, rel_error=RANK_ERROR)
    ranks = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(p).alias("p"),
            F.count(c).alias("row_count"),
            F.count_if(F.col(c) < value).alias("below"),
            F.count_if(F.col(c) <= value).alias("up_to"),
        )
        for (c, p), value in found.items()
    ]
    within = (F.col("below") <= (F.col("p") + RANK_ERROR) * F.col("row_count")) & (
        F.col("up_to") >= (F.col("p") - RANK_ERROR) * F.col("row_count")
    )
    return lines.agg(F.array(*ranks).alias("ranks")).select(F.inline("ranks")).select(
        "column_name", "p", "row_count", within.alias("within_error")
    )


def kills_by_weapon_pair(spark, folder):
    return reports.aggregate_by(
        fx.rounds(spark, folder),
        ["primaryweapon", "secondaryweapon"],
        {"kills": F.sum("nbkills")},
        order=[F.desc("kills"), "primaryweapon", "secondaryweapon"],
        drop_null_keys=True,
    )


def crosstab_objective_reason(spark, folder):
    return matrix.crosstab(fx.rounds(spark, folder), "objectivelocation", "endroundreason", REASONS)


def top_share(spark, folder):
    shares = matrix.top_share(
        fx.rounds(spark, folder), "objectivelocation", "endroundreason", "1-URGENT"
    )
    return shares.withColumn("share_percent", F.round("share_percent", 9))


def paired_reason_counts(spark, folder):
    return matrix.crosstab(
        fx.rounds(spark, folder), "objectivelocation", "endroundreason", ["1-URGENT", "5-LOW"]
    )


def map_values(spark, folder):
    return fx.rounds(spark, folder).select(
        "matchid",
        "nbkills",
        mapped(F.col("haswon"), RESULT_LABELS).alias("result"),
        mapped(F.col("nbkills"), {1: "one", 2: "two"}).alias("kills_label"),
    )


def literal_table(spark, folder):
    """Rounds per label, the labels coming from a literal table."""
    labels = literal(spark, MODES, "mode string, label string")
    labelled = fx.rounds(spark, folder).join(
        F.broadcast(labels), F.col("gamemode") == F.col("mode"), "left"
    )
    return reports.count_by(labelled, ["label"])


def won_lost_by_rank(spark, folder):
    rounds = fx.rounds(spark, folder).withColumn("haswon", mapped(F.col("haswon"), RESULT_LABELS))
    return matrix.won_lost(rounds, "skillrank", "haswon", ["Won", "Lost"])


def correlation_matrix(spark, folder):
    lines = fx.table(spark, folder, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    return matrix.correlation(lines, columns, full=True).withColumn("r", F.round("r", 9))


def rounds_correlation(spark, folder):
    found = matrix.correlation(fx.rounds(spark, folder), NUMERICS)
    return found.withColumn("r", F.round("r", 9))


def numeric_profile(spark, folder):
    profile = profiles.numeric_profile(fx.table(spark, folder, "lineitem"), LINE_NUMERICS)
    return profile.withColumns({c: F.round(c, 6) for c in ["mean", "std", "p25", "p50", "p75"]})


def text_profile(spark, folder):
    return profiles.text_profile(fx.rounds(spark, folder), TEXTS)


def null_counts(spark, folder):
    return quality.null_counts(fx.typed(spark, folder))


def schema_report(spark, folder):
    return quality.schema_report(fx.typed(spark, folder))


def distinct_values(spark, folder):
    return quality.distinct_values(fx.rounds(spark, folder), DISTINCT)


def telemetry_job(spark, folder):
    """The exploration as a whole: one row per cell of every report."""
    found = telemetry_report(
        fx.rounds(spark, folder), share_reasons=REASONS[:1], paired_reasons=PAIRED, reasons=REASONS
    )
    if set(found) != set(JOB_REPORTS):
        raise ValueError(f"reports without a listing: {sorted(set(found) ^ set(JOB_REPORTS))}")
    return reports.stack_by_name(
        [_cells(found[name], name, keys, columns) for name, (_, keys, columns) in JOB_REPORTS.items()]
    )


def _cells(frame, name, keys, columns):
    """(report, key, column_name, value, text): numbers, rounded, in value, other cells in text."""
    kinds = dict(frame.dtypes)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.round(F.lit(None).cast("double") if kinds[c] == "string" else F.col(f"`{c}`").cast("double"), 6).alias("value"),
            (F.col(f"`{c}`") if kinds[c] == "string" else F.lit(None).cast("string")).alias("text"),
        )
        for c in columns
    ]
    return frame.select(F.lit(name).alias("report"), F.concat_ws("|", *keys).alias("key"), F.inline(F.array(*cells)))


_rounds = f"with {ROUNDS_SQL}\n"


def _count_sql(*keys: str) -> str:
    listed = ", ".join(keys)
    return _rounds + f"select {listed}, count(*) as row_count from rounds group by {listed}"


def _mean_sql(*keys: str) -> str:
    listed = ", ".join(keys)
    return f"select {listed}, round(avg(roundduration), 9) as mean_duration from rounds group by {listed}"


def _crosstab_sql(values: list[str]) -> str:
    counts = ", ".join(f"count(*) filter (where endroundreason = '{v}') as \"{v}\"" for v in values)
    return _rounds + f"select objectivelocation, {counts} from rounds group by objectivelocation"


def _correlation_sql(source: str, pairs: list[tuple[str, str]]) -> str:
    return "\nunion all\n".join(
        f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 9) as r from {source}"
        for a, b in pairs
    )


def _profile_sql(source: str, columns: list[str]) -> str:
    return "\nunion all\n".join(
        f"""select '{c}' as column_name, count({c}) as value_count, round(avg({c}), 6) as mean,
       round(stddev_samp({c}), 6) as std, cast(min({c}) as double) as min, round(quantile_cont({c}, 0.25), 6) as p25,
       round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75, cast(max({c}) as double) as max
from {source}"""
        for c in columns
    )


_LINE_NUMERICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_ROUND_COLUMNS = (
    "dateid matchid gamemode mapname objectivelocation winrole endroundreason roundduration"
    " primaryweapontype primaryweapon secondaryweapon nbkills skillrank haswon"
).split()
_TYPED_COLUMNS = {
    "release_date": "date",
    "title": "string",
    "overview": "string",
    "popularity": "double",
    "vote_count": "int",
    "vote_average": "double",
    "original_language": "string",
    "genre": "string",
    "poster_url": "string",
    "item_id": "bigint",
}

CASES = {
    "count_mode_map": (count_mode_map, _count_sql("gamemode", "mapname")),
    "count_mode_role": (count_mode_role, _count_sql("gamemode", "winrole")),
    "nonnull_counts_by_key": (
        nonnull_counts_by_key,
        _rounds
        + "select operator, "
        + ", ".join(f"count({c}) as {c}" for c in _ROUND_COLUMNS)
        + " from rounds group by operator",
    ),
    "pick_count": (pick_count, _count_sql("operator")),
    "weapon_type_count": (weapon_type_count, _count_sql("primaryweapontype")),
    "avg_duration_by_map": (avg_duration_by_map, _rounds + _mean_sql("mapname")),
    "pivot_mean": (pivot_mean, _rounds + _mean_sql("mapname", "objectivelocation")),
    "pivot_outside_range": (
        pivot_outside_range,
        _rounds
        + _mean_sql("mapname", "objectivelocation")
        + " having avg(roundduration) > 190 or avg(roundduration) < 180",
    ),
    "kills_by_weapon_pair": (
        kills_by_weapon_pair,
        _rounds
        + "select primaryweapon, secondaryweapon, cast(sum(nbkills) as bigint) as kills"
        + " from rounds group by primaryweapon, secondaryweapon",
    ),
    "crosstab_objective_reason": (crosstab_objective_reason, _crosstab_sql(REASONS)),
    "top_share": (
        top_share,
        _rounds
        + """select objectivelocation, row_count,
       round(100e0 * row_count / sum(row_count) over (), 9) as share_percent
from (select objectivelocation, count(*) filter (where endroundreason = '1-URGENT') as row_count
      from rounds group by objectivelocation order by row_count desc, objectivelocation limit 5)""",
    ),
    "paired_reason_counts": (paired_reason_counts, _crosstab_sql(["1-URGENT", "5-LOW"])),
    "map_values": (
        map_values,
        _rounds
        + """select matchid, nbkills, case haswon when 0 then 'Lost' when 1 then 'Won' end as result,
       case nbkills when 1 then 'one' when 2 then 'two' end as kills_label from rounds""",
    ),
    "literal_table": (
        literal_table,
        _rounds
        + """, labels_of_modes(mode, label) as (values ('A', 'area'), ('N', 'bomb'), ('R', 'hostage'))
select label, count(*) as row_count from rounds left join labels_of_modes on gamemode = mode group by label""",
    ),
    "won_lost_by_rank": (
        won_lost_by_rank,
        _rounds
        + """select skillrank, count(*) filter (where haswon = 1) as "Won",
       count(*) filter (where haswon = 0) as "Lost" from rounds group by skillrank""",
    ),
    "correlation_matrix": (
        correlation_matrix,
        _correlation_sql("lineitem", [(a, b) for a in _LINE_NUMERICS for b in _LINE_NUMERICS]),
    ),
    "rounds_correlation": (
        rounds_correlation,
        _rounds
        + _correlation_sql(
            "rounds", [(a, b) for i, a in enumerate(NUMERICS) for b in NUMERICS[i + 1 :]]
        ),
    ),
    "numeric_profile": (
        numeric_profile,
        _profile_sql("lineitem", LINE_NUMERICS),
    ),
    "text_profile": (
        text_profile,
        _rounds
        + "\nunion all\n".join(
            f"""select '{c}' as column_name, cast(sum(n) as bigint) as value_count, count(*) as distinct_count,
       (array_agg(v order by n desc, v))[1] as top_value, max(n) as top_count
from (select {c} as v, count(*) as n from rounds where {c} is not null group by {c})"""
            for c in TEXTS
        ),
    ),
    "null_counts": (
        null_counts,
        f"with {fx.TYPED_SQL}\n"
        + "\nunion all\n".join(
            f"select '{c}' as column_name, count(*) - count({c}) as null_count from typed"
            for c in _TYPED_COLUMNS
        ),
    ),
    "schema_report": (
        schema_report,
        f"with {fx.TYPED_SQL}\n"
        + "\nunion all\n".join(
            f"select '{c}' as column_name, '{t}' as data_type, count({c}) as non_null_count from typed"
            for c, t in _TYPED_COLUMNS.items()
        ),
    ),
    "distinct_values": (
        distinct_values,
        _rounds
        + "\nunion\n".join(
            f"select '{c}' as column_name, cast({c} as varchar) as value from rounds" for c in DISTINCT
        ),
    ),
}

# Every report of the job: its SQL, the columns of its key and the columns that are cells.
_ROUND_TYPES = {c: "string" for c in TEXTS} | {
    "dateid": "int", "matchid": "bigint", "roundduration": "double", "nbkills": "int", "haswon": "int"
}
_ROUND_NUMERICS = [c for c, kind in _ROUND_TYPES.items() if kind != "string"]
JOB_REPORTS = {
    "schema": (
        _rounds
        + "\nunion all\n".join(
            f"select '{c}' as column_name, '{kind}' as data_type, count({c}) as non_null_count from rounds"
            for c, kind in _ROUND_TYPES.items()
        ),
        ["column_name"],
        ["data_type", "non_null_count"],
    ),
    "null_counts": (
        _rounds
        + "\nunion all\n".join(
            f"select '{c}' as column_name, count(*) - count({c}) as null_count from rounds" for c in _ROUND_TYPES
        ),
        ["column_name"],
        ["null_count"],
    ),
    "numeric_profile": (
        _rounds + _profile_sql("rounds", _ROUND_NUMERICS),
        ["column_name"],
        "value_count mean std min p25 p50 p75 max".split(),
    ),
    "text_profile": (
        CASES["text_profile"][1],
        ["column_name"],
        ["value_count", "distinct_count", "top_value", "top_count"],
    ),
    "distinct_values": (CASES["distinct_values"][1], ["column_name"], ["value"]),
    "count_by_mode_and_map": (CASES["count_mode_map"][1], ["gamemode", "mapname"], ["row_count"]),
    "count_by_mode_and_role": (CASES["count_mode_role"][1], ["gamemode", "winrole"], ["row_count"]),
    "non_null_counts_by_operator": (CASES["nonnull_counts_by_key"][1], ["operator"], _ROUND_COLUMNS),
    "picks_by_operator": (CASES["pick_count"][1], ["operator"], ["row_count"]),
    "duration_by_map": (CASES["avg_duration_by_map"][1], ["mapname"], ["mean_duration"]),
    "duration_by_map_and_objective": (
        CASES["pivot_mean"][1],
        ["mapname", "objectivelocation"],
        ["mean_duration"],
    ),
    "durations_outside_band": (
        CASES["pivot_outside_range"][1],
        ["mapname", "objectivelocation"],
        ["mean_duration"],
    ),
    "objective_by_reason": (CASES["crosstab_objective_reason"][1], ["objectivelocation"], REASONS),
    "paired_reasons": (CASES["paired_reason_counts"][1], ["objectivelocation"], PAIRED),
    "correlation": (
        _rounds + _correlation_sql("rounds", [(a, b) for a in NUMERICS for b in NUMERICS]),
        ["column_a", "column_b"],
        ["r"],
    ),
    "weapon_types": (CASES["weapon_type_count"][1], ["primaryweapontype"], ["row_count"]),
    "kills_by_weapons": (
        CASES["kills_by_weapon_pair"][1],
        ["primaryweapon", "secondaryweapon"],
        ["kills"],
    ),
    "won_lost_by_rank": (CASES["won_lost_by_rank"][1], ["skillrank"], ["Won", "Lost"]),
    "top_objectives_1-URGENT": (CASES["top_share"][1], ["objectivelocation"], ["row_count", "share_percent"]),
}


def _cells_sql(name: str, sql: str, keys: list[str], columns: list[str]) -> str:
    key = f"concat_ws('|', {', '.join(keys)})"
    text = {"data_type", "top_value", "value"}
    return "\nunion all\n".join(
        f"select '{name}' as report, {key} as key, '{c}' as column_name, "
        + (
            f"cast(null as double) as value, {c} as text"
            if c in text
            else f"round(cast(\"{c}\" as double), 6) as value, cast(null as varchar) as text"
        )
        + f" from ({sql})"
        for c in columns
    )


CASES["telemetry_job"] = (
    telemetry_job,
    "\nunion all\n".join(_cells_sql(name, *listed) for name, listed in JOB_REPORTS.items()),
)
CASES["saved_pivot"] = (saved_pivot, CASES["pivot_outside_range"][1])
CASES["approximate_quartiles"] = (
    approximate_quartiles,
    "\nunion all\n".join(
        f"select '{c}' as column_name, cast({p} as double) as p, count({c}) as row_count, true as within_error from lineitem"
        for c in LINE_NUMERICS
        for p in QUARTILES
    ),
)
