"""Views over the supplied tables that have the shape the operators expect.

Each exists twice: as a DataFrame and as the common table expressions that put it in front of a check query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulon.operators.standardize import ColumnSpec
from tabulon.operators.tokens import explode_tokens
from tabulon.plans.catalog import CatalogColumns, clean_catalog, typed_catalog
from tabulon.sources import materialize

ITEM_COLUMNS = CatalogColumns(extra=(ColumnSpec("item_id", "item_id", "raw"),), tie_breaker="item_id")


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A supplied table; its schema is looked up in the file once per session of the program."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """One item per order: its customer as title, its lines as votes, its part types as genre list.

    An order has few lines, so they are dealt by order as they are: sets of them in each task before would be larger and dearer than the lines.
    """
    lines = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "l_quantity", "p_type")
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("int").alias("vote_count"),
            F.avg("l_quantity").alias("vote_average"),
            F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("genre"),
        )
    )
    return (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("item_id"),
            F.col("o_orderdate").cast("date").alias("release_date"),
            F.col("c_name").alias("title"),
            F.col("o_totalprice").alias("popularity"),
            "vote_count",
            "vote_average",
            F.col("n_name").alias("original_language"),
            "genre",
            F.col("o_orderpriority").alias("overview"),
        )
    )


def catalog_raw(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog as the text cells of a dirty file."""

    def every(n: int):
        return F.col("item_id") % n == 0

    date, votes = F.col("release_date").cast("string"), F.col("vote_count").cast("string")
    return catalog(spark, folder).select(
        F.when(every(97), "bad-date").when(every(101), None).otherwise(date).alias("Release_Date"),
        F.when(every(89), "   ").otherwise(F.concat(F.lit("  "), "title", F.lit(" "))).alias("Title"),
        F.when(every(71), None).otherwise(F.concat(F.lit(" "), "overview")).alias("Overview"),
        F.when(every(83), "n/a").otherwise(F.col("popularity").cast("string")).alias("Popularity"),
        F.when(every(79), F.concat(votes, F.lit(".0"))).otherwise(votes).alias("Vote_Count"),
        F.col("vote_average").cast("string").alias("Vote_Average"),
        F.col("original_language").alias("Original_Language"),
        F.when(every(73), F.concat("genre", F.lit(", "))).otherwise(F.col("genre")).alias("Genre"),
        F.concat(F.lit("poster/"), F.col("item_id").cast("string")).alias("Poster_Url"),
        "item_id",
    )


def typed(spark: SparkSession, folder: str) -> DataFrame:
    return typed_catalog(catalog_raw(spark, folder), ITEM_COLUMNS)


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Clean rows with year and decade."""
    return clean_catalog(typed(spark, folder), ITEM_COLUMNS)


def kept_items(spark: SparkSession, folder: str) -> DataFrame:
    """The clean rows written as a table, for queries that pass over them more than once."""
    return materialize(items(spark, folder), "items")


def item_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return explode_tokens(items(spark, folder), "genre", "genre_name")


def rounds(spark: SparkSession, folder: str) -> DataFrame:
    """One telemetry row per order line.

    Orders get their customer before the lines meet them, and long texts join last, so the lines are dealt out as seldom and as narrow as can be.
    """
    day = F.col("o_orderdate")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    places = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "s_name", "n_name")
    )
    return (
        table(spark, folder, "lineitem")
        .join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("dateid"),
            F.col("l_orderkey").alias("matchid"),
            F.col("l_returnflag").alias("gamemode"),
            F.col("p_brand").alias("mapname"),
            F.col("n_name").alias("objectivelocation"),
            F.col("l_linestatus").alias("winrole"),
            F.col("o_orderpriority").alias("endroundreason"),
            (F.lit(160) + F.col("l_quantity")).alias("roundduration"),
            F.col("s_name").alias("operator"),
            F.col("p_type").alias("primaryweapontype"),
            F.col("p_name").alias("primaryweapon"),
            F.col("o_orderstatus").alias("secondaryweapon"),
            F.col("l_linenumber").alias("nbkills"),
            F.col("c_mktsegment").alias("skillrank"),
            (F.col("l_linenumber") % 2).alias("haswon"),
        )
    )


CATALOG_SQL = """
lines as (
    select l_orderkey, cast(count(*) as int) as vote_count, avg(l_quantity) as vote_average,
           string_agg(distinct p_type, ', ' order by p_type) as genre
    from lineitem join part on l_partkey = p_partkey group by l_orderkey),
catalog as (
    select o_orderkey as item_id, cast(o_orderdate as date) as release_date, c_name as title,
           o_totalprice as popularity, vote_count, vote_average, n_name as original_language, genre,
           o_orderpriority as overview
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
         left join lines on l_orderkey = o_orderkey)"""

RAW_SQL = (
    CATALOG_SQL
    + """,
catalog_raw as (
    select case when item_id % 97 = 0 then 'bad-date' when item_id % 101 = 0 then null
                else cast(release_date as varchar) end as raw_date,
           case when item_id % 89 = 0 then '   ' else '  ' || title || ' ' end as raw_title,
           case when item_id % 71 = 0 then null else ' ' || overview end as raw_overview,
           case when item_id % 83 = 0 then 'n/a' else cast(popularity as varchar) end as raw_popularity,
           case when item_id % 79 = 0 then cast(vote_count as varchar) || '.0'
                else cast(vote_count as varchar) end as raw_vote_count,
           cast(vote_average as varchar) as raw_vote_average, original_language as raw_language,
           case when item_id % 73 = 0 then genre || ', ' else genre end as raw_genre,
           'poster/' || cast(item_id as varchar) as raw_poster, item_id
    from catalog)"""
)

TYPED_SQL = (
    RAW_SQL
    + """,
typed as (
    select try_cast(raw_date as date) as release_date, trim(raw_title) as title,
           trim(raw_overview) as overview, try_cast(raw_popularity as double) as popularity,
           try_cast(try_cast(raw_vote_count as double) as int) as vote_count,
           try_cast(raw_vote_average as double) as vote_average,
           trim(raw_language) as original_language, trim(raw_genre) as genre, raw_poster as poster_url,
           item_id
    from catalog_raw)"""
)

ITEMS_SQL = (
    TYPED_SQL
    + """,
items as (
    select *, cast(year(release_date) as int) as release_year,
           cast(floor(year(release_date) / 10e0) * 10 as int) as decade
    from typed
    where release_date is not null and title is not null and popularity is not null
      and vote_count is not null and vote_average is not null and original_language is not null
      and genre is not null)"""
)

TOKENS_SQL = (
    ITEMS_SQL
    + """,
item_tokens as (
    select * from (select items.*, trim(unnest(string_split(genre, ','))) as genre_name from items)
    where genre_name <> '')"""
)

ROUNDS_SQL = """
rounds as (
    select cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) as int) as dateid,
           l_orderkey as matchid, l_returnflag as gamemode, p_brand as mapname,
           n_name as objectivelocation, l_linestatus as winrole, o_orderpriority as endroundreason,
           160 + l_quantity as roundduration, s_name as operator, p_type as primaryweapontype,
           p_name as primaryweapon, o_orderstatus as secondaryweapon, l_linenumber as nbkills,
           c_mktsegment as skillrank, l_linenumber % 2 as haswon
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
         join nation on s_nationkey = n_nationkey join orders on l_orderkey = o_orderkey
         join customer on o_custkey = c_custkey)"""


def rounded_sql(expression: str, digits: int = 2) -> str:
    """The rounding of tabulon.functions.rounded in SQL."""
    return f"cast(round(cast({expression} as decimal(30,8)), {digits}) as double)"
