"""Feature, clustering and projection queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabulon.operators import clusters, features, grouping, kmeans, reports
from tabulon.operators.similar import recommend
from tabulon.operators.tokens import explode_tokens
from tabulon.plans import cluster_report, write_reports
from tabulon.plans.clustering import NUMERICS, SIMILAR_COLUMNS, feature_input
from tabulon.sources import materialize, read_delimited, write_delimited
from tabulon.sources.shared import new_path
from workload import fixtures as fx
from workload.catalog import PROBES, cells, cells_sql
from workload.fixtures import TOKENS_SQL, rounded_sql
from workload.learning_sql import directions_sql, features_sql, kmeans_sql, silhouette_sql

K = 6


def _rows(spark, folder):
    return feature_input(fx.kept_items(spark, folder))


def _features(spark, folder, columns=("item_id",)):
    """The listed columns of the items with their vector; what the vectors are made of is computed and written once, and no other column."""
    needed = list(dict.fromkeys([*columns, "genre_array", *NUMERICS]))
    rows = materialize(feature_input(fx.items(spark, folder)).select(needed), "items")
    return features.fit_features(rows, "genre_array", NUMERICS).transform(rows)


def _clustered(spark, folder, columns):
    """The listed columns of the items with their cluster, written once for the queries that pass over them again."""
    wanted = list(dict.fromkeys(["item_id", *[c for c in columns if c != "cluster"]]))
    vectors = materialize(_features(spark, folder, [c for c in wanted if c != "features"]).select(*dict.fromkeys([*wanted, "features"])), "vectors")
    model = clusters.fit_kmeans(vectors, "item_id", K)
    return materialize(clusters.assign(vectors, model).select(*wanted, "cluster"), "clustered")


def vocabulary(spark, folder):
    return features.vocabulary(feature_input(fx.items(spark, folder)), "genre_array")


def token_presence(spark, folder):
    return features.token_presence(_rows(spark, folder), "item_id", "genre_array")


def minmax_scaled(spark, folder):
    scaled = features.min_max_scaled(_rows(spark, folder), "item_id", NUMERICS)
    return scaled.withColumns({c: F.round(c, 9) for c in NUMERICS})


def features_long(spark, folder):
    rows = _rows(spark, folder)
    model = features.fit_features(rows, "genre_array", NUMERICS)
    return features.features_long(rows, "item_id", model).withColumn("value", F.round("value", 9))


def kmeans_assign(spark, folder):
    return _clustered(spark, folder, ["item_id"]).select("item_id", "cluster")


def kmeans_nearest(spark, folder):
    """Whether each item's center is the nearest one, by distances that plain column expressions add up."""
    vectors = _features(spark, folder).select("item_id", "features")
    model = clusters.fit_kmeans(vectors, "item_id", K)
    rows = clusters.assign(vectors, model).withColumn("point", vector_to_array("features"))

    def distance(center):
        parts = F.zip_with("point", F.array(*[F.lit(x) for x in center]), lambda a, b: (a - b) * (a - b))
        return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)

    measured = rows.withColumn("distances", F.array(*[distance(c) for c in clusters.ordered_centers(model)]))
    nearest = F.get("distances", "cluster") <= F.array_min("distances") + F.lit(1e-9)
    return measured.select("item_id", nearest.alias("is_nearest"))


def silhouette_by_label(spark, folder):
    found = clusters.silhouette_of_arrays(fx.table(spark, folder, "embeddings"), "embedding", "label")
    return found.withColumn("silhouette", F.round("silhouette", 9))


def k_search(spark, folder):
    return clusters.search_k(_features(spark, folder), "item_id")


def pca_2d(spark, folder):
    found = clusters.project_2d(_clustered(spark, folder, ["features"]), ["item_id", "cluster"])
    return found.withColumns({c: F.round(c, 6) for c in "xy"})


def cluster_profile(spark, folder):
    rows = _clustered(spark, folder, ["genre", "vote_average", "popularity", "release_year"])
    return grouping.group_profile(
        rows,
        explode_tokens(rows, "genre", "genre_name"),
        "cluster",
        "genre_name",
        "vote_average",
        "popularity",
        "release_year",
    )


def recommend_in_cluster(spark, folder):
    return recommend(
        _clustered(spark, folder, SIMILAR_COLUMNS),
        PROBES,
        group="cluster",
        title="title",
        id_column="item_id",
        order=["vote_average", "popularity"],
        output=["item_id", *SIMILAR_COLUMNS],
    )


def cluster_job(spark, folder):
    """The clustering job as a whole, from a written CSV over the saved model to its saved frames: one row per cell, read back from the files."""
    job = new_path(spark, "cluster-job")
    write_delimited(fx.catalog_raw(spark, folder), f"{job}/raw")
    raw = read_delimited(spark, f"{job}/raw").withColumn("item_id", F.col("item_id").cast("bigint"))
    found = cluster_report(raw, PROBES, "item_id", fx.ITEM_COLUMNS, k_min=JOB_KS[0], k_max=JOB_KS[1], model_path=f"{job}/model")
    write_reports(found, f"{job}/reports")
    saved = {name: read_delimited(spark, f"{job}/reports/{name}", columns=frame.columns) for name, frame in found.items()}
    return reports.stack_by_name([cells(saved[name], name, *listed) for name, listed in JOB_REPORTS.items()])


JOB_KS = (3, 5)
#: Every frame of the job: the columns of its key, its numbers and its other cells.
JOB_REPORTS = {
    "k_scores": (["k"], ["silhouette"], []),
    "movies_with_clusters": (["title", "release_year", "genre"], ["vote_average", "popularity", "vote_count", "cluster"], ["original_language"]),
    "cluster_profiles": (["cluster"], ["movie_count", "avg_vote", "std_vote", "avg_popularity", "avg_release_year"], ["top_genres"]),
    "projection": (["cluster"], ["x", "y"], []),
    "recommendations": (["because_you_watched", "title", "release_year"], ["vote_average", "popularity", "cluster"], ["genre"]),
}

_VOCABULARY_SQL = f"""with {TOKENS_SQL},
presence as (select distinct item_id, genre_name as token from item_tokens),
vocabulary as (select token, count(*) as row_count from presence group by token having count(*) >= 2)"""

_SCALED_SQL = """logged as (
    select item_id, ln(1 + popularity) as log_popularity, vote_average,
           ln(1 + cast(vote_count as double)) as log_vote_count from items),
scaled as (
    select item_id, """ + ", ".join(
    f"""case when max({c}) over () = min({c}) over () then 0.5e0
         else ({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ()) end as {c}"""
    for c in NUMERICS
) + " from logged)"

_SILHOUETTE_SQL = """with points as (
    select vec_id, label, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x
    from embeddings),
norms as (select vec_id, label, sum(x * x) as norm from points group by vec_id, label),
sums as (select label, pos, sum(x) as y from points group by label, pos),
sizes as (select label, count(*) as n, sum(norm) as psi from norms group by label),
dots as (
    select points.vec_id, points.label as own, sums.label as other, sum(x * y) as dot
    from points join sums on points.pos = sums.pos group by 1, 2, 3),
distances as (
    select dots.vec_id, own, other, n, n * norm + psi - 2 * dot as total
    from dots join norms using (vec_id) join sizes on sizes.label = other),
sides as (
    select vec_id, max(case when own = other then case when n = 1 then 0 else total / (n - 1) end end) as a,
           min(case when own <> other then total / n end) as b,
           max(case when own = other then n end) as size from distances group by vec_id)
select round(avg(case when size = 1 then 0 when a < b then 1 - a / b when a > b then b / a - 1 else 0 end), 9)
       as silhouette from sides"""

_FEATURES_SQL = f"{_VOCABULARY_SQL}, {_SCALED_SQL}, {features_sql(NUMERICS)}"
_LABELS_SQL = f"{_FEATURES_SQL},\n{kmeans_sql('fit', f'select {K} as k', kmeans.FINAL_ITERATIONS, K)}"
_CLUSTERED_SQL = f"{_LABELS_SQL},\nclustered as materialized (select items.*, cluster from items join fit_labels using (item_id))"

_PROFILE_SQL = """stats as (
    select cluster, count(*) as row_count, {avg_vote} as avg_vote, {std_vote} as std_vote, {avg_popularity} as avg_popularity,
           cast({avg_year} as int) as avg_release_year from clustered group by cluster),
ranked as (
    select cluster, genre_name, row_number() over (partition by cluster order by n desc, genre_name) as place
    from (select cluster, genre_name, count(*) as n from item_tokens join clustered using (item_id) group by cluster, genre_name)),
tops as (select cluster, string_agg(genre_name, ' / ' order by place) as top_tokens from ranked where place <= 3 group by cluster),
profile as (select * from stats join tops using (cluster))""".format(
    avg_vote=rounded_sql("avg(vote_average)"),
    std_vote=rounded_sql("stddev_samp(vote_average)"),
    avg_popularity=rounded_sql("avg(popularity)"),
    avg_year=rounded_sql("avg(release_year)", 0),
)

_SIMILAR_SQL = f"""probes as (select unnest({PROBES!r}) as because),
homes as (select because, cluster as home from (
    select because, cluster, row_number() over (partition by because order by item_id) as rn from clustered join probes on lower(title) = lower(because)) where rn = 1),
similar_rows as (select * from (
    select because, clustered.*, cast(row_number() over (partition by because order by vote_average desc, popularity desc, item_id) as int) as place
    from clustered join homes on cluster = home and lower(title) <> lower(because)) where place <= 10)"""

_PROJECTION_SQL = f"""{directions_sql()},
projection as (select item_id, cluster, list_dot_product(dense.v, a.v) as x, list_dot_product(dense.v, b.v) as y
    from clustered join dense using (item_id), direction_1 a, direction_2 b)"""


def _search_sql(name, k_min, k_max):
    models = kmeans_sql(name, f"select unnest(range({k_min}, {k_max + 1})) as k", clusters.SEARCH_ITERATIONS, k_max)
    return f"{models}, {silhouette_sql(name)}"


_JOB_FRAMES = {
    "k_scores": "select k, silhouette from search_scores",
    "movies_with_clusters": "select * replace (nullif(title, '') as title) from clustered",
    "cluster_profiles": "select *, row_count as movie_count, top_tokens as top_genres from profile",
    "projection": "select cluster, x, y from projection",
    "recommendations": "select * replace (nullif(title, '') as title), because as because_you_watched from similar_rows",
}
_BEST_K = "select k from search_scores order by silhouette desc, k limit 1"
_JOB_SQL = ",\n".join(
    [
        _FEATURES_SQL,
        _search_sql("search", *JOB_KS),
        kmeans_sql("fit", _BEST_K, kmeans.FINAL_ITERATIONS, JOB_KS[1]),
        "clustered as materialized (select items.*, cluster from items join fit_labels using (item_id))",
        _PROFILE_SQL,
        _SIMILAR_SQL,
        _PROJECTION_SQL,
    ]
) + "\n" + "\nunion all\n".join(cells_sql(name, _JOB_FRAMES[name], *listed) for name, listed in JOB_REPORTS.items())

CASES = {
    "vocabulary": (vocabulary, _VOCABULARY_SQL + " select * from vocabulary"),
    "token_presence": (
        token_presence,
        _VOCABULARY_SQL + " select item_id, token from presence join vocabulary using (token)",
    ),
    "minmax_scaled": (
        minmax_scaled,
        f"with {TOKENS_SQL}, {_SCALED_SQL} select item_id, "
        + ", ".join(f"round({c}, 9) as {c}" for c in NUMERICS)
        + " from scaled",
    ),
    "features_long": (
        features_long,
        f"{_VOCABULARY_SQL}, {_SCALED_SQL}"
        + "".join(
            f"\nselect item_id, '{c}' as dim, round({c}, 9) as value from scaled where {c} <> 0 union all"
            for c in NUMERICS
        )
        + "\nselect item_id, token as dim, 1e0 as value from presence join vocabulary using (token)",
    ),
    "kmeans_assign": (kmeans_assign, f"{_CLUSTERED_SQL} select item_id, cluster from clustered"),
    "kmeans_nearest": (kmeans_nearest, f"with {fx.ITEMS_SQL} select item_id, true as is_nearest from items"),
    "silhouette_by_label": (silhouette_by_label, _SILHOUETTE_SQL),
    "k_search": (k_search, f"{_FEATURES_SQL},\n{_search_sql('search', clusters.K_MIN, clusters.K_MAX)} select cast(k as integer) as k, silhouette from search_scores"),
    "cluster_job": (cluster_job, _JOB_SQL),
    "pca_2d": (pca_2d, f"{_CLUSTERED_SQL},\n{_PROJECTION_SQL} select item_id, cluster, round(x, 6) as x, round(y, 6) as y from projection"),
    "cluster_profile": (cluster_profile, f"{_CLUSTERED_SQL},\n{_PROFILE_SQL} select * from profile"),
    "recommend_in_cluster": (
        recommend_in_cluster,
        f"{_CLUSTERED_SQL},\n{_SIMILAR_SQL} select because, item_id, title, release_year, genre, vote_average, popularity, cluster, place from similar_rows",
    ),
}
