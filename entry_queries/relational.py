"""Projections, joins, aggregates, splits, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinerank.functions import (
    default_title,
    epoch_to_utc,
    flag_name,
    genre_array,
    genre_text,
    parse_release_date,
)
from cinerank.operators import catalogue as cat
from cinerank.operators import splits
from cinerank.operators.topk import explode_list
from cinerank.plans.clean import clean_catalogue
from cinerank.plans.folds import export_split, read_fold, read_holdout, write_folds, write_holdout
from cinerank.session import scratch_path
from cinerank.sources import rename_by_position
from cinerank.sources.schemas import GENRE_COLUMNS
from entry_queries import views
from entry_queries.registry import query
from entry_queries.views import _GENRES_SQL, with_views

# ---- projections, filters, predicates


@query(
    "rename_positional",
    "SELECT c_custkey AS user_id, c_nationkey AS region_id, c_acctbal AS balance FROM customer",
)
def rename_positional(spark, d):
    customers = views.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return rename_by_position(customers, ["user_id", "region_id", "balance"])


@query("with_column", with_views("movies_d", f"SELECT movie_id, {_GENRES_SQL} AS genres FROM movies_d"))
def with_column(spark, d):
    movies = views.movies(spark, d).withColumn("genres", genre_array())
    return movies.withColumn("genres", F.concat_ws(",", "genres")).select("movie_id", "genres")


@query("select_cols", with_views("movies_d", "SELECT movie_id, title FROM movies_d"))
def select_cols(spark, d):
    return views.movies(spark, d).select("movie_id", "title")


@query(
    "alias_agg",
    with_views("ratings_d", "SELECT user_id, avg(rating) AS mean_given FROM ratings_d GROUP BY 1"),
)
def alias_agg(spark, d):
    return views.ratings(spark, d).groupBy("user_id").agg(F.avg("rating").alias("mean_given"))


@query(
    "filter_eq",
    with_views("ratings_d", "SELECT user_id, movie_id, rating FROM ratings_d WHERE user_id = 1"),
)
def filter_eq(spark, d):
    ratings = views.ratings(spark, d).select("user_id", "movie_id", "rating")
    return ratings.filter(F.col("user_id") == 1)


# Requests: every customer, and every supplier under a number no customer has.
REQUESTED_USERS = (
    "SELECT CAST(c_custkey AS INT) AS user_id FROM customer"
    " UNION ALL SELECT CAST(-1 - s_suppkey AS INT) FROM supplier"
)


def requested_users(spark, d):
    customers = views.table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("user_id"))
    suppliers = views.table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).cast("int").alias("user_id"))
    return customers.unionByName(suppliers)


@query(
    "key_exists",
    with_views(
        "ratings_d",
        "SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM ratings_d)"
        " THEN 200 ELSE 404 END AS status FROM requested",
        requested=REQUESTED_USERS,
    ),
)
def key_exists(spark, d):
    requests, ratings = requested_users(spark, d), views.ratings(spark, d)
    status = F.when(F.col("known"), 200).otherwise(404).alias("status")
    return cat.with_known(requests, ratings).select("user_id", status)


@query(
    "param_required",
    with_views(
        "movies_d",
        "SELECT movie_id, CASE WHEN release_date IS NULL OR release_date = ''"
        " THEN 400 ELSE 200 END AS status FROM movies_d",
    ),
)
def param_required(spark, d):
    status = F.when(cat.parameter_missing(F.col("release_date")), 400).otherwise(200)
    return views.movies(spark, d).select("movie_id", status.alias("status"))


# Ratings of films that the catalogue lacks: one by each supplier.
_STRANGE_FILMS = "SELECT CAST(-1 - s_suppkey AS INT) AS movie_id, s_name AS title FROM supplier"


def strange_films(spark, d):
    suppliers = views.table(spark, d, "supplier")
    return suppliers.select(
        (-1 - F.col("s_suppkey")).cast("int").alias("movie_id"), F.col("s_name").alias("title")
    )


@query(
    "source_projection",
    with_views(
        "ratings_d catalogue_d",
        "SELECT user_id, movie_id, coalesce(title, 'Unknown') AS title,"
        " round(avg_rating, 9) AS avg_rating FROM asked LEFT JOIN catalogue_d USING (movie_id)",
        strange=_STRANGE_FILMS,
        asked="SELECT user_id, movie_id FROM ratings_d"
        " UNION ALL SELECT -movie_id, movie_id FROM strange",
    ),
)
def source_projection(spark, d):
    strange = strange_films(spark, d).select((-F.col("movie_id")).alias("user_id"), "movie_id")
    asked = views.ratings(spark, d).select("user_id", "movie_id").unionByName(strange)
    joined = asked.join(views.catalogue(spark, d), "movie_id", "left")
    return joined.select(
        "user_id",
        "movie_id",
        default_title(F.col("title")).alias("title"),
        F.round("avg_rating", 9).alias("avg_rating"),
    )


# ---- joins and aggregates


@query(
    "agg_avg_rating",
    with_views("average_d", "SELECT movie_id, round(avg_rating, 9) AS avg_rating FROM average_d"),
)
def agg_avg_rating(spark, d):
    means = cat.average_rating(views.ratings(spark, d))
    return means.select("movie_id", F.round("avg_rating", 9).alias("avg_rating"))


@query(
    "join_left_avg",
    with_views(
        "movies_d ratings_d",
        "SELECT movie_id, title, round(avg(rating), 9) AS avg_rating FROM films"
        " LEFT JOIN ratings_d USING (movie_id) GROUP BY movie_id, title",
        films="SELECT movie_id, title FROM movies_d UNION ALL " + _STRANGE_FILMS,
    ),
)
def join_left_avg(spark, d):
    films = views.movies(spark, d).select("movie_id", "title").unionByName(strange_films(spark, d))
    joined = cat.with_average_rating(films, views.ratings(spark, d))
    return joined.select("movie_id", "title", F.round("avg_rating", 9).alias("avg_rating"))


@query(
    "join_semi_user",
    with_views(
        "ratings_d",
        "SELECT user_id FROM requested WHERE user_id IN (SELECT user_id FROM ratings_d)",
        requested=REQUESTED_USERS,
    ),
)
def join_semi_user(spark, d):
    return cat.known_users(requested_users(spark, d), views.ratings(spark, d))


@query(
    "agg_count_filter",
    with_views(
        "ratings_d",
        "SELECT user_id, count(*) AS n_ratings, count(*) > 0 AS present"
        " FROM ratings_d GROUP BY user_id",
    ),
)
def agg_count_filter(spark, d):
    counts = cat.user_activity(views.ratings(spark, d))
    return counts.withColumn("present", F.col("n_ratings") > 0)


@query(
    "agg_dataset_profile",
    with_views(
        "ratings_d",
        "SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT movie_id) AS n_movies,"
        " count(*) AS n_ratings FROM ratings_d",
    ),
)
def agg_dataset_profile(spark, d):
    return cat.dataset_profile(views.ratings(spark, d))


@query(
    "agg_min_activity",
    with_views(
        "ratings_d",
        "SELECT user_id, movie_id, rating FROM ratings_d WHERE user_id IN"
        " (SELECT user_id FROM ratings_d GROUP BY user_id HAVING count(*) >= 40)",
    ),
)
def agg_min_activity(spark, d):
    return cat.active_users(views.ratings(spark, d).select("user_id", "movie_id", "rating"), 40)


@query(
    "agg_user_running_count",
    with_views(
        "seq_d",
        "SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS ordinal"
        " FROM seq_d",
    ),
)
def agg_user_running_count(spark, d):
    return splits.running_count(views.sequence(spark, d).select("user_id", "seq"), "user_id", "seq")


# ---- splits, slices, sorts


_NTH = "row_number() OVER (PARTITION BY user_id ORDER BY seq) AS nth"


def _nth_split(start: int, stop: int, cap: int | None = None) -> str:
    eligible = f"nth BETWEEN {start} AND {stop}"
    limit = f" ORDER BY seq LIMIT {cap}" if cap else ""
    return with_views(
        "seq_d",
        "SELECT user_id, seq, value, seq IN (SELECT seq FROM chosen) AS is_test FROM seq_d",
        numbered=f"SELECT seq, {_NTH} FROM seq_d",
        chosen=f"SELECT seq FROM numbered WHERE {eligible}{limit}",
    )


@query("win_split_nth", _nth_split(3, 12, 700))
def win_split_nth(spark, d):
    rows = views.sequence(spark, d).select("user_id", "seq", "value")
    return splits.split_nth_per_user(rows, 3, 12, 700, "user_id", "seq")


@query("holdout_n_per_user", _nth_split(1, 10))
def holdout_n_per_user(spark, d):
    rows = views.sequence(spark, d).select("user_id", "seq", "value")
    return splits.holdout_per_user(rows, 10, "user_id", "seq")


@query("holdout_second_block", _nth_split(11, 20))
def holdout_second_block(spark, d):
    rows = views.sequence(spark, d).select("user_id", "seq", "value")
    return splits.holdout_per_user(rows, 10, "user_id", "seq", block=2)


@query(
    "sort_user_item",
    with_views("ratings_d", "SELECT user_id, movie_id, rating FROM ratings_d ORDER BY user_id, movie_id"),
)
def sort_user_item(spark, d):
    return splits.sort_user_item(views.ratings(spark, d).select("user_id", "movie_id", "rating"))


@query(
    "slice_rows",
    with_views(
        "seq_d",
        "SELECT seq, user_id, ordinal FROM (SELECT seq, user_id, row_number() OVER (ORDER BY seq)"
        " AS ordinal FROM seq_d) WHERE ordinal > 200 AND ordinal <= 400",
    ),
)
def slice_rows(spark, d):
    return splits.slice_rows(views.sequence(spark, d).select("seq", "user_id"), 2, 200, ["seq"])


_FOLDS = "SELECT *, ntile(5) OVER (ORDER BY seq) AS fold FROM seq_d"


def folds(spark, d):
    return splits.assign_folds(views.sequence(spark, d), 5, ["seq"])


@query(
    "cv_folds",
    with_views("seq_d", "SELECT seq, user_id, CAST(fold AS INT) AS fold FROM folds", folds=_FOLDS),
)
def cv_folds(spark, d):
    return folds(spark, d).select("seq", "user_id", "fold")


@query(
    "fold_tables",
    with_views(
        "seq_d",
        "SELECT seq, user_id, movie_id, fold <> 2 AS in_base FROM (SELECT *,"
        " seq % 1000 AS movie_id, ntile(5) OVER (ORDER BY seq) AS fold FROM seq_d)",
    ),
)
def fold_tables(spark, d):
    """Folds written once and read as base and test of one of them."""
    rows = views.sequence(spark, d).select("seq", "user_id", (F.col("seq") % 1000).alias("movie_id"))
    path = scratch_path(spark, "folds")
    write_folds(rows, path, 5, "seq")
    base, test = read_fold(spark, path, 2, rows.schema)
    return base.withColumn("in_base", F.lit(True)).unionByName(test.withColumn("in_base", F.lit(False)))


@query(
    "holdout_tables",
    with_views(
        "seq_d",
        "SELECT seq, user_id, movie_id, nth > 10 AS in_base FROM (SELECT seq, user_id, seq % 1000 AS"
        " movie_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS nth FROM seq_d)",
    ),
)
def holdout_tables(spark, d):
    """Ten rows held out per user, written as tab-separated files and read again."""
    rows = views.sequence(spark, d).select("seq", "user_id", (F.col("seq") % 1000).alias("movie_id"))
    path = scratch_path(spark, "holdout")
    write_holdout(rows, f"{path}/table", 10, "user_id", "seq")
    export_split(*read_holdout(spark, f"{path}/table", rows.schema), path, "ua")
    parts = [
        spark.read.schema(rows.schema).csv(f"{path}/ua.{part}", sep="\t").withColumn(
            "in_base", F.lit(part == "base")
        )
        for part in ("base", "test")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "union_base",
    with_views("seq_d", "SELECT seq, user_id, value FROM folds WHERE fold <> 2", folds=_FOLDS),
)
def union_base(spark, d):
    return splits.fold_base(folds(spark, d), 2).select("seq", "user_id", "value")


@query(
    "fold_complement",
    with_views(
        "ratings_d",
        "SELECT user_id, movie_id, rating FROM ratings_d EXCEPT ALL"
        " SELECT user_id, movie_id, rating FROM ratings_d WHERE rating = 3",
    ),
)
def fold_complement(spark, d):
    rows = views.ratings(spark, d).select("user_id", "movie_id", "rating")
    return splits.complement(rows, rows.filter(F.col("rating") == 3))


@query(
    "join_anti_base",
    with_views(
        "ratings_d",
        "SELECT user_id, movie_id, rating FROM ratings_d r WHERE NOT EXISTS (SELECT 1 FROM"
        " ratings_d t WHERE t.rating = 3 AND t.user_id = r.user_id AND t.movie_id = r.movie_id)",
    ),
)
def join_anti_base(spark, d):
    rows = views.ratings(spark, d).select("user_id", "movie_id", "rating")
    return splits.anti_base(rows, rows.filter(F.col("rating") == 3), ["user_id", "movie_id"])


@query(
    "fold_disjoint",
    with_views(
        "seq_d",
        "SELECT (SELECT count(*) FROM (SELECT seq FROM n WHERE nth <= 10 INTERSECT"
        " SELECT seq FROM n WHERE nth BETWEEN 11 AND 20)) AS n_common,"
        " (SELECT count(*) FROM n WHERE nth <= 20) AS n_test",
        n=f"SELECT seq, {_NTH} FROM seq_d",
    ),
)
def fold_disjoint(spark, d):
    rows = views.sequence(spark, d).select("user_id", "seq")
    blocks = [
        splits.holdout_per_user(rows, 10, "user_id", "seq", block).filter("is_test").select("seq")
        for block in (1, 2)
    ]
    common = blocks[0].intersect(blocks[1]).select(F.lit(1).alias("common"), F.lit(0).alias("test"))
    tested = blocks[0].unionByName(blocks[1]).select(F.lit(0).alias("common"), F.lit(1).alias("test"))
    return common.unionByName(tested).agg(
        F.sum("common").alias("n_common"), F.sum("test").alias("n_test")
    )


@query(
    "split_random",
    with_views(
        "ratings_d",
        "SELECT user_id, movie_id, rating, (CAST(user_id AS BIGINT) * 31 + movie_id) % 10 < 8"
        " AS is_train FROM ratings_d",
    ),
)
def split_random(spark, d):
    rows = views.ratings(spark, d).select("user_id", "movie_id", "rating")
    return rows.withColumn("is_train", splits.is_training_key(F.col("user_id"), F.col("movie_id")))


@query(
    "split_random_seeded",
    with_views(
        "ratings_d",
        "SELECT user_id, movie_id, rating, count(*) AS n, true AS fair FROM ratings_d GROUP BY ALL",
    ),
)
def split_random_seeded(spark, d):
    """Both parts of the seeded split together are the table, and one holds four fifths."""
    rows = views.ratings(spark, d).select("user_id", "movie_id", "rating")
    training, test = splits.random_split(rows, 0.8, seed=7)
    share = training.count() / max(1, rows.count())
    counted = training.unionByName(test).groupBy("user_id", "movie_id", "rating")
    return counted.agg(F.count("*").alias("n"), F.lit(abs(share - 0.8) < 0.03).alias("fair"))


# ---- scalar functions


_FLAG_SQL = ", ".join(
    "CASE WHEN \"{0}\" = 1 THEN '{1}' END AS \"{0}\"".format(n, n.replace("'", "''"))
    for n in GENRE_COLUMNS
)


@query("fn_flag_to_name", with_views("movies_d", f"SELECT movie_id, {_FLAG_SQL} FROM movies_d"))
def fn_flag_to_name(spark, d):
    names = [flag_name(name).alias(name) for name in GENRE_COLUMNS]
    return views.movies(spark, d).select("movie_id", *names)


_ARRAY_SQL = "[" + ", ".join(
    "CASE WHEN \"{0}\" = 1 THEN '{1}' END".format(n, n.replace("'", "''")) for n in GENRE_COLUMNS
) + "]"


@query(
    "fn_array_build",
    with_views(
        "movies_d",
        "SELECT movie_id, CAST(pos - 1 AS INT) AS position, names[pos] AS name FROM"
        f" (SELECT movie_id, {_ARRAY_SQL} AS names FROM movies_d),"
        f" (SELECT unnest(range(1, {len(GENRE_COLUMNS) + 1})) AS pos)",
    ),
)
def fn_array_build(spark, d):
    names = F.array(*[flag_name(name) for name in GENRE_COLUMNS])
    return views.movies(spark, d).select("movie_id", F.posexplode(names).alias("position", "name"))


@query(
    "fn_array_drop_null",
    with_views(
        "movies_d",
        "SELECT movie_id, CAST(len(names) AS INT) AS n_genres,"
        " array_to_string(names, '|') AS names FROM (SELECT movie_id,"
        f" list_filter({_ARRAY_SQL}, lambda n: n IS NOT NULL) AS names FROM movies_d)",
    ),
)
def fn_array_drop_null(spark, d):
    return views.movies(spark, d).select(
        "movie_id",
        F.size(genre_array()).alias("n_genres"),
        F.array_join(genre_array(), "|").alias("names"),
    )


@query("fn_concat_ws", with_views("movies_d", f"SELECT movie_id, {_GENRES_SQL} AS genres FROM movies_d"))
def fn_concat_ws(spark, d):
    return views.movies(spark, d).select("movie_id", genre_text().alias("genres"))


@query(
    "fn_parse_date",
    with_views(
        "movies_d",
        "SELECT movie_id, CAST(try_strptime(release_date, '%d-%b-%Y') AS DATE) AS release_date"
        " FROM movies_d",
    ),
)
def fn_parse_date(spark, d):
    return views.movies(spark, d).select(
        "movie_id", parse_release_date(F.col("release_date")).alias("release_date")
    )


@query(
    "fn_epoch_ts",
    with_views(
        "ratings_d",
        "SELECT user_id, movie_id, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(\"timestamp\")"
        " AS rated_at FROM ratings_d",
    ),
)
def fn_epoch_ts(spark, d):
    return views.ratings(spark, d).select(
        "user_id", "movie_id", epoch_to_utc(F.col("timestamp")).alias("rated_at")
    )


@query(
    "fn_default",
    "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, 'Unknown') AS title FROM"
    " (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem"
    " UNION ALL SELECT s_suppkey, 0, -1 - s_suppkey FROM supplier)"
    " LEFT JOIN part ON l_partkey = p_partkey",
)
def fn_default(spark, d):
    """Line items, and one line of each supplier for a part that there is not."""
    lines = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("movie_id")
    )
    strange = views.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_orderkey"),
        F.lit(0).alias("l_linenumber"),
        (-1 - F.col("s_suppkey")).alias("movie_id"),
    )
    titles = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title")
    )
    titled = cat.with_titles(lines.unionByName(strange), titles)
    return titled.withColumnRenamed("movie_id", "l_partkey")


@query("fn_explode_recs", with_views("listed_d", "SELECT user_id, rank, movie_id, rating FROM listed_d"))
def fn_explode_recs(spark, d):
    return explode_list(views.lists(spark, d)).withColumn("rating", F.col("rating").cast("double"))


# ---- the flagship


@query(
    "clean_catalogue",
    with_views(
        "catalogue_d",
        "SELECT movie_id, title, genres, release_date, round(avg_rating, 9) AS avg_rating"
        " FROM catalogue_d",
    ),
)
def clean_catalogue_query(spark, d):
    cleaned = clean_catalogue(views.movies(spark, d), views.ratings(spark, d))
    return cleaned.select(
        "movie_id", "title", "genres", "release_date", F.round("avg_rating", 9).alias("avg_rating")
    )
