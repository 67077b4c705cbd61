"""Token tables, ranking statistics and ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinerank.operators.lists import entries, users_by_film
from cinerank.operators.search import (
    build_index,
    document_frequencies,
    field_statistics,
    first_hit,
    query_term_rows,
    search,
    token_rows,
)
from cinerank.operators.segments import (
    add_documents,
    open_index,
    remove_documents,
    term_statistics,
)
from cinerank.session import scratch_path
from entry_queries import views
from entry_queries.registry import query
from entry_queries.views import tokens_sql, with_views


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def ranking_views(docs: str, doc_id: str, fields: list[str], requests: str) -> dict[str, str]:
    """SQL views up to ``ranked_hits`` (query, doc_id, score, rank) for a search.

    ``requests`` is a query that yields the texts to search for as ``query``.
    """
    tokens = _union(
        f"SELECT {doc_id} AS doc_id, '{f}' AS field, unnest({tokens_sql(f)}) AS term FROM {docs}"
        for f in fields
    )
    lengths = _union(
        f"SELECT {doc_id} AS doc_id, '{f}' AS field, coalesce(len({tokens_sql(f)}), 0) AS length"
        f" FROM {docs}"
        for f in fields
    )
    return {
        "asked": f"SELECT DISTINCT query FROM ({requests})",
        "query_terms": "SELECT query, term, count(*) AS qtf FROM"
        f" (SELECT query, unnest({tokens_sql('query')}) AS term FROM asked) GROUP BY query, term",
        "counts": f"SELECT doc_id, field, term, count(*) AS tf FROM ({tokens})"
        " GROUP BY doc_id, field, term",
        "lengths": lengths,
        "stats": "SELECT field, count(*) AS n_docs, avg(length) AS mean_length FROM lengths"
        " GROUP BY field",
        "dfs": "SELECT field, term, count(*) AS df FROM counts GROUP BY field, term",
        "weights": "SELECT doc_id, field, term, ln(1 + (n_docs - df + 0.5) / (df + 0.5))"
        " * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS weight"
        " FROM counts JOIN dfs USING (field, term) JOIN lengths USING (doc_id, field)"
        " JOIN stats USING (field)",
        "field_scores": "SELECT query, doc_id, field, sum(qtf * weight) AS score"
        " FROM query_terms JOIN weights USING (term) GROUP BY query, doc_id, field",
        "scores": "SELECT query, doc_id, round(max(score), 6) AS score FROM field_scores"
        " GROUP BY query, doc_id",
        "ranked_hits": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query"
        " ORDER BY score DESC, doc_id) AS INT) AS rank FROM scores) WHERE rank <= 10",
    }


def search_sql(names: str, body: str, *ranking, **more: str) -> str:
    return with_views(names, body, **ranking_views(*ranking), **more)


# Title requests: every film's title (found), every customer's name (no such film),
# and every film's release date (blank for some).
TITLE_REQUESTS = (
    "SELECT concat('film-', p_partkey) AS request_id, p_name AS title FROM part UNION ALL"
    " SELECT concat('customer-', c_custkey), c_name FROM customer UNION ALL"
    " SELECT concat('date-', movie_id), release_date FROM movies_d"
)


def title_requests(spark, d):
    films = views.table(spark, d, "part").select(
        F.concat(F.lit("film-"), "p_partkey").alias("request_id"), F.col("p_name").alias("title")
    )
    customers = views.table(spark, d, "customer").select(
        F.concat(F.lit("customer-"), "c_custkey").alias("request_id"), F.col("c_name").alias("title")
    )
    dates = views.movies(spark, d).select(
        F.concat(F.lit("date-"), "movie_id").alias("request_id"), F.col("release_date").alias("title")
    )
    return films.unionByName(customers).unionByName(dates)


@query(
    "search_tokens",
    "SELECT doc_id, CAST(generate_subscripts(terms, 1) - 1 AS INT) AS position, unnest(terms) AS term"
    f" FROM (SELECT doc_id, {tokens_sql('text')} AS terms FROM documents)",
)
def search_tokens(spark, d):
    return token_rows(views.table(spark, d, "documents"), "doc_id", "text")


@query(
    "search_stats",
    "WITH t AS (SELECT doc_id, unnest(" + tokens_sql("text") + ") AS term FROM documents),"
    " n AS (SELECT count(*) AS n_docs FROM documents)"
    " SELECT term, count(DISTINCT doc_id) AS df,"
    " round(ln(1 + (n_docs - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6)"
    " AS idf FROM t, n GROUP BY term, n_docs",
)
def search_stats(spark, d):
    found = document_frequencies(views.table(spark, d, "documents"), "doc_id", "text")
    return found.withColumn("idf", F.round("idf", 6))


@query(
    "search_field_stats",
    with_views(
        "catalogue_d",
        "SELECT field, count(*) AS n_docs, round(avg(length), 6) AS mean_length FROM ("
        f"SELECT 'title' AS field, len({tokens_sql('title')}) AS length FROM catalogue_d UNION ALL"
        f" SELECT 'genres', len({tokens_sql('genres')}) FROM catalogue_d) GROUP BY field",
    ),
)
def search_field_stats(spark, d):
    figures = field_statistics(views.catalogue(spark, d), "movie_id", ["title", "genres"])
    return figures.withColumn("mean_length", F.round("mean_length", 6))


# Films whose id seven divides are taken out of the index again, and every second one of
# those comes back under a title of its own.
_CHANGED = {
    "live": "SELECT movie_id, title FROM movies_d WHERE movie_id % 7 <> 0 UNION ALL"
    " SELECT movie_id, concat(title, ' again') FROM movies_d WHERE movie_id % 14 = 0"
}


def _changed_index(spark, d) -> str:
    """A stored index of titles after appends, a removal and a replacement."""
    path = scratch_path(spark, "title-index")
    films = views.movies(spark, d).select("movie_id", "title")
    odd = F.col("movie_id") % 2 == 1
    add_documents(films.filter(odd), "movie_id", ["title"], path)
    add_documents(films.filter(~odd), "movie_id", ["title"], path)
    remove_documents(spark, path, films.filter("movie_id % 7 = 0").select(F.col("movie_id").alias("doc_id")))
    again = films.filter("movie_id % 14 = 0").withColumn("title", F.concat("title", F.lit(" again")))
    add_documents(again, "movie_id", ["title"], path)
    return path


@query(
    "search_stored",
    with_views(
        "movies_d",
        "SELECT request_id, title AS query, doc_id, score, rank FROM requests"
        " JOIN ranked_hits ON query = title",
        requests=TITLE_REQUESTS,
        **_CHANGED,
        **ranking_views("live", "movie_id", ["title"], "SELECT title AS query FROM requests"),
    ),
)
def search_stored(spark, d):
    """Searches answered from a stored index that has changed, by its postings of their terms."""
    requests = title_requests(spark, d)
    index = open_index(spark, _changed_index(spark, d), only=query_term_rows(requests, "title"))
    return search(requests, "request_id", "title", index)


@query(
    "search_stored_stats",
    with_views(
        "movies_d",
        "SELECT field, term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf"
        " FROM dfs JOIN stats USING (field)",
        requests=TITLE_REQUESTS,
        **_CHANGED,
        **ranking_views("live", "movie_id", ["title"], "SELECT title AS query FROM requests"),
    ),
)
def search_stored_stats(spark, d):
    """Document frequencies of that index, added up over its segments."""
    found = term_statistics(spark, _changed_index(spark, d))
    return found.withColumn("idf", F.round("idf", 6))


_TITLE_SEARCH = ("movies_d", "movie_id", ["title"], "SELECT title AS query FROM requests")


def _title_sql(body: str) -> str:
    return with_views("movies_d", body, requests=TITLE_REQUESTS, **ranking_views(*_TITLE_SEARCH))


def _title_index(spark, d):
    return build_index(views.movies(spark, d), "movie_id", ["title"])


@query(
    "search_match",
    _title_sql(
        "SELECT request_id, title AS query, doc_id, score, rank FROM requests"
        " JOIN ranked_hits ON query = title"
    ),
)
def search_match(spark, d):
    return search(title_requests(spark, d), "request_id", "title", _title_index(spark, d))


@query(
    "topk_hits",
    _title_sql("SELECT request_id, doc_id, rank FROM requests JOIN ranked_hits ON query = title WHERE rank <= 3"),
)
def topk_hits(spark, d):
    hits = search(title_requests(spark, d), "request_id", "title", _title_index(spark, d), k=3)
    return hits.select("request_id", "doc_id", "rank")


@query(
    "first_hit",
    _title_sql(
        "SELECT request_id, title AS query, doc_id, score FROM requests"
        " JOIN ranked_hits ON query = title WHERE rank = 1"
    ),
)
def first_hit_query(spark, d):
    return first_hit(title_requests(spark, d), "request_id", "title", _title_index(spark, d))


@query(
    "search_no_hits",
    _title_sql(
        "SELECT request_id, CASE WHEN title IN (SELECT query FROM ranked_hits) THEN 200 ELSE 404 END"
        " AS status FROM requests"
    ),
)
def search_no_hits(spark, d):
    requests = title_requests(spark, d)
    found = first_hit(requests, "request_id", "title", _title_index(spark, d)).select("request_id", "doc_id")
    status = F.when(F.col("doc_id").isNull(), 404).otherwise(200)
    return requests.join(found, "request_id", "left").select("request_id", status.alias("status"))


# Queries that touch both fields: a film's title together with its genres.
CATALOGUE_REQUESTS = (
    "SELECT movie_id AS request_id, concat(title, ' ', genres) AS query FROM catalogue_d"
)


def catalogue_requests(spark, d):
    return views.catalogue(spark, d).select(
        F.col("movie_id").alias("request_id"), F.concat_ws(" ", "title", "genres").alias("query")
    )


@query(
    "search_multi_match",
    search_sql(
        "catalogue_d",
        "SELECT request_id, query, doc_id, score, rank FROM requests JOIN ranked_hits USING (query)",
        "catalogue_d",
        "movie_id",
        ["title", "genres"],
        CATALOGUE_REQUESTS,
        requests=CATALOGUE_REQUESTS,
    ),
)
def search_multi_match(spark, d):
    index = build_index(views.catalogue(spark, d), "movie_id", ["title", "genres"])
    return search(catalogue_requests(spark, d), "request_id", "query", index)


@query(
    "search_documents",
    search_sql(
        "",
        "SELECT item_id, doc_id, score, rank FROM benchmark JOIN ranked_hits ON query = text",
        "documents",
        "doc_id",
        ["text"],
        "SELECT text AS query FROM benchmark",
    ),
)
def search_documents(spark, d):
    """Whole benchmark passages as queries against whole documents."""
    requests = views.table(spark, d, "benchmark")
    index = build_index(
        views.table(spark, d, "documents"), "doc_id", ["text"], only=query_term_rows(requests, "text")
    )
    return search(requests, "item_id", "text", index).drop("query")


@query(
    "search_nested",
    with_views("listed_d", "SELECT movie_id, user_id, 1.0::DOUBLE AS score FROM listed_d WHERE movie_id IN"
               " (SELECT CAST(p_partkey AS INT) FROM part)"),
)
def search_nested(spark, d):
    films = views.movies(spark, d).select("movie_id")
    return users_by_film(views.lists(spark, d), films).withColumn("score", F.lit(1.0))


@query(
    "join_nested_contains",
    with_views(
        "listed_d",
        "SELECT user_id FROM listed_d WHERE movie_id = (SELECT min(movie_id) FROM listed_d)",
    ),
)
def join_nested_contains(spark, d):
    from cinerank.operators.lists import users_recommended

    lists = views.lists(spark, d)
    film = entries(lists).agg(F.min("movie_id")).first()[0]
    return users_recommended(lists, film).select("user_id")
