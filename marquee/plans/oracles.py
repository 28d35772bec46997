"""Independent DuckDB SQL for every exact query key.

The SQL states each operator the brute-force way (request x catalog
products, fan-out tables, nested containment), so it checks the Spark
plans rather than repeating them. Tables ``part lineitem orders ...`` are
views registered by the checker; the recommendation tables are CTEs with
the adapter expressions.
"""

from __future__ import annotations

from marquee.functions.text import GENRE_VOCAB
from marquee.sources import adapter as A


# --- fixed values: code points that str.strip() removes, as ranges ----------
TRIM_POINTS = ((9, 13), (28, 32), (133, 133), (160, 160), (5760, 5760), (8192, 8202), (8232, 8233), (8239, 8239),
               (8287, 8287), (12288, 12288))
# What titles lose: a year in parentheses, and all but letters, digits, _ and the points above.
YEAR = r"[(]\p{Nd}\p{Nd}\p{Nd}\p{Nd}[)]"
OTHER = r"[^_\p{L}\p{N}" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in TRIM_POINTS) + "]"
# ---------------------------------------------------------------------------


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_sql_str(v) for v in values) + "]"


def normalize_sql(x: str) -> str:
    step1 = f"regexp_replace({x}, {_sql_str(YEAR)}, '', 'g')"
    step2 = f"regexp_replace({step1}, {_sql_str(OTHER)}, '', 'g')"
    return strip_sql(f"lower({step2})")


def strip_sql(x: str) -> str:
    spaces = "".join(chr(c) for low, high in TRIM_POINTS for c in range(low, high + 1))
    return f"trim({x}, {_sql_str(spaces)})"


def genres_sql(x: str) -> str:
    return f"list_filter({_list(sorted(GENRE_VOCAB))}, lambda g: coalesce(contains(lower({x}), g), false))"


_GENRES = _list(A.ADAPTER_GENRES)

BASE = f"""
movies AS (
  SELECT CAST(p_partkey AS INTEGER) AS movieId,
         p_name || ' ' || CAST(p_partkey AS VARCHAR) || ' (' || CAST(1980 + p_size % 40 AS VARCHAR) || ')' AS title,
         CASE WHEN p_partkey % 50 = 0 THEN {_sql_str(A.NO_GENRES)}
              WHEN {_GENRES}[p_partkey % 14 + 1] = {_GENRES}[p_size % 14 + 1] THEN {_GENRES}[p_partkey % 14 + 1]
              ELSE {_GENRES}[p_partkey % 14 + 1] || '|' || {_GENRES}[p_size % 14 + 1] END AS genres
  FROM part
),
ratings AS (
  SELECT CAST(o_custkey AS INTEGER) AS userId, CAST(l_partkey AS INTEGER) AS movieId,
         CAST(ceil(l_quantity / 5) / 2 AS FLOAT) AS rating, CAST(epoch(l_shipdate) AS BIGINT) AS timestamp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
tags AS (
  SELECT CAST(o_custkey AS INTEGER) AS userId, CAST(l_partkey AS INTEGER) AS movieId,
         unnest([lower(l_returnflag), lower(l_linestatus)]) AS tag, CAST(epoch(l_shipdate) AS BIGINT) AS timestamp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount >= 0.05
),
clean_ratings AS (SELECT userId, movieId, rating FROM ratings WHERE rating IS NOT NULL AND NOT isnan(rating)),
clean_tags AS (SELECT DISTINCT userId, movieId, tag FROM tags),
hybrid AS (
  SELECT r.userId, r.movieId, r.rating, m.genres, coalesce(t.tag, 'unknown') AS tag
  FROM clean_ratings r
  LEFT JOIN (SELECT movieId, genres FROM movies) m ON r.movieId = m.movieId
  LEFT JOIN clean_tags t ON r.userId = t.userId AND r.movieId = t.movieId
),
als AS (
  SELECT userId, movieId, ALS_score FROM (
    SELECT userId, movieId, avg(CAST(rating AS DOUBLE)) AS ALS_score FROM ratings GROUP BY userId, movieId)
  QUALIFY row_number() OVER (PARTITION BY userId ORDER BY ALS_score DESC, movieId ASC) <= {A.ALS_STANDIN_TOP}
),
stats AS (SELECT movieId, avg(rating) AS avg_rating, count(rating) AS rating_count FROM hybrid GROUP BY movieId),
ranking AS (
  SELECT a.userId, a.movieId, a.ALS_score, s.avg_rating, s.rating_count, g.genres, tg.tag,
         coalesce(l.label, 0) AS label
  FROM als a
  LEFT JOIN stats s ON a.movieId = s.movieId
  LEFT JOIN (SELECT DISTINCT movieId, genres FROM hybrid) g ON a.movieId = g.movieId
  LEFT JOIN (SELECT DISTINCT movieId, tag FROM hybrid) tg ON a.movieId = tg.movieId
  LEFT JOIN (SELECT userId, movieId, rating AS label FROM hybrid) l ON a.userId = l.userId AND a.movieId = l.movieId
),
queries AS (
  SELECT CAST(movieId AS BIGINT) AS query_id,
         CASE movieId % 8
           WHEN 0 THEN {_sql_str(A.QUERY_PREFIX_WATCHED)} || title
           WHEN 1 THEN title
           WHEN 2 THEN {_sql_str(A.QUERY_SUGGEST[0])} || lower(string_split(genres, '|')[1]) || {_sql_str(A.QUERY_SUGGEST[1])}
           WHEN 3 THEN title || {_sql_str(A.QUERY_SUFFIX_EXTRA)}
           WHEN 4 THEN {_sql_str(A.QUERY_NO_SIGNAL)}
           WHEN 5 THEN {_sql_str(A.QUERY_BLANK)}
           WHEN 6 THEN NULL
           ELSE {_sql_str(A.QUERY_SUBSTRING_TRAP)} END AS text
  FROM movies
),
lookup AS (
  SELECT key, length(key) AS klen, max(movieId) AS movieId, arg_max(genres, movieId) AS genres,
         min(movieId) AS first_pos
  FROM (SELECT {normalize_sql('title')} AS key, movieId, genres FROM movies WHERE title IS NOT NULL)
  GROUP BY key
),
matched AS (
  SELECT query_id, movieId, genres, key AS title_key FROM (
    SELECT q.query_id, l.movieId, l.genres, l.key, l.klen, l.first_pos
    FROM (SELECT query_id, {normalize_sql('text')} AS qn FROM queries WHERE text IS NOT NULL AND text <> '') q
    JOIN lookup l ON contains(q.qn, l.key))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY klen DESC, first_pos ASC) = 1
),
intents AS (
  SELECT q.query_id, q.text,
         CASE WHEN q.text IS NULL OR q.text = '' THEN 'missing'
              WHEN {strip_sql('q.text')} = '' THEN 'blank' ELSE 'ok' END AS state,
         {genres_sql(strip_sql('q.text'))} AS text_genres,
         m.movieId AS m_id, m.genres AS m_genres
  FROM queries q LEFT JOIN matched m ON q.query_id = m.query_id
),
intents2 AS (
  SELECT *, CASE WHEN state = 'ok' THEN m_id END AS seed_id,
         CASE WHEN state = 'ok' THEN m_genres END AS seed_genres FROM intents
),
classified AS (
  SELECT query_id, seed_id, seed_genres, text_genres,
         CASE WHEN state = 'missing' THEN 'fallback' WHEN state = 'blank' THEN 'fallback'
              WHEN seed_id IS NULL AND len(text_genres) = 0 THEN 'fallback'
              WHEN seed_id IS NOT NULL AND seed_genres IS NULL THEN 'error' END AS pre_status,
         CASE WHEN state = 'missing' THEN 'The request has no text.'
              WHEN state = 'blank' THEN 'The request holds only spaces.'
              WHEN seed_id IS NULL AND len(text_genres) = 0 THEN 'No known title or genre occurs in the request.'
              WHEN seed_id IS NOT NULL AND seed_genres IS NULL THEN 'The named movie has no genres.' END AS pre_message,
         CASE WHEN seed_id IS NOT NULL THEN 'title' ELSE 'genre' END AS mode,
         list_sort(list_distinct(list_concat(
             CASE WHEN seed_id IS NULL OR seed_genres IS NULL THEN CAST([] AS VARCHAR[])
                  ELSE list_transform(string_split(seed_genres, '|'), lambda t: lower(t)) END,
             text_genres))) AS req
  FROM intents2
),
eligible AS (SELECT * FROM classified WHERE pre_status IS NULL),
item_agg AS (
  SELECT movieId, avg(ALS_score) AS als, avg(avg_rating) AS rating, max(rating_count) AS cnt
  FROM ranking GROUP BY movieId
),
scored AS (
  SELECT i.movieId, i.genres, coalesce(a.als, 0) AS als, coalesce(a.rating, 0) AS rating,
         coalesce(a.cnt, 0) AS cnt,
         coalesce(a.als, 0) * 0.6 + coalesce(a.rating, 0) * 0.3 + (coalesce(a.cnt, 0) / 1000) * 0.1 AS score_title,
         coalesce(a.rating, 0) * 0.7 + (coalesce(a.cnt, 0) / 1000) * 0.3 AS score_genre
  FROM (SELECT DISTINCT movieId, genres FROM hybrid) i LEFT JOIN item_agg a ON i.movieId = a.movieId
),
pairs AS (
  SELECT e.query_id, e.mode, s.movieId, s.genres,
         round(CASE WHEN e.mode = 'title' THEN s.score_title ELSE s.score_genre END, 6) AS okey,
         CASE WHEN s.genres IS NULL THEN 3
              WHEN list_bool_and(list_transform(e.req, lambda g: contains(lower(s.genres), g))) THEN 1
              WHEN list_bool_or(list_transform(e.req, lambda g: contains(lower(s.genres), g))) THEN 2
              ELSE 3 END AS item_stage
  FROM eligible e JOIN scored s ON (e.seed_id IS NULL OR s.movieId <> e.seed_id)
),
chosen AS (
  SELECT * FROM pairs QUALIFY item_stage = min(item_stage) OVER (PARTITION BY query_id)
),
top10 AS (
  SELECT * , CAST(row_number() OVER (PARTITION BY query_id ORDER BY okey DESC, movieId ASC, genres ASC NULLS FIRST) AS INTEGER) AS rank
  FROM chosen QUALIFY rank <= 10
),
rec_rows AS (
  SELECT t.query_id, t.rank, t.movieId, m.title, m.genres, t.okey AS score, t.item_stage AS stage, t.mode
  FROM top10 t LEFT JOIN movies m ON t.movieId = m.movieId
),
rec_status AS (
  SELECT c.query_id,
         coalesce(c.pre_status, CASE WHEN n.n > 0 THEN 'success' ELSE 'fallback' END) AS status,
         coalesce(c.pre_message, CASE WHEN n.n > 0 THEN NULL ELSE 'Nothing can be suggested from this catalog.' END) AS message,
         CAST(CASE WHEN c.pre_status IS NULL THEN coalesce(n.n, 0) ELSE 0 END AS BIGINT) AS n_recs,
         CASE WHEN c.pre_status IS NULL THEN n.stage END AS stage
  FROM classified c LEFT JOIN (SELECT query_id, count(*) AS n, min(stage) AS stage FROM rec_rows GROUP BY query_id) n
    ON c.query_id = n.query_id
)
"""


def with_base(select: str) -> str:
    return "WITH " + BASE.strip() + "\n" + select.strip()


def _parse_sql() -> str:
    return with_base(f"""
SELECT q.query_id,
       CASE WHEN q.text IS NULL OR q.text = '' THEN 'unknown'
            WHEN m.movieId IS NOT NULL THEN 'movie'
            WHEN len({genres_sql('q.text')}) > 0 THEN 'genre' ELSE 'unknown' END AS intent_type,
       CASE WHEN q.text IS NOT NULL AND q.text <> '' THEN m.movieId END AS movieId,
       CASE WHEN q.text IS NOT NULL AND q.text <> '' THEN m.genres END AS movie_genres,
       CASE WHEN q.text IS NOT NULL AND q.text <> '' AND m.movieId IS NULL AND len({genres_sql('q.text')}) > 0
            THEN array_to_string({genres_sql('q.text')}, ',') END AS genres,
       round(CAST(CASE WHEN q.text IS NULL OR q.text = '' THEN 0.0
            WHEN m.movieId IS NOT NULL THEN 1.0
            WHEN len({genres_sql('q.text')}) > 0 THEN least(1.0, 0.5 + 0.1 * len({genres_sql('q.text')}))
            ELSE 0.0 END AS DOUBLE), 6) AS confidence
FROM queries q LEFT JOIN matched m ON q.query_id = m.query_id
""")


def _genre_sets_sql(strict: bool) -> str:
    agg = "list_bool_and" if strict else "list_bool_or"
    return with_base(f"""
SELECT s.rkey, i.movieId, i.genres
FROM (SELECT DISTINCT array_to_string(req, '|') AS rkey, req FROM eligible) s
JOIN (SELECT DISTINCT movieId, genres FROM hybrid) i
  ON i.genres IS NOT NULL AND {agg}(list_transform(s.req, lambda g: contains(lower(i.genres), g)))
""")


def _split_sql() -> str:
    return with_base("""
SELECT userId, movieId, rating,
       CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, CAST(('0x' || substr(md5('42:' || CAST(userId AS VARCHAR) || ':' || CAST(movieId AS VARCHAR)), 1, 8))::BIGINT % 10000 AS INTEGER) AS b
      FROM hybrid WHERE userId IS NOT NULL AND movieId IS NOT NULL AND rating IS NOT NULL)
""")


ORACLES: dict[str, str] = {
    "scan_csv_roundtrip": with_base("SELECT movieId, title, genres FROM movies"),
    "write_parquet_roundtrip": with_base("SELECT * FROM hybrid"),
    "profile_tables": with_base("""
SELECT 'movies' AS table_name, count(*) AS n_rows,
       count(*) FILTER (WHERE movieId IS NULL OR title IS NULL OR genres IS NULL) AS n_rows_with_null,
       CAST(3 AS BIGINT) AS n_columns FROM movies
UNION ALL SELECT 'ratings', count(*), count(*) FILTER (WHERE userId IS NULL OR movieId IS NULL OR rating IS NULL OR timestamp IS NULL), 4 FROM ratings
UNION ALL SELECT 'tags', count(*), count(*) FILTER (WHERE userId IS NULL OR movieId IS NULL OR tag IS NULL OR timestamp IS NULL), 4 FROM tags
UNION ALL SELECT 'hybrid', count(*), count(*) FILTER (WHERE userId IS NULL OR movieId IS NULL OR rating IS NULL OR genres IS NULL OR tag IS NULL), 5 FROM hybrid
UNION ALL SELECT 'als_candidates', count(*), count(*) FILTER (WHERE userId IS NULL OR movieId IS NULL OR ALS_score IS NULL), 3 FROM als
"""),
    "clean_ratings": with_base("SELECT * FROM clean_ratings"),
    "clean_tags": with_base("SELECT * FROM clean_tags"),
    "build_hybrid": with_base("SELECT * FROM hybrid"),
    "project_hybrid": with_base("SELECT userId, movieId, rating FROM hybrid"),
    "als_triples": with_base("SELECT userId, movieId, rating FROM hybrid WHERE userId IS NOT NULL AND movieId IS NOT NULL AND rating IS NOT NULL"),
    "labels_from_ratings": with_base("SELECT userId, movieId, rating AS label FROM hybrid"),
    "item_genres": with_base("SELECT DISTINCT movieId, genres FROM hybrid"),
    "item_tags": with_base("SELECT DISTINCT movieId, tag FROM hybrid"),
    "explode_genres": with_base("SELECT movieId, unnest(string_split(genres, '|')) AS genre FROM movies"),
    "fill_defaults": with_base("""
SELECT userId, movieId, coalesce(ALS_score, 0) AS ALS_score, coalesce(avg_rating, 0) AS avg_rating,
       coalesce(rating_count, 0) AS rating_count, coalesce(label, 0) AS label FROM ranking"""),
    "movie_stats": with_base("SELECT movieId, round(avg_rating, 6) AS avg_rating, rating_count FROM stats"),
    "movie_stats_dedup": with_base("""
SELECT movieId, round(avg(rating), 6) AS avg_rating, count(rating) AS rating_count
FROM (SELECT DISTINCT userId, movieId, rating FROM hybrid) GROUP BY movieId"""),
    "build_ranking": with_base("""
SELECT userId, movieId, round(ALS_score, 6) AS ALS_score, round(avg_rating, 6) AS avg_rating, rating_count,
       genres, tag, label FROM ranking"""),
    "ranking_with_stats": with_base("""
SELECT a.userId, a.movieId, round(a.ALS_score, 6) AS ALS_score, round(s.avg_rating, 6) AS avg_rating, s.rating_count
FROM als a LEFT JOIN stats s ON a.movieId = s.movieId"""),
    "aggregate_candidates": with_base("""
SELECT movieId, genres, round(als, 6) AS als, round(rating, 6) AS rating, CAST(cnt AS BIGINT) AS count FROM scored"""),
    "score_item_mode": with_base("SELECT movieId, genres, round(score_title, 6) AS score FROM scored"),
    "score_genre_mode": with_base("SELECT movieId, genres, round(score_genre, 6) AS score FROM scored"),
    "topk_global": with_base("""
SELECT CAST(row_number() OVER (ORDER BY round(score_genre, 6) DESC, movieId ASC, genres ASC NULLS FIRST) AS INTEGER) AS rank,
       movieId, genres, round(score_genre, 6) AS score
FROM scored QUALIFY rank <= 10"""),
    "enrich_topk": with_base("""
SELECT t.rank, t.movieId, m.title, m.genres, t.score FROM (
  SELECT CAST(row_number() OVER (ORDER BY round(score_genre, 6) DESC, movieId ASC, genres ASC NULLS FIRST) AS INTEGER) AS rank,
         movieId, round(score_genre, 6) AS score FROM scored QUALIFY rank <= 10) t
LEFT JOIN movies m ON t.movieId = m.movieId"""),
    "normalize_titles": with_base(f"SELECT movieId, {normalize_sql('title')} AS title_key FROM movies"),
    "match_titles": with_base("SELECT * FROM matched"),
    "extract_genres": with_base(f"SELECT query_id, array_to_string({genres_sql('text')}, ',') AS genres FROM queries"),
    "parse_query": _parse_sql(),
    "requested_genres": with_base("""
SELECT query_id, mode, seed_id, array_to_string(req, '|') AS requested FROM eligible"""),
    "retrieve_strict": _genre_sets_sql(True),
    "retrieve_relaxed": _genre_sets_sql(False),
    "retrieve_global": with_base("SELECT DISTINCT movieId, genres FROM hybrid"),
    "retrieve_seed_excluded": with_base("""
SELECT m.query_id, m.movieId AS seed_id, CAST(count(i.movieId) AS BIGINT) AS n_candidates
FROM matched m JOIN (SELECT DISTINCT movieId, genres FROM hybrid) i ON i.movieId <> m.movieId
GROUP BY m.query_id, m.movieId"""),
    "recall_stage": with_base("SELECT query_id, stage FROM rec_status WHERE stage IS NOT NULL"),
    "rank_item_mode": with_base("""
SELECT query_id, rank, movieId, title, genres, score FROM rec_rows WHERE mode = 'title'"""),
    "rank_genre_mode": with_base("""
SELECT query_id, rank, movieId, title, genres, score FROM rec_rows WHERE mode = 'genre'"""),
    "recommend_batch": with_base("SELECT query_id, rank, movieId, title, genres, score FROM rec_rows"),
    "recommend_status": with_base("SELECT query_id, status, message, n_recs FROM rec_status"),
    "filter_by_genres": with_base("""
SELECT DISTINCT movieId FROM hybrid WHERE contains(genres, 'Drama') AND contains(genres, 'Romance')"""),
    "users_reached_by_item": with_base("""
SELECT DISTINCT a.movieId, a.userId FROM als a WHERE a.movieId IN (SELECT movieId FROM matched)"""),
    "collaborative_candidates": with_base("""
SELECT s.seed_id, a.movieId, round(a.ALS_score, 6) AS als_score
FROM (SELECT DISTINCT movieId AS seed_id FROM matched) s
JOIN (SELECT DISTINCT userId, movieId FROM als) r ON r.movieId = s.seed_id
JOIN als a ON a.userId = r.userId"""),
    "explode_recommendations": with_base("SELECT userId, movieId, round(ALS_score, 6) AS ALS_score FROM als"),
    "split_ratings": _split_sql(),
    "topk_features_per_user": with_base("""
SELECT userId, movieId, round(ALS_score, 6) AS ALS_score, round(avg_rating, 6) AS avg_rating, rating_count, label FROM (
  SELECT userId, movieId, coalesce(ALS_score, 0) AS ALS_score, coalesce(avg_rating, 0) AS avg_rating,
         coalesce(rating_count, 0) AS rating_count, coalesce(label, 0) AS label FROM ranking)
QUALIFY row_number() OVER (PARTITION BY userId ORDER BY ALS_score DESC, movieId ASC, label DESC) <= 20"""),
    "ranker_group_sizes": with_base("""
SELECT userId, count(*) AS group_size FROM (
  SELECT userId FROM ranking
  QUALIFY row_number() OVER (PARTITION BY userId ORDER BY coalesce(ALS_score, 0) DESC, movieId ASC, coalesce(label, 0) DESC) <= 20)
GROUP BY userId"""),
    "ranker_pairs": with_base("""
SELECT a.userId, CAST(count(*) AS BIGINT) AS n_pairs
FROM (SELECT userId, coalesce(label, 0) AS label FROM ranking
      QUALIFY row_number() OVER (PARTITION BY userId ORDER BY coalesce(ALS_score, 0) DESC, movieId ASC, coalesce(label, 0) DESC) <= 20) a
JOIN (SELECT userId, coalesce(label, 0) AS label FROM ranking
      QUALIFY row_number() OVER (PARTITION BY userId ORDER BY coalesce(ALS_score, 0) DESC, movieId ASC, coalesce(label, 0) DESC) <= 20) b
  ON a.userId = b.userId AND a.label > b.label
GROUP BY a.userId"""),
}

ORACLES["training_rows_by_user"] = ORACLES["topk_features_per_user"]

_UTILITY = """
SELECT userId, movieId, label, pow(2.0, CAST(label AS DOUBLE) * 400) * (avg_rating - 3.0) AS raw FROM (
  SELECT userId, movieId, coalesce(ALS_score, 0) AS ALS_score, coalesce(avg_rating, 0) AS avg_rating,
         coalesce(rating_count, 0) AS rating_count, coalesce(label, 0) AS label FROM ranking)
QUALIFY row_number() OVER (PARTITION BY userId ORDER BY ALS_score DESC, movieId ASC, label DESC) <= 20"""
ORACLES["score_candidates"] = with_base(
    "SELECT movieId, genres, round(score_title, 6) AS score_title, round(score_genre, 6) AS score_genre FROM scored")
ORACLES["sanitize_scores"] = with_base(f"""
SELECT userId, movieId, label, CASE WHEN isnan(raw) OR isinf(raw) THEN 0.0 ELSE raw END AS score
FROM ({_UTILITY})""")
ORACLES["weighted_scores"] = with_base(f"""
SELECT userId, movieId, label,
       CASE WHEN isnan(raw) OR isinf(raw) THEN 0.0 ELSE raw END
       * CASE WHEN isnan(label - 1) OR label IS NULL THEN 1e-6 ELSE greatest(1e-6, CAST(label - 1 AS DOUBLE)) END
       AS weighted_score
FROM ({_UTILITY})""")

# --- evaluation on the held-out split ---------------------------------------
_HELD_OUT = """
split_ AS (SELECT userId, movieId, rating,
                  CAST(('0x' || substr(md5('42:' || CAST(userId AS VARCHAR) || ':' || CAST(movieId AS VARCHAR)), 1, 8))::BIGINT % 10000 AS INTEGER) AS b
           FROM hybrid WHERE userId IS NOT NULL AND movieId IS NOT NULL AND rating IS NOT NULL),
train AS (SELECT * FROM split_ WHERE b < 8000),
truth AS (SELECT userId, movieId, max(CAST(rating AS DOUBLE)) AS gain FROM split_ WHERE b >= 9000 GROUP BY 1, 2),
lists AS (
  SELECT 'popularity' AS list, movieId, row_number() OVER (ORDER BY n DESC, movieId) AS rank
  FROM (SELECT movieId, count(DISTINCT userId) AS n FROM train GROUP BY 1) QUALIFY rank <= 10
  UNION ALL
  SELECT 'mean_rating', movieId, row_number() OVER (ORDER BY v DESC, movieId) AS rank
  FROM (SELECT movieId, round((sum(CAST(rating AS DOUBLE)) + 5 * (SELECT avg(CAST(rating AS DOUBLE)) FROM train)) / (count(*) + 5), 9) AS v
        FROM train GROUP BY 1) QUALIFY rank <= 10),
best AS (SELECT userId, sum(gain / log2(rn + 1)) FILTER (rn <= 10) AS idcg, count(*) AS held
         FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY gain DESC) AS rn FROM truth) GROUP BY 1),
got AS (SELECT list, userId, sum(gain / log2(rank + 1)) AS dcg, count(*) AS hits, min(rank) AS first
        FROM lists JOIN truth USING (movieId) GROUP BY 1, 2),
per_user AS (
  SELECT n.list, b.userId, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg,
         coalesce(hits, 0) / least(held, 10) AS recall, coalesce(1.0 / first, 0) AS reciprocal_rank
  FROM best b CROSS JOIN (SELECT DISTINCT list FROM lists) n LEFT JOIN got g ON g.userId = b.userId AND g.list = n.list)
"""
ORACLES["ranking_quality"] = with_base("SELECT * FROM (WITH " + _HELD_OUT + """
SELECT list, count(*) AS n_users, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall,
       round(avg(reciprocal_rank), 6) AS reciprocal_rank FROM per_user GROUP BY list)""")
ORACLES["user_quality"] = with_base("SELECT * FROM (WITH " + _HELD_OUT + """
SELECT userId, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank
FROM per_user WHERE list = 'popularity')""")
ORACLES["out_of_fold_stats"] = with_base("""
SELECT m.movieId, CAST(f.fold AS INTEGER) AS fold,
       round(avg(CAST(h.rating AS DOUBLE)) FILTER (h.f <> f.fold), 6) AS avg_rating, count(h.rating) FILTER (h.f <> f.fold) AS rating_count
FROM (SELECT DISTINCT movieId FROM hybrid) m CROSS JOIN range(3) AS f(fold) JOIN (
  SELECT *, CAST(('0x' || substr(md5('1729:' || CAST(userId AS VARCHAR) || ':' || CAST(movieId AS VARCHAR)), 1, 8))::BIGINT % 10000 AS INTEGER) % 3 AS f
  FROM hybrid) h ON h.movieId = m.movieId
GROUP BY 1, 2""")

# --- long texts --------------------------------------------------------------
ORACLES["match_titles_documents"] = with_base(f"""
SELECT query_id, movieId, genres, key AS title_key FROM (
  SELECT q.query_id, l.movieId, l.genres, l.key, l.klen, l.first_pos
  FROM (SELECT query_id, {normalize_sql('text')} AS qn FROM (
          SELECT d.doc_id AS query_id, CASE WHEN m.title IS NULL OR d.text IS NULL THEN d.text ELSE
                 substr(d.text, 1, length(d.text) // 2) || ' ' || m.title || ' ' || substr(d.text, length(d.text) // 2 + 1) END AS text
          FROM documents d LEFT JOIN movies m ON d.doc_id = m.movieId AND d.doc_id % 3 = 0) WHERE text <> '') q
  JOIN lookup l ON contains(q.qn, l.key))
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY klen DESC, first_pos ASC) = 1""")
ORACLES["vocabulary_documents"] = with_base("""
SELECT doc_id, word FROM (SELECT DISTINCT doc_id, lower(text) AS t FROM documents) d JOIN (
  SELECT DISTINCT lower(unnest(string_split(concat_ws(' ', title, replace(genres, '|', ' ')), ' '))) AS word FROM movies) w
  ON w.word <> '' AND contains(d.t, w.word)""")

# --- edge cases of requests ---------------------------------------------------
_EDGE = BASE.replace("SELECT CAST(p_partkey AS INTEGER) AS movieId,\n         p_name", "SELECT CAST(p_partkey AS INTEGER) AS movieId, p_name", 1).replace(
    "CASE WHEN p_partkey % 50 = 0 THEN", f"CASE WHEN p_partkey % {A.EDGE_NO_GENRES} = 0 THEN NULL "
    f"WHEN p_partkey % {A.EDGE_OWN_GENRE} = 0 THEN {_sql_str(A.EDGE_GENRE_PREFIX)} || CAST(p_partkey AS VARCHAR) WHEN p_partkey % 50 = 0 THEN", 1)
_EDGE = _EDGE[:_EDGE.index("queries AS (")] + "queries AS (SELECT CAST(movieId AS BIGINT) AS query_id, title AS text FROM movies),\n" + _EDGE[_EDGE.index("lookup AS ("):]
_EMPTY = BASE.replace("FROM clean_ratings r\n", "FROM (SELECT * FROM clean_ratings WHERE false) r\n", 1)
assert A.EDGE_GENRE_PREFIX in _EDGE and _EMPTY != BASE
ORACLES["recall_stage_edges"] = "WITH " + _EDGE.strip() + "\nSELECT query_id, stage FROM rec_status WHERE stage IS NOT NULL"
ORACLES["recommend_status_edges"] = "WITH " + _EDGE.strip() + "\nSELECT query_id, status, message, n_recs FROM rec_status"
ORACLES["recommend_status_empty"] = "WITH " + _EMPTY.strip() + "\nSELECT query_id, status, message, n_recs FROM rec_status"
ORACLES["retrieve_seed_rows"] = with_base("""
SELECT s.rkey, s.seed_id, i.movieId, i.genres
FROM (SELECT DISTINCT array_to_string(req, '|') AS rkey, req, seed_id FROM eligible WHERE mode = 'title') s
JOIN (SELECT DISTINCT movieId, genres FROM hybrid) i
  ON i.genres IS NOT NULL AND i.movieId <> s.seed_id AND list_bool_and(list_transform(s.req, lambda g: contains(lower(i.genres), g)))""")
ORACLES["collaborative_single"] = with_base("""
SELECT a.movieId, round(a.ALS_score, 6) AS als_score
FROM als a WHERE a.userId IN (SELECT userId FROM als WHERE movieId = 7)""")
ORACLES["collaborative_scores"] = with_base("""
SELECT seed_id, movieId, support, mean_score,
       CAST(row_number() OVER (PARTITION BY seed_id ORDER BY support DESC, mean_score DESC, movieId) AS INTEGER) AS rank FROM (
  SELECT s.seed_id, a.movieId, count(*) AS support, round(avg(CAST(a.ALS_score AS DOUBLE)), 6) AS mean_score
  FROM (SELECT DISTINCT movieId AS seed_id FROM matched) s
  JOIN (SELECT DISTINCT userId, movieId FROM als) r ON r.movieId = s.seed_id
  JOIN als a ON a.userId = r.userId AND a.movieId <> s.seed_id GROUP BY 1, 2)
QUALIFY rank <= 10""")

# --- tables in, tables out ----------------------------------------------------
ORACLES["offline_from_csv"] = ORACLES["build_ranking"]


def _column_profile(table: str, column: str, kind: str) -> str:
    number = f"CAST({column} AS DOUBLE)" if kind == "number" else "CAST(NULL AS DOUBLE)"
    text = column if kind == "text" else "CAST(NULL AS VARCHAR)"
    return (f"SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS n_rows, count(*) FILTER ({column} IS NULL) AS n_null, "
            f"min({number}) AS low, max({number}) AS high, min({text}) AS low_text, max({text}) AS high_text FROM {table}")


ORACLES["profile_columns"] = with_base("\nUNION ALL ".join(_column_profile(t, c, k) for t, columns in {
    "movies": {"movieId": "number", "title": "text", "genres": "text"},
    "ratings": {"userId": "number", "movieId": "number", "rating": "number", "timestamp": "number"},
    "tags": {"userId": "number", "movieId": "number", "tag": "text", "timestamp": "number"},
    "hybrid": {"userId": "number", "movieId": "number", "rating": "number", "genres": "text", "tag": "text"},
    "queries": {"query_id": "number", "text": "text"}}.items() for c, k in columns.items()))
_RAW = """
WITH raw AS (
  SELECT CASE WHEN l_quantity = 50 THEN 'nobody' ELSE CAST(o_custkey + 5000000000 AS VARCHAR) END AS userId,
         CASE WHEN l_quantity <> 49 THEN CAST(CAST(l_partkey AS BIGINT) * 7000000001 AS VARCHAR) END AS movieId,
         CASE l_linenumber WHEN 7 THEN '' WHEN 6 THEN '9' ELSE CAST(CAST(ceil(l_quantity / 5) / 2 AS DOUBLE) AS VARCHAR) END AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
judged AS (
  SELECT *, CASE WHEN userId = 'nobody' THEN 'the user id is missing or no integer'
                 WHEN movieId IS NULL THEN 'the movie id is missing or no integer'
                 WHEN rating = '' THEN 'the rating is missing or no number'
                 WHEN CAST(rating AS DOUBLE) > 5 THEN 'the rating lies outside 0.5 to 5' END AS reason FROM raw)
"""
ORACLES["ratings_balance"] = _RAW + "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n_rows FROM judged GROUP BY 1"
ORACLES["quarantined_ratings"] = _RAW + """
SELECT userId, movieId, rating, reason, count(*) AS n_rows FROM judged WHERE reason IS NOT NULL GROUP BY ALL"""
ORACLES["dense_ratings"] = _RAW + """
SELECT CAST(dense_rank() OVER (ORDER BY CAST(userId AS BIGINT)) - 1 AS INTEGER) AS userId,
       CAST(dense_rank() OVER (ORDER BY CAST(movieId AS BIGINT)) - 1 AS INTEGER) AS movieId, CAST(rating AS FLOAT) AS rating
FROM judged WHERE reason IS NULL"""

# --- models of the hand ---------------------------------------------------------
ORACLES["responses_flat"] = with_base("""
SELECT s.query_id, s.status, s.message, r.rank, r.movieId, r.title, r.genres
FROM rec_status s LEFT JOIN rec_rows r ON r.query_id = s.query_id AND s.status = 'success'""")
ORACLES["ranker_score_fixed"] = with_base("""
SELECT userId, movieId, label,
       (0.5 * CASE WHEN ALS_score <= 3.0 THEN -1.0 WHEN avg_rating <= 2.75 THEN 0.5 ELSE 2.0 END
        + 0.5 * CASE WHEN rating_count <= 20 THEN 0.25 ELSE -0.25 END) * greatest(1e-6, CAST(label AS DOUBLE)) AS score
FROM (SELECT userId, movieId, coalesce(ALS_score, 0) AS ALS_score, coalesce(avg_rating, 0) AS avg_rating,
             coalesce(rating_count, 0) AS rating_count, coalesce(label, 0) AS label FROM ranking)
QUALIFY row_number() OVER (PARTITION BY userId ORDER BY ALS_score DESC, movieId ASC, label DESC) <= 20""")
