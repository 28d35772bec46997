"""Recommendation tables derived from the driver's TPC-H-like tables.

The driver ships no movie data, so movies, ratings, tags, request texts and a
deterministic stand-in for the ALS candidate table are derived with plain
column expressions (the SQL oracles use the same expressions).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions.text import GENRE_VOCAB

# --- fixed values (adapter definition) -------------------------------------
# The vocabulary's genres, capitalised, indexed 0..13 by key % 14.
ADAPTER_GENRES = tuple(g.title() for g in GENRE_VOCAB)
NO_GENRES = "(no genres listed)"
# Request templates chosen by movieId % 8.
QUERY_PREFIX_WATCHED = "I watched "
QUERY_SUGGEST = ("Suggest ", " movies")
QUERY_SUFFIX_EXTRA = " but with war and crime"
QUERY_NO_SIGNAL = "hello there"
QUERY_BLANK = "   "
QUERY_SUBSTRING_TRAP = "award winning software"
ALS_STANDIN_TOP = 50
# The catalog of edge cases: movies without genres, and movies of a genre that
# no other movie has.
EDGE_NO_GENRES = 53
EDGE_OWN_GENRE = 50
EDGE_GENRE_PREFIX = "Noir-"
# Parquet bytes that a task reads at most, and shuffled bytes it gets at most
# (a row is a few bytes there and about 100 in a hash table); bytes of the input
# tables per shuffle partition, before small ones are merged.
TASK_BYTES = 16 << 20
PARTITION_BYTES = 4 << 20
# ---------------------------------------------------------------------------


def _genre_at(idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(g) for g in ADAPTER_GENRES]), (idx % 14 + 1).cast("int"))


def movies_from_part(part: DataFrame) -> DataFrame:
    pk, size = F.col("p_partkey"), F.col("p_size")
    first, second = _genre_at(pk), _genre_at(size)
    genres = (F.when(pk % 50 == 0, F.lit(NO_GENRES))
              .when(first == second, first)
              .otherwise(F.concat(first, F.lit("|"), second)))
    title = F.concat(F.col("p_name"), F.lit(" "), pk.cast("string"), F.lit(" ("),
                     (F.lit(1980) + size % 40).cast("string"), F.lit(")"))
    return part.select(pk.cast("int").alias("movieId"), title.alias("title"), genres.alias("genres"))


def rated_lines(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per line of an order: the rating, and what its tags are made of.
    Ratings and tags both come from these rows, so lines meet orders once."""
    lines = lineitem.select(
        "l_orderkey", F.col("l_partkey").cast("int").alias("movieId"),
        (F.ceil(F.col("l_quantity") / 5) / 2).cast("float").alias("rating"),
        F.unix_timestamp(F.col("l_shipdate")).cast("long").alias("timestamp"),
        (F.col("l_discount") >= 0.05).alias("tagged"),
        F.lower("l_returnflag").alias("flag"), F.lower("l_linestatus").alias("status"))
    users = orders.select("o_orderkey", F.col("o_custkey").cast("int").alias("userId"))
    return lines.join(users, F.col("l_orderkey") == F.col("o_orderkey"), "inner").select(
        "userId", "movieId", "rating", "timestamp", "tagged", "flag", "status")


def ratings_of(lines: DataFrame) -> DataFrame:
    return lines.select("userId", "movieId", "rating", *_time_of(lines))


def tags_of(lines: DataFrame) -> DataFrame:
    return lines.filter("tagged").select("userId", "movieId", F.explode(F.array("flag", "status")).alias("tag"), *_time_of(lines))


def dealt_tags_of(lines: DataFrame) -> DataFrame:
    """The tags dealt by (userId, movieId). A tagged line is shuffled as one row, not one a tag."""
    return tags_of(lines.filter("tagged").repartition("userId", "movieId"))


def _time_of(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c == "timestamp"]


def queries_from_movies(movies: DataFrame) -> DataFrame:
    mid, title = F.col("movieId"), F.col("title")
    first_genre = F.lower(F.element_at(F.split(F.col("genres"), "[|]", -1), 1))
    slot = mid % 8
    text = (F.when(slot == 0, F.concat(F.lit(QUERY_PREFIX_WATCHED), title))
            .when(slot == 1, title)
            .when(slot == 2, F.concat(F.lit(QUERY_SUGGEST[0]), first_genre, F.lit(QUERY_SUGGEST[1])))
            .when(slot == 3, F.concat(title, F.lit(QUERY_SUFFIX_EXTRA)))
            .when(slot == 4, F.lit(QUERY_NO_SIGNAL))
            .when(slot == 5, F.lit(QUERY_BLANK))
            .when(slot == 6, F.lit(None).cast("string"))
            .otherwise(F.lit(QUERY_SUBSTRING_TRAP)))
    return movies.select(mid.cast("long").alias("query_id"), text.alias("text"))


def edge_movies(movies: DataFrame) -> DataFrame:
    """The catalog with rows that requests stumble over: null genres (such a
    seed is an error) and genres of one movie alone (nothing else has one of
    them, so retrieval widens to the whole catalog)."""
    mid = F.col("movieId")
    genres = (F.when(mid % EDGE_NO_GENRES == 0, F.lit(None).cast("string"))
              .when(mid % EDGE_OWN_GENRE == 0, F.concat(F.lit(EDGE_GENRE_PREFIX), mid.cast("string")))
              .otherwise(F.col("genres")))
    return movies.withColumn("genres", genres)


def als_standin(ratings: DataFrame, top: int = ALS_STANDIN_TOP) -> DataFrame:
    """Deterministic stand-in for ALS output: a user's best-rated items.

    ALS_score = avg(rating) per (user, item); top ``top`` per user by score
    desc, movieId asc. Ratings are dealt once, by user: that serves the averages
    and the window alike.
    """
    per_pair = ratings.select("userId", "movieId", "rating").repartition("userId").groupBy("userId", "movieId").agg(
        F.avg(F.col("rating").cast("double")).alias("ALS_score"))
    w = Window.partitionBy("userId").orderBy(F.col("ALS_score").desc(), F.col("movieId").asc())
    return (per_pair.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= top).drop("_rn"))


@dataclass
class DriverTables:
    """Lazily derived tables over one scale-factor folder.

    Tables read several times by a job (ratings, hybrid, candidates)
    are written once as Parquet below the session's shared checkpoint folder
    and read back: later reads prune columns and push filters into the scan,
    run one task per file, and a lost executor never recomputes the chain
    (the reference persists the same tables as Parquet). ``materialize=False``
    keeps everything as one lazy plan.
    """

    spark: SparkSession
    sf_dir: str
    materialize: bool = True
    _cache: dict = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    def _memo(self, key, build, persist: bool = False):
        if key not in self._cache:
            df = build()
            if persist and self.materialize:
                from marquee.session import shared_dir, short_shuffles
                path = shared_dir(self.spark, key)
                with short_shuffles(self.spark):
                    df.write.mode("overwrite").parquet(path)
                df = self.spark.read.parquet(path)
            self._cache[key] = df
        return self._cache[key]

    @property
    def movies(self) -> DataFrame:
        # The table is small on disk, so a scan of it would be few tasks; texts
        # and titles are made from it in as many as there are cores.
        cores = self.spark.sparkContext.defaultParallelism
        return self._memo("movies", lambda: movies_from_part(self.raw("part")).repartition(cores), persist=True)

    @property
    def rated_lines(self) -> DataFrame:
        return self._memo("rated_lines", lambda: rated_lines(self.raw("lineitem"), self.raw("orders")), persist=True)

    @property
    def untimed_lines(self) -> DataFrame:
        """The rated lines without their times, which no derived table needs; of
        the written ones with times if those are there."""
        if "rated_lines" in self._cache:
            return self.rated_lines
        return self._memo("untimed_lines", lambda: rated_lines(self.raw("lineitem"), self.raw("orders")).drop("timestamp"), persist=True)

    @property
    def ratings(self) -> DataFrame:
        return self._memo("ratings", lambda: ratings_of(self.rated_lines))

    @property
    def tags(self) -> DataFrame:
        return self._memo("tags", lambda: tags_of(self.rated_lines))

    @property
    def queries(self) -> DataFrame:
        return self._memo("queries", lambda: queries_from_movies(self.movies))

    @property
    def als_candidates(self) -> DataFrame:
        return self._memo("als", lambda: als_standin(ratings_of(self.untimed_lines)), persist=True)

    def _hybrid_over(self, movies: DataFrame) -> DataFrame:
        from marquee.operators.hybrid import build_hybrid
        lines = self.untimed_lines
        return build_hybrid(ratings_of(lines), movies, dealt_tags_of(lines), dealt_tags=True)

    @property
    def hybrid(self) -> DataFrame:
        return self._memo("hybrid", lambda: self._hybrid_over(self.movies), persist=True)

    @property
    def als_model(self):
        """ALS fitted once per session on the hybrid rows; its factors are two
        tables below the shared checkpoint folder."""
        from marquee.operators.als import fit_als
        return self._memo("als_model", lambda: fit_als(self.hybrid))

    @property
    def item_scores(self) -> DataFrame:
        """Per (movieId, genres): ranking aggregates and both mode scores.
        Request-independent, so every batch of requests reads it."""
        from marquee.operators.retrieve import item_scores
        return self._memo("item_scores", lambda: item_scores(self.hybrid, self.als_candidates), persist=True)

    @property
    def edge_movies(self) -> DataFrame:
        return self._memo("edge_movies", lambda: edge_movies(self.movies))

    @property
    def edge_hybrid(self) -> DataFrame:
        """The hybrid table over the catalog of edge cases."""
        return self._memo("edge_hybrid", lambda: self._hybrid_over(self.edge_movies), persist=True)

    @property
    def edge_item_scores(self) -> DataFrame:
        from marquee.operators.retrieve import item_scores
        return self._memo("edge_item_scores", lambda: item_scores(self.edge_hybrid, self.als_candidates), persist=True)

    @property
    def ranker_features(self) -> DataFrame:
        """At most 20 feature rows per user, equal to the top rows of the
        ranking table but computed without its fan-out; read by every
        ranker key."""
        from marquee.operators.features import ranker_features_from_parts
        return self._memo("ranker_features",
                          lambda: ranker_features_from_parts(self.als_candidates, self.hybrid), persist=True)

    @property
    def crossfit_candidates(self) -> DataFrame:
        """ALS candidates, each scored by a model that did not see its rating."""
        from marquee.operators.crossfit import out_of_fold_candidates
        return self._memo("crossfit_candidates", lambda: out_of_fold_candidates(self.hybrid), persist=True)

    @property
    def crossfit_features(self) -> DataFrame:
        """Feature rows of the ranker without any trace of their own label."""
        from marquee.operators.crossfit import crossfit_features
        return self._memo("crossfit_features",
                          lambda: crossfit_features(self.crossfit_candidates, self.hybrid), persist=True)

    @property
    def ranker_model(self):
        """The pairwise ranker with all its rounds, trained once per session
        on the cross-fitted features."""
        from marquee.operators.pairwise import train_pairwise
        return self._memo("ranker_model", lambda: train_pairwise(self.crossfit_features, track_accuracy=True))

    @property
    def ranking(self) -> DataFrame:
        from marquee.operators.hybrid import build_ranking
        # Read once per job: kept lazy (the fan-out is never written here).
        return self._memo("ranking", lambda: build_ranking(self.als_candidates, self.hybrid))


_SESSION_TABLES: dict = {}


def data_version(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files below ``sf_dir``, as its file system
    lists them: a folder whose data changed has another version."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir.rstrip("/"))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(folder, True)
    while listed.hasNext():
        status = listed.next()
        found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def fit_session(spark: SparkSession, n_bytes: int) -> None:
    """Lets partitions follow the input: with a fixed number of them, or with
    splits of 128 MB of Parquet, the rows that a task sorts or hashes grow with
    the tables until it spills. Adaptive execution merges what is too small, and
    joins by a hash table, unsorted, where no partition of a side is larger than a
    task gets; smaller splits and more partitions that the session asks for are kept."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.execution.arrow.maxBytesPerBatch"):
        if as_bytes(spark.conf.get(name)) > TASK_BYTES:
            spark.conf.set(name, str(TASK_BYTES))
    hashed = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if as_bytes(spark.conf.get(hashed)) < TASK_BYTES:
        spark.conf.set(hashed, str(TASK_BYTES))
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(initial, None) or 0))
    if n_bytes // PARTITION_BYTES > own:
        spark.conf.set(initial, str(n_bytes // PARTITION_BYTES))


def driver_tables(spark: SparkSession, sf_dir: str, materialize: bool = True,
                  reuse: bool = True) -> DriverTables:
    """Derived tables of ``sf_dir``. With ``reuse`` one instance serves every
    job of the session, so the persisted tables (like the reference's
    offline Parquet tables) are built once, by the first job needing them, and
    anew when the files of the folder have changed."""
    if not (reuse and materialize):
        return DriverTables(spark, sf_dir, materialize)
    key, version = (spark.sparkContext.applicationId, sf_dir.rstrip("/")), data_version(spark, sf_dir)
    fit_session(spark, sum(size for _, size, _ in version))
    if key not in _SESSION_TABLES or _SESSION_TABLES[key][0] != version:
        _SESSION_TABLES[key] = version, DriverTables(spark, sf_dir, materialize)
    return _SESSION_TABLES[key][1]
