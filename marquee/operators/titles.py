"""Title lookup: which catalog title does a free-text request name?

Rule (per request): normalise the text; the longest normalised catalog title
that is a substring of it wins (an exact hit is the longest possible one);
among equally long titles the one first in catalog order (least movieId)
wins. Duplicate normalised titles carry the data of their greatest movieId.
A title normalising to "" is contained in every request and is used only when
nothing else matches.

Containment is a theta join; here it is one equi-join of few rows. A filter
(``KeyFilter``, a Bloom filter of the titles' hashes and of those of their first
k characters, at most 64 MB whatever the titles) goes to the tasks. They read
each text once: at every position the k characters (or, for lengths below k that
some title has, the whole substring) are looked up, and only where a title's
beginning may stand are the lengths of the titles tried. What passes is cut from
the text and joined to the titles by equality, so the filter decides nothing by
itself. No row per position is ever made, and what is shuffled grows with the
titles found in the texts. Neither side is broadcast or collected.

Texts are cut, in one pass, into pieces of ``PIECE`` characters; each piece is
followed by as much of the text as the longest title needs. Work grows linearly
with the text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import normalize_title

# What runs in tasks travels by value: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GRAM_LENGTH = 8
PIECE = 256
# Bits of the filter per hash, and at most in all; probes per hash.
FILTER_BITS = 32
MAX_FILTER_BITS = 1 << 29
PROBES = 3
SLICE_CHARS = 1_000_000


def title_lookup(movies: DataFrame) -> DataFrame:
    """One row per normalised title: (key, klen, movieId, genres, first_pos)."""
    keyed = movies.filter(F.col("title").isNotNull()).select(
        normalize_title("title").alias("key"), "movieId", "genres")
    agg = keyed.groupBy("key").agg(
        F.max(F.struct("movieId", "genres")).alias("_last"),
        F.min("movieId").alias("first_pos"),
    )
    return agg.select("key", F.length("key").alias("klen"), F.col("_last.movieId").alias("movieId"),
                      F.col("_last.genres").alias("genres"), "first_pos")


def text_pieces(texts: DataFrame, longest: Column) -> DataFrame:
    """(tid, piece, own, part): consecutive pieces of texts (tid, qn); ``own``
    characters belong to the piece, ``part`` runs on for at least ``longest``
    characters or to the end of the text."""
    cuts = texts.select("tid", F.regexp_extract_all("qn", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("cuts"))
    more = F.ceil(F.coalesce(longest, F.lit(0)) / PIECE).cast("int")
    rows = cuts.select("tid", "cuts", F.posexplode("cuts").alias("piece", "mine"))
    return rows.select("tid", "piece", F.length("mine").alias("own"),
                       F.array_join(F.slice("cuts", F.col("piece") + 1, more + 1), "").alias("part"))


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (and the end)."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum(lengths)])


class Hashes:
    """64-bit hashes of any substrings: differences of polynomial sums, moved to
    the same power by the inverse of the base (odd, so there is one)."""

    def __init__(self, points: np.ndarray):
        powers, self.back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(points), b)]), dtype=np.uint64) for b in (BASE, INVERSE))
        scrambled = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        terms = (scrambled ^ (scrambled >> np.uint64(29))) * powers[:-1]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])

    def of(self, start: np.ndarray, length: int | np.ndarray, salt: int) -> np.ndarray:
        """Hashes of the substrings, whatever stands before them."""
        h = (self.sums[start + length] - self.sums[start]) * self.back[start]
        return mixed(h ^ (np.uint64(salt) + np.asarray(length).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def probe(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th place of a hash in a filter of ``bits`` (a power of two) bits."""
    return (h + np.uint64(i) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


BEGINNING, WHOLE = 1, 2


class KeyFilter:
    """Which substrings may be keys or their first k characters."""

    def __init__(self, words: np.ndarray, lengths: list[int], k: int):
        self.words, self.lengths, self.k = words, lengths, k

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that may be in the filter."""
        left = np.arange(len(h))
        for i in range(PROBES):
            at = probe(h[left], i, 64 * len(self.words))
            left = left[(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return left

    def spots(self, parts: pa.Array, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, length) of the substrings that may be keys and
        start in the first ``own`` characters of their text."""
        points, starts = characters(parts)
        text = np.repeat(np.arange(len(own)), own)
        at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + starts[text]
        room = starts[text + 1] - at
        hashes = Hashes(points)
        found = []
        longer = [n for n in self.lengths if n >= self.k]
        full = np.flatnonzero(room >= self.k) if longer else np.zeros(0, np.int64)
        begins = full[self.may_hold(hashes.of(at[full], self.k, BEGINNING))]
        for n in self.lengths:
            open_ = begins[room[begins] >= n] if n >= self.k else np.flatnonzero(room >= n)
            spot = open_[self.may_hold(hashes.of(at[open_], n, WHOLE))]
            found.append((text[spot], at[spot] - starts[text[spot]], np.full(len(spot), n)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def key_filter(keys: DataFrame, k: int) -> KeyFilter:
    """The filter of the keys (key, klen). Tasks make hashes, Spark unites the
    words of the filter; the driver holds these (at most 64 MB) and the lengths."""
    sizes = {r["klen"]: r["n"] for r in keys.groupBy("klen").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths, need = sorted(sizes), 2 * sum(sizes.values()) * FILTER_BITS
    bits = min(MAX_FILTER_BITS, max(1 << 16, 1 << int(need).bit_length()))

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of(batch, "key"):
                points, starts = characters(part.column("key"))
                if not len(points):
                    continue
                n = np.diff(starts)
                hashes = Hashes(points)
                begins = np.flatnonzero(n >= k)
                both = np.concatenate([hashes.of(starts[:-1], n, WHOLE), hashes.of(starts[begins], k, BEGINNING)])
                at = np.concatenate([probe(both, i, bits) for i in range(PROBES)])
                yield pa.RecordBatch.from_pydict({"word": pa.array((at >> np.uint64(6)).astype(np.int32)),
                                                  "bit": pa.array(np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64))})

    united = keys.select("key").mapInArrow(bits_of, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[united.column("word").to_numpy()] = united.column("bit").to_numpy().view(np.uint64)
    return KeyFilter(words, lengths, k)


def slices_of(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about ``SLICE_CHARS`` characters."""
    ends = np.cumsum(pc.utf8_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def title_pieces(texts: DataFrame, keys: DataFrame, k: int = GRAM_LENGTH) -> DataFrame:
    """(tid, key): the substrings of texts (tid, qn) that may be keys; what is
    compared with the titles afterwards. Tasks leave out most repetitions
    inside a text."""
    known = key_filter(keys, k)
    words, lengths = texts.sparkSession.sparkContext.broadcast(known.words), known.lengths
    pieces = text_pieces(texts, F.lit(max(lengths, default=0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KeyFilter(words.value, lengths, k)
        for batch in batches:
            for part in slices_of(batch, "part"):
                own = part.column("own").to_numpy().astype(np.int64)
                text, at, n = known.spots(part.column("part"), own)
                if not len(text):
                    continue
                parts = part.column("part").to_pylist()
                key = [parts[t][a:a + m] for t, a, m in zip(text.tolist(), at.tolist(), n.tolist(), strict=True)]
                tid = part.column("tid").take(pa.array(text))
                out = pa.table({"tid": tid, "key": pa.array(key, pa.string())})
                yield from out.group_by(["tid", "key"]).aggregate([]).select(["tid", "key"]).combine_chunks().to_batches()

    return pieces.select("tid", "own", "part").mapInArrow(cut, f"tid {texts.schema['tid'].dataType.simpleString()}, key string")


def best_title_per_text(texts: DataFrame, lookup: DataFrame, k: int = GRAM_LENGTH) -> DataFrame:
    """For texts (tid, qn): (tid, movieId, genres, title_key) of the winning
    title, or no row when no non-empty title is contained."""
    keys = lookup.filter(F.col("klen") > 0)
    hits = title_pieces(texts.filter(F.length("qn") > 0), keys.select("key", "klen"), k).join(keys.hint("shuffle_hash"), "key")
    # Highest (length, -first_pos) wins; a partial max runs before the shuffle.
    best = hits.groupBy("tid").agg(F.max(F.struct(
        F.col("klen"), (-F.col("first_pos").cast("long")).alias("neg_pos"),
        F.col("movieId"), F.col("genres"), F.col("key"))).alias("b"))
    return best.select("tid", F.col("b.movieId").alias("movieId"), F.col("b.genres").alias("genres"), F.col("b.key").alias("title_key"))


def attach_titles(requests: DataFrame, movies: DataFrame, text_col: str = "text",
                  k: int = GRAM_LENGTH, lookup: DataFrame | None = None) -> DataFrame:
    """``requests`` plus (movieId, genres, title_key) of the named title, or
    nulls. All request columns are carried through one join on the text
    (no second join on the request id).

    Requests are reduced to distinct texts first, so a text sent by a third
    of all users is normalised and matched once; the per-text winners (one
    row per text) join back by the text's md5, so texts are shuffled once (to
    make them distinct); AQE splits the partitions of hot texts. Null or empty
    texts never match. A ``lookup`` made before (see ``title_lookup``) serves
    many batches.
    """
    text = F.col(text_col)
    valid = text.isNotNull() & (text != "")
    lookup = title_lookup(movies) if lookup is None else lookup
    # The regex work runs after the dedup shuffle.
    raw = requests.filter(valid).select(F.unhex(F.md5(text)).alias("tid"), text.alias("_text")).distinct()
    best = best_title_per_text(raw.select("tid", normalize_title("_text").alias("qn")), lookup, k)
    # The empty key is one row at most: a scalar subquery, no join.
    empty = lookup.filter(F.col("klen") == 0).agg(
        F.max(F.struct("movieId", "genres", F.col("key").alias("title_key"))).alias("e")).scalar()
    base_cols = list(requests.columns)
    named = best.select(F.col("tid").alias("_tid"), F.struct("movieId", "genres", "title_key").alias("_m"))
    joined = requests.withColumn("_own_tid", F.when(valid, F.unhex(F.md5(text)))).join(
        named.hint("merge"), F.col("_own_tid") == F.col("_tid"), "left")
    picked = F.when(valid, F.when(F.col("_m.movieId").isNotNull(), F.col("_m")).otherwise(empty))
    return joined.select(*base_cols, picked.alias("_m")).select(
        *base_cols, F.col("_m.movieId").alias("movieId"), F.col("_m.genres").alias("genres"),
        F.col("_m.title_key").alias("title_key"))


def match_titles(queries: DataFrame, movies: DataFrame, k: int = GRAM_LENGTH) -> DataFrame:
    """(query_id, movieId, genres, title_key) for every request naming a title."""
    return (attach_titles(queries.select("query_id", "text"), movies, "text", k)
            .filter(F.col("movieId").isNotNull()).drop("text"))
