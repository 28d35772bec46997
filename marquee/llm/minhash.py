"""MinHash near-duplicate detection: one-permutation hashing, banded buckets,
star-shaped candidate edges, links confirmed on the full sets.

A document is the set of its distinct ``SHINGLE``-word shingles. One hash
deals the shingles into bins, a second one leaves the least of each bin. An
empty bin borrows from the first non-empty bin of its own random sequence of
bins (optimal densification), so every bin agrees between two sets with a
chance equal to their Jaccard similarity. ``rows`` bins in a row are a band,
the content of a band names a bucket.

Each bucket makes a star with its least member as centre, so candidate edges
grow with the members, not with their pairs. Every member tries the centre that
it shares most buckets with, then the other centres outside its component; what
is confirmed becomes a component. Two members of a bucket that belong to
different components may not have been compared yet.
Such mixed buckets are handled exactly: where at most ``FEW`` members lie
outside the most frequent component, these are compared with all members of
other components. Documents of buckets that are more mixed (a passage or
template that makes many different documents
half alike) get a second, sharper signature of longer bands, whose buckets part
them; the same steps follow, with a limit that is raised until no bucket is
mixed. So every pair that shares a bucket of its last signature is compared or
lies in one component.

Bands are dense: a pair at the threshold 0.8 is missed by all bands with a
chance of about 5e-7 (6 rows, 48 bands), above it less. Candidates are dropped
unread only if their sizes or parity sketches exclude the similarity (sketches
never differ in more bits than the sets differ in members), or if less than
0.68 of their bins agree (five standard deviations below 0.8). ``rows`` should
grow with the logarithm of the corpus.

Scale: copies count once (a text is known by its 64-bit hash). Buckets are
aggregated to their least and greatest member, which combines before the
shuffle; buckets of one text end there, the rest are joined back, so a hot
bucket is split like any join. Only texts that are part of a candidate pair are
shuffled: their keys are broadcast up to ``BROADCAST_KEYS`` (counted, 8 bytes
each), beyond that joined by shuffle. Components are found on the links alone.

Defined results: null or empty texts and texts without words have an empty
set, are linked with nothing and are kept; a text of fewer words than a shingle
is one shingle; copies and repeated rows are linked; a null id is never the
smallest of a component with other ids; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.frames import map_slices, mix, written
from marquee.llm.jaccard_join import shingle_sets
from marquee.llm.links import merged
from marquee.llm.substring_dedup import key_of

# --- fixed values ------------------------------------------------------------
SHINGLE = 2
LEAST_SHARE = (4, 5)  # links from an intersection of 4/5 of the union
LEVELS = ((6, 48), (12, 192))  # rows and bands of the signatures
FEW = 512
LEAST_AGREEMENT = 0.68  # of the bins, for a pair to be read
SKETCH = 16  # words of 64 bits
BROADCAST_KEYS = 1_000_000
SLICE = 2 << 20  # bytes of text worked on at a time
CELLS = 1 << 19  # bins of documents worked on at a time
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# -----------------------------------------------------------------------------


def similar(a, b, both):
    """Whether sets of a and b members with so many in common are linked."""
    return LEAST_SHARE[1] * both >= LEAST_SHARE[0] * (a + b - both)


def one_permutation(sets: np.ndarray, of: np.ndarray, docs: int, bins: int, seed: int) -> np.ndarray:
    """(docs x bins) least hashes of each bin, densified; documents without
    members have ``EMPTY`` throughout."""
    with np.errstate(over="ignore"):
        dealt = mix(sets ^ mix(np.array([2 * seed + 1], np.uint64)))
        value = mix(dealt + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    table = np.full(docs * bins, EMPTY)
    np.minimum.at(table, of * bins + ((dealt >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64), value)
    table = table.reshape(docs, bins)
    full = table != EMPTY
    doc, cell = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(doc):
        attempt += 1
        probe = (mix(np.arange(bins, dtype=np.uint64) + np.uint64(attempt << 32)) % np.uint64(bins)).astype(np.int64)
        lender = probe[cell]
        hit = full[doc, lender]
        table[doc[hit], cell[hit]] = table[doc[hit], lender[hit]]
        doc, cell = doc[~hit], cell[~hit]
    return table


def bucket_names(table: np.ndarray, rows: int) -> np.ndarray:
    """(docs x bands) 64-bit name of the bucket of each band."""
    docs, bins = table.shape
    parts = table.reshape(docs, bins // rows, rows)
    name = np.broadcast_to(mix(np.arange(bins // rows, dtype=np.uint64) + np.uint64(rows << 32)), parts.shape[:2])
    for r in range(rows):
        name = mix(name ^ parts[:, :, r])
    return name.view(np.int64)


def parity_sketches(sets: np.ndarray, of: np.ndarray, docs: int) -> np.ndarray:
    """(docs x SKETCH) words: the parity of the members that fall on each bit."""
    bits = 64 * SKETCH
    at = of * bits + (mix(sets ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    parity = (np.bincount(at, minlength=docs * bits) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64).reshape(docs, SKETCH)


WORDS = [f"s{i}" for i in range(SKETCH)]


def may_be_similar(one: str, two: str) -> F.Column:
    """Whether sizes and sketches of ``one`` and ``two`` (structs n, s0, ...)
    allow the similarity: then the sets differ in a ninth of their sizes at most."""
    a, b = F.col(f"{one}.n"), F.col(f"{two}.n")
    apart = sum((F.bit_count(F.col(f"{one}.{w}").bitwiseXOR(F.col(f"{two}.{w}"))) for w in WORDS[1:]),
                F.bit_count(F.col(f"{one}.s0").bitwiseXOR(F.col(f"{two}.s0"))))
    near, of = LEAST_SHARE
    return (F.least(a, b) * of >= F.greatest(a, b) * near) & (apart * (of + near) <= (a + b) * (of - near))


BUCKET, TEXT, DOC = range(3)  # kinds of rows


def signature_rows(part: pa.RecordBatch, level: int) -> pa.RecordBatch:
    """Bucket rows (g, k) and one row (k, n, bins, sketch) of each distinct text of a
    slice, and one row (id, k, n) of each document."""
    rows, bands = LEVELS[level]
    bins = rows * bands
    every = part.column("k").to_numpy(zero_copy_only=False)
    keys, first, back = np.unique(every, return_index=True, return_inverse=True)
    sets, of, sizes = shingle_sets(part.column("text").take(pa.array(first)), SHINGLE)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names, owners, seen, sketch = [], [], [], [np.zeros((0, SKETCH), np.int64)]
    step = max(1, CELLS // bins)
    for a in range(0, len(keys), step):
        b = min(a + step, len(keys))
        chosen, owner = sets[starts[a]:starts[b]], of[starts[a]:starts[b]] - a
        table = one_permutation(chosen, owner, b - a, bins, level)
        there = np.flatnonzero(sizes[a:b] > 0)
        names.append(bucket_names(table[there], rows).reshape(-1))
        owners.append(np.repeat(keys[a + there], bands))
        if level == 0:
            seen += [row.tobytes() for row in (table & np.uint64(255)).astype(np.uint8)]
            sketch.append(parity_sketches(chosen, owner, b - a))
    g, k = np.concatenate(names), np.concatenate(owners)
    ids = part.column("id")
    m, d = (len(keys), len(ids)) if level == 0 else (0, 0)
    kind = np.repeat(np.array([BUCKET, TEXT, DOC], np.int8), [len(g), m, d])
    blank = lambda n, kind_: pa.nulls(n, kind_)
    join = pa.concat_arrays
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(kind), "g": join([pa.array(g), blank(m + d, pa.int64())]),
        "k": pa.array(np.concatenate([k, keys[:m], every[:d]])),
        "n": join([blank(len(g), pa.int64()), pa.array(sizes[:m]), pa.array(sizes[back][:d])]),
        "bins": join([blank(len(g), pa.binary()), pa.array(seen, pa.binary()), blank(d, pa.binary())]),
        **{w: join([blank(len(g), pa.int64()), pa.array(np.ascontiguousarray(column)), blank(d, pa.int64())])
           for w, column in zip(WORDS, np.concatenate(sketch).T, strict=True)},
        "id": join([blank(len(g) + m, ids.type), ids.slice(0, d)])})


def signatures(texts: DataFrame, level: int) -> DataFrame:
    schema = T.StructType([T.StructField("kind", T.ByteType()), *[T.StructField(c, T.LongType()) for c in "gkn"],
                           T.StructField("bins", T.BinaryType()),
                           *[T.StructField(w, T.LongType()) for w in WORDS], texts.schema["id"]])
    return written(map_slices(texts.select("id", "k", "text"), lambda part: signature_rows(part, level), schema, max_bytes=SLICE), f"bins{level}")


def shared(rows: DataFrame) -> DataFrame:
    """Rows (g, k, low) of the buckets with more than one text; low is the
    centre of the star."""
    buckets = rows.filter(F.col("kind") == BUCKET).select("g", "k")
    stars = buckets.groupBy("g").agg(F.min("k").alias("low"), F.max("k").alias("high")).filter("low < high")
    return written(buckets.join(stars.select("g", "low"), "g").distinct(), "shared")


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (x, y) whose sizes, sketches and bins allow the similarity."""
    facts = F.struct("n", "bins", *WORDS)
    left = known.select(F.col("k").alias("x"), facts.alias("one"))
    right = known.select(F.col("k").alias("y"), facts.alias("two"))
    rows = pairs.join(left, "x").join(right, "y").filter(may_be_similar("one", "two"))
    least = LEAST_AGREEMENT * LEVELS[0][0] * LEVELS[0][1]

    def near(batches):
        for b in batches:
            if b.num_rows:
                one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("bx", "by"))
                yield b.filter(pa.array((one == two).sum(axis=1) >= least)).select(["x", "y"])

    return rows.select("x", "y", F.col("one.bins").alias("bx"), F.col("two.bins").alias("by")).mapInArrow(near, "x long, y long")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (x, y) whose full sets are similar, as a written table. Only
    texts of pairs are shuffled, copies once."""
    pairs = written(pairs, "candidates")
    needed = written(pairs.select(F.explode(F.array("x", "y")).alias("k")).distinct(), "needed")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed
    texts = docs.join(few, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    one = texts.select(F.col("k").alias("x"), F.col("text").alias("tx"))
    two = texts.select(F.col("k").alias("y"), F.col("text").alias("text"))

    def compare(part: pa.RecordBatch) -> pa.RecordBatch:
        a, oa, na = shingle_sets(part.column("tx"), SHINGLE)
        b, ob, nb = shingle_sets(part.column("text"), SHINGLE)
        # Members of both sets of a row meet as equal neighbours.
        both, of = np.concatenate([a, b]), np.concatenate([oa, ob])
        order = np.lexsort([both, of])
        both, of = both[order], of[order]
        same = np.flatnonzero((both[1:] == both[:-1]) & (of[1:] == of[:-1]))
        common = np.bincount(of[same], minlength=part.num_rows)
        return part.filter(pa.array(similar(na, nb, common) & (na > 0))).select(["x", "y"])

    rows = pairs.join(one, "x").join(two, "y").select("x", "y", "tx", "text")
    return written(map_slices(rows, compare, "x long, y long", max_bytes=SLICE), "confirmed")


def star_edges(buckets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (x, y) from centres to members: for each member the centre that
    it shares most buckets with, and all edges."""
    edges = buckets.filter("k > low").groupBy("low", "k").agg(F.count(F.lit(1)).alias("n"))
    edges = written(edges.select(F.col("low").alias("x"), F.col("k").alias("y"), "n"), "edges")
    best = edges.groupBy("y").agg(F.max(F.struct("n", "x")).alias("best"))
    return best.select(F.col("best.x").alias("x"), "y"), edges.select("x", "y")


def unlinked(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (x, y) of different components."""
    one = labels.select(F.col("k").alias("x"), F.col("label").alias("a"))
    two = labels.select(F.col("k").alias("y"), F.col("label").alias("b"))
    rows = pairs.join(one, "x", "left").join(two, "y", "left")
    return rows.filter(F.coalesce("a", "x") != F.coalesce("b", "y")).select("x", "y")


def labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))


def mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets in which some members lie outside the most frequent component:
    (g, main, others), written."""
    each = labelled(buckets, labels).groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy("g").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most"))
    return written(per.select("g", F.col("most.label").alias("main"), (F.col("all") - F.col("most.n")).alias("others"))
                   .filter("others > 0"), "mixed")


def across(buckets: DataFrame, open_: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of different components within buckets (g, main), of members
    outside the main component with the others, that sizes and sketches allow."""
    facts = known.select("k", F.struct("n", *WORDS).alias("s"))
    members = written(labelled(buckets.join(open_.select("g", "main"), "g"), labels).join(facts, "k")
                      .select("g", "k", "label", "main", "s"), "members")
    few = members.filter("label <> main").select(
        F.col("g").alias("h"), F.col("k").alias("a"), F.col("label").alias("of"), F.col("s").alias("t"))
    pairs = few.join(members, (F.col("h") == F.col("g")) & (F.col("label") != F.col("of")) & may_be_similar("s", "t"))
    return pairs.select(F.least("a", "k").alias("x"), F.greatest("a", "k").alias("y")).distinct()


def links_of(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (k, label) of linked texts and the rows (id, k, n) of all
    documents, from rows (id, k, text)."""
    rows = signatures(texts, 0)
    each = rows.filter(F.col("kind") == TEXT).groupBy("k").agg(
        F.max("n").alias("n"), F.max("bins").alias("bins"), F.min("bins").alias("other"), *[F.max(w).alias(w) for w in WORDS])
    same = F.when(F.col("bins") == F.col("other"), F.col("n")).otherwise(
        F.raise_error(F.lit("two texts share a 64-bit hash; choose another seed")).cast("long"))
    known = written(each.select("k", same.alias("n"), "bins", *WORDS), "known")
    labels, level, few = None, 0, FEW
    buckets = shared(rows)

    def join_all(pairs: DataFrame) -> DataFrame:
        return merged(labels, confirmed(possible(pairs, known), texts))

    while True:
        best, star = star_edges(buckets)
        labels = join_all(best if labels is None else unlinked(best, labels))
        labels = join_all(unlinked(star, labels).join(best, ["x", "y"], "left_anti"))
        while True:
            open_ = mixed(buckets, labels)
            counts = {r["more"]: r["n"] for r in open_.groupBy((F.col("others") > few).alias("more")).agg(
                F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
            if counts.get(False):
                labels = join_all(across(buckets, open_.filter(F.col("others") <= few), labels, known))
            if not counts.get(True):
                return labels, rows.filter(F.col("kind") == DOC).select("id", "k", "n")
            buckets = buckets.join(open_.filter(F.col("others") > few).select("g"), "g", "left_semi")
            if level == 0:
                break
            few *= 4
        # Too mixed: the documents of these buckets get longer bands.
        level = 1
        source = texts.join(buckets.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
        buckets = shared(signatures(source.select(F.lit(None).cast(texts.schema["id"].dataType).alias("id"), "k", "text"), 1))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (smallest id reachable), kept
    and k, the hash of its text."""
    texts = docs.select(F.col(id_col).alias("id"), key_of(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labels, rows = links_of(texts)
    rows = rows.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    least = rows.filter("n > 0").groupBy("label").agg(F.min("id").alias("least"))
    out = rows.join(least, "label", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), "k")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(t) AS t FROM (
    SELECT doc_id, array_to_string(ws[s : s + 1], ' ') AS t
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS s FROM w WHERE len(ws) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
sized AS MATERIALIZED (SELECT sh.doc_id, t, n FROM sh JOIN n USING (doc_id)),
link AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM sized a JOIN sized b ON a.t = b.t AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
