"""N-gram Jaccard join by PartEnum signatures, exact, with components.

A document is the set of its distinct 5-word shingles. If two sets reach the
similarity 3/4, they differ in at most (a + b) / 7 members. Sets of a size
band share one partition of the shingle domain; the parts that a set has
members in, and their content, are its signatures. With more parts in use
than members can differ, two similar sets agree on a whole part, so they
share a signature. Small bands use single shingles as parts.

Copies count once (a text is known by its 64-bit hash). Sets that share a
signature are not paired with each other: each is compared with the smallest
member of the group (a star), what is similar becomes a component, and only
members of different components in groups of at most ``GROUP`` are paired
after that. Larger groups of several components (a passage in very many
documents) are left out; a set keeps its guarantee as long as its other
signatures outnumber the possible differences. Sets that lose it go to a
second level where every shingle is a signature, and what is left even there
is compared block by block, so no link is lost.

Candidates pass a filter that only drops pairs which cannot be similar (size
ratio; parity sketches, whose distance never exceeds the sets' difference) and
are then verified exactly on their texts.

Scale: signatures are made in the scan; within a slice a signature with more
than ``GROUP`` texts leaves as ``LOCAL`` rows and settled remainders, so no
group in the shuffle exceeds GROUP rows per slice. A group that is cut short
is larger than GROUP, so all its rows, cut or not, count as a large group's;
one that may be paired is never cut. Large groups are otherwise
only reduced to their least member, which combines before it shuffles. Of the
texts only those in a candidate pair are shuffled, copies once; joins on hot
representatives can be split. Key sets are broadcast after they were counted
(``BROADCAST_ROWS``), else joined by shuffle. Components are found on the
links alone; later links only touch the labels that they join.

Defined results: null or empty texts, and texts without words, have an empty
set, are linked with nothing and are their own component; copies of a text
with words are linked; repeated rows are copies; a null id is never the
smallest of a component with other ids; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.frames import Words, map_slices, mix, rolling, written
from marquee.llm.links import merged
from marquee.llm.substring_dedup import key_of

# --- fixed values ------------------------------------------------------------
SHINGLE = 5
BASE = 0x9E3779B97F4A7C15
GROUP = 32  # members of a group that are paired across components
LOCAL = 8
FIRST_BAND = 8  # sizes up to 8, 16, 32, ...
SINGLES_UP_TO = 64  # bands in which every shingle is a part
PARTS = 0.36  # parts per size of the band's largest set
BLOCK = 512
BROADCAST_ROWS = 1_000_000  # keys of 8 or 16 bytes
SLICE = 2 << 20  # bytes of text worked on at a time
# -----------------------------------------------------------------------------


def similar(a, b, both):
    """100 * intersection >= 75 * union, for numbers or arrays."""
    return 4 * both >= 3 * (a + b - both)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in a row, the text of each, and the set sizes."""
    words = Words(pc.ascii_lower(texts))
    hashes = words.hashes()
    owner = words.owners()
    at = np.arange(len(owner)) - words.starts[owner]
    whole = np.flatnonzero(at + size <= words.counts[owner])
    sets, of = rolling(hashes, size, BASE)[whole], owner[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):  # the whole sequence is the one shingle
        extra = [mix(np.array([_chain(hashes[words.starts[d]:words.starts[d + 1]])], np.uint64))[0] for d in short]
        sets, of = np.concatenate([sets, np.array(extra, np.uint64)]), np.concatenate([of, short])
    order = np.lexsort([sets, of])
    sets, of = sets[order], of[order]
    fresh = np.ones(len(sets), bool)
    fresh[1:] = (sets[1:] != sets[:-1]) | (of[1:] != of[:-1])
    sets, of = sets[fresh], of[fresh]
    return sets, of, np.bincount(of, minlength=len(texts)).astype(np.int64)


def _chain(hashes: np.ndarray) -> int:
    total = len(hashes)
    for h in hashes.tolist():
        total = (total * BASE + h) % (1 << 64)
    return total


def band(sizes: np.ndarray) -> np.ndarray:
    """Largest size of the band of each size."""
    return FIRST_BAND << np.ceil(np.log2(np.maximum(sizes, FIRST_BAND) / FIRST_BAND)).astype(np.int64)


def most_differences(sizes: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Members in which a set and a similar one of at most ``upper`` can differ."""
    return (sizes + np.minimum(upper, 4 * sizes // 3)) // 7


def sketches(sets: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity of the members per bit; as many bits as the size, to a power of two."""
    bits = 64 << np.ceil(np.log2(np.maximum(sizes, 64) / 64)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(bits)])
    at = starts[of] + (mix(sets ^ np.uint64(0x5851F42D4C957F2D)) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    parity = np.bincount(at, minlength=int(starts[-1])) & 1
    packed = np.packbits(parity.astype(np.uint8)).tobytes()
    return [packed[a // 8:b // 8] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def parity_distance(a: bytes, b: bytes) -> int:
    """Bits that differ; the longer sketch is folded onto the shorter one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


ROWS = ("g long, k long, kind int, weight int, real long, least long, "
        "n long, slack0 long, slack1 long, sketch binary")
TEXT_ROW = 2  # kind; 0 and 1: signatures of the set's own and of the next band


def signature_rows(part: pa.RecordBatch, level: int) -> pa.RecordBatch:
    """Signatures and one text row of each distinct text of a slice."""
    keys, first = np.unique(part.column("k").to_numpy(zero_copy_only=False), return_index=True)
    sets, of, sizes = shingle_sets(part.column("text").take(pa.array(first)))
    upper = band(sizes)
    slack = [sizes - most_differences(sizes, 4 * sizes // 3)] * 2 if level == 2 else []
    found = []
    for kind, limit in ((0, upper), (1, 2 * upper)) if level == 1 else ((0, upper),):
        takes = sizes > 0 if kind == 0 else 4 * sizes > 3 * upper
        single = (limit <= SINGLES_UP_TO) | (level == 2)
        member = takes[of]
        s, o = sets[member], of[member]
        parts = np.maximum(1, (PARTS * limit).astype(np.int64))
        spread = mix(s ^ np.uint64(0xA0761D6478BD642F))
        part_no = np.where(single[o], 0, (spread % parts[o].astype(np.uint64)).astype(np.int64))
        # A single shingle is a part by itself: order by the shingle.
        order = np.lexsort([np.where(single[o], s, 0), part_no, o])
        s, o, part_no = s[order], o[order], part_no[order]
        new = np.ones(len(s), bool)
        new[1:] = (o[1:] != o[:-1]) | (part_no[1:] != part_no[:-1]) | single[o[1:]]
        begin = np.flatnonzero(new)
        content = np.add.reduceat(mix(s), begin) if len(begin) else np.zeros(0, np.uint64)
        scheme = limit[o[begin]] * (level == 1) + level
        with np.errstate(over="ignore"):
            salt = mix(part_no[begin].astype(np.uint64) * np.uint64(1 << 20) + scheme.astype(np.uint64))
        # 48 bits: whatever meets by chance is compared exactly later.
        g = (mix(content ^ salt) >> np.uint64(16)).astype(np.int64)
        found.append((g, o[begin], np.full(len(g), kind)))
        if level == 1:
            used = np.bincount(o[begin], minlength=len(keys))
            slack.append(np.where(takes, used - most_differences(sizes, limit), np.int64(1 << 40)))
    g, o, kind = (np.concatenate(x) for x in zip(*found, strict=True))
    k = keys[o]
    order = np.lexsort([k, g])
    g, k, kind = g[order], k[order], kind[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.arange(len(g)) - begin[group] if len(g) else np.zeros(0, np.int64)
    count = np.bincount(group, minlength=len(begin)) if len(g) else np.zeros(0, np.int64)
    # Only what is a large group already: its rows are not paired anyway.
    over = (rank >= LOCAL) & (count[group] > GROUP) if len(g) else np.zeros(0, bool)
    own = lambda a, b: -(mix(a.view(np.uint64) ^ mix(b.view(np.uint64))) >> np.uint64(1)).astype(np.int64) - 1
    # The first row of a group that is cut short carries the group's weight.
    weight = np.where(over, 0, 1 + np.bincount(group, over).astype(np.int64)[group] * (rank == 0)) if len(g) else rank
    # Back in the order of the texts: rows of a text that lie together in a
    # shuffle block share its key, which compresses.
    back = np.argsort(k, kind="stable")
    settled = over[back]
    m, n = len(keys), len(g)
    least = k[begin][group] if n else k
    both = lambda a, b, kind=np.int64: pa.array(np.concatenate([a, b]).astype(kind))
    only_cut = lambda x: pa.array(np.concatenate([x[back], np.zeros(m, np.int64)]),
                                  mask=np.concatenate([~settled, np.ones(m, bool)]))
    only_text = lambda x: pa.concat_arrays([pa.nulls(n, x.type), x])
    return pa.RecordBatch.from_pydict({
        "g": both(np.where(over, own(g, k), g)[back], own(keys, keys)), "k": both(k[back], keys),
        "kind": both(kind[back], np.full(m, TEXT_ROW), np.int32), "weight": both(weight[back], np.zeros(m), np.int32),
        "real": only_cut(g), "least": only_cut(least), "n": only_text(pa.array(sizes)),
        "slack0": only_text(pa.array(slack[0].astype(np.int64))), "slack1": only_text(pa.array(slack[1].astype(np.int64))),
        "sketch": only_text(pa.array(sketches(sets, of, sizes), pa.binary()))})


def signatures(texts: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Shared signatures (g, k, kind, least, size) and texts (k, n, slacks, sketch)."""
    rows = map_slices(texts.select("k", "text"), lambda part: signature_rows(part, level), ROWS, max_bytes=SLICE)
    w = Window.partitionBy("g")
    cut, text = F.col("real").isNotNull(), F.col("kind") == TEXT_ROW
    rows = (rows.withColumn("low", F.min("k").over(w)).withColumn("high", F.max("k").over(w))
            .withColumn("size", F.sum("weight").over(w)).filter(text | cut | (F.col("low") < F.col("high"))))
    rows = written(rows.select(
        F.when(~text, F.coalesce("real", "g")).alias("g"), "k", "kind",
        F.when(cut, F.col("least")).when(~text, F.col("low")).alias("least"),
        F.when(cut, F.lit(GROUP + 1)).otherwise(F.col("size")).alias("size"),
        "n", "slack0", "slack1", "sketch"), f"signatures{level}")
    known = rows.filter(text).groupBy("k").agg(
        *[F.max(c).alias(c) for c in ("n", "slack0", "slack1", "sketch")], F.min("sketch").alias("other"))
    checked = F.when(F.col("sketch") == F.col("other"), F.col("n")).otherwise(
        F.raise_error(F.lit("two texts share a 64-bit hash; choose another seed")).cast("long"))
    return (rows.filter(~text).select("g", "k", "kind", "least", "size"),
            written(known.select("k", checked.alias("n"), "slack0", "slack1", "sketch"), f"texts{level}"))


def sized(df: DataFrame) -> DataFrame:
    """``df``, a written table, marked for broadcast if it was counted to be small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (x, y) that size ratio and sketches do not rule out."""
    left = known.select(F.col("k").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    right = known.select(F.col("k").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    rows = pairs.join(left, "x").join(right, "y").filter("4 * least(nx, ny) >= 3 * greatest(nx, ny)")

    def near(batches):
        for b in batches:
            limit = ((b.column("nx").to_numpy() + b.column("ny").to_numpy()) // 7).tolist()
            keep = [parity_distance(s, t) <= m for s, t, m in zip(
                b.column("sx").to_pylist(), b.column("sy").to_pylist(), limit, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["x", "y"])

    return rows.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(near, "x long, y long")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (x, y) whose texts are similar, compared exactly. Only texts that
    are part of a pair are shuffled, copies once."""
    pairs = written(pairs, "pairs")
    needed = written(pairs.select(F.explode(F.array("x", "y")).alias("k")).distinct(), "needed")
    texts = docs.join(sized(needed), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    one = texts.select(F.col("k").alias("x"), F.col("text").alias("tx"))
    two = texts.select(F.col("k").alias("y"), F.col("text").alias("text"))

    def compare(part: pa.RecordBatch) -> pa.RecordBatch:
        a, oa, na = shingle_sets(part.column("tx"))
        b, ob, nb = shingle_sets(part.column("text"))
        # Members of both sets of a row meet as equal neighbours.
        both, of = np.concatenate([a, b]), np.concatenate([oa, ob])
        order = np.lexsort([both, of])
        both, of = both[order], of[order]
        same = np.flatnonzero((both[1:] == both[:-1]) & (of[1:] == of[:-1]))
        common = np.bincount(of[same], minlength=part.num_rows)
        return part.filter(pa.array(similar(na, nb, common) & (na > 0))).select(["x", "y"])

    rows = pairs.join(one, "x").join(two, "y")
    return map_slices(rows.select("x", "y", "tx", "text"), compare, "x long, y long", max_bytes=SLICE)


def labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the labels of k and of its group's least member."""
    low = labels.select(F.col("k").alias("least"), F.col("label").alias("low_label"))
    return (shared.join(labels, "k", "left").join(low, "least", "left")
            .withColumn("label", F.coalesce("label", "k")).withColumn("low_label", F.coalesce("low_label", "least")))


def across(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components within groups of at most GROUP members."""
    rows = labelled(shared.filter(F.col("size") <= GROUP), labels)
    groups = rows.groupBy("g").agg(F.sort_array(F.collect_set(F.struct("label", "k"))).alias("m")).filter(
        F.col("m")[0]["label"] != F.element_at("m", -1)["label"])
    # Many signatures have the same members: look at each list once.
    first = groups.select("m").distinct().select(F.explode("m").alias("p"), "m")
    pairs = first.select(F.col("p.k").alias("x"), F.explode(F.expr("filter(m, q -> q.label > p.label)")).alias("q"))
    return pairs.select(F.least("x", "q.k").alias("x"), F.greatest("x", "q.k").alias("y")).distinct()


def block_pairs(known: DataFrame) -> DataFrame:
    """Possible pairs of different components among few sets (k, n, sketch,
    label), block against block. Each block meets each other once; blocks, not
    pairs, are the rows that are shuffled."""
    rows = known.count()
    blocks = max(1, -(-rows // BLOCK))
    of = F.pmod(F.xxhash64("k"), F.lit(blocks))
    every = known.withColumn("b", of).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = every.withColumn("lo", F.least("b", "o")).withColumn("hi", F.greatest("b", "o"))

    def compare(frame):
        import pandas as pd

        low, high = frame["lo"].iloc[0], frame["hi"].iloc[0]
        left, right = frame[frame["b"] == low], frame[frame["b"] == high]
        out = []
        others = list(zip(right["k"], right["n"], right["sketch"], right["label"], strict=True))
        for x, n, s, a in zip(left["k"], left["n"], left["sketch"], left["label"], strict=True):
            for y, m, t, b in others:
                if a != b and 4 * min(n, m) >= 3 * max(n, m) and parity_distance(s, t) <= (n + m) // 7:
                    out.append((min(x, y), max(x, y)))
        return pd.DataFrame(out, columns=["x", "y"], dtype="int64")

    return every.groupBy("lo", "hi").applyInPandas(compare, "x long, y long").distinct()


def links_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (k, label) and sizes (k, n) of documents (k, text)."""
    level, source, sizes, labels = 1, docs, None, None
    while True:
        shared, known = signatures(source, level)
        sizes = known.select("k", "n") if sizes is None else sizes
        star = shared.filter("k > least").select(F.col("least").alias("x"), F.col("k").alias("y")).distinct()
        labels = merged(labels, written(verified(possible(star, known), docs), "star"))
        # Groups that are one component have nothing left to find.
        more = across(shared, labels).join(star, ["x", "y"], "left_anti")
        labels = merged(labels, written(verified(possible(more, known), docs), "across"))
        # Large groups of several components are not paired: a set that has
        # too many of their signatures loses its guarantee.
        large = labelled(shared.filter(F.col("size") > GROUP), labels)
        mixed = large.filter("label <> low_label").select("g").distinct()
        lost = (large.join(mixed, "g", "left_semi").groupBy("k")
                .agg(F.count(F.when(F.col("kind") == 0, 1)).alias("lost0"),
                     F.count(F.when(F.col("kind") == 1, 1)).alias("lost1")))
        weak = written(known.filter("n > 0").join(lost, "k", "left").filter(
            "coalesce(lost0, 0) >= slack0 OR coalesce(lost1, 0) >= slack1").select("k", "n", "sketch"), "weak")
        if weak.isEmpty():
            return labels, sizes
        if level == 2:
            named = weak.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
            return merged(labels, written(verified(block_pairs(named), docs), "blocks")), sizes
        level, source = 2, docs.join(sized(weak.select("k")), "k", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (smallest id reachable) and k,
    the hash of its text."""
    keyed = docs.select(F.col(id_col).alias("id"), key_of(text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labels, sizes = links_of(keyed.select("k", "text"))
    rows = keyed.select("id", "k").join(sizes, "k").join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    rows = written(rows, "labelled")
    least = rows.filter("n > 0").groupBy("label").agg(F.min("id").alias("least"))
    out = rows.join(least, "label", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), "k")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s : s + 4], ' ') AS t
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
          FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
