"""Token-id files: adaptive context mixing and a range coder, block by block.

Texts are encoded with a public byte-level tokenizer, an end id is appended to
each, and the ids are stored in ascending order of the document ids. A shard
holds consecutive documents: their ids and counts, and the token ids in blocks
of ``BLOCK``. Each block starts from a fresh model and carries its size and a
checksum of its ids, so blocks are decoded by themselves and damage is found.

The model of a block predicts the next id at order 2 and 1 (the last id seen
after the same two ids, or the same one, with a confidence) and at order 0
(adaptive counts of the id's high and low byte). Bayesian weights mix the
three; the mixture drives a carry-less range coder. Blocks are independent, so
all blocks of a task advance side by side, one id at a time, in arrays.

Scale: texts are shuffled once, by ranges of the id. A task keeps at most
``TASK_IDS`` ids at a time. Shards are rows of a table in the shared folder,
written by Spark's committer; only the token total of each partition passes
the driver, to number the documents' starts.

Defined results: a null text counts as empty (just the end id); null ids come
first; rows with the same id are ordered by text and all kept; an empty table
gives an empty result; extra columns are not read. Vocabularies of more than
65,536 ids are refused.
"""

from __future__ import annotations

import re
import struct
import sys
import types
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.frames import slices, written

# --- fixed values ------------------------------------------------------------
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
BLOCK = 2048
SHARD_IDS = 1 << 18
TASK_IDS = 1 << 23
HEADER = "<III"  # ids, payload bytes, crc32 of the ids
FLAG, BYTE = 12, 10  # bits of a probability: which order, and each byte at order 0
TOTAL = np.uint64(FLAG + 2 * BYTE)
MASK, TOP, BOTTOM = np.uint64((1 << 48) - 1), np.uint64(1 << 32), np.uint64(1 << 32)
SHARE = 3900.0  # of 2**FLAG that predictions may take at most
SLOTS2, SLOTS1 = 1024, 512
CACHE = 500_000
# -----------------------------------------------------------------------------
CUT = "\u0001"
#: A space before white space: there a text is not cut.
SPACE_SPACE = " [\\t-\\r \\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
W = np.uint64(16)


class Mixer:
    """Predictions of many blocks at once; row i belongs to block i."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        # Last id seen after a context, and how sure (low 4 bits); -1: none.
        self.seen = [np.full((lanes, SLOTS1), -1, np.int32), np.full((lanes, SLOTS2), -1, np.int32)]
        # Chance that a prediction of some confidence is right.
        self.right = [np.tile(((np.arange(16) + 1.0) / 18).astype(np.float32), (lanes, 1)) for _ in range(2)]
        self.w = np.full((3, lanes), 1 / 3)
        # Order 0: counts of high and low bytes. Ids are ordered by frequency.
        self.counts = [np.tile((4096 // (np.arange(256) + 8)).astype(np.int32) + 1, (lanes, 1)),
                       np.ones((lanes, 256), np.int32)]
        self.starts = [np.zeros((lanes, 257), np.int32) for _ in range(2)]
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.step = 0

    def refresh(self, m: int) -> None:
        for counts, starts in zip(self.counts, self.starts, strict=True):
            c = counts[:m]
            freq = 1 + c * np.int64((1 << BYTE) - 256) // c.sum(axis=1, dtype=np.int64)[:, None]
            starts[:m, 1:] = np.cumsum(freq, axis=1)
            starts[:m, 256] = 1 << BYTE

    def predict(self, m: int) -> tuple[np.ndarray, ...]:
        """For the first m blocks: the ids predicted at order 2 and 1 and
        their shares of 2**FLAG; the rest is for order 0."""
        if self.step & (self.step - 1) == 0 or self.step % 64 == 0:
            self.refresh(m)
        lane, mixed = self.lane[:m], self.last[:m] * 40503
        self.slot = ((mixed >> 3) % SLOTS1, (mixed + self.before[:m] * 30011 >> 3) % SLOTS2)
        self.found = [t[lane, s] for t, s in zip(self.seen, self.slot, strict=True)]
        self.c = [x >> 4 for x in self.found]
        self.sure = [x & 15 for x in self.found]
        self.e = [np.where(c >= 0, r[lane, k], 0.0) for c, r, k in zip(self.c, self.right, self.sure, strict=True)]
        one, two = SHARE * self.w[1, :m] * self.e[0], SHARE * self.w[2, :m] * self.e[1]
        same = self.c[0] == self.c[1]
        share2 = np.where(same, one + two, two).astype(np.int64)
        share1 = np.where(same, 0.0, one).astype(np.int64)
        return self.c[1], self.c[0], share2, share1

    def update(self, m: int, ids: np.ndarray) -> None:
        lane = self.lane[:m]
        hits = [c == ids for c in self.c]
        missed = ~(hits[0] | hits[1])
        # Weights: how likely each order held the id to be.
        base = np.where(missed, 1.0, 1 / 256)
        new = self.w[:, :m]
        new[0] *= base
        for i, (hit, e) in enumerate(zip(hits, self.e, strict=True)):
            new[i + 1] *= np.where(hit, e, (1 - e) * base)
        new += 1e-4 * base
        new /= new.sum(axis=0)
        fresh = (ids << 4).astype(np.int32)
        for hit, table, slot, found, right, k in zip(
                hits, self.seen, self.slot, self.found, self.right, self.sure, strict=True):
            p = right[lane, k]
            right[lane, k] = p + (hit - p) * np.float32(0.04)
            kept = found - (k - (k >> 1))
            table[lane, slot] = np.where(hit, found + (k < 15), np.where((k > 0) & (found >= 0), kept, fresh))
        # Order 0 learns only what it had to code.
        other = np.flatnonzero(missed)
        high, low = np.divmod(ids[other], 256)
        self.counts[0][other, high] += 32
        self.counts[1][other, low] += 32
        self.before[:m], self.last[:m] = self.last[:m], ids
        self.step += 1


def lanes_of(sizes: np.ndarray) -> np.ndarray:
    """Blocks from longest to shortest, so that those still running are a prefix."""
    return np.argsort(-sizes, kind="stable")


def settled(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Blocks whose range [x, x + y) must give off its top 16 bits."""
    return np.flatnonzero(((x ^ (x + y)) < TOP) | (y < BOTTOM))


def shift(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gives off the top 16 bits of ``x`` at ``at``; a range that became too
    small without agreeing on them ends at the next boundary."""
    p, q = x[at], y[at]
    q = np.where((p ^ (p + q)) < TOP, q, (~p + np.uint64(1)) & (BOTTOM - np.uint64(1)))
    x[at], y[at] = (p << W) & MASK, q << W
    return (p >> np.uint64(32)).astype(np.uint16)


def encode_blocks(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Payloads of blocks that lie in ``ids`` at ``starts``."""
    order = lanes_of(sizes)
    begin, size, n = starts[order], sizes[order], len(sizes)
    if not n:
        return []
    model, low, span = Mixer(n), np.zeros(n, np.uint64), np.full(n, MASK)
    out, fill = np.zeros((n, 3 * int(size[0]) + 8), np.uint16), np.zeros(n, np.int64)
    for t in range(int(size[0])):
        m = int(np.searchsorted(-size, -t, side="left"))
        x = ids[begin[:m] + t].astype(np.int64)
        c2, c1, share2, share1 = model.predict(m)
        # A share may round to nothing; then the id is coded at order 0.
        is2 = (c2 == x) & (share2 > 0)
        is1 = (c1 == x) & (share1 > 0) & ~is2
        taken = share2 + share1
        start = np.where(is2, 0, np.where(is1, share2, taken)) << 2 * BYTE
        width = np.where(is2, share2, share1) << 2 * BYTE
        rest = np.flatnonzero(~(is2 | is1))
        if len(rest):
            high, low_ = np.divmod(x[rest], 256)
            a, b = model.starts[0][rest, high].astype(np.int64), model.starts[1][rest, low_].astype(np.int64)
            wide = model.starts[0][rest, high + 1] - a
            left = (1 << FLAG) - taken[rest]
            start[rest] += left * ((a << BYTE) + wide * b)
            width[rest] = left * wide * (model.starts[1][rest, low_ + 1] - b)
        r = span[:m] >> TOTAL
        low[:m] += start.astype(np.uint64) * r
        span[:m] = width.astype(np.uint64) * r
        at = settled(low[:m], span[:m])
        while len(at):
            out[at, fill[at]] = shift(low, span, at)
            fill[at] += 1
            at = at[settled(low[at], span[at])]
        model.update(m, x)
    for k in range(3):  # the last 48 bits
        out[model.lane, fill + k] = (low >> np.uint64(32 - 16 * k)).astype(np.uint16)
    payloads = [b""] * n
    for lane, block in enumerate(order.tolist()):
        payloads[block] = out[lane, :fill[lane] + 3].astype(">u2").tobytes()
    return payloads


def decode_blocks(payloads: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The ids of all blocks, one block after the other."""
    n = len(payloads)
    if not n:
        return np.zeros(0, np.int64)
    order = lanes_of(sizes)
    size = sizes[order]
    words = [np.frombuffer(payloads[b], ">u2") for b in order.tolist()]
    data = np.zeros((n, max(len(w) for w in words) + 4), np.uint16)
    for lane, w in enumerate(words):
        data[lane, :len(w)] = w
    model, low, span = Mixer(n), np.zeros(n, np.uint64), np.full(n, MASK)
    code = (data[:, 0].astype(np.uint64) << np.uint64(32)) | (data[:, 1].astype(np.uint64) << W) | data[:, 2]
    read = np.full(n, 3)
    found = np.zeros((n, int(size[0])), np.int32)

    def search(starts: np.ndarray, rest: np.ndarray, v: np.ndarray) -> np.ndarray:
        byte = np.zeros(len(rest), np.int64)
        for bit in (128, 64, 32, 16, 8, 4, 2, 1):
            byte += bit * (starts[rest, byte + bit] <= v)
        return byte

    for t in range(int(size[0])):
        m = int(np.searchsorted(-size, -t, side="left"))
        c2, c1, share2, share1 = model.predict(m)
        r = span[:m] >> TOTAL
        v = np.minimum(((code[:m] - low[:m]) & MASK) // r, np.uint64((1 << int(TOTAL)) - 1)).astype(np.int64)
        flag, taken = v >> 2 * BYTE, share2 + share1
        is2, is1 = flag < share2, (flag >= share2) & (flag < taken)
        x = np.where(is2, c2, c1).astype(np.int64)
        start = np.where(is2, 0, np.where(is1, share2, taken)) << 2 * BYTE
        width = np.where(is2, share2, share1) << 2 * BYTE
        rest = np.flatnonzero(flag >= taken)
        if len(rest):
            left = (1 << FLAG) - taken[rest]
            u = (v[rest] - start[rest]) // left
            high = search(model.starts[0], rest, u >> BYTE)
            a = model.starts[0][rest, high].astype(np.int64)
            wide = model.starts[0][rest, high + 1] - a
            low_ = search(model.starts[1], rest, (u - (a << BYTE)) // wide)
            b = model.starts[1][rest, low_].astype(np.int64)
            start[rest] += left * ((a << BYTE) + wide * b)
            width[rest] = left * wide * (model.starts[1][rest, low_ + 1] - b)
            x[rest] = high << 8 | low_
        low[:m] += start.astype(np.uint64) * r
        span[:m] = width.astype(np.uint64) * r
        at = settled(low[:m], span[:m])
        while len(at):
            shift(low, span, at)
            code[at] = ((code[at] << W) & MASK) | data[at, read[at]]
            read[at] += 1
            at = at[settled(low[at], span[at])]
        found[:m, t] = x
        model.update(m, x)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    inside = np.arange(found.shape[1]) < size[back][:, None]
    return found[back][inside].astype(np.int64)


def block_sizes(total: int) -> np.ndarray:
    full, rest = divmod(total, BLOCK)
    return np.array([BLOCK] * full + [rest] * (rest > 0), np.int64)


def crc(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())


def pack(streams: list[np.ndarray]) -> list[bytes]:
    """One byte string per stream of ids: its blocks, each with a header."""
    ids = np.concatenate(streams) if streams else np.zeros(0, np.int64)
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError("ids beyond 65,535 do not fit this format")
    sizes = [block_sizes(len(s)) for s in streams]
    every = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    starts = np.cumsum(every) - every
    payloads = encode_blocks(ids, starts, every)
    out, at = [], 0
    for own in sizes:
        parts = []
        for n in own.tolist():
            a = int(starts[at])
            parts += [struct.pack(HEADER, n, len(payloads[at]), crc(ids[a:a + n])), payloads[at]]
            at += 1
        out.append(b"".join(parts))
    return out


def unpack(packed: list[bytes]) -> list[np.ndarray]:
    """The streams of ``pack``; raises ValueError where a checksum is wrong."""
    sizes, payloads, checks, per = [], [], [], []
    for data in packed:
        at, before = 0, len(sizes)
        while at < len(data):
            n, length, check = struct.unpack_from(HEADER, data, at)
            at += struct.calcsize(HEADER)
            sizes.append(n)
            checks.append(check)
            payloads.append(data[at:at + length])
            at += length
        per.append(sum(sizes[before:]))
    ids = decode_blocks(payloads, np.array(sizes, np.int64))
    at = 0
    for n, check in zip(sizes, checks, strict=True):
        if crc(ids[at:at + n]) != check:
            raise ValueError("a block of token ids does not match its checksum")
        at += n
    return np.split(ids, np.cumsum(per)[:-1]) if per else []


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the worker process: tasks that run
    in the same worker share it. Callers bound its size."""
    holder = sys.modules.setdefault("marquee_worker_cache", types.ModuleType("marquee_worker_cache"))
    return holder.__dict__.setdefault(name, {})


class ChunkEncoder:
    """The tokenizer, applied once to each distinct chunk of the texts. The
    pre-tokenizer always starts a new piece at a space before a character that
    is no white space, so a text's ids are those of its chunks in a row."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(spec), worker_cache(f"chunks-{crc32(spec.encode())}")

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        odd = pc.or_(pc.match_substring_regex(texts, SPACE_SPACE), pc.match_substring(texts, CUT)).to_pylist()
        split = pc.split_pattern(pc.replace_substring(texts, " ", CUT + " "), CUT)
        if any(odd):
            lists = [re.split(r"(?= \S)", t) if o else s for t, s, o in zip(
                texts.to_pylist(), split.to_pylist(), odd, strict=True)]
            split = pa.array(lists, pa.large_list(pa.large_string()))
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        codes, values = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        fresh = [v for v in values if v not in known]
        for v, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            known[v] = array("i", e.ids).tobytes()
        pieces = [known[v] for v in values]
        sizes = np.fromiter((len(p) for p in pieces), np.int64, len(pieces)) // 4
        ids = np.frombuffer(b"".join(pieces), np.int32)
        begins = np.cumsum(sizes) - sizes
        per = sizes[codes]
        total = np.concatenate([[0], np.cumsum(per)])
        where = np.repeat(begins[codes] - total[:-1], per) + np.arange(total[-1])
        ends = total[offsets - offsets[0]]
        return ids[where], np.diff(ends)


SHARDS = "part int, shard int, first long, n long, doc_ids array<{kind}>, counts array<int>, blocks binary"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
          end_id: int = END_ID) -> DataFrame:
    """Writes the shards and returns the table read back. ``first`` counts
    the ids of the partition before the shard."""
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as file:
        spec = file.read()
    kind = docs.schema[id_col].dataType

    def run(batches):
        import os

        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = ChunkEncoder(spec), TaskContext.get().partitionId()
        id_type = to_arrow_type(kind)
        names, counts, streams, waiting, first, shard = [], [], [], 0, 0, 0

        def flush():
            nonlocal names, counts, streams, waiting, first, shard
            ids, sizes = np.concatenate(streams), np.concatenate(counts)
            ends = np.cumsum(sizes)
            cut = np.flatnonzero(np.diff((ends - sizes) // SHARD_IDS, prepend=-1))
            spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(sizes)], strict=True))
            bounds = [(int(ends[a] - sizes[a]), int(ends[b - 1])) for a, b in spans]
            packed = pack([ids[x:y] for x, y in bounds])
            for (a, b), (x, y), blocks in zip(spans, bounds, packed, strict=True):
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()),
                    pa.array([y - x], pa.int64()), pa.array([names[a:b]], pa.list_(id_type)),
                    pa.array([sizes[a:b].tolist()], pa.list_(pa.int32())), pa.array([blocks], pa.binary()),
                ], ["part", "shard", "first", "n", "doc_ids", "counts", "blocks"])
                first, shard = first + y - x, shard + 1
            names, counts, streams, waiting = [], [], [], 0

        for batch in slices(batches, "text_"):
            ids, sizes = encoder(batch.column("text_"))
            names += batch.column("id_").to_pylist()
            counts.append(sizes + 1)
            streams.append(np.insert(ids, np.cumsum(sizes), end_id))
            waiting += len(streams[-1])
            if waiting >= TASK_IDS:
                yield from flush()
        if names:
            yield from flush()

    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    rows = rows.repartitionByRange("id_").sortWithinPartitions("id_", "text_")
    return written(rows.mapInArrow(run, SHARDS.format(kind=kind.simpleString())), "tokens")


def load(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, with ``with_ids``, the ids."""
    spark = shards.sparkSession
    # One number per partition, as a numbering of rows needs.
    totals = shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, rows = 0, []
    for r in totals:
        rows.append((r["part"], base))
        base += r["n"]
    bases = spark.createDataFrame(rows, "part int, base long")
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def decoded(batch):
        packed, names = batch.column("blocks").to_pylist(), batch.column("doc_ids")
        counts, first = batch.column("counts").to_pylist(), batch.column("first").to_pylist()
        for k, ids in enumerate(unpack(packed)):
            sizes = np.array(counts[k], np.int64)
            ends = np.cumsum(sizes)
            cuts = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
            out = {"part": pa.array([batch.column("part")[k].as_py()] * len(sizes), pa.int32()),
                   "doc_id": names[k].values, "start": pa.array(first[k] + ends - sizes), "n_tokens": pa.array(sizes),
                   "ids_crc32": pa.array([crc(ids[a:b]) for a, b in cuts], pa.int64())}
            if with_ids:
                out["ids"] = pa.array([ids[a:b] for a, b in cuts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    def run(batches):
        for batch in batches:  # as many shards at a time as a task may hold
            n = max(1, TASK_IDS // SHARD_IDS)
            for at in range(0, batch.num_rows, n):
                yield from decoded(batch.slice(at, n))

    docs = shards.select("part", "first", "doc_ids", "counts", "blocks").mapInArrow(
        run, f"part int, doc_id {kind}, start long, n_tokens long, ids_crc32 long{', ids array<int>' * with_ids}")
    # Hinted, as a shuffle of the documents for this join would decode them twice.
    return docs.join(F.broadcast(bases), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")
