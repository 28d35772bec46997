"""SentencePiece encoding and decoding: unigram Viterbi over a double array.

The pieces of a public vocabulary form a double-array trie over characters.
A text's best segmentation has the highest sum of piece log scores; characters
without a piece fall back to their UTF-8 byte pieces. A space is the marker
character, one is put before a text that is not empty, and decoding removes
it again, so decoding gives back every text exactly.

The vocabulary file has merge ranks, not probabilities, so a piece's log score
follows Zipf's law: minus the logarithm of its rank.

No piece crosses a space after a letter, or a line feed (checked when the
vocabulary is read), so a text is cut there and each distinct chunk of a slice
is segmented once, all chunks side by side. One scan each way, no shuffle; the
trie travels with the task (its size follows from the vocabulary).

Defined results: a null text has null ids and decodes to null, an empty text
has no ids; a literal marker character goes through its bytes; repeated rows
give repeated results; null ids are kept; an empty table gives an empty
result; extra columns are not read unless asked for.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.frames import map_slices

# --- fixed values ------------------------------------------------------------
MARKER = "▁"
VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0  # below the lowest piece
# -----------------------------------------------------------------------------
#: Texts of a slice: the arrays over all matching pieces take a hundred times as much.
SLICE_BYTES = 2 << 20
#: Cuts chunks apart while a slice is prepared; texts with it take the slower way.
CUT = "\u0001"


class DoubleArray:
    """Static trie in two arrays: the child of ``node`` by letter c is
    ``base[node] + c`` if ``check`` there names the node."""

    def __init__(self, keys: list[tuple[np.ndarray, int]], alphabet_size: int):
        # Breadth first over sorted keys: a node is a range of keys and a depth.
        keys = sorted(((tuple(int(x) for x in k), v) for k, v in keys))
        size = 8 * alphabet_size + 4 * sum(len(k) for k, _ in keys) + 8192
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        todo, since = [(0, 0, len(keys), 0)], {}
        free = self.check < 0
        while todo:
            node, low, high, depth = todo.pop()
            if low < high and len(keys[low][0]) == depth:
                self.value[node] = keys[low][1]
                low += 1
            groups, at = [], low
            while at < high:
                letter, end = keys[at][0][depth], at
                while end < high and keys[end][0][depth] == letter:
                    end += 1
                groups.append((letter, at, end))
                at = end
            if not groups:
                continue
            letters = np.array([g[0] for g in groups])
            # Nodes of one width look where the last such node found room.
            width = min(len(letters), 16)
            start = self._room(free, since.get(width, 1), letters)
            since[width] = start
            self.base[node] = start
            for letter, a, b in groups:
                child = start + letter
                self.check[child], free[child] = node, False
                todo.append((child, a, b, depth + 1))
        last = int(np.flatnonzero(~free)[-1]) + alphabet_size + 2
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    @staticmethod
    def _room(free: np.ndarray, at: int, letters: np.ndarray, width: int = 2048) -> int:
        """First base at which all letters find a free slot."""
        while True:
            starts = np.flatnonzero(free[at:at + width]) + at - int(letters[0])
            starts = starts[starts >= 1]
            fits = free[starts[:, None] + letters].all(axis=1)
            if fits.any():
                return int(starts[np.argmax(fits)])
            at += width

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of many nodes at once, and which of them exist."""
        to = self.base[nodes] + letters
        to = np.where((letters > 0) & (to < len(self.check)), to, 0)
        return to, (self.check[to] == nodes) & (to > 0)


class Pieces:
    """Vocabulary: pieces, log scores, byte pieces and the trie."""

    def __init__(self, pieces: list[str], log_scores: list[float], byte_ids: list[int], normal: list[bool]):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.scores = np.array(log_scores, float)
        usable = [k for k, ok in enumerate(normal) if ok and pieces[k]]
        for k in usable:
            bare = pieces[k].lstrip(MARKER)
            if MARKER in bare or ("\n" in pieces[k] and len(pieces[k]) > 1):
                raise ValueError(f"piece {k} crosses a chunk: {pieces[k]!r}")
        # Frequent letters get low numbers, so that the array stays dense.
        times = Counter(ord(c) for k in usable for c in pieces[k])
        number = {c: n + 1 for n, c in enumerate(sorted(times, key=lambda c: (-times[c], c)))}
        letters = sorted(number)
        self.alphabet = np.array(letters, np.int64)
        self.numbers = np.array([number[c] for c in letters] + [0], np.int64)
        self.marker = number.get(ord(MARKER), 0)
        self.trie = DoubleArray([(np.array([number[ord(c)] for c in pieces[k]]), k) for k in usable], len(letters))
        self.unknown = float(self.scores[usable].min()) - UNKNOWN_PENALTY
        # What an id stands for, as bytes, one after the other.
        spelled = [b""] * len(pieces)
        for k in usable:
            spelled[k] = pieces[k].replace(MARKER, " ").encode()
        for b, k in enumerate(byte_ids):
            spelled[k] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_ends = np.cumsum([0] + [len(s) for s in spelled]).astype(np.int64)

    def letters(self, points: np.ndarray) -> np.ndarray:
        """Letter numbers of code points; 0: in no piece. A space is the marker."""
        where = np.searchsorted(self.alphabet, points)
        known = where < len(self.alphabet)
        known[known] = self.alphabet[where[known]] == points[known]
        out = np.where(known, self.numbers[where], 0)
        out[points == ord(MARKER)] = 0
        out[points == 32] = self.marker
        return out

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in a row, and where each chunk's begin."""
        lengths = np.fromiter((len(c) for c in chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(points)
        begins = np.cumsum(lengths) - lengths
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(chunks) + 1, np.int64)
        letter = self.letters(points)
        owner = np.repeat(np.arange(len(chunks)), lengths)
        inside = np.arange(n) - begins[owner]
        left = lengths[owner] - inside
        # Every piece that starts at every position: walk all positions at once.
        starts, sizes, ids = [], [], []
        alive, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        single = np.zeros(n, bool)
        while len(alive):
            node, ok = self.trie.step(node, letter[alive + depth])
            alive, node, depth = alive[ok], node[ok], depth + 1
            value = self.trie.value[node]
            hit = value >= 0
            starts.append(alive[hit].astype(np.int32))
            sizes.append(np.full(int(hit.sum()), depth, np.int8))
            ids.append(value[hit])
            if depth == 1:
                single[alive[hit]] = True
            go = left[alive] > depth
            alive, node = alive[go], node[go]
        alone = np.flatnonzero(~single).astype(np.int32)
        start = np.concatenate([*starts, alone])
        size = np.concatenate([*sizes, np.ones(len(alone), np.int8)])
        piece = np.concatenate([*ids, np.full(len(alone), -1, np.int32)])
        del starts, sizes, ids, alive, node
        # Relax in order of the start within the chunk. A chunk has one more
        # point than characters, so chunk k's points begin at begins + k.
        # A round has one start and one size, so no two of its pieces end
        # at the same point.
        key = inside[start] * 64 + size
        order = np.argsort(key)
        key, start, size, piece = key[order], start[order], size[order], piece[order]
        del order
        score = np.where(piece >= 0, self.scores[np.maximum(piece, 0)], self.unknown)
        source = start + owner[start].astype(np.int32)
        target = source + size
        best = np.full(n + len(chunks), -np.inf)
        best[begins + np.arange(len(chunks))] = 0.0
        back = np.zeros(n + len(chunks), np.int64)
        rounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        for a, b in zip(rounds[:-1], rounds[1:], strict=True):
            reach = best[source[a:b]] + score[a:b]
            better = reach > best[target[a:b]]
            at = target[a:b][better]
            best[at], back[at] = reach[better], np.arange(a, b)[better]
        # Walk back from all ends at once.
        chosen = []
        at = (begins + np.arange(len(chunks)) + lengths)[lengths > 0]
        floor = (begins + np.arange(len(chunks)))[lengths > 0]
        while len(at):
            edge = back[at]
            chosen.append(edge)
            at = source[edge]
            go = at > floor
            at, floor = at[go], floor[go]
        edge = np.concatenate(chosen)
        edge = edge[np.argsort(start[edge])]
        # Byte pieces for what has no piece.
        unknown = piece[edge] < 0
        wide = points[start[edge][unknown]]
        count = np.ones(len(edge), np.int64)
        count[unknown] = 1 + (wide >= 0x80) + (wide >= 0x800) + (wide >= 0x10000)
        out = np.repeat(piece[edge], count)
        if unknown.any():
            raw = np.frombuffer(wide.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                                .encode("utf-8", "surrogatepass"), np.uint8)
            out[np.repeat(unknown, count)] = self.byte_ids[raw]
        per = np.bincount(owner[start[edge]], count, len(chunks)).astype(np.int64)
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(per)])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of id sequences that lie in a row and end at ``ends``."""
        size = (self.spelled_ends[1:] - self.spelled_ends[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.spelled_ends[ids] - total[:-1], size) + np.arange(total[-1])
        raw = self.spelled[where].tobytes()
        cuts = total[np.concatenate([[0], ends])]
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=4)
def load(path: str | None = None) -> Pieces:
    """The vocabulary at ``path`` (default: the public 32k one), read on the driver."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    every = range(model.get_piece_size())
    normal = [not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)) for k in every]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces([model.id_to_piece(k) for k in every], [-float(np.log(2.0 - min(model.get_score(k), 0.0))) for k in every],
                  byte_ids, normal)


CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")


def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Chunk numbers of all texts in a row, where each text begins, and the
    distinct chunks. Each text that is not empty gets a space in front."""
    marked = pc.replace_substring_regex(texts, r"^(.|\n)", r" \1", max_replacements=1)
    odd = pc.or_(pc.match_substring(marked, "  "), pc.match_substring(marked, CUT)).to_pylist()
    cut = pc.replace_substring(pc.replace_substring(marked, " ", CUT + " "), "\n", CUT + "\n" + CUT)
    split = pc.split_pattern(cut, CUT)
    if any(odd):
        lists = [CHUNK.findall(m) if o else s for m, s, o in zip(marked.to_pylist(), split.to_pylist(), odd, strict=True)]
        split = pa.array(lists, pa.large_list(pa.large_string()))
    offsets = split.offsets.to_numpy().astype(np.int64)
    flat = split.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], flat.dictionary.to_pylist()


def encode_slice(pieces: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice's texts in a row, and where each text's end."""
    codes, starts, values = chunked(texts)
    ids, begins = pieces.segment(values)
    size = np.diff(begins)[codes]
    total = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(begins[codes] - total[:-1], size) + np.arange(total[-1])
    return ids[where], total[starts[1:]]


def encode(docs: DataFrame, pieces: Pieces | None = None, text_col: str = "text",
           keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_columns`` and ids (array of int) per row."""
    pieces = pieces or load()

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends = encode_slice(pieces, part.column("text_"))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32),
                           mask=np.append(part.column("null_").to_numpy(zero_copy_only=False), False))
        lists = pa.ListArray.from_arrays(offsets, pa.array(ids))
        return pa.RecordBatch.from_pydict({**{f"_{c}": part.column(f"_{c}") for c in keep_columns}, "ids": lists})

    kept = "".join(f"`_{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep_columns)
    picked = docs.select(F.col(text_col).alias("text_"), F.col(text_col).isNull().alias("null_"),
                         *[F.col(c).alias(f"_{c}") for c in keep_columns])
    out = map_slices(picked, judge, f"{kept}ids array<int>", "text_", SLICE_BYTES)
    return out.select(*[F.col(f"_{c}").alias(c) for c in keep_columns], "ids")


def by_length(batch: pa.RecordBatch, ids_col: str, most: int = SLICE_BYTES // 4):
    """Cuts a batch so that each part has about ``most`` ids."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids_col)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def decode(encoded: DataFrame, pieces: Pieces | None = None, ids_col: str = "ids",
           text_col: str = "decoded") -> DataFrame:
    """The rows with one more column: the text of their ids (null for null)."""
    pieces = pieces or load()
    names = encoded.columns

    def run(batches):
        for batch in batches:
            for part in by_length(batch, ids_col):
                lists = part.column(ids_col)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
                texts = pieces.decode(ids, ends.astype(np.int64))
                none = pc.is_null(lists).to_pylist()
                column = pa.array([None if x else t for t, x in zip(texts, none, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*names, text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `{text_col}` string")
