"""License scans: TF-IDF cosine to notice templates, then inheritance by path.

Every line of a file, and the whole text of a licence file, is a sparse TF-IDF
vector over words; the nearest template by cosine names its licence if it
reaches ``MIN_COSINE``. Words outside the templates count with the highest
IDF, so prose around a few licence words stays far from all templates. Windows of
consecutive lines, as long as a standard passage (paragraphs of licences, file
headers, openings of licence files, SPDX lines; ``license_passages``), are
compared with the passages in the same way and need ``PASSAGE_COSINE``; of all
matches that reach their threshold the best score counts, the longer passage
among equal ones. Lines and windows
without a key word are skipped; the key words are chosen so that no line
without one can reach the threshold (checked when the templates are weighed).

A file without a licence of its own takes that of the nearest ancestor
directory with a licence file: directories, not files, are expanded to their
ancestors and joined, then files join their directory.

Scale: lines are compared inside the scan; the templates are a fixed small
set. Directories are combined before they are shuffled; a directory or root
with a third of all files is one row on its side of the join, whose other
side Spark can split.

Defined results: null and empty texts have no licence of their own but
inherit; a null path inherits nothing; among equal scores the first template,
among several licence files of a directory the best score and then the
smallest path count; repeated rows give repeated results; empty tables give an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.frames import map_slices, written
from marquee.llm.license_passages import ORDINARY as PASSAGE_ORDINARY
from marquee.llm.license_passages import PASSAGES

# --- fixed values ------------------------------------------------------------
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
)
MIN_COSINE = 0.6
PASSAGE_COSINE = 0.7
#: Words of ordinary prose, the most frequent first; they are the last to become key words.
ORDINARY = ("the", "of", "and", "to", "a", "in", "is", "this", "by", "with", "are", "as", "all", "2", "3", "use",
            "under", "work", "free", "general", "public", "source", "forms", "program", "charge", "version")
LICENCE_FILES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
# -----------------------------------------------------------------------------

TERM = re.compile(r"[a-z0-9.]*[a-z0-9]")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Templates:
    """Weighed templates, and the key words without which no line can match."""

    def __init__(self, templates=TEMPLATES, least: float = MIN_COSINE, ordinary=ORDINARY):
        self.names, self.least = [n for n, _ in templates], least
        counts = [Counter(terms(t)) for _, t in templates]
        seen = Counter(w for c in counts for w in c)
        self.rare = 1 + math.log((1 + len(counts)) / 1)
        self.idf = {w: 1 + math.log((1 + len(counts)) / (1 + n)) for w, n in seen.items()}
        self.vectors = [self.weigh(c) for c in counts]
        self.sizes = [c.total() for c in counts]
        self.squares: dict[str, list[tuple[int, float]]] = {}
        for t, vector in enumerate(self.vectors):
            for w, x in vector.items():
                self.squares.setdefault(w, []).append((t, x * x))
        # Words stay out, ordinary ones first, while even all of them
        # together keep every template's cosine under the threshold.
        plain: set[str] = set()
        for w in sorted(self.idf, key=lambda w: (ordinary.index(w) if w in ordinary else len(ordinary), len(w), w)):
            trial = plain | {w}
            if all(sum(v[x] ** 2 for x in trial if x in v) < least ** 2 for v in self.vectors):
                plain = trial
        self.keys = sorted(set(self.idf) - plain)
        self.pattern = r"(?i)\b(" + "|".join(re.escape(k) for k in self.keys) + r")\b"

    def weigh(self, counts: Counter) -> dict[str, float]:
        weights = {w: n * self.idf.get(w, self.rare) for w, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in weights.values())) or 1.0
        return {w: x / norm for w, x in weights.items()}

    def nearest(self, text: str) -> tuple[float, str | None]:
        """Best cosine and its licence; (0, None) under the threshold."""
        line = self.weigh(Counter(terms(text)))
        scores = [sum(x * line.get(w, 0.0) for w, x in v.items()) for v in self.vectors]
        best = max(range(len(scores)), key=lambda k: scores[k])
        return (round(scores[best], 6), self.names[best]) if scores[best] >= self.least else (0.0, None)

    def reachable(self, words) -> list[int]:
        """Templates that a text of these words may match: a cosine is at most
        the length of the template's part in them."""
        mass: Counter = Counter()
        for w in words:
            for t, x in self.squares.get(w, ()):
                mass[t] += x
        return sorted(t for t, x in mass.items() if x >= self.least ** 2 - 1e-9)

    def passage(self, lines: list[str]) -> tuple[float, str | None, bool]:
        """Best cosine of a template and a window of lines as long as it, to
        the line, and its licence; of equal ones the longest window's. Also
        whether a match starts at the first line."""
        words = [terms(x) for x in lines]
        able = self.reachable({w for line in words for w in line})
        if not able:
            return 0.0, None, False
        keys = set(self.keys)
        keyed = np.concatenate([[0], np.cumsum([not keys.isdisjoint(w) for w in words])])
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        start = np.arange(len(lines))
        windows: dict[tuple[int, int], list[int]] = {}
        for t in able:
            whole = np.searchsorted(ends, ends[:-1] + self.sizes[t], side="right") - 1
            stops = np.concatenate([np.maximum(whole, start + 1), np.minimum(whole + 1, len(lines))])
            both = np.concatenate([start, start])
            some = keyed[stops] > keyed[both]
            for window in set(zip(both[some].tolist(), stops[some].tolist(), strict=True)):
                windows.setdefault(window, []).append(t)
        best, opens = (0.0, 0, None), False
        for (a, b), of in sorted(windows.items()):
            counts = Counter(w for line in words[a:b] for w in line)
            may = set(self.reachable(counts))
            if may.isdisjoint(of):
                continue
            line = self.weigh(counts)
            for t in of:
                score = round(sum(x * line.get(w, 0.0) for w, x in self.vectors[t].items()), 6) if t in may else 0.0
                if score < self.least:
                    continue
                opens |= a == 0
                if (score, counts.total()) > best[:2]:
                    best = (score, counts.total(), self.names[t])
        return best[0], best[2], opens


def scan(files: DataFrame, path_col: str, text_col: str = "text", templates: Templates | None = None,
         keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """path, own (licence named in the file), score and first (whether its
    first line that is not blank names it or opens a passage that does)."""
    known = templates or Templates()
    passages = Templates(PASSAGES, PASSAGE_COSINE, PASSAGE_ORDINARY)

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text_")
        some = pc.match_substring_regex(texts, known.pattern).to_pylist()
        long = pc.match_substring_regex(texts, passages.pattern).to_pylist()
        out = []
        for text, hit, more in zip(texts.to_pylist(), some, long, strict=True):
            best, first = (0.0, None), False
            if hit:
                lines = [x for x in text.split("\n") if x.strip()]
                wanted = pc.match_substring_regex(pa.array(lines, pa.large_string()), known.pattern).to_pylist()
                for k, (line, key) in enumerate(zip(lines, wanted, strict=True)):
                    found = known.nearest(line) if key else (0.0, None)
                    if k == 0:
                        first = found[1] is not None
                    if found[0] > best[0]:
                        best = found
                whole = known.nearest(text) if len(lines) > 1 else (0.0, None)
                best = max(best, whole, key=lambda x: x[0])
            if more:
                lines = [x for x in text.split("\n") if x.strip()]
                *found, opens = passages.passage(lines)
                best, first = max(best, tuple(found), key=lambda x: x[0]), first or opens
            out.append((best[1], best[0], first))
        return pa.RecordBatch.from_pydict({
            **{c: part.column(c) for c in ("path_", *[f"_{c}" for c in keep_columns])},
            "own": pa.array([x[0] for x in out], pa.string()), "score": pa.array([x[1] for x in out], pa.float64()),
            "first": pa.array([x[2] for x in out], pa.bool_())})

    more = "".join(f"`_{c}` {files.schema[c].dataType.simpleString()}, " for c in keep_columns)
    picked = files.select(F.col(path_col).alias("path_"), F.col(text_col).alias("text_"),
                          *[F.col(c).alias(f"_{c}") for c in keep_columns])
    out = map_slices(picked, judge, f"path_ string, {more}own string, score double, first boolean", "text_")
    return out.select(F.col("path_").alias("path"), *[F.col(f"_{c}").alias(c) for c in keep_columns], "own", "score", "first")


def directory(path) -> F.Column:
    """The path up to its last slash; "" for the root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(scanned: DataFrame, licence_file) -> DataFrame:
    """Adds licence and origin (own, inherited or none) to scanned files;
    ``licence_file`` says which rows speak for their directory."""
    # Read three times below, scanned once.
    rows = written(scanned, "licences").withColumn("dir", directory(F.col("path")))
    speak = rows.filter(licence_file & F.col("own").isNotNull() & F.col("path").isNotNull())
    of_dir = speak.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("best"))
    of_dir = of_dir.select(F.col("dir").alias("up"), F.col("best.own").alias("licence"))
    dirs = rows.filter("path IS NOT NULL").select("dir").distinct()
    # a/b/c, a/b, a and the root: the longest that has a licence is nearest.
    names = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/"))
    nearest = (dirs.withColumn("up", F.explode(F.array_distinct(ups))).join(of_dir, "up")
               .groupBy("dir").agg(F.max_by("licence", F.length("up")).alias("inherited")))
    out = rows.join(nearest, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.withColumn("licence", F.coalesce("own", "inherited")).withColumn("origin", origin).drop("dir", "inherited")


def scan_files(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Licences of files; those named LICENSE, COPYING and the like speak for
    their directory."""
    found = scan(files, path_col, text_col)
    return inherit(found, F.col("path").rlike(LICENCE_FILES))
