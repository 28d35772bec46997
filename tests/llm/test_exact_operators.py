"""Operators with an exact result, against plain Python on small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa

from marquee.llm import decontaminate, jaccard_join, substring_dedup

from .conftest import awkward_rows, make_docs, prose


def rows_of(df):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def as_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_contamination(docs, items):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, text in items:
        ws = rx.findall(ascii_lower(text))
        w = min(10, len(ws))
        for s in range(len(ws) - w + 1 if ws else 0):
            windows.setdefault(tuple(ws[s:s + w]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        ws, hit, found = rx.findall(ascii_lower(text)), set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                if (t := tuple(ws[s:s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[t] - {None}
        ids = ",".join(sorted(map(str, found)))
        yield doc, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_decontaminate(spark, awkward, nothing):
    docs = awkward_rows()
    words = docs[8][1].split()
    items = [(1, " ".join(words[55:80])), (2, " ".join(words[60:75]).upper() + "!"), (10, "one, two"), (3, None), (None, "x y"),
             (4, ""), (5, "É é"), (1, " ".join(words[55:80])), (6, "nowhere to be found at all")]
    table = spark.createDataFrame([(i, t, "c", 1) for i, t in items], "item_id long, text string, word string, n int")
    got = decontaminate.digest(decontaminate.decontaminate(awkward, table))
    assert rows_of(got) == as_rows(brute_contamination(docs, items))
    assert decontaminate.decontaminate(nothing, table).count() == 0
    none = decontaminate.digest(decontaminate.decontaminate(awkward, table.limit(0)))
    assert rows_of(none) == as_rows(brute_contamination(docs, []))


def test_decontaminate_runs_no_python(awkward, spark):
    items = spark.createDataFrame([(1, prose(2, 20))], "item_id long, text string")
    plan = decontaminate.digest(decontaminate.decontaminate(awkward, items))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_dedup(docs, window):
    seen = Counter()
    lists = [SPLIT.findall(t or "") for _, t in docs]
    for ws in lists:
        seen.update(tuple(ws[s:s + window]) for s in range(len(ws) - window + 1))
    for (doc, _), ws in zip(docs, lists, strict=True):
        gone = set()
        for s in range(len(ws) - window + 1):
            if seen[tuple(ws[s:s + window])] > 1:
                gone |= set(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        yield doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_substring_dedup(awkward, nothing):
    docs = awkward_rows()
    assert rows_of(substring_dedup.digest(awkward)) == as_rows(brute_dedup(docs, 35))
    assert substring_dedup.digest(nothing).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in substring_dedup.dedup(awkward).collect()}
    assert kept[9] == "one two" and kept[1] == ""


def test_substring_dedup_at_the_edges(spark):
    """Passages of 34, 35 and 36 words at all offsets; overlaps; a repeat within one text."""
    rows = []
    for n in (34, 35, 36, 55):
        passage = prose(100 + n, n)
        rows += [(len(rows) + i, f"{prose(1000 * n + i, i)} {passage} {prose(2000 * n + i, 25)}") for i in range(0, 23)]
    rows.append((900, f"{prose(8, 50)} a {prose(8, 50)}"))
    rows.append((901, "a b " * 30))
    docs = make_docs(spark, rows).repartition(5)
    assert rows_of(substring_dedup.digest(docs)) == as_rows(brute_dedup(rows, 35))


def test_cover_reaches_every_offset():
    cover = substring_dedup.COVER
    assert {(a - b) % substring_dedup.PERIOD for a in cover for b in cover} == set(range(substring_dedup.PERIOD))


def brute_components(docs):
    sets = []
    for _, t in docs:
        ws = SPLIT.findall(ascii_lower(t))
        sets.append({tuple(ws[s:s + 5]) for s in range(max(1, len(ws) - 4))} if ws else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    for a, (doc, _) in enumerate(docs):
        same = [docs[b][0] for b in range(len(docs)) if find(b) == find(a) and docs[b][0] is not None]
        yield doc, len(sets[a]), min(same) if same else doc


def test_jaccard_join(awkward, nothing):
    assert rows_of(jaccard_join.digest(jaccard_join.near_duplicates(awkward))) == as_rows(brute_components(awkward_rows()))
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_jaccard_join_near_the_threshold(spark):
    """Chains and stars of edited copies around similarity 3/4, of all sizes."""
    rows = []
    for n in (5, 6, 8, 9, 12, 20, 40, 70, 150, 300):
        base = prose(n, n).split()
        for edits in range(0, 1 + n // 12):
            words = list(base)
            for e in range(edits):
                words[(7 * e + 3) % n] = f"new{e}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base[: int(n * 0.8)])))
        rows.append((len(rows), " ".join(base[: int(n * 0.78)] + ["end"])))
    docs = make_docs(spark, rows).repartition(4)
    assert rows_of(jaccard_join.digest(jaccard_join.near_duplicates(docs))) == as_rows(brute_components(rows))


def test_jaccard_join_with_a_common_passage(spark, monkeypatch):
    """Mixed groups beyond the pairing size: second level and blocks lose no link."""
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    monkeypatch.setattr(jaccard_join, "LOCAL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    passage, rows = prose(50, 70), []
    for i in range(24):
        rows.append((len(rows), f"{passage} {prose(300 + i, 12 + 6 * (i % 8))}"))
        if i % 4 == 0:
            rows.append((len(rows), rows[-1][1] + " tail"))
    rows += [(len(rows) + i, f"{prose(60, 90)} {i}") for i in range(12)]
    docs = make_docs(spark, rows).repartition(3)
    assert rows_of(jaccard_join.digest(jaccard_join.near_duplicates(docs))) == as_rows(brute_components(rows))


def twelve_with_a_passage(clusters):
    """Twelve texts share a passage; the first two are similar, and only by
    signatures that all twelve have."""
    rows = []
    for c in range(clusters):
        passage = prose(3000 + c, 36, 9_000)
        for k, extra in enumerate([2, 8, *range(23, 33)]):
            rows.append((100 * c + k, f"{passage} {prose(5000 + 100 * c + k, extra, 9_000)}"))
    return rows


def test_jaccard_join_pairs_groups_of_one_slice(spark):
    rows = twelve_with_a_passage(8)
    want = as_rows(brute_components(rows))
    assert sum(n for n in Counter(r[2] for r in want).values() if n > 1) == 16
    assert rows_of(jaccard_join.digest(jaccard_join.near_duplicates(make_docs(spark, rows).coalesce(1)))) == want


def test_signature_groups_that_may_be_paired_are_not_cut():
    def groups(texts):
        part = pa.RecordBatch.from_pydict({"k": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.large_string())})
        rows = [r for r in jaccard_join.signature_rows(part, 1).to_pylist() if r["kind"] != jaccard_join.TEXT_ROW]
        weight = Counter()
        for r in rows:
            weight[r["g"]] += r["weight"]
        return rows, weight

    rows, weight = groups([t for _, t in twelve_with_a_passage(1)])
    assert max(weight.values()) == 12 and all(r["real"] is None for r in rows)
    passage = prose(3000, 36, 9_000)
    rows, weight = groups([f"{passage} {prose(7000 + k, 23 + k % 10, 9_000)}" for k in range(jaccard_join.GROUP + 1)])
    cut = {r["real"] for r in rows if r["real"] is not None}
    assert cut and all(weight[g] == jaccard_join.GROUP + 1 for g in cut)
