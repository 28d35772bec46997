"""Operators 11 to 13 against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from marquee.llm import conversation_repair, jaccard_join, links, minhash, vector_codes

from .conftest import awkward_rows, make_docs, prose
from .test_exact_operators import SPLIT, as_rows, ascii_lower, brute_components, rows_of


# ---------------------------------------------------------------- operator 11
def brute_bigrams(docs):
    sets = []
    for _, t in docs:
        ws = SPLIT.findall(ascii_lower(t))
        sets.append({tuple(ws[s:s + 2]) for s in range(max(1, len(ws) - 1))} if ws else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for a, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(a)] = min(doc, least.get(find(a), doc))
    for a, (doc, _) in enumerate(docs):
        component = least.get(find(a), doc) if sets[a] else doc
        yield doc, len(sets[a]), component, doc == component


def found(docs):
    return rows_of(minhash.digest(minhash.near_duplicates(docs)))


def test_minhash_awkward_rows(awkward, nothing):
    assert found(awkward) == as_rows(brute_bigrams(awkward_rows()))
    assert minhash.near_duplicates(nothing).count() == 0


def test_minhash_around_the_threshold(spark):
    """Chains of edited copies on both sides of 0.8, sets of 1 to 400 members."""
    rows = []
    for n in (1, 2, 5, 6, 10, 20, 41, 100, 401):
        for c in range(6):
            base = prose(50 * n + c, n, 5000).split()
            for edits in range(1 + n // 12):
                words = list(base)
                for e in range(edits):
                    words[(7 * e + 3) % n] = f"new{e}"
                rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(base[: int(n * 0.81)])))
            rows.append((len(rows), " ".join([*base[: int(n * 0.79)], "end"])))
    assert found(make_docs(spark, rows).repartition(4)) == as_rows(brute_bigrams(rows))


@pytest.mark.parametrize("operator, brute", [(minhash, brute_bigrams), (jaccard_join, brute_components)], ids=["bigrams", "shingles"])
def test_links_are_confirmed_in_every_slice(spark, monkeypatch, operator, brute):
    """Texts beyond the first slice of a batch are read from their own start."""
    monkeypatch.setattr(operator, "SLICE", 2500)
    rows = []
    for c in range(60):
        base = prose(900 + c, 60, 5000).upper().split()
        rows.append((len(rows), " ".join(base)))
        for at in (1, 2, 3, 4):
            rows.append((len(rows), " ".join(w if i % 12 or i // 12 >= at else f"new{c}" for i, w in enumerate(base))))
    got = rows_of(operator.digest(operator.near_duplicates(make_docs(spark, rows).repartition(2))))
    assert got == as_rows(brute(rows))


@pytest.mark.parametrize("few", [1, 16])
def test_minhash_keeps_links_in_mixed_buckets(spark, monkeypatch, few):
    """Many half-alike documents fill the same buckets; each has one near copy
    that only meets it there. ``few`` = 1 sends all through the second level."""
    monkeypatch.setattr(minhash, "FEW", few)
    passage, rows = prose(50, 60, 5000), []
    for i in range(40):
        own = prose(300 + i, 22 + i % 9, 5000)
        rows.append((len(rows), f"{passage} {own}"))
        rows.append((len(rows), f"{passage} {own} tail {i}"))
    rows += [(len(rows) + i, f"{prose(60, 90)} {i}") for i in range(12)]
    want = as_rows(brute_bigrams(rows))
    assert len({r[2] for r in want}) == 41
    assert found(make_docs(spark, rows).repartition(3)) == want


def test_densified_bins_agree_as_often_as_the_sets(spark):
    """Unbiased for sets smaller and larger than the number of bins."""
    rng = np.random.default_rng(5)
    for common, own in ((4, 1), (40, 10), (900, 100)):
        share = []
        for seed in range(60):
            a = rng.integers(0, 1 << 63, common + own, dtype=np.uint64)
            b = np.concatenate([a[:common], rng.integers(0, 1 << 63, own, dtype=np.uint64)])
            of = np.repeat([0, 1], common + own)
            t = minhash.one_permutation(np.concatenate([a, b]), of, 2, 288, seed)
            assert (t != minhash.EMPTY).all()
            share.append((t[0] == t[1]).mean())
        assert abs(np.mean(share) - common / (common + 2 * own)) < 0.03


def test_merged_labels(spark):
    rng = random.Random(3)
    labels, pairs = None, []
    for _ in range(3):
        more = [(rng.randrange(400), rng.randrange(400)) for _ in range(90)]
        more = [(x, y) for x, y in more if x != y]
        pairs += more
        labels = links.merged(labels, spark.createDataFrame(more, "x long, y long"))
    least = {k: k for p in pairs for k in p}
    for _ in range(400):
        for x, y in pairs:
            least[x] = least[y] = min(least[x], least[y])
    assert {r["k"]: r["label"] for r in labels.collect()} == least
    assert labels.count() == len(least)


# ---------------------------------------------------------------- operator 12
def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    if not first:
        return []
    dim = len(first[0][1])
    w = dim // parts
    same = [r for r in kept if len(r[1]) == dim]
    books = [[v[p * w:(p + 1) * w] for _, v, _ in first if len(v) == dim] for p in range(parts)]

    def closest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in same:
                x = v[p * w:(p + 1) * w]
                groups.setdefault(closest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else y for e, y in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    out, total = [], Counter()
    for i, v, lab in kept:
        if len(v) == dim:
            best = [closest(v[p * w:(p + 1) * w], books[p]) for p in range(parts)]
            code, error = "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)
            total[lab] += error
        else:
            code = error = None
        out.append([i, code, error, lab, sha])
    return [(i, c, e, total[lab] if lab in total else None, s) for i, c, e, lab, s in out]


VECTORS = "vec_id long, embedding array<float>, label int, id string, vector int, code string, k int"


def vectors(seed, n, dim, labels=4, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(grid)) if grid else (lambda: float(np.float32(rng.uniform(-1, 1))))
    return [(i * 3, [draw() for _ in range(dim)], rng.choice([None, *range(labels)])) for i in range(n)]


def coded(spark, rows):
    return vector_codes.digest(spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], VECTORS).repartition(3))


@pytest.mark.parametrize("rows", [
    vectors(1, 150, 16),
    vectors(2, 90, 8, grid=(0.0, -0.25, 0.25)),  # many ties and equal vectors
    vectors(3, 5, 24),  # fewer vectors than entries
], ids=["plain", "ties", "few"])
def test_vector_codes(spark, rows):
    assert rows_of(coded(spark, rows)) == as_rows(brute_codes(rows))


def test_vector_codes_awkward_rows(spark):
    rows = vectors(4, 60, 16)
    ok = rows[0][1]
    rows += [rows[5], rows[5], (None, ok, 1), (500, None, 1), (501, [None, *ok[1:]], 1), (502, [math.nan, *ok[1:]], 2),
             (503, [math.inf, *ok[1:]], 2), (504, ok[:8], 3), (505, [], 77), (-5, [-0.0, *ok[1:]], None)]
    assert rows_of(coded(spark, rows)) == as_rows(brute_codes(rows))
    assert coded(spark, []).count() == 0
    assert coded(spark, [(1, None, 2)]).count() == 0


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(1)
    for spread, dim, entries in ((3, 4, 16), (5000, 8, 16), (40, 2, 300)):
        parts, book = (rng.integers(-spread, spread + 1, (n, dim)) for n in (700, entries))
        d = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        index, best = vector_codes.nearest(parts, book)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


# ---------------------------------------------------------------- operator 13
def brute_damage(rows):
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(ch for ch in text if ch not in ".!?")
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield c, t, role, text


def brute_repair(rows):
    """Cheapest, then least edits by Dijkstra's order on (cost, edits)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, best = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, edits, "\n".join(out)
        if (i, state) in best:
            continue
        best.add((i, state))
        role = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 3, edits + "I", i, role[0], (*out, f"{role}:")))
        if i < len(rows):
            r, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, r[:1]) in after:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, after[state, r[:1]], (*out, f"{r}:{text}")))
                heapq.heappush(heap, (cost + more + 3, edits + "R", i + 1, role[0], (*out, f"{role}:{text}")))


def brute_conversations(rows):
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in brute_damage([r for r in rows if r[0] == conv])]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, judged = set(), []
        for _, role, text in mine:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        faults = Counter(f for _, _, f in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, text = brute_repair(judged)
        yield (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"],
               faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


TURNS = "conv_id long, turn long, role string, text string, conv string, h int, code string, audit int"


def repaired(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], TURNS).repartition(3)
    return rows_of(conversation_repair.digest(conversation_repair.damaged(frame)))


def random_conversations(seed, many, longest, roles=("user", "assistant", "system", "tool", "", "User")):
    rng = random.Random(seed)
    for c in range(many):
        role, used = "user", set()
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(roles) if rng.random() < 0.25 else "assistant" if role == "user" else "user"
            text = rng.choice(["Yes.", "No!", "", " \n", "Hm", "So?  ", f"Text {c} {t}.", f"Text {c} {t}"])
            turn = None if rng.random() < 0.05 and None not in used else t * rng.choice([1, 1, 2]) + 1000 * (t > 8)
            if turn not in used:  # the order of different rows of one turn is ours alone
                used.add(turn)
                yield c, turn, role, text


def test_conversation_repair(spark):
    rows = list(random_conversations(1, 150, 9))
    assert repaired(spark, rows) == as_rows(brute_conversations(rows))


def test_conversation_repair_of_long_ones(spark):
    """Longer than a stretch; the cheapest chain of stretches is the whole search's answer."""
    rows = [(c, t, r, x) for c, n in enumerate((15, 16, 17, 33, 120, 400)) for t, (_, _, r, x) in
            zip(range(n), random_conversations(40 + c, 600, 60, ("user", "assistant", "system", "tool")), strict=False)]
    assert repaired(spark, rows) == as_rows(brute_conversations(rows))


def test_conversation_repair_awkward_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (None, 2, "assistant", "Yes."), (7, None, "user", "Q?"),
            (8, 1, "user", None), (9, 1, None, "text."), (10, 1, "user", "long. " * 50_000), (10, 2, "assistant", "ok."),
            (11, 1, "user", "same."), (11, 1, "user", "same."), (11, 1, "user", "same."), (12, -3, "system", "é ß 😀!"), (12, 9, "user", "x ")]
    rows += [(20 + k, 0, "user", "Only one.") for k in range(60)]
    assert repaired(spark, rows) == as_rows(brute_conversations(rows))
    assert any(r[7] == "" and r[0] is not None for r in as_rows(brute_conversations(rows)))
    assert repaired(spark, []) == []


def test_repaired_rows(spark):
    rows = list(random_conversations(5, 40, 30))
    frame = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    verdicts = conversation_repair.judged(conversation_repair.coded(frame))
    out = {}
    for r in conversation_repair.repaired(frame, verdicts).orderBy("conv", "position").collect():
        out.setdefault(r["conv"], []).append(r)
    for lines in out.values():
        assert [r["position"] for r in lines] == list(range(len(lines)))
        roles = "".join(r["role"][0] for r in lines).removeprefix("s")
        assert roles == "ua" * (len(roles) // 2)


def test_search_agrees_with_one_whole_search():
    rng = random.Random(9)
    for _ in range(300):
        codes = bytes(rng.choice([4, 8, 4, 8, 0, 12, 5, 10, 11, 7, 15]) for _ in range(rng.randrange(17, 24)))
        assert conversation_repair.Solver().edits(codes) == conversation_repair.search(codes, 0, None)
