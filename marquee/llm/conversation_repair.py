"""Repair of the structure of conversations by iterative-deepening A*.

A conversation is a list of rows (role, text) ordered by turn. Rows are kept,
given another role, deleted, or rows are inserted, at the least cost, so that
the role initials read ``(s?(ua)+)?``. Among the cheapest edit strings the one
that is least in ASCII order is taken.

Search: a state is (rows read, state of the pattern). A depth-first search
tries the edits in ASCII order (D, I, K, R) under a cost bound and raises the
bound to the least cost that exceeded it; costs that rows cannot avoid are the
lower bound of what remains. States that failed with some budget are
remembered and not searched again with the same or a smaller one. The first
path that ends well under the first bound that allows one is the cheapest
and, as edits are tried in order, the least.

A conversation of more than ``STRETCH`` rows is cut into stretches. Each
stretch is searched for every pair of pattern states before and after it, and
the cheapest chain of stretches is the answer: as a stretch ends with the edit
that reads its last row, no edit string of it is the beginning of another, so
the least chain is made of least stretches. Time is linear in the rows.

Scale: what the search needs of a row is one byte (role initial and fault), so
the first shuffle carries no texts and a task holds one byte for each row of
the conversation it is in. The second shuffle brings the texts behind their
edits and hashes or writes them as a stream: no conversation is held whole,
whatever its length. The search results of equal byte strings are kept, up to
a bound.

Order and defined results: rows of a conversation are ordered by turn (nulls
first), then role, then the hash of the text; equal rows are interchangeable.
Null roles and texts become one space (a blank text; a role whose row must get
another role or go). A role of no characters has no initial: it is treated in
the same way. Null conversation ids are one conversation. A conversation
without rows keeps zeros, an empty edit string and the hash of the empty text.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values ------------------------------------------------------------
WHITE = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3  # costs
#: Pattern states: nothing read, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after the initials s, u, a in each state (None: not allowed).
AFTER = ((SYSTEM, USER, None), (None, USER, None), (None, None, ASSISTANT), (None, USER, None))
#: The only role that may follow in each state, for edits that choose one.
NEXT = ("user", "user", "assistant", "user")
INITIALS = ("s", "u", "a")  # role classes 0 to 2; class 3 is any other
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)  # faults
LEGAL = ((0, 1), (1, 2), (2, 1))  # classes that may be neighbours: su, ua, au
STRETCH = 16
CACHED = 200_000  # remembered searches of a task
DROPPED = 64  # code of a row that only carries its conversation's id
# -----------------------------------------------------------------------------

#: Cost and edits that complete the pattern at the end, by state.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
OUT_OF_REACH = 1 << 60


def least_costs(codes: bytes) -> list[int]:
    """Cost that the rows from each index on cannot avoid."""
    rest = [0]
    for code in reversed(codes):
        cls, fault = code >> 2, code & 3
        if fault in (BLANK, DUPLICATE):
            least = DELETE
        else:
            least = min(DELETE, (TRUNCATED if fault == CUT_OFF else 0) + (REROLE if cls == 3 else 0))
        rest.append(rest[-1] + least)
    return rest[::-1]


def search(codes: bytes, start: int, goal: int | None) -> tuple[int, str]:
    """Cheapest, then least, edits of rows ``codes`` from pattern state
    ``start``. With a ``goal`` the edits end with the last row in that state;
    without, they complete the pattern."""
    n, rest = len(codes), least_costs(codes)
    most = DELETE * n + 3 * INSERT  # what any reachable goal costs at most
    reads_system = start == EMPTY and any(c >> 2 == 0 and c & 3 in (FINE, CUT_OFF) for c in codes)
    if (goal == EMPTY and start != EMPTY) or (goal == SYSTEM and start != SYSTEM and not reads_system):
        return OUT_OF_REACH, ""
    path: list[str] = []

    def visit(i: int, state: int, budget: int) -> bool:
        """Whether rows from ``i`` on can be edited within the budget."""
        nonlocal beyond
        if i == n and (state == goal if goal is not None else END[state][0] == 0):
            return True
        if rest[i] > budget:
            beyond = min(beyond, rest[i] - budget)
            return False
        if failed.get((i, state), -1) >= budget:
            return False
        steps = []
        if i < n:
            cls, fault = codes[i] >> 2, codes[i] & 3
            steps.append(("D", i + 1, state, DELETE))
            steps.append(("I", i, AFTER[state][INITIALS.index(NEXT[state][0])], INSERT))
            if fault in (FINE, CUT_OFF):
                extra = TRUNCATED if fault == CUT_OFF else 0
                if cls < 3 and AFTER[state][cls] is not None:
                    steps.append(("K", i + 1, AFTER[state][cls], extra))
                steps.append(("R", i + 1, AFTER[state][INITIALS.index(NEXT[state][0])], REROLE + extra))
        elif goal is None:
            steps.append(("I", i, AFTER[state][INITIALS.index(NEXT[state][0])], INSERT))
        for edit, j, after, cost in steps:
            if cost > budget:
                beyond = min(beyond, cost - budget)
                continue
            path.append(edit)
            if visit(j, after, budget - cost):
                return True
            path.pop()
        failed[i, state] = budget
        return False

    bound = rest[0]
    while bound <= most:
        failed: dict[tuple[int, int], int] = {}
        beyond = OUT_OF_REACH
        if visit(0, start, bound):
            return bound, "".join(path)
        bound += beyond
    return OUT_OF_REACH, ""


class Solver:
    """Searches with a bounded memory of earlier ones."""

    def __init__(self) -> None:
        self.known: dict = {}

    def found(self, codes: bytes, start: int, goal: int | None) -> tuple[int, str]:
        key = codes, start, goal
        if key not in self.known:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[key] = search(*key)
        return self.known[key]

    def edits(self, codes: bytes) -> tuple[int, str]:
        """Cost and edits of a whole conversation."""
        if len(codes) <= STRETCH:
            return self.found(codes, EMPTY, None)
        parts = [codes[s:s + STRETCH] for s in range(0, len(codes), STRETCH)]
        # Least cost from each state to the end, from the last stretch back.
        ahead = [[c for c, _ in END]]
        for part in reversed(parts):
            ahead.append([min(self.found(part, q, r)[0] + ahead[-1][r] for r in range(4)) for q in range(4)])
        ahead.reverse()
        state, out = EMPTY, []
        for k, part in enumerate(parts):
            ways = ((self.found(part, state, r), r) for r in range(4))
            text, state = min((edits, r) for (cost, edits), r in ways if cost + ahead[k + 1][r] == ahead[k][state])
            out.append(text)
        return ahead[0][EMPTY], "".join(out) + END[state][1]


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text, gone) with the damage of the contract. A
    dropped row stays, marked as gone, so that its conversation does."""
    named = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    hurt = named.withColumn("kind", kind).select(
        "conv", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", "".join(ENDINGS), ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return hurt.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("time", "times")


def coded(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h, seen, code): role class and first fault of each
    row; ``seen`` counts equal rows in their order."""
    h = rows.withColumn("h", F.xxhash64("text"))
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    small = h.select("conv", "turn", "role", "h", "gone", (end == "").alias("blank"),
                     F.substring(end, -1, 1).isin(*ENDINGS).alias("ends"))
    # Equal rows of a conversation meet here, not whole conversations.
    seen = F.row_number().over(Window.partitionBy("conv", "role", "h", "gone").orderBy(F.col("turn").asc_nulls_first()))
    first = F.substring("role", 1, 1)
    cls = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(F.col("blank"), BLANK).when(F.col("seen") > 1, DUPLICATE).when(~F.col("ends"), CUT_OFF).otherwise(FINE)
    code = F.when(F.col("gone"), DROPPED).otherwise(cls * 4 + fault).cast("byte")
    return small.withColumn("seen", seen).select("conv", "turn", "role", "h", "seen", code.alias("code"))


def changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it (nulls equal each other)."""
    if len(column) < 2:
        return np.zeros(max(0, len(column) - 1), bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def judged(rows: DataFrame) -> DataFrame:
    """Per conversation: its measures, the least cost and the edits."""
    conv_type = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", conv_type)] + [
        T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        + [T.StructField("audit", T.StringType())])

    def measure(codes: bytes, solver: Solver) -> tuple:
        faults = np.bincount(np.frombuffer(codes, np.uint8) & 3, minlength=4).tolist()
        illegal = sum((a >> 2, b >> 2) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
        return *faults[1:], illegal, *solver.edits(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, known = Solver(), {}
        now, codes, turns, low, high, open_ = None, bytearray(), 0, None, None, False

        def done():
            key = bytes(codes)
            if key not in known:
                if len(known) >= CACHED:
                    known.clear()
                known[key] = measure(key, solver)
            gaps = high - low + 1 - turns if turns else 0
            return now, gaps, *known[key]

        out = []
        for batch in batches:
            conv, turn = batch.column("conv"), batch.column("turn").cast(pa.int64())
            code = batch.column("code").to_numpy(zero_copy_only=False).astype(np.uint8)
            starts = np.concatenate([[0], np.flatnonzero(changes(conv)) + 1, [batch.num_rows]]) if batch.num_rows else [0]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                this = conv[int(a)].as_py()
                if not open_ or this != now:
                    if open_:
                        out.append(done())
                    now, codes, turns, low, high, open_ = this, bytearray(), 0, None, None, True
                here = code[a:b] != DROPPED
                codes += code[a:b][here].tobytes()
                part = turn.slice(int(a), int(b - a)).filter(pa.array(here)).drop_null().to_numpy()
                if len(part):
                    turns += int((part[1:] != part[:-1]).sum()) + (turns == 0 or int(part[0]) != high)
                    low = int(part[0]) if low is None else low
                    high = int(part[-1])
            if len(out) >= 4096:
                yield as_batch(out)
                out = []
        if open_:
            out.append(done())
        if out:
            yield as_batch(out)

    arrow = [pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields]

    def as_batch(rows_: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_, strict=True), arrow, strict=True)],
                                          schema=pa.schema(arrow))

    sorted_ = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "h", "seen")
    return sorted_.select("conv", "turn", "code").mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Repair:
    """Applies edits to rows that come one by one."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, EMPTY

    def chosen(self) -> str:
        role = NEXT[self.state]
        self.state = AFTER[self.state][INITIALS.index(role[0])]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self.chosen(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """Rows of the repaired conversation up to this one."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[self.state][INITIALS.index(role[0])]
            yield role, text
        elif edit == "R":
            yield self.chosen(), text


def _streamed(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts and texts of each conversation behind each other: the verdict
    row (audit not null) comes first."""
    texts = rows.filter(~F.col("gone")).select(
        "conv", F.col("turn"), "role", F.xxhash64("text").alias("h"), "text", F.lit(None).cast("string").alias("audit"),
        F.lit(1).alias("behind"))
    first = verdicts.select("conv", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"),
                            F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("text"), "audit", F.lit(0).alias("behind"))
    return (first.unionByName(texts).repartition("conv")
            .sortWithinPartitions("conv", "behind", F.col("turn").asc_nulls_first(), "role", "h")
            .select("conv", "role", "text", "audit"))


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, None) when a conversation begins, then (conv, (role, text)) for
    each of its repaired rows."""
    repair, now = None, None
    for batch in batches:
        for conv, role, text, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "audit")), strict=True):
            if audit is not None:
                if repair is not None:
                    yield from ((now, r) for r in repair.inserted())
                repair, now = Repair(audit), conv
                yield conv, None
            else:
                yield from ((now, r) for r in repair.row(role, text))
    if repair is not None:
        yield from ((now, r) for r in repair.inserted())


def repaired(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, position, role, text)."""
    schema = T.StructType([rows.schema["conv"], T.StructField("position", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    kinds = [_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        out, size, position = [], 0, 0
        for conv, row in _repairs(batches):
            if row is None:
                position = 0
                continue
            out.append((conv, position, *row))
            position, size = position + 1, size + len(row[1])
            if size > 1 << 20 or len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

    return _streamed(rows, verdicts).mapInArrow(run, schema)


def hashed(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the repaired ``role:text`` lines."""
    schema = T.StructType([rows.schema["conv"], T.StructField("repaired_sha256", T.StringType())])
    kind = _arrow_type(schema["conv"].dataType)

    def run(batches):
        out, digest, now, lines = [], None, None, 0
        batch = lambda: pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in out], kind), pa.array([d for _, d in out], pa.string())], schema.names)
        for conv, row in _repairs(batches):
            if row is None:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                    if len(out) >= 4096:
                        yield batch()
                        out = []
                digest, now, lines = hashlib.sha256(), conv, 0
            else:
                digest.update(f"{chr(10) if lines else ''}{row[0]}:{row[1]}".encode())
                lines += 1
        if digest is not None:
            out.append((now, digest.hexdigest()))
        if out:
            yield batch()

    return _streamed(rows, verdicts).mapInArrow(run, schema)


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns for damaged rows (see ``damaged``)."""
    from marquee.llm.frames import written

    verdicts = written(judged(coded(rows)), "verdicts")
    hashes = hashed(rows, verdicts).withColumnRenamed("conv", "c")
    return verdicts.join(hashes, F.col("conv").eqNullSafe(F.col("c"))).select(
        F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _steps() -> str:
    """Every way to read a row: inserted rows before it, then one edit; as
    SQL rows (state, role class, deletable only or not, state after, edits, cost)."""
    out = []
    for state in range(4):
        at, edits, cost = state, "", 0
        for _ in range(3):
            out += [(state, cls, 1, at, edits + "D", cost + DELETE) for cls in range(4)]
            chosen = AFTER[at][INITIALS.index(NEXT[at][0])]
            for cls in range(4):
                if cls < 3 and AFTER[at][cls] is not None:
                    out.append((state, cls, 0, AFTER[at][cls], edits + "K", cost))
                out.append((state, cls, 0, chosen, edits + "R", cost + REROLE))
            at, edits, cost = chosen, edits + "I", cost + INSERT
    return ", ".join(f"({a}, {b}, {c}, {d}, '{e}', {f})" for a, b, c, d, e, f in out)


ORACLE = r"""
WITH RECURSIVE steps(q, cls, any_fault, q2, e, c) AS (VALUES """ + _steps() + r"""),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(key, ''),
            lambda ch: list_transform(range(8), lambda j: (CAST(ascii(ch) AS BIGINT) >> j) & 1)))),
            lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))) % 20 AS kind FROM raw),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS time FROM crc WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
                  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS seen FROM placed),
judged AS (SELECT *, CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS cls,
                  CASE WHEN body = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
                  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || substr(role, 1, 1) AS pair FROM numbered),
convs AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (
  SELECT conv_id, 0 AS i, 0 AS q, '00000000' AS best FROM convs
  UNION ALL
  SELECT d.conv_id, d.i + 1, s.q2, min(printf('%08d', CAST(substr(d.best, 1, 8) AS INTEGER) + s.c
           + CASE WHEN r.fault = 3 AND s.any_fault = 0 THEN 3 ELSE 0 END) || substr(d.best, 9) || s.e)
  FROM dp d JOIN judged r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.rn = d.i + 1
       JOIN steps s ON s.q = d.q AND s.cls = r.cls AND (s.any_fault = 1 OR r.fault IN (0, 3))
  GROUP BY d.conv_id, d.i + 1, s.q2),
sums AS (SELECT conv_id, max(rn) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank,
                count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1),
ends AS (SELECT d.conv_id, min(printf('%08d', CAST(substr(best, 1, 8) AS INTEGER) + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END)
                || substr(best, 9) || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END) AS best
         FROM dp d LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM d.conv_id WHERE d.i = coalesce(s.n, 0) GROUP BY 1),
edits AS (SELECT conv_id, substr(best, 9) AS audit, CAST(substr(best, 1, 8) AS BIGINT) AS cost FROM ends),
chars AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, audit FROM edits WHERE audit <> ''),
marks AS (SELECT conv_id, p, audit[p] AS e, count(*) FILTER (audit[p] <> 'I') OVER w AS rn,
                 count(*) FILTER (audit[p] <> 'D') OVER w AS line FROM chars WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
lines AS (SELECT m.conv_id, m.p, m.e, m.line, r.role, r.text, max(CASE WHEN m.e = 'K' AND r.cls = 0 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY m.conv_id) AS has_system
          FROM marks m LEFT JOIN judged r ON m.e <> 'I' AND r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.rn = m.rn WHERE m.e <> 'D'),
text_ AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (line - has_system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                 || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS t FROM lines GROUP BY 1)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, e.cost, e.audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM edits e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN text_ t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""
