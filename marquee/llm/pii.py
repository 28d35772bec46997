"""Personal data: patterns propose, checksums confirm, context adjusts.

Patterns propose spans; validators (Luhn for cards, mod-97 for bank account
numbers, value ranges) confirm them; words near a span raise or lower its
score. Four base kinds (email, ip, card, phone) follow fixed patterns and are
always kept; the method adds bank accounts (iban), credentials (secret),
national ids and local phone numbers, where their score reaches ``MIN_SCORE``
and no base span overlaps.

One scan, no shuffle; every pattern runs in linear time on any text.

Defined results: a null text counts as empty and has no spans; repeated rows
give repeated results; null ids are kept; an empty table gives an empty
result; extra columns are not read. Positions count code points, the end is
exclusive.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.frames import map_slices

# --- fixed values ------------------------------------------------------------
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "secret", "national_id", "local_phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from all its digits.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CLOUD_KEY = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")
# Of any length; a run is read once, from its first character.
CREDENTIAL = re.compile(r"(?<![\w/+-])[A-Za-z0-9_/+-]{16,}+(?![\w/+])")
NATIONAL_ID = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
# Start score of a proposal, by kind.
START = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.8, "secret": 0.2, "national_id": 0.3,
         "local_phone": 0.3}
CONTEXT = {
    "email": ("mail", "contact"), "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "secret": ("password", "passwd", "token", "secret", "key", "credential"),
    "national_id": ("ssn", "social", "security", "tax"), "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}
AGAINST = ("version", "isbn", "example", "order", "invoice", "section", "commit", "sha")
NEAR = 40  # characters on either side
RAISE, LOWER = 0.4, 0.3
MIN_SCORE = 0.5
# -----------------------------------------------------------------------------

WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of a bank account number: moved, spelled as digits, mod 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Local parts of different @ signs
    share no character, so each @ is looked at once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def byte_parts(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in match.split("."))


def digits_of(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("email", a, b) for a, b in emails(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if byte_parts(m[0])]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def without_spans(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with blanks in place of spans: words inside an address say
    nothing about its neighbours."""
    out, done = [], 0
    for _, a, b in spans:
        out += [text[done:a], " " * (b - max(a, done))]
        done = max(done, b)
    return "".join([*out, text[done:]])


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """``text`` is read around the span, without the base spans."""
    near = {w.lower() for w in WORD.findall(text, max(0, start - NEAR), start)}
    near |= {w.lower() for w in WORD.findall(text, end, end + NEAR)}
    score = START[kind] + RAISE * bool(near & set(CONTEXT[kind])) - LOWER * bool(near & set(AGAINST))
    return round(min(1.0, max(0.0, score)), 3)


def mixed(token: str) -> bool:
    """Looks random: digits and letters that change places often."""
    flips = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    return flips >= 4 and any(c.isalpha() for c in token)


def added_spans(text: str, base: list[tuple[str, int, int]], clear: str) -> list[tuple[str, int, int, float]]:
    proposals = [("iban", *m.span()) for m in IBAN.finditer(text)
                 if 15 <= len(a := m[0].replace(" ", "")) <= 34 and mod97(a)]
    certain = {m.span() for m in CLOUD_KEY.finditer(text)}
    proposals += [("secret", *m.span()) for m in CREDENTIAL.finditer(text) if m.span() in certain or mixed(m[0])]
    proposals += [("national_id", *m.span()) for m in NATIONAL_ID.finditer(text)]
    proposals += [("local_phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    out: list[tuple[str, int, int, float]] = []
    taken = sorted((a, b) for _, a, b in base)
    for kind, a, b in proposals:
        score = 1.0 if (a, b) in certain else context_score(clear, kind, a, b)
        if score >= MIN_SCORE and not any(x < b and a < y for x, y in taken):
            out.append((kind, a, b, score))
            taken.append((a, b))
    return out


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text: kind, start, end, score, whether a base span."""
    base = base_spans(text)
    kinds = BASE_KINDS + ADDED_KINDS
    clear = without_spans(text, base)
    spans = [(k, a, b, context_score(clear, k, a, b), True) for k, a, b in base]
    spans += [(*s, False) for s in added_spans(text, base, clear)]
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0])))


def redacted(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the
    first in order takes what it covers, the rest of the others goes with it."""
    out, done = [], 0
    for kind, a, b, *_ in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind: string, start: int, end: int, score: double, base: boolean>>"
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()),
                  ("base", pa.bool_())])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
           keep_columns: tuple[str, ...] = ()) -> DataFrame:
    """Per document: its spans and, with ``with_text``, the redacted text
    (null stays null). ``keep_columns`` of the input are passed through."""

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text_")
        # Every pattern needs a digit, an @ or a key prefix; most texts have none.
        some = pc.match_substring_regex(texts, "[0-9@]|AKIA|ASIA").to_pylist()
        found = [find_spans(t) if s else [] for t, s in zip(texts.to_pylist(), some, strict=True)] if any(some) else [
            [] for _ in range(part.num_rows)]
        out = {c: part.column(c) for c in ("doc_id_", *[f"_{c}" for c in keep_columns])}
        if with_text:
            out["redacted"] = pa.array([None if null else redacted(t, s) if s else t for t, s, null in zip(
                texts.to_pylist(), found, part.column("null_").to_pylist(), strict=True)], pa.string())
        rows = [[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in x] for x in found]
        return pa.RecordBatch.from_pydict(out | {"spans": pa.array(rows, pa.list_(SPAN))})

    kind = docs.schema[id_col].dataType.simpleString()
    more = "".join(f"`_{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep_columns)
    picked = docs.select(F.col(id_col).alias("doc_id_"), F.col(text_col).alias("text_"),
                         F.col(text_col).isNull().alias("null_"), *[F.col(c).alias(f"_{c}") for c in keep_columns])
    out = map_slices(picked, judge, f"doc_id_ {kind}, {more}{'redacted string, ' * with_text}spans {SPANS}", "text_")
    return out.withColumnRenamed("doc_id_", id_col)


def joined(spans) -> F.Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of detected spans."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.array_remove(F.transform(base, lambda s: s["kind"] == F.lit(k)), F.lit(False)))
              .cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


