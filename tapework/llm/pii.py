"""Personal data by a semi-Markov conditional random field over candidate segments.

Base findings (e-mail, IP, card, phone) follow fixed patterns and always stay. Around every place
that could hold personal data, a window of tokens is decoded as a whole: each segment of up to
``LONGEST`` tokens is scored by features of the entire span (digits, shape, separators, checksum,
words before it), each pair of neighbouring labels by a transition weight, and a dynamic programme
with segments of bounded length chooses boundaries and types together. Entities so found that touch
no base finding are added.

The field is trained here, on windows around base findings of a bounded sample of documents. Base
findings are the true segments; each also appears in written variants that no base pattern matches
(a phone number without its plus, an address with "at" and "dot", dotted digits), and number
windows without a finding are negatives.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tapework.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
#: Labels of segments: 0 is plain text (always one token), the others are ``KINDS``.
LABELS = len(KINDS) + 1
LONGEST = 8
#: Characters of a segment at most; the kinds added by the field are all shorter.
LONGEST_CHARS = 320
#: Tokens of context on either side of a trigger.
CONTEXT = 3
#: Documents (smallest by hash of id and text, among those with a digit or an at sign) to train on.
SAMPLE = 400
#: Windows kept of the sample, and passes over them.
TRAIN_WINDOWS = 500
PASSES = 6
#: Added entities must beat the best parse without them by this much.
MARGIN = 2.0

# The base patterns.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive: a match never begins inside a run of digits, so a long run is read once, not once a digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]")
#: An address in words: "at" in brackets, or "at" with a "dot" a few words later.
_SPELLED = re.compile(r"(?<!\S)(?:[(\[][aA][tT][)\]]|[aA][tT]\s+[A-Za-z0-9-]+\s+[(\[]?[dD][oO][tT][)\]]?)(?!\S)")
_MAIL = re.compile(r"[a-z0-9._%+-]+(@|\s*[(\[]?at[)\]]?\s*)[a-z0-9-]+((\.|\s*[(\[]?dot[)\]]?\s*)[a-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9]{2}")
_WORDS_AT = frozenset(("at", "(at)", "[at]"))
_WORDS_DOT = frozenset(("dot", "(dot)", "[dot]"))
_CUES = frozenset(("phone", "tel", "telephone", "call", "mobile", "fax", "tel.", "tel:", "phone:", "call:"))
_SHOP = frozenset(("card", "visa", "mastercard", "amex", "card:", "payment", "kreditkarte", "carte", "tarjeta"))
_NET = frozenset(("ip", "ip:", "host", "address", "server", "addr", "from"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    """Whether a run of digits is at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from their at signs: the text before one is walked once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            yield m.span()
            end = m.end()
        # Without a match here a later at sign begins its own local part after this one.
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, by start, then kind as listed."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out)


# --- windows of tokens -------------------------------------------------------------------------

def _trigger(token: str) -> bool:
    return "@" in token or _NUMBER.search(token) is not None


def _hits(text: str) -> list[int]:
    """Places that could belong to personal data: two digits, an at sign, an address in words."""
    hits = [m.start() for m in _NUMBER.finditer(text)] if _DIGITS.search(text) else []
    if "@" in text:
        hits += [i for i, c in enumerate(text) if c == "@"]
    if " dot" in text or "at)" in text or "at]" in text or " DOT" in text:
        hits += [m.start() for m in _SPELLED.finditer(text)]
    return sorted(hits)


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans of the windows: triggers with their context; windows that touch are one."""
    hits = _hits(text)
    window: list[tuple[int, int]] = []
    reach = -1
    for hit in hits:
        if hit < reach:
            continue
        # Walk back to the start of CONTEXT tokens before the one that holds the hit.
        start, seen = hit, 0
        floor = window[-1][1] if window else 0
        while start > floor and seen <= CONTEXT:
            start -= 1
            if text[start].isspace() and start + 1 <= hit and not text[start + 1].isspace():
                seen += 1
        tokens = []
        after = 0
        for m in _TOKEN.finditer(text, max(start, floor)):
            tokens.append(m.span())
            after = 0 if m.end() <= hit or _trigger(m[0]) else after + 1
            if after > CONTEXT:
                break
        if not tokens:
            continue
        if window and tokens[0][0] - window[-1][1] <= 1 and tokens[0][0] >= window[-1][1]:
            window += tokens
        else:
            if window:
                yield window
            window = tokens
        reach = window[-1][1]
    if window:
        yield window


# --- features of a whole span ------------------------------------------------------------------

_STRIP = ".,;:!?()[]{}<>\"'|*&%$#"
N_FEATURES = 34


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> np.ndarray | None:
    """Features of tokens i..j (inclusive); None where no entity is possible (no digit, no at)."""
    if tokens[j][1] - tokens[i][0] > LONGEST_CHARS:
        return None
    raw = text[tokens[i][0]:tokens[j][1]]
    span = raw.strip(_STRIP) if raw[:1] != "(" else raw.rstrip(_STRIP)
    low = span.lower()
    parts = low.split()
    at_word = any(p in _WORDS_AT for p in parts[1:-1])
    digits = _DIGITS.findall(span)
    n = len(digits)
    mail = _MAIL.fullmatch(low) if "@" in low or at_word else None
    if not ("@" in span or mail or n >= 4):
        return None
    letters = sum(c.isalpha() for c in span)
    fields = re.split(r"[.\s-]+", re.sub(r"[()+]", "", span))
    quads = span.replace(" ", "").split(".")
    is_quad = len(quads) == 4 and all(q.isascii() and q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quads)
    before = text[tokens[i - 1][0]:tokens[i - 1][1]].lower() if i else ""
    digit_parts = sum(p.strip(_STRIP + "+-").replace("-", "").replace(".", "").isdigit() for p in parts)
    joined = "".join(digits)
    f = np.zeros(N_FEATURES)
    f[:32] = (
        1, j - i == 0, j - i == 1, j - i >= 2,
        "@" in span, span.count("@") == 1 and span[0] != "@" and span[-1] != "@", at_word, any(p in _WORDS_DOT for p in parts), mail is not None,
        letters == 0, letters > 0 and n > 0, min(letters, 20) / 20,
        n < 7, 7 <= n <= 9, 10 <= n <= 11, 12 <= n <= 13, 14 <= n <= 19, n > 19,
        14 <= n <= 19 and luhn(joined), is_quad, span.count(".") == 3,
        span[0] == "+", "(" in span, ")" in span, "-" in span,
        letters == 0 and len(fields) >= 3 and all(len(x) in (3, 4) for x in fields[-2:]) and n in (10, 11),
        letters == 0 and len(fields) == 4 and all(len(x) == 4 for x in fields),
        digit_parts == len(parts), len(set(joined)) > 2,
        before in _CUES, before in _SHOP, before in _NET)
    # Digits right outside the span: the entity would be cut.
    after = text[tokens[j + 1][0]:tokens[j + 1][1]] if j + 1 < len(tokens) else ""
    f[32] = bool(before) and before.strip(_STRIP)[-1:].isdigit()
    f[33] = bool(after) and after.lstrip("(")[:1].isdigit()
    return f


def segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """Candidate segments (first token, last token, features) of a window."""
    out = []
    for i in range(len(tokens)):
        for j in range(i, min(len(tokens), i + LONGEST)):
            f = span_features(text, tokens, i, j)
            if f is not None:
                out.append((i, j, f))
    return out


# --- the field ---------------------------------------------------------------------------------

class Field:
    """Weights: one vector per entity label over span features, and label transitions."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((LABELS - 1, N_FEATURES)) if weights is None else weights
        self.moves = np.zeros((LABELS, LABELS)) if moves is None else moves

    def scores(self, found: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        return np.stack([f for _, _, f in found]) @ self.weights.T if found else np.zeros((0, LABELS - 1))

    def decode(self, n: int, found: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int, float]]:
        """Best parse of n tokens: (first, last, kind, lead), ``lead`` being the entity's own score
        with its transitions over that of plain text."""
        own = self.scores(found)
        ends: list[list[int]] = [[] for _ in range(n)]
        for s, (_, j, _) in enumerate(found):
            ends[j].append(s)
        best = np.full((n + 1, LABELS), -np.inf)
        best[0, 0] = 0.0
        back: list[list] = [[None] * LABELS for _ in range(n + 1)]
        for t in range(n):
            step = best[t] + self.moves[:, 0]
            p = int(step.argmax())
            best[t + 1, 0], back[t + 1][0] = step[p], (t, p, None)
            for s in ends[t]:
                i = found[s][0]
                for y in range(1, LABELS):
                    step = best[i] + self.moves[:, y]
                    p = int(step.argmax())
                    value = step[p] + own[s, y - 1]
                    if value > best[t + 1, y]:
                        best[t + 1, y], back[t + 1][y] = value, (i, p, s)
        out, t, y = [], n, int(best[n].argmax())
        while t:
            i, p, s = back[t][y]
            if s is not None:
                plain = self.moves[p, 0] + self.moves[0, 0] * (t - i - 1)
                out.append((i, t - 1, y - 1, float(own[s, y - 1] + self.moves[p, y] - plain)))
            t, y = i, p
        return out[::-1]

    def gradient(self, n: int, found: list, truth: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of the log likelihood of the true segments, by forward and backward sums."""
        own = self.scores(found)
        features = np.stack([f for _, _, f in found]) if found else np.zeros((0, N_FEATURES))
        ends: list[list[int]] = [[] for _ in range(n)]
        starts: list[list[int]] = [[] for _ in range(n)]
        for s, (i, j, _) in enumerate(found):
            ends[j].append(s)
            starts[i].append(s)
        ahead = np.full((n + 1, LABELS), -np.inf)
        ahead[0, 0] = 0.0
        for t in range(n):
            ahead[t + 1, 0] = np.logaddexp.reduce(ahead[t] + self.moves[:, 0])
            for s in ends[t]:
                into = np.logaddexp.reduce(ahead[found[s][0]][:, None] + self.moves[:, 1:], axis=0) + own[s]
                ahead[t + 1, 1:] = np.logaddexp(ahead[t + 1, 1:], into)
        behind = np.full((n + 1, LABELS), -np.inf)
        behind[n] = 0.0
        for t in range(n - 1, -1, -1):
            total = self.moves[:, 0] + behind[t + 1, 0]
            for s in starts[t]:
                total = np.logaddexp(total, np.logaddexp.reduce(self.moves[:, 1:] + own[s] + behind[found[s][1] + 1, 1:], axis=1))
            behind[t] = total
        z = np.logaddexp.reduce(ahead[n])
        moves = np.zeros_like(self.moves)
        expected = np.zeros_like(own)
        for t in range(n):
            moves[:, 0] -= np.exp(ahead[t] + self.moves[:, 0] + behind[t + 1, 0] - z)
        for s, (i, j, _) in enumerate(found):
            p = np.exp(ahead[i][:, None] + self.moves[:, 1:] + own[s] + behind[j + 1, 1:] - z)
            moves[:, 1:] -= p
            expected[s] = p.sum(axis=0)
        weights = -expected.T @ features
        score, t, label = 0.0, 0, 0
        where = {(i, j): s for s, (i, j, _) in enumerate(found)}
        by_start = {i: (j, y) for (i, j), y in truth.items()}
        while t < n:
            j, y = by_start.get(t, (t, 0))
            moves[label, y] += 1
            score += self.moves[label, y]
            if y:
                weights[y - 1] += found[where[t, j]][2]
                score += own[where[t, j], y - 1]
            t, label = j + 1, y
        return weights, moves, z - score


def _variants(kind: int, value: str) -> list[str]:
    """Other ways to write a finding, none of which its base pattern matches."""
    digits = "".join(_DIGITS.findall(value))
    if kind == 0:
        name, _, domain = value.partition("@")
        return [f"{name} at {domain.replace('.', ' dot ')}", f"{name} [at] {domain}"]
    if kind == 1:
        return [value.replace(".", " . ")]
    if kind == 2:
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    tail = digits[-10:]
    return [f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}"]


def examples(text: str) -> list[tuple[str, list[tuple[int, int]], dict[tuple[int, int], int]]]:
    """Labelled windows of a text: as written, and with its findings rewritten."""
    found = base_spans(text)
    out = []
    for tokens in windows(text):
        if len(tokens) > 60:
            continue
        low, high = tokens[0][0], tokens[-1][1]
        inside = [x for x in found if low <= x[0] and x[2] <= high]
        versions = [[text[a:b] for a, _, b in inside]]
        if len(inside) == 1:
            versions += [[v] for v in _variants(inside[0][1], versions[0][0])]
        for version in versions:
            piece, marks, at = "", [], low
            for (a, kind, b), value in zip(inside, version):
                piece += text[at:a]
                marks.append((len(piece), len(piece) + len(value), kind))
                piece += value
                at = b
            piece += text[at:high]
            spans = [m.span() for m in _TOKEN.finditer(piece)]
            truth, used = {}, -1
            for a, b, kind in marks:
                i = next(k for k, s in enumerate(spans) if s[1] > a)
                j = next(k for k in range(len(spans) - 1, -1, -1) if spans[k][0] < b)
                if i > used and j - i < LONGEST and span_features(piece, spans, i, j) is not None:
                    truth[i, j] = kind + 1
                    used = j
            out.append((piece, spans, truth))
    return out


def train(texts: list[str], most: int = TRAIN_WINDOWS, passes: int = PASSES) -> Field:
    """Fit the field by stochastic gradient steps with a weight penalty, in a fixed order."""
    data = []
    for text in texts:
        data += [(len(spans), segments(piece, spans), truth) for piece, spans, truth in examples(text)]
        if len(data) >= most:
            break
    field, order = Field(), np.random.default_rng(7)
    sums_w, sums_m = np.full_like(field.weights, 1e-2), np.full_like(field.moves, 1e-2)
    for _ in range(passes):
        for k in order.permutation(len(data)):
            w, m, _ = field.gradient(*data[k])
            w, m = w - 1e-3 * field.weights, m - 1e-3 * field.moves
            sums_w += w * w
            sums_m += m * m
            field.weights += 0.5 * w / np.sqrt(sums_w)
            field.moves += 0.5 * m / np.sqrt(sums_m)
    return field


def added_spans(field: Field, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Entities of the field that touch no base finding."""
    out = []
    for tokens in windows(text):
        found = segments(text, tokens)
        if not found:
            continue
        for i, j, kind, lead in field.decode(len(tokens), found):
            raw = text[tokens[i][0]:tokens[j][1]]
            left = len(raw) - len(raw.lstrip(_STRIP.replace("(", "")))
            a, b = tokens[i][0] + left, tokens[i][0] + len(raw.rstrip(_STRIP))
            if lead >= MARGIN and a < b and not any(s < b and a < e for s, _, e in base):
                out.append((a, kind, b))
    return out


def spans_of(field: Field, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    text = text or ""
    base = base_spans(text)
    return base, sorted(set(base + added_spans(field, text, base)))


# --- Spark -------------------------------------------------------------------------------------

def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Field:
    """The field trained on the documents of ``docs`` with the smallest hashes that hold a digit or
    an at sign, and are not very long; ``sample`` different ones are sent to the driver. The hashes
    are found first, so tasks send hashes and only the chosen texts travel."""
    able = docs.select(F.col(text_col).alias("t"), F.xxhash64(id_col, text_col).alias("h")).where(
        (F.length("t") < 20000) & F.col("t").rlike("[0-9]{2}|@"))
    chosen = [r.h for r in able.select("h").distinct().orderBy("h").limit(sample).collect()]
    texts = {r.h: r.t for r in able.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("t").alias("t")).collect()} if chosen else {}
    return train([texts[h] for h in sorted(texts)])


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scanner(weights: np.ndarray, moves: np.ndarray, columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = Field(weights, moves)
        for frame in frames:
            rows = []
            for text in frame["_text"]:
                base, every = spans_of(field, text)
                rows.append((*(sum(s[1] == k for s in base) for k in range(4)),
                             hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every), len(every) - len(base)))
            out = pd.DataFrame(rows, columns=columns[1:])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: ``doc_id``, the number of base findings of each kind, ``base_sha256``
    of them, ``spans`` of all findings (code points, end exclusive), ``n_added`` by the field.

    NULL texts are empty and hold nothing; repeated rows give equal results; other columns are
    ignored. With no document to learn from the field adds nothing.
    """
    prepare(docs.sparkSession)
    field = field or fitted(docs, id_col, text_col)
    columns = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInPandas(
        _scanner(field.weights, field.moves, columns), schema)


def redact(text: str | None, field: Field) -> str | None:
    """The text with every finding replaced by its kind in brackets; overlapping ones are one."""
    if not text:
        return text
    out, at = [], 0
    for a, k, b in spans_of(field, text)[1]:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
             field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced and ``chars_col`` counted anew."""
    prepare(docs.sparkSession)
    field = field or fitted(docs, id_col, text_col)

    @F.pandas_udf(StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, field) for t in texts], dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
