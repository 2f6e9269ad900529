"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find what is written in full.  The field labels every word that holds a digit or an at sign as one
of the kinds or as none.  A word's own shape and its neighbours' give its potentials, words side by side
share a chain potential, and words that repeat (or have the same digits) share a skip potential, each with
the occurrence before it: a number written once in full and later without its prefix is labelled alike.
Words in a pattern's span are observed.  Marginals come from loopy message passing over a document's graph,
whose edges are at most two a word.

The field is trained by pseudo-likelihood, with the patterns as labels, on a sample of words of a fixed size.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, add_columns, fresh, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
N = len(LABELS)
#: Words that the field is trained on at most: those of the documents of the lowest hash.
TRAIN_WORDS = 20_000
ROUNDS, DAMPING = 20, 0.3
#: Numbers of the same last digits are similar words.
ENDING = 7
#: Words whose graphs are solved together, unless one text has more.
GRAPH_WORDS = 20_000
#: Digits at most of a card and a phone number.
MOST_DIGITS = {2: 19, 3: 15}
#: And at least.
LEAST_DIGITS = {2: 13, 3: 7}

MARK = re.compile(r"[0-9@]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number's first digit: later starts in the same run of digits match nothing that this one does not
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from their at signs: linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind, in code points."""
    if not MARK.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# features of a word: whether each of these holds
TESTS = (
    ("at sign", lambda w, d: "@" in w),
    ("at sign and dot after it", lambda w, d: "." in w.partition("@")[2]),
    ("plus first", lambda w, d: w.startswith("+")),
    ("bracketed", lambda w, d: w[:1] == "("),
    ("letters", lambda w, d: any(c.isalpha() for c in w)),
    ("three dots", lambda w, d: w.strip(".,;:").count(".") == 3),
    ("some dot", lambda w, d: "." in w.strip(".,;:")),
    ("hyphen", lambda w, d: "-" in w.strip("-")),
    ("equals or quotes", lambda w, d: "=" in w or '"' in w),
    ("only digits", lambda w, d: len(d) == len(w)),
    ("under 3 digits", lambda w, d: len(d) < 3),
    ("3 digits", lambda w, d: len(d) == 3),
    ("4 digits", lambda w, d: len(d) == 4),
    ("5 to 6 digits", lambda w, d: 5 <= len(d) <= 6),
    ("7 digits", lambda w, d: len(d) == 7),
    ("8 to 13 digits", lambda w, d: 8 <= len(d) <= 13),
    ("14 to 19 digits", lambda w, d: 14 <= len(d) <= 19),
    ("over 19 digits", lambda w, d: len(d) > 19),
    ("check digit", lambda w, d: 13 <= len(d) <= 19 and luhn(d)),
)
D = 3 * (len(TESTS) + 1) + 1  # of a word, the one before and the one after; and whether there is one


def shape(word: str) -> list[float]:
    digits = NOT_DIGIT.sub("", word)
    return [1.0, *(float(test(word, digits)) for _, test in TESTS)]


@dataclass
class Words:
    """The marked words of one text, and their graph."""

    spans: list[tuple[int, int]]
    x: np.ndarray
    seen: np.ndarray  # label of the pattern that covers it, else -1
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def words_of(text: str, base: list[Span]) -> Words:
    """Graph of a text's marked words.  A skip edge goes to the last word before of the same key."""
    spans, shapes, order = [], [], []
    for number, m in enumerate(WORD.finditer(text)):
        if MARK.search(m[0]):
            spans.append(m.span())
            shapes.append(shape(m[0]))
            order.append(number)
    chain = [(i - 1, i) for i in range(1, len(order)) if order[i - 1] == order[i] - 1]
    own = np.array(shapes).reshape(len(shapes), len(TESTS) + 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if chain:
        left, right = np.array(chain).T
        before[right], after[left] = own[left], own[right]
    skip, where = [], {}
    for i, (a, b) in enumerate(spans):
        word = text[a:b]
        digits = NOT_DIGIT.sub("", word)
        key = digits[-ENDING:] if len(digits) >= 3 and "@" not in word else word.lower().strip(".,;:()<>\"'")
        last = where.get(key)
        if last is not None and (last < i - 1 or order[last] < order[i] - 1):
            skip.append((last, i))
        where[key] = i
    seen = np.full(len(spans), -1)
    k = 0
    for i, (a, b) in enumerate(spans):
        while k < len(base) and base[k][2] <= a:
            k += 1
        over, j = [], k
        while j < len(base) and base[j][0] < b:
            if base[j][2] > a:
                over.append(base[j])
            j += 1
        if over:
            seen[i] = 1 + max(over, key=lambda s: min(s[2], b) - max(s[0], a))[1]
    return Words(spans, np.hstack([np.ones((len(spans), 1)), own, before, after]), seen, chain, skip)


@dataclass(frozen=True)
class Field:
    """Weights: of features by label, of labels side by side, and of equal labels on a skip edge."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, x: np.ndarray, seen: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Loopy sum-product on a graph; observed words keep their label."""
        own = x @ self.node
        fixed = seen >= 0
        own[fixed] = -50.0
        own[np.flatnonzero(fixed), seen[fixed]] = 0.0
        ends = np.concatenate([chain, skip]).astype(np.int64)
        same = np.diag(self.skip)
        pair = np.concatenate([np.broadcast_to(self.chain, (len(chain), N, N)), np.broadcast_to(same, (len(skip), N, N))])
        source = np.concatenate([ends[:, 0], ends[:, 1]])
        target = np.concatenate([ends[:, 1], ends[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        m, e = np.zeros((len(source), N)), len(ends)
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        for _ in range(ROUNDS if e else 0):
            belief = own + gathered(target, m, len(own))
            out = belief[source] - m[back]
            out = np.logaddexp.reduce(out[:, :, None] + pair, axis=1)
            out -= out.max(axis=1, keepdims=True)
            m = DAMPING * m + (1 - DAMPING) * out
        belief = own + gathered(target, m, len(own))
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def gathered(target: np.ndarray, messages: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(target, messages[:, k], n) for k in range(N)], axis=1)


EMPTY = Field(np.zeros((D, N)), np.zeros((N, N)), np.zeros(N))


def around(w: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: labels of the chain neighbours (-1: none), and counts of labels on its skip edges."""
    before, after, linked = np.full(len(labels), -1), np.full(len(labels), -1), np.zeros((len(labels), N))
    for i, j in w.chain:
        before[j], after[i] = labels[i], labels[j]
    for i, j in w.skip:
        linked[j, labels[i]] += 1
        linked[i, labels[j]] += 1
    return before, after, linked


def fit(x: np.ndarray, y: np.ndarray, before: np.ndarray, after: np.ndarray, linked: np.ndarray, steps: int = 300, penalty: float = 1.0) -> Field:
    """Maximise the pseudo-likelihood: each word given the labels around it, by scaled gradient steps."""
    if not len(y):
        return EMPTY
    one = np.eye(N + 1)[:, :N]  # row -1 is all zero
    parts = [x, one[before], one[after], linked]
    target = np.eye(N)[y]
    w = [np.zeros((D, N)), np.zeros((N, N)), np.zeros(N)]
    speed = [np.full_like(v, 1e-8) for v in w]
    for _ in range(steps):
        z = parts[0] @ w[0] + parts[1] @ w[1] + parts[2] @ w[1].T + parts[3] * w[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gap = target - p / p.sum(axis=1, keepdims=True)
        steep = [parts[0].T @ gap, parts[1].T @ gap + (parts[2].T @ gap).T, (parts[3] * gap).sum(axis=0)]
        for v, s, g in zip(w, speed, steep):
            g = (g - penalty * v) / len(y)
            s += g * g
            v += 0.3 * g / np.sqrt(s)
    return Field(*w)


TRAINING = "x array<double>, y int, before int, after int, linked array<double>, place int"


def train(docs: DataFrame, words: int = TRAIN_WORDS) -> Field:
    """Fit the field on marked words of ``docs``, at most ``words`` of them, with the patterns as labels."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column("order").to_pylist()
            for order, text in zip(ids, batch.column("text").to_pylist()):
                base = base_spans(text or "")
                w = words_of(text, base) if MARK.search(text or "") else None
                if w is not None and len(w.spans):
                    y = np.maximum(w.seen, 0)
                    before, after, linked = around(w, y)
                    rows += zip([order] * len(y), w.x.tolist(), y.tolist(), before.tolist(), after.tolist(), linked.tolist(), range(len(y)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32()]
            names = ["order", "x", "y", "before", "after", "linked", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    texts = docs.select(F.xxhash64("doc_id").alias("order"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    found = texts.mapInArrow(run, "order long, " + TRAINING).orderBy("order", "place", "y").limit(words).toArrow()
    column = lambda c: found.column(c).to_numpy()
    n = found.num_rows
    flat = lambda c, k: found.column(c).combine_chunks().flatten().to_numpy().reshape(n, k)
    return fit(flat("x", D), column("y"), column("before"), column("after"), flat("linked", N))


def plausible(kind: int, text: str, supported: bool = False) -> bool:
    """What an added span must have at least to be of its kind; ``supported``: a pattern found a number of the
    kind with the same last digits in the text, so how this one is written does not matter."""
    digits = len(NOT_DIGIT.sub("", text))
    if kind == 0:
        return bool(re.search(r"[^@]@[^@]", text))
    if kind == 1:
        parts = [p.lstrip("0") for p in NOT_DIGIT.split(text) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    if kind == 2:
        written = r"[0-9 .-]+" if supported else r"[0-9 -]+"
        return bool(re.fullmatch(written, text)) and 13 <= digits <= MOST_DIGITS[kind] and luhn(NOT_DIGIT.sub("", text))
    written = r"[0-9 +().-]+" if supported else r"[0-9 +().-]*[+(-][0-9 +().-]*"
    return bool(re.fullmatch(written, text)) and 7 <= digits <= MOST_DIGITS[kind]


def added_spans(text: str, w: Words, labels: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of labelled words outside the patterns'; neighbours join into the longest number that is plausible.

    What repeats a card or phone number of the patterns, or its end without a prefix, is of its kind however the field
    labels it: the field learns from the patterns' finds, which leave such repeats out.
    """
    out: list[Span] = []
    side = {j for i, j in w.chain if w.seen[i] < 0 and w.seen[j] < 0}
    n_digits = [len(NOT_DIGIT.sub("", text[a:b])) for a, b in w.spans]
    known: set[tuple[int, str]] = set()
    ends: dict[str, int] = {}
    for a, kind, b in base:
        if kind in MOST_DIGITS:
            digits = NOT_DIGIT.sub("", text[a:b])
            known.add((kind, digits[-ENDING:]))
            ends.update((digits[k:], kind) for k in range(len(digits) - LEAST_DIGITS[kind] + 1))
    i = 0
    while i < len(labels):
        found = None
        if w.seen[i] < 0:
            for kind in dict.fromkeys((int(labels[i]) - 1, *sorted(set(ends.values())))):
                labelled = kind == labels[i] - 1
                k, total, most = i, n_digits[i], MOST_DIGITS.get(kind, 0)
                while k + 1 in side and n_digits[k + 1] and total + n_digits[k + 1] <= most and (not labelled or labels[k + 1] == labels[i]):
                    k += 1
                    total += n_digits[k]
                while kind >= 0 and k >= i and found is None:
                    a, b = w.spans[i][0], w.spans[k][1]
                    inner = text[a:b].rstrip(".,;:!?\"'>]}|")
                    b = a + len(inner)
                    a = b - len(inner.lstrip("\"'<[{|"))
                    digits = NOT_DIGIT.sub("", text[a:b])
                    repeats = ends.get(digits) == kind
                    alike = (kind, digits[-ENDING:]) in known and not any(ends.get(NOT_DIGIT.sub("", text[w.spans[j][0] : b])) == kind for j in range(i + 1, k + 1))
                    if (labelled or repeats) and plausible(kind, text[a:b], repeats or alike):
                        found = (a, kind, b), k
                    k -= 1
        if found:
            out.append(found[0])
        i = found[1] + 1 if found else i + 1
    return out


def solved(graphs: list[Words], field: Field) -> list[np.ndarray]:
    """Labels of the words of some graphs, which are passed over together."""
    starts = np.cumsum([0, *(len(w.spans) for w in graphs)])
    edges = lambda name: np.array([(a + i, a + j) for a, w in zip(starts, graphs) for i, j in getattr(w, name)], dtype=np.int64).reshape(-1, 2)
    p = field.marginals(np.concatenate([w.x for w in graphs]), np.concatenate([w.seen for w in graphs]), edges("chain"), edges("skip"))
    return np.split(np.where(p.max(axis=1) > 0.5, p.argmax(axis=1), 0), starts[1:-1])


def find_all(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    found: list[tuple[list[Span], list[Span]]] = []
    waiting: list[tuple[int, Words]] = []

    def solve() -> None:
        for (i, w), labels in zip(waiting, solved([w for _, w in waiting], field) if waiting else ()):
            base = found[i][0]
            found[i] = (base, sorted(base + added_spans(texts[i], w, labels, base)))
        waiting.clear()

    for i, t in enumerate(texts):
        base = base_spans(t or "")
        found.append((base, base))
        if t and MARK.search(t):
            waiting.append((i, words_of(t, base)))
            if sum(len(w.spans) for _, w in waiting) >= GRAPH_WORDS:
                solve()
    solve()
    return found


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that overlap, replaced by the kind of its first."""
    out, at, open_until = [], 0, -1
    for a, k, b in spans:
        if a >= open_until:
            out.append(text[at:a] + f"[{KINDS[k].upper()}]")
        open_until = at = max(b, open_until)
    return "".join(out) + text[at:]


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans, for every row's whole text.

    A null text is an empty one and has none; rows that repeat are each returned.
    """
    long, string = T.LongType(), T.StringType()
    fields = [*(T.StructField(f"n_{k}", long) for k in KINDS), T.StructField("base_sha256", string), T.StructField("spans", string)]

    def run(texts):
        out = []
        for base, spans in find_all(texts, field):
            kinds = [k for _, k, _ in base]
            out.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
        return list(zip(*out))

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return add_columns(docs, ["text"], fields, run, drop=("text",))


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The same rows and columns with personal data replaced, and n_chars, if there is one, counted anew."""
    name = fresh(docs.columns, "clean")

    def run(texts):
        return [[t if t is None else redacted(t, s) for t, (_, s) in zip(texts, find_all(texts, field))]]

    docs = docs.withColumn("text", F.col("text").cast("string"))
    done = add_columns(docs, ["text"], [T.StructField(name, T.StringType())], run)
    change = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        same = F.col(name).eqNullSafe(F.col("text"))
        change["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(name).cast(docs.schema["n_chars"].dataType))
    return done.withColumns(change).select(*docs.columns)


def spans(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))
