"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins; the model is one lookup table a feature and one a chosen pair of
features, and a score is the logistic of the sum of the cells a text falls into.  Tables are learned by
cyclic boosting: round after round, each feature in turn gets a shallow tree on its own bins, fitted to what
is left unexplained; then pairs are ranked by how much a coarse grid of them still explains, and the best
are boosted in the same way.

Training uses a sample of labelled rows of a fixed size, which is all that reaches the driver; scoring
runs where the rows are.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, fold, fresh

#: Labelled rows that a model is fitted on at most: those of the lowest hash of doc_id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_words",
    "word_length",
    "longest_word",
    "upper",
    "digits",
    "blanks",
    "symbols",
    "marks",
    "other_bytes",
    "distinct_words",
    "top_word",
    "repeated_next",
    "lines_per_word",
    "distinct_lines",
    "short_words",
    "entropy",
)

# classes of bytes: 0 lower case, 1 upper case, 2 digits, 3 blanks, 4 symbols, 5 punctuation marks, 6 the rest
CLASSES = np.full(256, 6, dtype=np.uint8)
CLASSES[ord("a") : ord("z") + 1] = 0
CLASSES[ord("A") : ord("Z") + 1] = 1
CLASSES[ord("0") : ord("9") + 1] = 2
CLASSES[[9, 10, 11, 12, 13, 32]] = 3
CLASSES[[ord(c) for c in "#*$%&|<>=@^~_\\{}[]/+"]] = 4
CLASSES[[ord(c) for c in ".,;:!?'\"()-"]] = 5


def features(text: str | None) -> tuple[float, ...]:
    """Numbers about a whole text, in the order of FEATURES; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    octets = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    kinds = np.bincount(CLASSES, weights=octets, minlength=7)
    share = octets[octets > 0] / size
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    lengths = list(map(len, words))
    some = max(n, 1)
    return (
        math.log1p(n),
        sum(lengths) / some,
        math.log1p(max(lengths, default=0)),
        kinds[1] / max(kinds[0] + kinds[1], 1),
        kinds[2] / size,
        kinds[3] / size,
        kinds[4] / some,
        kinds[5] / some,
        kinds[6] / size,
        len(count) / some,
        max(count.values(), default=0) / some,
        sum(map(eq, words, words[1:])) / some,
        len(lines) / some,
        len(set(lines)) / max(len(lines), 1),
        sum(x < 3 for x in lengths) / some,
        float(-(share * np.log2(share)).sum()),
    )


@dataclass(frozen=True)
class Additive:
    """Bin edges and tables; ``coarse`` maps a feature's bins to the cells of a pair's axis."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    grids: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        out = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables):
            out += t[b]
        for (i, j), g in zip(self.pairs, self.grids):
            out += g[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def step(gradient: np.ndarray, weight: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """A tree over ordered bins with up to ``leaves`` leaves: the value of each bin."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + penalty)
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                won = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(np.argmax(won))
                best = max(best, (float(won[k]), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + penalty)
    return out


def plane(gradient: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """The best tree of one cut along the first axis and one cut on each side along the second; its gain."""
    top_g, top_w = np.cumsum(gradient, axis=0), np.cumsum(weight, axis=0)
    best, chosen = -1.0, None
    for a in range(len(gradient) - 1):
        won, parts = 0.0, []
        for sg, sw in ((top_g[a], top_w[a]), (top_g[-1] - top_g[a], top_w[-1] - top_w[a])):
            cg, cw = np.cumsum(sg), np.cumsum(sw)
            left = cg**2 / (cw + penalty) + (cg[-1] - cg) ** 2 / (cw[-1] - cw + penalty)
            k = int(np.argmax(left))
            won += float(left[k])
            parts.append((k, cg[k] / (cw[k] + penalty), (cg[-1] - cg[k]) / (cw[-1] - cw[k] + penalty)))
        if won > best:
            best, chosen = won, (a, parts)
    out = np.zeros_like(gradient)
    if chosen:
        a, parts = chosen
        for rows, (k, low, high) in zip((slice(0, a + 1), slice(a + 1, None)), parts):
            out[rows, : k + 1], out[rows, k + 1 :] = low, high
    return out, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 48, cells: int = 8, n_pairs: int = 8, leaves: int = 3, penalty: float = 5.0) -> Additive:
    """Boost the tables on rows ``x`` and labels ``y`` of 0 and 1."""
    y = np.asarray(y, dtype=np.float64)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    base = math.log(mean / (1 - mean))
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], grid)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.arange(len(e) + 1) * cells // (len(e) + 1) for e in edges]
    logit = np.full(len(x), base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds if len(x) else 0):
        for j, t in enumerate(tables):
            g, w = slopes()
            add = rate * step(np.bincount(at[j], g, len(t)), np.bincount(at[j], w, len(t)), leaves, penalty)
            t += add
            logit += add[at[j]]
    low = [c[b] for c, b in zip(coarse, at)]
    square = lambda i, j, v: np.bincount(low[i] * cells + low[j], v, cells * cells).reshape(cells, cells)
    pairs: list[tuple[int, int]] = []
    if len(x):
        g, w = slopes()
        gains = {(i, j): plane(square(i, j, g), square(i, j, w), penalty)[1] for i, j in combinations(range(x.shape[1]), 2)}
        pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    grids = [np.zeros((cells, cells)) for _ in pairs]
    for _ in range(rounds // 2):
        for (i, j), t in zip(pairs, grids):
            g, w = slopes()
            add = rate * plane(square(i, j, g), square(i, j, w), penalty)[0]
            t += add
            logit += add[low[i], low[j]]
    for t, b in zip(tables, at):  # centred, so that each table is a deviation from the base
        if len(x):
            shift = float(t[b].mean())
            t -= shift
            base += shift
    return Additive(base, edges, tables, coarse, pairs, grids)


def with_features(docs: DataFrame, text: str, name: str) -> DataFrame:
    field = T.StructField(name, T.ArrayType(T.DoubleType()))
    return add_columns(docs, [text], [field], lambda texts: [[features(t) for t in texts]], drop=(text,))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Additive:
    """Fit on labelled documents whose fold is not held out, at most ``rows`` of them.

    Labels that are null or of other values than 0 and 1, and ids that are null, take no part.  Without any
    label the model gives 0.5 to all.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(fold("doc_id", 5) > 0)
    usable = usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # a fixed number of ids and labels
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    found = with_features(texts, "text", "x").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(rows).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(found.num_rows, len(FEATURES))
    return fit(x, np.array(found.column("label").to_pylist(), dtype=np.float64))


def add_score(docs: DataFrame, model: Additive, score: str = "score", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Append the score, from 0 to 1, of every row's whole text; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    whole = fresh(docs.columns, "whole")
    named = docs.withColumn(whole, F.col(text).cast("string"))
    drop = (whole,) if keep_text else (whole, text)

    def run(texts):
        return [shared.value.score(np.array([features(t) for t in texts])).tolist()]

    return add_columns(named, [whole], [T.StructField(score, T.DoubleType())], run, drop=drop)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document row; labels are read for training only."""
    docs = docs.select("doc_id", "text")
    scored = add_score(docs, train(docs, labels), keep_text=False)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns unchanged."""
    name = fresh(docs.columns, "score")
    scored = add_score(docs, train(docs, labels), score=name)
    return scored.where(F.col(name) >= THRESHOLD).select(*docs.columns)
