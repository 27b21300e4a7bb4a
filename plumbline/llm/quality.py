"""A quality classifier: a generalised additive model with pairwise interactions.

The score is the logistic of a sum of lookup tables, one per text feature and one per chosen
pair of features. Cyclic boosting learns them: round after round, each feature in turn gets a
shallow tree over its bins, fitted to the current gradients, and the tree is added to the
feature's table. Pairs are chosen by what they would still explain and boosted in the same way
on a coarser grid. Scoring looks up bins and adds, for a batch of texts at a time.

The fit uses at most about ``TRAIN_ROWS`` labelled rows (a hash-random share of them where there
are more), so features of that many rows reach the driver; every other step is distributed and
covers all rows. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have all features zero and one common score; rows without
a label are scored alike; several labels of one id all count; without any usable label, or with
one class only, every score is that class's share (0.5 where there is none); an empty table
gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.shared import checked_keys

TRAIN_ROWS = 40_000
FOLDS = 5
BINS = 64
GRID = 12
PAIRS = 8
ROUNDS = 80
RATE = 0.1
LEAVES_DEPTH = 2
LEAST_ROWS = 10.0
SMOOTH = 1.0
CUT = 0.3

UPPER, LOWER, DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
SYMBOL = np.frombuffer(b"#$%&*!|<>{}[]^~@=+_\\/", dtype=np.uint8)
STOP = np.frombuffer(b".,;:?", dtype=np.uint8)
FEATURES = (
    "log_bytes", "upper", "letters", "digits", "symbols", "stops", "other_bytes", "bars", "bangs",
    "log_words", "word_bytes", "distinct_words", "top_word", "long_words", "capitals",
    "log_lines", "words_per_line", "distinct_lines", "top_line", "marked_words",
)


def features(text: str | None) -> np.ndarray:
    """The features of one whole text, in the order of FEATURES."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n, seen = len(data), np.bincount(data, minlength=256)
    words = text.split()
    count = max(1, len(words))
    often = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    line_count = max(1, len(lines))
    often_line = Counter(lines)
    marks = sum(v for w, v in often.items() if not (w[-1].isalnum() or w[-1] in ".,;:?"))
    out[:] = (
        np.log1p(n), seen[UPPER].sum() / n, (seen[UPPER].sum() + seen[LOWER].sum()) / n,
        seen[DIGIT].sum() / n, seen[SYMBOL].sum() / n, seen[STOP].sum() / n, seen[128:].sum() / n,
        seen[ord("|")] / n, seen[ord("!")] / n,
        np.log1p(len(words)), n / count, len(often) / count,
        max(often.values(), default=0) / count,
        sum(v for w, v in often.items() if len(w) > 15) / count,
        sum(v for w, v in often.items() if w[0].isupper()) / count,
        np.log1p(len(lines)), len(words) / line_count, len(often_line) / line_count,
        max(often_line.values(), default=0) / line_count, marks / count,
    )
    return out


@dataclass
class Additive:
    """``score = logistic(base + tables + pair tables)``."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grid_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            rows = np.searchsorted(self.grid_edges[a], x[:, a], side="right")
            cols = np.searchsorted(self.grid_edges[b], x[:, b], side="right")
            total += table[rows, cols]
        return 1 / (1 + np.exp(-total))


def cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """A value per bin: the best tree of ``depth`` splits of the ordered bins."""
    value = -g.sum() / (h.sum() + SMOOTH)
    if depth == 0 or len(g) < 2:
        return np.full(len(g), value)
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + SMOOTH) + gr**2 / (hr + SMOOTH)
    gain[(nl < LEAST_ROWS) | (nr < LEAST_ROWS)] = -np.inf
    at = int(gain.argmax())
    if gain[at] <= g.sum() ** 2 / (h.sum() + SMOOTH):
        return np.full(len(g), value)
    k = at + 1
    return np.concatenate(
        [shallow_tree(g[:k], h[:k], n[:k], depth - 1), shallow_tree(g[k:], h[k:], n[k:], depth - 1)]
    )


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost the tables on features ``x`` and labels ``y`` (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        bounded = min(max(share, 1e-6), 1 - 1e-6)
        return Additive(float(np.log(bounded / (1 - bounded))))
    model = Additive(float(np.log(share / (1 - share))))
    count = x.shape[1]
    model.edges = [cuts(x[:, j], BINS) for j in range(count)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.grid_edges = [cuts(x[:, j], GRID) for j in range(count)]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(count)]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(count):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * shallow_tree(
                np.bincount(bins[j], g, size), np.bincount(bins[j], h, size), rows[j], LEAVES_DEPTH
            )
            model.tables[j] += step
            total += step[bins[j]]

    grid = [np.searchsorted(model.grid_edges[j], x[:, j], side="right") for j in range(count)]
    g, h = slopes()

    def sums(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.grid_edges[a]) + 1, len(model.grid_edges[b]) + 1)
        cell = grid[a] * shape[1] + grid[b]
        size = shape[0] * shape[1]
        return (cell, np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape))

    def explained(a: int, b: int) -> float:
        _, gs, hs = sums(a, b, g, h)
        return float((gs**2 / (hs + 10 * SMOOTH)).sum())

    model.pairs = sorted(combinations(range(count), 2), key=lambda p: -explained(*p))[:PAIRS]
    model.pair_tables = [
        np.zeros((len(model.grid_edges[a]) + 1, len(model.grid_edges[b]) + 1)) for a, b in model.pairs
    ]
    for _ in range(ROUNDS // 2):
        for at, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            cell, gs, hs = sums(a, b, g, h)
            # A tree of two levels: split the first feature, then each part by the second.
            width = gs.shape[0]
            parts = shallow_tree(gs.sum(1), hs.sum(1), np.full(width, LEAST_ROWS), 1)
            step = np.zeros_like(gs)
            for value in np.unique(parts):
                part = parts == value
                step[part] = shallow_tree(
                    gs[part].sum(0), hs[part].sum(0), np.full(gs.shape[1], LEAST_ROWS), 1
                )
            model.pair_tables[at] += RATE * step
            total += RATE * step.ravel()[cell]
    return model


def held_out(doc_id: str) -> Column:
    """Whether a document belongs to the fold that no fit may see."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Additive:
    """Fit on labelled documents outside the held-out fold, ``train_rows`` of them at most in
    expectation: labels are cut by a hash of their id, then documents (an id may stand on any number)
    by a hash of id and text; equal rows count once."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id")).select("doc_id", "quality")
    share = min(1.0, train_rows / max(1, usable.count()))
    place = F.conv(F.substring(F.md5(F.concat(F.lit("fit:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10)
    chosen = checked_keys(usable.where(place.cast("double") < share * 2.0**32))
    standing = docs.select("doc_id").join(chosen, "doc_id").count()
    row = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(1 << 32)) / F.lit(2.0**32)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [features(t).tolist() for t in batch["text"]]
            yield pd.DataFrame({"quality": batch["quality"].astype("int32"), "x": values})

    rows = (
        docs.select("doc_id", "text").join(chosen, "doc_id")
        .where(row < min(1.0, train_rows / max(1, standing)))
        .dropDuplicates(["doc_id", "text", "quality"]).select("quality", "text")
        .mapInPandas(measure, "quality int, x array<double>")
        .toPandas()
    )
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(rows["x"].tolist()), rows["quality"].to_numpy(dtype=float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def classify_quality(docs: DataFrame, model: Additive, text: str = "text") -> DataFrame:
    """``docs`` with ``_pl_score``, the probability of good quality, and ``_pl_predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(shared.value.score(x), dtype="float64")

    return docs.withColumn("_pl_score", score(F.col(text))).withColumn(
        "_pl_predicted", (F.col("_pl_score") >= CUT).cast("int")
    )
