"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in turn; each step fits one shallow tree (at
most three leaves) to the gradient over that feature's bins and adds it to the
feature's lookup table. Then the pairs whose four-quadrant split explains most
of what is left are boosted in the same way over their two-way bins. A score
is the logistic of the intercept plus one table entry for each feature and
pair: vectorised additions of looked-up bins.

The model is fitted on at most ``max_rows`` labelled documents (a documented
bound; see common.training_rows). Features and scores cover every whole text,
and nothing but the text enters a score.

Defined cases: null and empty texts have the features of an empty text and get
its score; extra columns are kept, one with the score's name is replaced;
without labelled rows, or with labels of one kind, all scores are the share of
ones (0.5 without rows); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, parts_of, training_rows

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "upper", "digits", "symbols", "shouts", "pipes", "stops",
    "short_words", "line_length", "distinct_lines", "longest_word", "non_ascii", "sentence_length", "distinct_pairs",
)

_CLASS = np.zeros(256, np.int64)  # of bytes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 ! or ?, 6 |, 7 stop, 8 line end, 9 beyond ASCII
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in "#$%&*@^~<>=+\\/_{}[]`"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[ord("|")] = 6
_CLASS[[ord(c) for c in ".,;:"]] = 7
_CLASS[10] = 8
_CLASS[128:] = 9


def features(text: str | None) -> list[float]:
    """One value for each of FEATURES."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    of = np.bincount(_CLASS[np.frombuffer(text.encode(), np.uint8)], minlength=10)
    letters = max(1, int(of[1] + of[2] + of[9]))
    lines = [x for x in text.split("\n") if x]
    lengths = [len(w) for w in words]
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(lengths) / n, len(set(words)) / n, of[1] / letters, of[3] / max(1, len(text)),
        of[4] / n, of[5] / n, of[6] / n, of[7] / n, sum(x <= 3 for x in lengths) / n, n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)), np.log1p(max(lengths, default=0)), of[9] / letters,
        n / max(1, text.count(".") + text.count("!") + text.count("?")), len(set(zip(words, words[1:], strict=False))) / n,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _gain(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    return g * g / (h + smooth)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Step for each bin of a tree of at most ``leaves`` leaves over ordered bins."""
    edges = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(edges):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            left = _gain(cg[cut] - cg[a], ch[cut] - ch[a], smooth)
            right = _gain(cg[b] - cg[cut], ch[b] - ch[cut], smooth)
            more = left + right - _gain(cg[b] - cg[a], ch[b] - ch[a], smooth)
            if more.max() > best[0]:
                best = (more.max(), k, int(cut[more.argmax()]))
        if best[1] is None:
            break
        a, b = edges.pop(best[1])
        edges += [(a, best[2]), (best[2], b)]
    step = np.zeros(len(g))
    for a, b in edges:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return step


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best split of a grid of bins into four quadrants."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    if not i.size:
        return 0.0, np.zeros_like(g)
    part = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    total = sum(_gain(a, b, smooth) for a, b in zip(part(cg), part(ch), strict=True))
    x, y = np.unravel_index(int(total.argmax()), total.shape)
    steps = [float(a[x, y] / (b[x, y] + smooth)) for a, b in zip(part(cg), part(ch), strict=True)]
    out = np.empty_like(g)
    out[: x + 1, : y + 1], out[: x + 1, y + 1 :], out[x + 1 :, : y + 1], out[x + 1 :, y + 1 :] = steps
    return float(total[x, y] - _gain(g.sum(), h.sum(), smooth)), out


@dataclass
class AdditiveModel:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, (cuts, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += t[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return _sigmoid(total)


def fit_matrix(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, leaves: int = 3,
    n_pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, smooth: float = 5.0,
) -> AdditiveModel:
    """Fit on a matrix of features and 0/1 labels."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    coarse = [np.unique(np.quantile(c, np.linspace(0, 1, pair_bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    model = AdditiveModel(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse)
    if not 0 < y.sum() < len(y):
        return model
    at = [np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T, strict=True)]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = _sigmoid(total)
            step = rate * _tree(np.bincount(at[j], y - p, len(table)), np.bincount(at[j], p * (1 - p), len(table)), leaves, smooth)
            table += step
            total += step[at[j]]
    rough = [np.searchsorted(c, v, side="right") for c, v in zip(coarse, x.T, strict=True)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        n, m = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(rough[a] * m + rough[b], v, n * m).reshape(n, m)

    p = _sigmoid(total)
    gains = {(a, b): _quadrants(grid(a, b, y - p), grid(a, b, p * (1 - p)), smooth)[0] for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            p = _sigmoid(total)
            step = rate * _quadrants(grid(a, b, y - p), grid(a, b, p * (1 - p)), smooth)[1]
            table += step
            total += step[rough[a], rough[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 20_000, **options) -> AdditiveModel:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": [list(map(float, features(t))) for t in b["text"]]})

    sample = training_rows(docs, labels, label, max_rows).mapInPandas(rows, "doc_id long, label int, x array<double>")
    found = sample.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(found), len(FEATURES))
    return fit_matrix(x, found.column("label").to_numpy().astype(float), **options)


def score(docs: DataFrame, model: AdditiveModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in parts_of(batches):
            yield pa.array(model.score(np.array([features(t) for t in b.to_pylist()], float).reshape(len(b), len(FEATURES))))

    return docs.withColumn(out, of(F.col(text)))


def keep(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows that score at least ``threshold``, with the columns of ``docs``, whatever their names."""
    name = fresh("quality", docs.columns)
    return score(docs, model, text, name).where(F.col(name) >= threshold).select(*docs.columns)


