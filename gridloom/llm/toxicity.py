"""Toxicity by multiple-instance learning.

Labels are of documents, scores of sentences: a document is toxic if any
sentence is. With p_s the logistic score of a sentence, the document's
probability is the noisy-or 1 - prod(1 - p_s), and the sentence model is
trained through it from the documents' labels alone. Afterwards the sentence
scores locate what offends.

A sentence's features are its distinct words and their prefixes of four to six
letters.
The vocabulary is the ``vocabulary`` features that tell the two labels apart
best among the training documents, counted by Spark; features that fewer than
``least`` documents hold are left out. Training sees at most ``max_rows``
labelled documents of at most ``max_chars`` code points in all (documented
bounds, which also bound what the driver holds; see common.training_rows);
scores cover every whole text and depend on nothing else.

Defined cases: null and empty texts have no sentence and score 0; extra columns
are kept, ones with the results' names are replaced; without labelled rows of
both kinds every score is 0; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, parts_of, training_rows

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 200_000


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) >= n)]


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct lower-case words) of each run of text between sentence ends that has words."""
    return [(m.start(), m.end(), words) for m in _SENTENCE.finditer(text or "") if (words := list(dict.fromkeys(_WORD.findall(m[0].lower()))))]


@dataclass
class NoisyOrModel:
    bias: float
    weights: dict[str, float]

    def word_weights(self) -> dict[str, float]:
        """Looks up a word's weight: the sum over its features, kept for words seen before."""
        return _Weights(self.weights)


class _Weights(dict):
    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.of = weights

    def __missing__(self, word: str) -> float:
        w = sum(self.of.get(f, 0.0) for f in word_features(word))
        if len(self) < _CACHE:
            self[word] = w
        return w


def train(
    bags: Sequence[tuple[int, int, Sequence[int], Sequence[int]]], size: int, steps: int = 400, rate: float = 0.08, ridge: float = 0.03, members: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """Bias and weights from (label, number of sentences, sentence of each hit, feature of each hit).

    With ``members``, a hit is a word, and its row of ``members`` has the
    word's features, -1 where there are fewer.
    """
    members = np.arange(size)[:, None] if members is None else members
    members = np.where(members < 0, size, members)  # a place that takes no part
    y = np.array([b[0] for b in bags], float)
    n = np.array([b[1] for b in bags])
    first = np.r_[0, np.cumsum(n)[:-1]].astype(int)
    doc = np.repeat(np.arange(len(bags)), n)
    row = np.concatenate([np.asarray(b[2], int) + f for b, f in zip(bags, first, strict=True)] or [np.zeros(0, int)]).astype(int)
    col = np.concatenate([np.asarray(b[3], int) for b in bags] or [np.zeros(0, int)]).astype(int)
    theta = np.zeros(size + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        word = np.r_[theta[:-1], 0.0][members].sum(axis=1)
        z = theta[-1] + np.bincount(row, word[col], len(doc))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)))
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0)
        d = pull[doc] * p
        per_word = np.bincount(col, d[row], len(members))
        per_feature = np.bincount(members.ravel(), np.repeat(per_word, members.shape[1]), size + 1)[:size]
        g = np.r_[per_feature, d.sum()] / max(1, len(bags))
        g[:-1] -= ridge * theta[:-1] / max(1, len(bags))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return float(theta[-1]), theta[:-1]


class _Codes(dict):
    """A word's features in the vocabulary as one number: 16 bits each, the feature's place plus 1; 0 where it has none."""

    def __init__(self, index: dict[str, int]) -> None:
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> int:
        known = [k for f in word_features(word) if (k := self.index.get(f)) is not None]
        code = sum((k + 1) << 16 * j for j, k in enumerate(known))
        if len(self) < _CACHE:
            self[word] = code
        return code


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, max_chars: int = 64_000_000, vocabulary: int = 4096, least: int = 4) -> NoisyOrModel:
    if not 0 < vocabulary < 1 << 15:
        raise ValueError("a vocabulary has fewer than 32,768 features")
    sample = training_rows(docs, labels, label, max_rows, max_chars).dropDuplicates(["doc_id"])
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return NoisyOrModel(-30.0, {})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b["text"], b["label"], strict=True):
                words = {w for _, _, ws in sentences(text) for w in ws}
                seen[int(y > 0)].update({f for w in words for f in word_features(w)})
            every = sorted(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"feature": every, "pos": [seen[1][f] for f in every], "neg": [seen[0][f] for f in every]})

    counts = sample.mapInPandas(counted, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = (float(kinds.get(k, 0)) for k in (1, 0))
    # signed-root-free likelihood ratio of a feature's split against the labels' shares
    total = F.col("pos") + F.col("neg")
    part = lambda k, share: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (total * share))).otherwise(0.0)
    best = (
        counts.where(total >= least)
        .withColumn("ratio", part("pos", a / (a + b)) + part("neg", b / (a + b)))
        .orderBy(F.desc("ratio"), "feature")
        .limit(vocabulary)
        .select("feature")
        .collect()
    )
    index = {r["feature"]: i for i, r in enumerate(best)}

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code_of = _Codes(index)
        for b in batches:
            out = []
            for doc_id, text, y in zip(b["doc_id"], b["text"], b["label"], strict=True):
                found = sentences(text)
                at = [(i, code) for i, (_, _, ws) in enumerate(found) for w in ws if (code := code_of[w])]
                out.append((doc_id, y, len(found), [i for i, _ in at], [code for _, code in at]))
            yield pd.DataFrame(out, columns=["doc_id", "label", "n", "sentence", "word"])

    bags = sample.mapInPandas(hits, "doc_id long, label int, n int, sentence array<int>, word array<long>").toArrow().sort_by("doc_id").combine_chunks()
    plain = lambda c: bags.column(c).combine_chunks()
    ends = np.r_[0, np.cumsum(pc.list_value_length(plain("sentence")).to_numpy(zero_copy_only=False))].astype(int)
    s, code = (plain(c).flatten().to_numpy(zero_copy_only=False) for c in ("sentence", "word"))
    codes, word = np.unique(code, return_inverse=True)
    members = np.array([(codes >> 16 * j & 0xFFFF) - 1 for j in range(4)]).T.reshape(len(codes), 4)
    each = zip(plain("label").to_pylist(), plain("n").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    bias, weights = train([(int(y > 0), n, s[i:j], word[i:j]) for y, n, i, j in each], len(index), members=members)
    return NoisyOrModel(bias, {f: float(weights[i]) for f, i in index.items()})


def score(docs: DataFrame, model: NoisyOrModel, text: str = "text", out: str = "score", located: str | None = "offending", sentence_threshold: float = 0.5) -> DataFrame:
    """Add the document's probability and, as ``located``, [(start, end, score)] of sentences that reach ``sentence_threshold``.

    Starts and ends count code points; ``located`` None leaves the list out.
    """

    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    @F.arrow_udf("struct<score double, spans array<struct<start int, end int, score double>>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight = model.word_weights()
        for texts in parts_of(batches):
            scores, spans = [], []
            for t in texts.to_pylist():
                found = sentences(t)
                z = np.array([sum(map(weight.__getitem__, ws)) for _, _, ws in found], float) + model.bias
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                scores.append(1 - float(np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))
                spans.append([{"start": a, "end": b, "score": float(q)} for (a, b, _), q in zip(found, p, strict=True) if q >= sentence_threshold])
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], names=["score", "spans"])

    name = fresh("tox", [*docs.columns, out, located or ""])
    scored = docs.withColumn(name, of(F.col(text))).withColumn(out, F.col(f"{name}.score"))
    if located:
        scored = scored.withColumn(located, F.col(f"{name}.spans"))
    return scored.drop(name)


def keep(docs: DataFrame, model: NoisyOrModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with the columns of ``docs``, whatever their names."""
    name = fresh("toxic", docs.columns)
    return score(docs, model, text, name, None).where(F.col(name) < threshold).select(*docs.columns)
