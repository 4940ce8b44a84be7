"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters of a lower-cased text stay, every stretch of anything else becomes one
gap, and the n-grams of one to ``longest`` of these characters are hashed to
``buckets`` places. A text's vector has (1 + log tf) * idf at each place that
occurs in it, with length 1. idf comes from the number of documents with that
place among **all** documents to learn from, counted by Spark.

The weights of every language are learned by follow-the-regularised-leader
(per-coordinate steps) with an elastic net: l1 makes them sparse, l2 small. A
temperature, fitted on a fifth of the sample that the weights don't see, then
calibrates the probabilities; the score is the largest of them.

Weights and temperature see a bounded sample: at most ``max_rows`` documents,
dealt evenly to the ``max_languages`` most frequent languages (a language that
has fewer leaves the rest to the others), and of these as many, smallest hashes
first, as have ``max_entries`` places in all; a text has at most ``buckets``
places, so that none is too long. These are documented bounds of what the
driver holds; rows with a null language or id are not learned from. Copies
alike in id and text count once in the sample.

Defined cases: a null text, or one without a letter, is of language ``und`` with
score 0, as is every text if there was nothing to learn from; with one language
alone every other text is of it, with score 1; ties go to the language that
sorts first; very long texts are scored whole, by windows; repeated rows score
alike; extra columns stay, ones with a result's name are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, tidied
from .words import parts_by_bytes

UNKNOWN = "und"
_GAP = 32
_WINDOW = 1 << 20  # code points of one text at once
_TOGETHER = 1 << 17  # code points of texts counted together
_PART = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd; spreads codes over the upper bits


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def places(chars: np.ndarray, longest: int, buckets: int, old: int = 0) -> np.ndarray:
    """The bucket of every n-gram, n from 1 to ``longest``, that ends after the first ``old`` characters."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    code, out = np.zeros(len(chars), np.uint64), []
    for n in range(1, min(longest, len(chars)) + 1):
        code = (code[: len(chars) - n + 1] + chars[n - 1 :] + np.uint64(n)) * _MIX
        out.append((code[max(0, old - n + 1) :] >> shift).astype(np.int64))
    return np.concatenate(out)


def counted(text: str | None, longest: int, buckets: int, window: int = _WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, ascending; how often each occurs) in a whole text, by windows; nothing without a letter.

    Letters, lower-case, stay, with one gap before, between and after stretches of them.
    """
    text = text or ""
    total, tail, old, letters = np.zeros(buckets, np.int64), np.array([_GAP], np.uint64), 0, 0
    for a in range(0, len(text), window):
        points = np.frombuffer(text[a : a + window].lower().encode("utf-32-le"), "<u4")
        letter = _letters()[points]
        letters += int(letter.sum())
        last = a + window >= len(text)
        chars = np.concatenate([tail, np.where(letter, points, _GAP), [_GAP] * last], dtype=np.uint64, casting="unsafe")
        gap = chars == _GAP
        gap[1:] &= gap[:-1]
        gap[0] = False
        chars = chars[~gap]
        total += np.bincount(places(chars, longest, buckets, old), minlength=buckets)
        tail = chars[-(longest - 1) :] if longest > 1 else chars[:0]
        old = len(tail)
    at = np.flatnonzero(total) if letters else np.zeros(0, np.int64)
    return at, total[at]


def counted_each(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, places, counts): what counted() gives each text, one after the other; long texts one by one, the others together."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(texts):
        z, size = a, 0
        while z < len(texts) and (size := size + len(texts[z] or "")) <= _TOGETHER:
            z += 1
        if z == a:
            at, n = counted(texts[a], longest, buckets)
            parts.append((np.array([len(at)]), at, n))
            a += 1
        else:
            parts.append(_counted_together([(t or "").lower() for t in texts[a:z]], longest, buckets))
            a = z
    sizes, at, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    return np.cumsum(sizes), at, n


def _counted_together(lower: list[str], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of places, places, counts) of each text: n-grams of all texts are sorted by text and place."""
    bits = buckets.bit_length() - 1
    points = np.frombuffer(f" {'  '.join(lower)} ".encode("utf-32-le"), "<u4")
    doc = np.repeat(np.arange(len(lower), dtype=np.uint32), np.array([len(t) + 2 for t in lower]))
    chars = np.where(_letters()[points], points, _GAP).astype(np.uint64)
    gap = chars == _GAP
    keep = ~(gap[1:] & gap[:-1] & (doc[1:] == doc[:-1]))
    chars, doc = chars[np.concatenate([[True], keep])], doc[np.concatenate([[True], keep])]
    has = np.bincount(doc, minlength=len(lower)) > 1  # more than a gap
    code, keys = np.zeros(len(chars), np.uint64), []
    for n in range(1, min(longest, len(chars)) + 1):
        code = (code[: len(chars) - n + 1] + chars[n - 1 :] + np.uint64(n)) * _MIX
        first, last = doc[: len(code)], doc[n - 1 :]
        key = (code >> np.uint64(64 - bits)) | first.astype(np.uint64) << np.uint64(bits)
        keys.append(key[(first == last) & has[first]])
    keys = np.concatenate(keys)
    if len(lower) << bits <= 1 << 32:
        keys = keys.astype(np.uint32)  # sorts faster
    keys.sort()
    new = np.flatnonzero(np.concatenate([[True] * min(1, len(keys)), keys[1:] != keys[:-1]]))
    found = keys[new].astype(np.int64)
    return np.bincount(found >> bits, minlength=len(lower)), found & buckets - 1, np.diff(np.append(new, len(keys)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # places by languages
    bias: np.ndarray
    longest: int
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[at]
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and score."""
        ends, at, n = counted_each(texts, self.longest, len(self.idf))
        known = np.flatnonzero(np.diff(ends, prepend=0))
        if not len(known) or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        first = ends[known] - np.diff(ends, prepend=0)[known]
        v = (1 + np.log(n)) * self.idf[at]
        size = np.maximum(np.sqrt(np.add.reduceat(v * v, first)), 1e-12)
        logits = np.stack([np.add.reduceat(v * w[at], first) / size for w in self.weights.T], axis=1) + self.bias
        p = _softmax(logits / self.temperature)
        names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        names[known] = np.array(self.languages, object)[p.argmax(axis=1)]
        scores[known] = np.minimum(1.0, p.max(axis=1))
        return names.tolist(), scores


class Leader:
    """Follow-the-regularised-leader for a softmax over ``k`` classes: per-coordinate rates, l1 and l2."""

    def __init__(self, size: int, k: int, rate: float = 0.5, steady: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros((size + 1, k)), np.zeros((size + 1, k))  # the last row is the bias
        self.rate, self.steady, self.l1, self.l2 = rate, steady, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.sign(z) * -np.maximum(np.abs(z) - self.l1, 0) / ((self.steady + np.sqrt(self.n[at])) / self.rate + self.l2)

    def learn(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        at, v = np.append(at, len(self.z) - 1), np.append(v, 1.0)
        w = self.weights(at)
        p = _softmax(v @ w)
        p[y] -= 1
        g = v[:, None] * p
        had = self.n[at]
        now = had + g * g
        self.z[at] += g - (np.sqrt(now) - np.sqrt(had)) / self.rate * w
        self.n[at] = now


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature, 0.05 to 20, that makes the labels likeliest, by golden sections of its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    a, b = np.log(0.05), np.log(20.0)
    ratio = (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, longest: int, epochs: int = 4, seed: int = 1, **net: float) -> LanguageModel:
    """Weights from four fifths of (places, counts, language), the temperature from the others."""
    languages = sorted({r[2] for r in rows})
    model = LanguageModel(languages, idf, np.zeros((len(idf), len(languages)), np.float32), np.zeros(len(languages)), longest)
    if len(languages) < 2:
        return model
    index = {x: k for k, x in enumerate(languages)}
    data = [(at, model.vector(at, n), index[x]) for at, n, x in rows]
    apart = len(data) >= 50  # with fewer, the temperature sees what the weights see
    kept = [i for i in range(len(data)) if not (apart and i % 5 == 4)]
    leader = Leader(len(idf), len(languages), **net)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(kept):
            leader.learn(*data[i])
    w = leader.weights()
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    apart_rows = [i for i in range(len(data)) if i % 5 == 4] if apart else kept
    logits = np.array([data[i][1] @ model.weights[data[i][0]] + model.bias for i in apart_rows])
    model.temperature = fit_temperature(logits, np.array([data[i][2] for i in apart_rows]))
    return model


def learnable(folds: int = 4, fold: int = 2, doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from: not of the fold held out, and with an id."""
    return F.col(doc_id).isNotNull() & (F.crc32(F.col(doc_id).cast("string")) % folds != fold)


def document_counts(docs: DataFrame, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents with each place; a task adds up what it sees, Spark adds up the tasks."""

    @tidied
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(buckets, np.int64)
        for b in batches:
            for part in parts_by_bytes(b.column(0).cast(pa.string()), _PART):
                total += np.bincount(counted_each(part.to_pylist(), longest, buckets)[1], minlength=buckets)
                n += len(part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], names=["place", "n"])

    found = docs.select("text").mapInArrow(seen, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = (found.column(c).to_numpy() for c in ("place", "n"))
    out = np.zeros(buckets, np.int64)
    out[place[place >= 0]] = n[place >= 0]
    return int(n[place < 0].sum()), out


def quotas(counts: dict[str, int], max_rows: int) -> dict[str, int]:
    """Rows of each language: even shares; what one lacks goes to the others."""
    out, left = {}, max_rows
    for k, (x, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        out[x] = min(n, left // (len(counts) - k))
        left -= out[x]
    return {x: n for x, n in out.items() if n}


def sample(docs: DataFrame, counts: dict[str, int], max_rows: int, max_entries: int, longest: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """(places, counts, language) of the rows to train on, dealt over the languages in turn."""
    share = quotas(counts, max_rows)
    if not share:
        return []
    top = 1 << 40
    # about a quarter more than each language's rows, by hash; then exactly its rows among these
    limits = docs.sparkSession.createDataFrame([(x, n, min(top, int(top * (1.25 * n + 20) / counts[x]))) for x, n in share.items()], "lang string, quota long, below long")
    hashed = docs.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).join(F.broadcast(limits), "lang").where(F.pmod("h", F.lit(top)) < F.col("below"))
    distinct = cut(hashed.groupBy("lang", "h").agg(F.min("text").alias("text"), F.min("quota").alias("quota")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(top)), "h"))

    @tidied
    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 200):
                part = b.slice(k, 200)
                ends, at, n = counted_each(part.column("text").to_pylist(), longest, buckets)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (at, n)]
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("turn"), part.column("h"), *lists, pa.array(np.diff(ends, prepend=0))], names=["lang", "turn", "h", "at", "n", "size"])

    keys = distinct.select("lang", "h", turn.alias("turn"), "quota").where(F.col("turn") <= F.col("quota")).drop("quota")
    chosen = distinct.select("lang", "h", "text").join(F.broadcast(keys), ["lang", "h"]).select("lang", "turn", "h", "text")
    rows = cut(chosen.mapInArrow(counts_of, "lang string, turn int, h long, at array<int>, n array<int>, size long").where(F.col("size") > 0))
    # one window over max_rows short rows at most
    order = Window.orderBy("turn", "lang", "h")
    fit = rows.select("lang", "turn", "h", F.sum("size").over(order).alias("sum")).where(F.col("sum") <= max_entries).select("lang", "turn", "h")
    found = rows.join(F.broadcast(fit), ["lang", "turn", "h"], "left_semi").toArrow().sort_by([("turn", "ascending"), ("lang", "ascending"), ("h", "ascending")])
    lists = {c: found.column(c).combine_chunks() for c in ("at", "n")}
    ends = lists["at"].offsets.to_numpy()
    flat = {c: x.values.to_numpy() for c, x in lists.items()}
    return [(flat["at"][a:z], flat["n"][a:z], x) for a, z, x in zip(ends[:-1], ends[1:], found.column("lang").to_pylist(), strict=True)]


def fit(
    docs: DataFrame, max_rows: int = 6_000, max_languages: int = 1_000, max_entries: int = 16_000_000, longest: int = 3, buckets: int = 1 << 16, **options,
) -> LanguageModel:
    """Fit on (doc_id, text, lang) of the rows that may be learned from (see learnable())."""
    if buckets & buckets - 1 or not 1 < buckets <= 1 << 24:
        raise ValueError("buckets must be a power of two, at most 2^24")
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").where(learnable() & F.col("lang").isNotNull())
    # as many rows as there are languages, cut at max_languages, come to the driver
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    total, seen = document_counts(known, longest, buckets)
    idf = np.log((1 + total) / (1 + seen)) + 1
    return train(sample(known, counts, max_rows, max_entries, longest, buckets), idf, longest, **options)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the likeliest language and its calibrated probability to every row."""

    @F.arrow_udf("struct<lang string, score double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = [model.predict(part.to_pylist()) for part in parts_by_bytes(texts.cast(pa.string()), _PART)]
            names, scores = (np.concatenate(x) for x in zip(*done, strict=True)) if done else ([], [])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    name = fresh("language", [*docs.columns, out, score])
    return docs.withColumn(name, of(F.col(text))).withColumns({out: F.col(f"{name}.lang"), score: F.col(f"{name}.score")}).drop(name)
