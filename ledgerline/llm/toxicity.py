"""Toxicity by multiple-instance learning: sentence scores joined by a noisy-or, learned from document labels."""

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .common import chunks, mapped, texts

#: A sentence ends after a run of these marks or at a line break; words are runs of letters.
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features beside the word itself.
STEMS = range(4, 9)

SPANS = "array<struct<start int, length int, score double, text string>>"


class Model(NamedTuple):
    """Logit of a sentence: bias and the weights of its distinct features."""

    features: tuple[str, ...]
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is kept from learning: CRC-32 of its identifier as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def training_labels(labels: DataFrame, max_docs: int, learn: Column) -> DataFrame:
    """doc_id, toxic of at most `max_docs` labelled documents for learning, in the order of a hash; null labels do
    not count and a document with several labels is toxic if one of them says so."""
    return (
        labels.filter(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        .select(F.col("doc_id").alias("__id"), "toxic")
    )


def features_of(words: set[str]) -> set[str]:
    """The words, and the beginnings of longer ones marked by a hyphen."""
    return words | {word[:n] + "-" for word in words for n in STEMS if len(word) > n}


def sentences(text: bytes) -> list[tuple[int, int, set[str]]]:
    """Start and length in code points, and distinct lower-case words, of each sentence that has a word."""
    out = []
    for m in SENTENCE.finditer(text.decode()):
        words = WORD.findall(m[0].lower())
        if words:
            out.append((m.start(), m.end() - m.start(), set(words)))
    return out


class Finder:
    """The chosen features of words; each distinct word is looked at once."""

    def __init__(self, features):
        self.place = {w: i for i, w in enumerate(features)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, words: set[str]) -> set[int]:
        if len(self.known) > 100_000:
            self.known.clear()
        out: set[int] = set()
        for word in words:
            hits = self.known.get(word)
            if hits is None:
                hits = self.known[word] = tuple(self.place[f] for f in features_of({word}) if f in self.place)
            if hits:
                out.update(hits)
        return out


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, toxic, clean: in how many learning documents of either kind a feature stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=2 << 20):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(texts(batch), batch.column(batch.schema.get_field_index("toxic")).to_pylist()):
                counts[toxic > 0].update(features_of(set(WORD.findall(text.decode().lower()))))
            names = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(names, pa.string()), "toxic": pa.array([counts[1][w] for w in names], pa.int64()),
                "clean": pa.array([counts[0][w] for w in names], pa.int64())})

    return mapped(rows.select("text", "toxic"), run, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_features(rows: DataFrame, known: DataFrame, size: int, min_share: float, min_lift: float) -> list[str]:
    """The features whose share among toxic documents lies furthest above that among clean ones, in standard errors."""
    totals = known.selectExpr("count_if(toxic > 0) as t", "count_if(toxic <= 0) as c").first()
    t, c = float(max(1, totals["t"])), float(max(1, totals["c"]))
    share = (F.col("toxic") + F.col("clean")) / (t + c)
    lift = (F.col("toxic") / t - F.col("clean") / c) / F.sqrt(share * (1 - share) * (1 / t + 1 / c) + 1e-9)
    best = feature_counts(rows).filter(F.col("toxic") >= max(3.0, min_share * t)).withColumn("lift", lift).filter(F.col("lift") >= min_lift)
    return [r["feature"] for r in best.orderBy(F.desc("lift"), "feature").limit(size).select("feature").collect()]


def bags(rows: DataFrame, features: list[str]) -> list:
    """Per learning document: its label, sentences without a chosen feature, and the chosen features of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(features)
        for batch in chunks(batches):
            plain, found = [], []
            for text in texts(batch):
                hits = [sorted(find(words)) for _, _, words in sentences(text)]
                plain.append(sum(not h for h in hits))
                found.append([h for h in hits if h])
            yield pa.RecordBatch.from_pydict({
                "toxic": batch.column(batch.schema.get_field_index("toxic")).cast(pa.int32()),
                "plain": pa.array(plain, pa.int32()), "found": pa.array(found, pa.list_(pa.list_(pa.int32())))})

    return mapped(rows.select("text", "toxic"), run, "toxic int, plain int, found array<array<int>>").collect()


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit_noisy_or(bags: list, size: int, rounds: int = 300, rate: float = 0.1, penalty: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of the document labels.

    With p = sigmoid(z) for each sentence the noisy-or 1 - prod(1 - p) equals 1 - exp(-S) for S = sum softplus(z);
    full-batch gradient steps with per-weight scaling (Adam) and a quadratic penalty."""
    label = np.array([b["toxic"] > 0 for b in bags], bool)
    plain = np.array([b["plain"] for b in bags], float)
    flat = [(i, s) for i, b in enumerate(bags) for s in b["found"]]
    bag = np.array([i for i, _ in flat], np.int64)
    lengths = np.array([len(s) for _, s in flat], np.int64)
    word = np.array([w for _, s in flat for w in s], np.int64)
    row = np.repeat(np.arange(len(flat)), lengths)
    x = np.append(np.zeros(size), -5.0)
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        z = x[-1] + np.bincount(row, x[word], len(flat))
        total = np.bincount(bag, softplus(z), len(bags)) + plain * softplus(x[-1])
        slope = np.where(label, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / max(1, len(bags))
        by_sentence = slope[bag] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, by_sentence[row], size), by_sentence.sum() + (slope * plain).sum() / (1 + np.exp(-x[-1])))
        grad[:-1] += penalty * x[:-1] / max(1, len(bags))
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        x -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return x[:-1], float(x[-1])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, vocabulary: int = 1_000, min_share: float = 0.05,
          min_lift: float = 4.0, learn: Column | None = None) -> Model:
    """Learn from at most `max_docs` labelled documents (whole texts): the features and then the noisy-or weights.

    `learn` says which labels may be used, by default those that are not held out.  The learning documents are
    found by a broadcast of at most `max_docs` identifiers.  A feature must stand in `min_share` of the toxic
    documents (copies of one document shall not make a feature) and be `min_lift` standard errors more frequent there.  Without labels of both kinds, or without such a
    feature, the model has none and a low bias, so every score is near 0."""
    known = training_labels(labels, max_docs, ~held_out(F.col("doc_id")) if learn is None else learn)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("text", "toxic")
    features = choose_features(rows, known, vocabulary, min_share, min_lift)
    got = bags(rows, features)
    if not features or len({b["toxic"] > 0 for b in got}) < 2:
        return Model((), np.zeros(0), -20.0)
    weights, bias = fit_noisy_or(got, len(features))
    return Model(tuple(features), weights, bias)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, sentence_threshold: float = 0.5) -> DataFrame:
    """All columns of `docs` with score (double), predicted (int), n_sentences (long) and offending (SPANS).

    Reads `text`; columns of the new names are replaced, all others pass through.  score is the noisy-or of the
    sentences of the whole text, 0 without any (null and empty texts); predicted is 1 from `threshold` on; offending
    lists the sentences with a probability of `sentence_threshold` or more, with start and length in code points."""
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.LongType()),
           T.StructField("offending", T._parse_datatype_string(SPANS))]
    names = [c for c in docs.columns if c not in [f.name for f in new]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, weight, bias = Finder(model.features), model.weights.tolist(), model.bias
        plain = float(softplus(np.float64(bias)))
        for batch in chunks(batches):
            scores, counts, spans = [], [], []
            for text in texts(batch):
                found, total, whole = [], 0.0, text.decode()
                parts = sentences(text)
                for start, length, words in parts:
                    hits = find(words)
                    if hits:
                        z = bias + sum([weight[i] for i in hits])
                        total += float(softplus(np.float64(z)))
                        p = float(1 / (1 + np.exp(-z)))
                        if p >= sentence_threshold:
                            found.append({"start": start, "length": length, "score": p, "text": whole[start : start + length]})
                    else:
                        total += plain
                scores.append(float(-np.expm1(-total)))
                counts.append(len(parts))
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                 pa.array(counts, pa.int64()), pa.array(spans, kind)], names=[*names, *[f.name for f in new]])

    return mapped(docs.select(*names), run, T.StructType([docs.schema[c] for c in names] + new))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that a model learned from `labels` does not call toxic, with all their columns."""
    return score_toxicity(docs, train(docs, labels)).filter("predicted = 0").select(*docs.columns)
