"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from meterlake.llm.bpe import Memo
from meterlake.llm.common import column, id_and_text, slices, whole_row

#: Hashed features; weights are 8 bytes each, so a broadcast model never exceeds 12 MB.
BUCKETS = 1 << 20
#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
#: FTRL-proximal: learning rate, its smoothing, L1, L2, passes over the sample, weight of a toxic example.
ALPHA, BETA, L1, L2, PASSES, TOXIC_WEIGHT = 2.0, 1.0, 10.0, 0.0, 6, 3.0

_WORD = re.compile(r"[^\W_]+")
#: Odd multipliers of the left and the right word of a unigram, a bigram and a skip-gram.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def word_hashes() -> Memo:
    """Hashes of words, kept for one task only, so that an idle worker holds no words."""
    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), 150_000)


def hashed_features(texts: list[str], buckets: int = BUCKETS, words: Memo | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) pairs of ``texts``: words, word pairs and pairs with one word left out, hashed into ``buckets``."""
    get, parts = (words if words is not None else word_hashes()).__getitem__, []
    for text in texts:
        found = _WORD.findall(text.lower())
        parts.append(np.fromiter(map(get, found), np.uint64, len(found)))
    sizes = [len(p) for p in parts]
    h, row = np.concatenate([*parts, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(texts)), sizes)
    found, rows = [h * _MIX[0]], [row]
    for gap, (a, b) in ((1, _MIX[1:3]), (2, _MIX[3:5])):
        same = row[:-gap] == row[gap:]
        found.append((h[:-gap] * a + (h[gap:] ^ (h[gap:] >> np.uint64(29))) * b)[same])
        rows.append(row[:-gap][same])
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    return (np.concatenate(found) >> shift).astype(np.int64), np.concatenate(rows)


def train_ftrl(examples: list[tuple[np.ndarray, int]], buckets: int = BUCKETS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, passes: int = PASSES, toxic_weight: float = TOXIC_WEIGHT) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias): FTRL-proximal over ``examples`` (distinct features, label 0 or 1) in the given order.

    Each coordinate has its own rate, from the sum of its squared gradients; L1 leaves most weights at exactly zero.
    The bias is a coordinate without L1.
    """
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for _ in range(passes):
        for features, label in examples:
            at = np.append(features, np.int32(buckets))
            zi, ni = z[at], n[at]
            penalty = np.full(len(at), l1)
            penalty[-1] = 0.0
            w = np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1.0 / (1.0 + np.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
            g *= toxic_weight if label else 1.0
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    penalty = np.full(buckets + 1, l1)
    penalty[-1] = 0.0
    w = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.flatnonzero(w[:buckets])
    return kept, w[kept], float(w[buckets])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits on at most ``sample_rows`` labelled documents and returns the sparse weights.

    ``labels`` (doc_id, toxic): only rows whose crc32 of the id as text leaves a remainder other than 0 by 5 are used;
    null labels and ids are left out, and of several labels of an id the greatest counts; labels of ids that ``docs``
    doesn't have take no part in the sample. Of several texts of an id the one with the smallest hash counts, so the
    sample never has more rows than ids. The sample of ids (16 bytes a row) is broadcast to the scan of ``docs``;
    features are hashed where the texts are, and one task learns from the bounded sample, in order of a hash of the id.
    Without labelled rows the model is empty: every score is 0.5.
    """
    key = F.col("doc_id").cast("long")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(key)).join(docs.select(key.alias("present")), key == F.col("present"), "left_semi")
    sample = usable.groupBy(key.alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
    chosen = id_and_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic", F.xxhash64("text").alias("text_hash"))

    def hashed(batches):
        words = word_hashes()
        for batch in slices(batches):
            features, rows = hashed_features(batch.column(1).to_pylist(), buckets, words)
            order = np.argsort(rows, kind="stable")
            cuts = np.searchsorted(rows[order], np.arange(1, batch.num_rows))
            each = [np.unique(x).astype(np.int32) for x in np.split(features[order], cuts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(each, pa.list_(pa.int32()))], ["doc_id", "toxic", "text_hash", "features"])

    def learn(batches):
        examples = []
        for batch in batches:
            found = (f.values.to_numpy() for f in batch.column(2))  # views of the batch, not copies
            examples += zip(batch.column(0).to_pylist(), found, batch.column(1).to_pylist())
        examples.sort(key=lambda x: (xxhash.xxh64_intdigest(str(x[0])), x[0]))
        features, weights, bias = train_ftrl([x[1:] for x in examples], buckets) if examples else (np.zeros(0, np.int64), np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([*features.tolist(), buckets], pa.int32()), pa.array([*weights.tolist(), bias], pa.float64())], ["feature", "weight"])

    examples = chosen.mapInArrow(hashed, "doc_id long, toxic int, text_hash long, features array<int>")
    first = examples.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "features"), "text_hash").alias("e")).select("doc_id", "e.*")  # combined where the texts are
    learned = first.repartition(1).mapInArrow(learn, "feature int, weight double").collect()
    bias = [r.weight for r in learned if r.feature == buckets]
    weights = sorted((r.feature, r.weight) for r in learned if r.feature != buckets)
    return np.array([w[0] for w in weights], np.int64), np.array([w[1] for w in weights], np.float64), bias[0] if bias else 0.0


def held_out(doc_id):
    """True for ids whose crc32 as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], buckets: int = BUCKETS, name: str = "toxicity") -> DataFrame:
    """``docs`` with the score ``name`` (double, 0 to 1). Narrow; the compact weights are broadcast, at most 16 bytes a bucket.

    Null and empty texts score by the bias alone. Rows that repeat score alike. A column of that name is replaced.
    """
    features, weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((features.astype(np.int32), weights))
    kept: dict[str, np.ndarray] = {}

    def run(batches):
        if "w" not in kept:
            kept["w"] = w = np.zeros(buckets)
            w[shared.value[0]] = shared.value[1]
        words = word_hashes()
        for batch in slices(batches):
            texts = batch.column(0).field("text").to_pylist()
            found, rows = hashed_features([t or "" for t in texts], buckets, words)
            hit = np.flatnonzero(kept["w"][found])
            pairs = np.unique(rows[hit] * buckets + found[hit])  # a feature counts once in a text
            score = bias + np.bincount(pairs // buckets, weights=kept["w"][pairs % buckets], minlength=batch.num_rows)
            p = 1.0 / (1.0 + np.exp(-np.clip(score, -35.0, 35.0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["row", "score"])

    packed = docs.select(whole_row(docs, [c for c in docs.columns if c != name]).alias("row"))
    schema = packed.schema["row"].dataType
    return packed.mapInArrow(run, StructType().add("row", schema).add("score", DoubleType())).select("row.*", F.col("score").alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; see ``fit_toxicity`` and ``score_toxicity``."""
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_toxicity(docs, labels, sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with its columns unchanged; all rows if nothing was learned.

    Null and empty texts score by the bias alone; ids may be null and repeat; equal texts are kept or go alike; an empty
    table gives none; a score of exactly ``threshold`` goes.
    """
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    model = fit_toxicity(docs, labels)
    if not len(model[0]) and model[2] == 0.0:
        return docs
    scored = score_toxicity(docs, model, name=name)
    return scored.where(F.col(name) < threshold).select(*map(column, docs.columns))
