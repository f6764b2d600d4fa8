"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from numpy passes over the whole texts.  Trees are grown
on a bounded sample of labelled rows (``FIT_ROWS``): every feature is cut into
bins at quantiles, gradients are summed by bin, and each tree takes the split
of greatest gain at every node of a level.  All trees are flattened into arrays
(feature, threshold, value by heap position) that score a batch with as many
numpy steps as a tree is deep.

Cases: a null or empty text has all statistics 0 and is scored as such;
repeated rows are scored each; labels that are null, or of no document, are
left out, of repeated labels of a doc_id the greatest counts, and of rows that
share a labelled doc_id the one with the least statistics; of splits of equal
gain the first feature and lowest threshold wins; very long texts are measured
whole, a few megabytes of text at a time (one text may have more); an empty table
gives an empty result; without two
classes among the labels every score is the share of 1 among them (0.5 without
labels); doc_id null is held in (it has no remainder); other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import Scratch
from ledgerlark.llm.wordhash import buffers, hash_spans, slices, tidy, word_hashes
from ledgerlark.llm.wordhash import words as split_words

#: At most about so many labelled rows fit the trees.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST, L2 = 80, 4, 64, 0.15, 10.0, 1.0
CUTOFF = 0.3

_NAMES = ("upper", "lower", "digit", "high", "blank", "newline", "stop", "comma", "mark", "bar", "symbol", "dash", "bracket", "other")
_CLASS = np.full(256, 13, np.uint8)
for _i, _set in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "", " \t", "\n\r", ".", ",;:", "!?", "|", "#$%&*@^~+=", "-_/\\", "()[]{}<>'\"`"]):
    _CLASS[[ord(_c) for _c in _set]] = _i
_CLASS[128:] = 3
_SPLIT_LINES = np.zeros(256, bool)
_SPLIT_LINES[10] = True
FEATURES = (*(f"{n}_share" for n in _NAMES), "log_bytes", "log_words", "word_bytes", "distinct_words", "most_common_word", "log_lines", "distinct_lines", "line_words", "capital_words", "end_marked_words", "class_changes", "longest_word", "short_words", "neighbour_repeats")


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    body, at = buffers(column)
    n, k = len(column), len(_NAMES)
    size = np.diff(at)
    cls = _CLASS[body]
    out = np.zeros((n, len(FEATURES)), np.float64)
    owner = np.repeat(np.arange(n), size)
    share = np.bincount(owner * k + cls, minlength=n * k).reshape(n, k) if n else np.zeros((0, k))
    whole = np.maximum(size, 1)
    out[:, :k] = share / whole[:, None]
    hashed, w = word_hashes(body, at)
    words = np.diff(w)
    lines, ln = _line_hashes(body, at)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(words)
    out[:, k + 2] = (size - share[:, 4] - share[:, 5]) / np.maximum(words, 1) if n else 0
    changed = np.zeros(len(body), bool)
    changed[1:] = cls[1:] != cls[:-1]
    changed[at[:-1][size > 0]] = False  # not across two texts
    out[:, k + 10] = np.bincount(owner, weights=changed, minlength=n)[:n] / whole
    starts, ends = split_words(body, at)
    word_owner = np.repeat(np.arange(n), words)
    length = ends - starts
    many = np.maximum(words, 1)
    if len(starts):
        out[:, k + 8] = np.bincount(word_owner, weights=cls[starts] == 0, minlength=n) / many
        out[:, k + 9] = np.bincount(word_owner, weights=np.isin(cls[ends - 1], (6, 8, 10)), minlength=n) / many
        np.maximum.at(out[:, k + 11], word_owner, np.log1p(length))
        out[:, k + 12] = np.bincount(word_owner, weights=length <= 3, minlength=n) / many
        same = np.zeros(len(hashed), bool)
        same[1:] = hashed[1:] == hashed[:-1]
        same[w[:-1][words > 0]] = False
        out[:, k + 13] = np.bincount(word_owner, weights=same, minlength=n) / many
    out[:, k + 5] = np.log1p(np.diff(ln))
    out[:, k + 7] = words / np.maximum(np.diff(ln), 1)
    for i, (a, b, c, d) in enumerate(zip(w[:-1].tolist(), w[1:].tolist(), ln[:-1].tolist(), ln[1:].tolist())):
        if b > a:
            s = np.sort(hashed[a:b])
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            out[i, k + 3] = (len(edge) - 1) / (b - a)
            out[i, k + 4] = np.diff(edge).max() / (b - a)
        if d > c:
            out[i, k + 6] = len(np.unique(lines[c:d])) / (d - c)
    return out


def _line_hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = split_words(body, at, _SPLIT_LINES)
    return hash_spans(body, starts, ends, lower=False), np.searchsorted(starts, at)


@dataclass
class Trees:
    """All trees as arrays: node i of a level's heap has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    column = np.arange(m) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (m * BINS) + column + binned).ravel()
            shape = (width, m, BINS)
            hg = np.bincount(slot, weights=np.repeat(g, m), minlength=width * m * BINS).reshape(shape)
            hh = np.bincount(slot, weights=np.repeat(h, m), minlength=width * m * BINS).reshape(shape)
            lg, lh = hg.cumsum(2), hh.cumsum(2)
            tg, th = lg[:, :, -1:], lh[:, :, -1:]
            rg, rh = tg - lg, th - lh
            gain = lg**2 / (lh + L2) + rg**2 / (rh + L2) - tg**2 / (th + L2)
            gain[(lh < LEAST / 4) | (rh < LEAST / 4)] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                j, cut = divmod(int(b), BINS)
                if gain[i, j, cut] > 1e-9 and cut < len(cuts[j]):
                    feature[first + i], threshold[first + i] = j, cuts[j][cut]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + L2)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


@tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x = statistics(part.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "x"])


def score_quality(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out: their labels are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "quality")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    x = scratch.save(docs.mapInArrow(_measure, "doc_id long, x array<float>"), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = scratch.save(known, "labels")
    share = min(1.0, fit_rows / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    table = x.join(few, "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()
    table = table.sort_values("doc_id", kind="stable")
    model = fit(np.array(table["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES)), table["quality"].to_numpy(dtype=np.float64))
    sent = spark.sparkContext.broadcast(model)

    def predict(batches):  # noqa: ANN001, ANN202
        trees = sent.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.scores(own))], names=["doc_id", "score"])

    out = x.mapInArrow(predict, "doc_id long, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
