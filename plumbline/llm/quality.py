"""Quality rules: gradient-boosted trees over document statistics.

The statistics of every whole text come first, and fixed base rules on them: a text with fewer than 20
words, or with more than 30 % of its words in repeated eight-word windows, fails. The rest is judged by a
boosted ensemble of depth-limited trees for logistic loss, flattened into numpy node arrays so that a
batch of documents descends all trees at once. On the features in ``MONOTONE`` the score may only
rise (+1) or only fall (-1): a split is allowed only if its sides are ordered so, and the values of
later splits are kept between the bounds that earlier ones set.

The ensemble is fitted on at most about ``TRAIN_DOCS`` labelled documents, chosen by a hash of their id;
all statistics and verdicts cover all documents.

Defined results for odd input: null and empty texts have no words and fail the base rules. Labels that
are null, or whose document is missing, are ignored; of a document's labels, and of an id's rows, any may be learned from. Repeated rows are judged row by row. With
no labels, or labels of one kind, the base rules decide alone. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import binary_column, ranges, slices, ready, texts

#: Bound of the labelled sample that the trees are fitted on.
TRAIN_DOCS = 20_000
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Share of good documents' odds at which a document is kept.
KEEP_FROM = 0.5
FEATURES = ["log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "stop_rate", "line_words", "end_rate", "distinct_rate"]
#: Repetition and symbols can only lower the score.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1}
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_TAIL = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_ENDS = b".!?"


def _repeated(words: list[list[bytes]], counts: np.ndarray) -> np.ndarray:
    """For each text, how many words lie in eight-word windows that it has twice or more."""
    out = np.zeros(len(words), np.int64)
    sizes = np.maximum(counts - WINDOW + 1, 0)
    if not sizes.sum():
        return out
    flat = np.fromiter((hash(w) for ws in words for w in ws), np.int64, int(counts.sum())).view(np.uint64)
    at = ranges(np.cumsum(counts) - counts, sizes)
    doc = np.repeat(np.arange(len(words)), sizes)
    full = doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(WINDOW):
        full = full * np.uint64(0x9E3779B97F4A7C15) + flat[at + j]
    full = (full ^ (full >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(full, kind="stable")
    same = full[order][1:] == full[order][:-1]
    again = np.zeros(len(full), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(flat) + 1, np.int64)
    np.add.at(hit, at[again], 1)
    np.add.at(hit, at[again] + WINDOW, -1)
    covered = np.append(0, np.cumsum(np.cumsum(hit[:-1]) > 0))
    ends = np.cumsum(counts)
    return covered[ends] - covered[ends - counts]


def statistics(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Base counts [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and the features of each text."""
    words = [t.split() for t in parts]
    counts = np.array([len(w) for w in words], np.int64)
    base = np.zeros((len(parts), 5), np.int64)
    base[:, 0], base[:, 4] = counts, _repeated(words, counts)
    more = np.zeros((len(parts), 6))
    for i, (t, ws) in enumerate(zip(parts, words, strict=True)):
        chars = t.translate(None, _TAIL)
        base[i, 1] = len(chars.translate(None, _SPACE))
        base[i, 2] = len(t) - len(t.translate(None, _SYMBOLS))
        lines = t.split(b"\n")
        if len(set(lines)) < len(lines):
            full = [x for x in lines if x.strip(_SPACE)]
            base[i, 3] = len(full) - len(set(full))
        distinct = set(ws)
        more[i] = (len(t) - len(t.translate(None, _UPPER)), len(t) - len(t.translate(None, _DIGIT)), sum(map(_short, ws)), len(lines), len(t) - len(t.translate(None, _ENDS)), len(distinct))
    n, chars = np.maximum(counts, 1), np.maximum(base[:, 1], 1)
    features = np.stack([np.log1p(counts), base[:, 1] / n, base[:, 2] / chars, base[:, 3] / np.maximum(more[:, 3], 1), base[:, 4] / n, more[:, 0] / chars, more[:, 1] / chars, more[:, 2] / n, n / np.maximum(more[:, 3], 1), more[:, 4] / n, more[:, 5] / n], axis=1)
    return base, features


def _short(word: bytes) -> bool:
    return len(word) < 4


@dataclass
class Trees:
    """Node arrays of all trees: an inner node k sends x[feature[k]] <= threshold[k] to left[k], the rest to left[k] + 1; a leaf has feature -1."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good of each row; all rows descend all trees together."""
        if not len(x):
            return np.zeros(0)
        node = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[node]
            inner = feature >= 0
            right = x[rows, np.maximum(feature, 0)] > self.threshold[node]
            node = np.where(inner, self.left[node] + right, node)
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(1))))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 2.0, monotone: dict[int, int] | None = None) -> Trees:
    """Fit by second-order boosting on histograms of quantile bins."""
    monotone = monotone or {}
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    margin = np.full(len(y), start)
    root, feature, threshold, left, value = [], [], [], [], []

    def node() -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(0)
        value.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = y - prob, prob * (1 - prob)
        root.append(node())
        work = [(root[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while work:
            k, rows, low, high, deep = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[k] = float(np.clip(g / (h + ridge), low, high)) * rate
            best = (1e-6, None)
            for f in range(x.shape[1] if deep < depth else 0):
                n = len(edges[f])
                if not n:
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], grad[rows], n + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], hess[rows], n + 1))[:-1]
                gr, hr = g - gl, h - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g**2 / (h + ridge)
                ok = (hl >= least) & (hr >= least)
                if sign := monotone.get(f):
                    ok &= sign * (np.clip(gr / (hr + ridge), low, high) - np.clip(gl / (hl + ridge), low, high)) >= 0
                gain = np.where(ok, gain, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), (f, at, gl[at] / (hl[at] + ridge), gr[at] / (hr[at] + ridge)))
            if best[1] is None:
                margin[rows] += value[k]
                continue
            f, at, wl, wr = best[1]
            feature[k], threshold[k], left[k] = f, float(edges[f][at]), node()
            node()
            to_left = binned[rows, f] <= at
            middle = float((np.clip(wl, low, high) + np.clip(wr, low, high)) / 2)
            sides = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[monotone.get(f, 0)]
            work.append((left[k], rows[to_left], *sides[0], deep + 1))
            work.append((left[k] + 1, rows[~to_left], *sides[1], deep + 1))
    return Trees(np.array(root), np.array(feature), np.array(threshold), np.array(left), np.array(value), start, depth)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = binary_column(batch, "text")
        found = [statistics(texts(column, a, b))[1] for a, b in slices(column)]
        x = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        yield pa.record_batch([batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS) -> Trees | None:
    """Trees for ``quality`` of labels joined by doc_id; None if there are not labels of both kinds."""
    ready(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    if not total:
        return None
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, max_docs / total) * (1 << 20))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("quality").cast("int"))
    found = rows.mapInArrow(_measure, "quality int, x array<double>").toArrow()
    y = (found["quality"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    order = np.lexsort((y, *x.T))  # the fit does not depend on the order of arrival
    return boost(x[order], y[order], monotone={FEATURES.index(k): v for k, v in MONOTONE.items()})


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, the base counts, base_failed, quality_score and kept of every document."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(trees)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = binary_column(batch, "text")
            found = [statistics(texts(column, a, b)) for a, b in slices(column)]
            base = np.concatenate([b for b, _ in found]) if found else np.zeros((0, 5), np.int64)
            x = np.concatenate([f for _, f in found]) if found else np.zeros((0, len(FEATURES)))
            failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > REPEAT_PERCENT * base[:, 0])
            score = np.ones(len(base)) if shared.value is None else shared.value.score(x)
            score = np.where(failed, 0.0, score)
            yield pa.record_batch([batch.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (score >= KEEP_FROM)), pa.array(score)], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)
