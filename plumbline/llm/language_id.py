"""Language identification by multilingual mixture inference.

Each learned language is a multinomial over hashed byte trigrams. The words of a text are the
units of a mixture: expectation-maximisation estimates the share of every language from the
words' trigram likelihoods, and a language stays in the text's set only while the
log-likelihood that it adds exceeds a penalty that grows with the logarithm of the word count.

A filter (``keep_known``) also rejects texts that no mixture explains: see ``least_likelihood``.

Defined results for odd input: null text, empty text and text without a letter give ``und`` with
score 0 and no language set; so does every text when no language could be learned. Rows with a
null ``lang`` are not learned from. Repeated rows are predicted row by row; ties go to the first
language in code-point order. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import binary_column, id_remainder, slices, ready, texts

BUCKETS = 1 << 16
#: Bound of the labelled sample, in documents of each language.
TRAIN_DOCS = 4000
UNKNOWN = "und"
#: Bytes whose likelihoods are summed up at a time.
STRETCH = 1 << 18
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


@dataclass
class LanguageModel:
    """``table[bucket, k]`` is the log-likelihood of a trigram in ``languages[k]``."""

    languages: list[str]
    table: np.ndarray


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts between spaces, as bytes, and the offset at which each text starts."""
    low = [p.decode("utf-8", "replace").lower().encode().translate(_SPACED) for p in parts]
    starts = np.cumsum([1] + [len(x) + 2 for x in low])[:-1]
    return np.frombuffer(b" " + b"  ".join(low) + b"  ", np.uint8), starts


def _buckets(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not spaces."""
    edge = np.diff((data != 32).astype(np.int8))
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def fit(docs: DataFrame, learn_from=None, max_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learn trigram counts from at most about ``max_docs`` labelled documents of each language.

    ``learn_from`` is the condition that training rows meet; by default crc32(doc_id) mod 3 is not 1.
    The sample is by a hash of the id, so it does not depend on partitioning. Counts are summed by
    Spark; what reaches the driver is bounded by languages times ``BUCKETS``.
    """
    ready(docs.sparkSession)
    condition = id_remainder(F.col("doc_id"), 3) != 1 if learn_from is None else learn_from
    rows = docs.where(condition & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_docs / sizes[k]))])
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(index), BUCKETS), np.int64)
        for batch in batches:
            column = binary_column(batch, "text")
            of = np.array([index[x] for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.int64)
            for a, b in slices(column):
                for k in np.unique(of[a:b]):
                    data, _ = _joined([t for t, x in zip(texts(column, a, b), of[a:b], strict=True) if x == k])
                    held[k] += np.bincount(_buckets(data), minlength=BUCKETS)
        for k in range(len(index)):
            seen = np.flatnonzero(held[k])
            yield pa.record_batch({"k": pa.array(np.full(len(seen), k, np.int32)), "bucket": pa.array(seen.astype(np.int32)), "n": pa.array(held[k][seen])})

    found = rows.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"].to_numpy(), found["k"].to_numpy()] = found["n"].to_numpy()
    seen = max(1, int((counts.sum(1) > 0).sum()))
    return LanguageModel(languages, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * seen)).astype(np.float32))


def least_likelihood(model: LanguageModel) -> np.ndarray:
    """Log-likelihood per trigram, for each language, below which a text is not of that language.

    Text of a language scores the negative entropy of its trigrams on average, text of unlearned trigrams the
    floor of the table; the bound lies halfway, so a text goes if it is nearer to the latter. Both follow from the model alone.
    """
    if not len(model.languages):
        return np.zeros(0)
    table = model.table.astype(np.float64)
    floor = table.min(0)
    weight = np.where(table > floor + 1e-6, np.exp(table), 0)
    own = (weight * table).sum(0) / np.maximum(weight.sum(0), 1e-300)
    return (np.where(weight.sum(0) > 0, own, floor) + floor) / 2


def mixture(model: LanguageModel, parts: list[bytes], penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language shares of each text, [texts, languages], whether the text has words and the model languages, and the mixture's log-likelihood per trigram."""
    n, width = len(parts), len(model.languages)
    shares, fits = np.zeros((n, width)), np.zeros(n)
    data, starts = _joined(parts)
    begin, end = _words(data)
    if not len(begin) or not width:
        return shares, np.zeros(n, bool), fits
    of = np.searchsorted(starts, begin, side="right") - 1
    like = np.empty((len(begin), width))
    first = 0
    while first < len(begin):  # stretches of whole words, so a very long text needs no more memory than others
        last = max(first + 1, int(np.searchsorted(end, begin[first] + STRETCH)))
        low = begin[first] - 1
        total = np.zeros((end[last - 1] - low, width))
        np.cumsum(model.table[_buckets(data[low : end[last - 1] + 1])], axis=0, dtype=np.float64, out=total[1:])
        like[first:last] = total[end[first:last] - 1 - low] - total[begin[first:last] - 1 - low]
        first = last
    peak = like.max(1)
    like = (np.exp(np.maximum(like - peak[:, None], -30)) + 1e-6).astype(np.float32)
    held, first = np.unique(of, return_index=True)
    row = np.searchsorted(held, of)
    words = np.diff(np.append(first, len(of)))

    def settle(allowed: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        share = np.where(allowed, start, 0).astype(np.float32)
        share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
        for _ in range(rounds):
            joint = like * share[row]
            joint /= joint.sum(1, keepdims=True)
            new = np.add.reduceat(joint, first, axis=0) / words[:, None]
            moved = float(np.abs(new - share).max())
            share = new
            if moved < 1e-3:
                break
        return share, np.add.reduceat(np.log((like * share[row]).sum(1, dtype=np.float64)), first)

    allowed = np.ones((len(held), width), bool)
    share, fitness = settle(allowed, allowed / width, 15)
    cost = penalty * np.log(words + 1.0)
    for _ in range(width - 1):
        least = np.where(allowed, share, 2).argmin(1)
        trial = allowed.copy()
        trial[np.arange(len(held)), least] = False
        trial[~trial.any(1)] = allowed[~trial.any(1)]
        share_t, fitness_t = settle(trial, np.where(trial, share + 1e-3, 0), 6)
        take = (trial.sum(1) < allowed.sum(1)) & (fitness - fitness_t < cost)
        if not take.any():
            break
        allowed[take], share[take], fitness[take] = trial[take], share_t[take], fitness_t[take]
    shares[held] = share
    fits[held] = (np.add.reduceat(peak, first) + fitness) / np.add.reduceat(end - begin, first)
    known = np.zeros(n, bool)
    known[held] = True
    return shares, known, fits


def has_letter(text: bytes) -> bool:
    decoded = text.decode("utf-8", "replace")
    return bool(_ASCII_LETTER.search(decoded)) or any(map(str.isalpha, decoded))


def _predict(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray, list[str]]:
    names, scores, sets = [], [], []
    for a, b in slices(column):
        parts = texts(column, a, b)
        shares, known, _ = mixture(model, parts)
        for i, part in enumerate(parts):
            if not known[i] or not has_letter(part):
                names.append(UNKNOWN)
                scores.append(0.0)
                sets.append("")
                continue
            best = int(shares[i].argmax())
            names.append(model.languages[best])
            scores.append(min(1.0, float(shares[i, best])))
            sets.append(",".join(f"{model.languages[k]}:{shares[i, k]:.3f}" for k in np.argsort(-shares[i], kind="stable") if shares[i, k] >= 5e-4))
    return names, np.array(scores, float), sets


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_mix (the language set with shares) for every document."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_mix", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sets = _predict(shared.value, binary_column(batch, "text"))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(sets, pa.string())], names=out.names)

    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, out)


def keep_known(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents that a mixture of learned languages explains, with all their columns; the rest is rejected.

    Texts without a letter go, and so do those whose log-likelihood per trigram falls short of the bounds of
    their languages, weighted by share: letter noise, encoded data, scripts and languages unlike all learned ones.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast((model, least_likelihood(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, least = shared.value
        for batch in batches:
            column, kept = binary_column(batch, "text"), [np.zeros(0, bool)]
            for a, b in slices(column):
                parts = texts(column, a, b)
                shares, known, fits = mixture(own, parts)
                kept.append(known & (fits >= shares @ least) & np.array([has_letter(x) for x in parts], bool))
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
