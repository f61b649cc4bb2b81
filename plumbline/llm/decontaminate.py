"""Benchmark decontamination by winnowing.

Words are runs of characters other than ASCII separators, with A-Z lower-cased. A window is ten consecutive words of
a benchmark item; an item of fewer words is one window. Of every six consecutive five-word grams the one with the least hash is
kept as a fingerprint, so any ten shared words share a fingerprint: windows in a document are found by
joining fingerprints, then extending each hit along its diagonal while words agree. A run of agreement of ten words or more is exactly
a union of occurring windows. Items of fewer than ten words are looked up whole, by length.

Words are compared, not only hashes: the benchmark's words are numbered, and a document's words become those
numbers. Up to ``BROADCAST_WORDS`` benchmark words the index is broadcast. The fingerprints of a larger
benchmark are joined with those of the distinct texts by a shuffle, and only the texts and items that share one meet, in whole.

Defined results for odd input: null and empty texts have no words and no hits. Items without words never occur; items of equal words
occur together, and an item id counts once. Items with a null id mark words as hit but are not listed. Repeated documents are
scanned row by row. An empty benchmark hits nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import WordHash, binary_column, group_of, groups, materialize, mixed, ranges, ready, slices, texts

WINDOW = 10
GRAM = 5
#: Grams of which the least is kept; GRAM + WINNOW - 1 is WINDOW.
WINNOW = 6
#: Words of a benchmark that is broadcast (about 100 MB as an index).
BROADCAST_WORDS = 1_000_000
_SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATE).split()


def gram_hashes(ids: np.ndarray, size: int = GRAM) -> np.ndarray:
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - size + 1 + j].astype(np.uint64)
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def winnow(hashes: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Positions of hashes that are the least of some ``width`` consecutive ones (all of them on ties)."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for j in range(1, width):
        np.minimum(least, hashes[j : j + n], out=least)
    chosen = np.zeros(len(hashes), bool)
    for j in range(width):
        chosen[j : j + n] |= hashes[j : j + n] == least
    return np.flatnonzero(chosen)


class Index:
    """Benchmark items as word numbers (0 is any other word) with the fingerprints of their windows."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.number: dict[bytes, int] = {}
        same: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words_of(text))
            if ids:
                same[ids] |= {item} - {None}
        self.items = [np.array(ids, np.int64) for ids in same]
        self.names = [sorted(x) for x in same.values()]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, ids in enumerate(self.items):
            if len(ids) < WINDOW:
                self.short[len(ids)][int(gram_hashes(ids, len(ids))[0])].append(k)
                continue
            hashes = gram_hashes(ids)
            for q in winnow(hashes):
                places[int(hashes[q])].append((k, int(q)))
        self.places = dict(places)
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.known = np.array(sorted(self.places), np.uint64)
        self.known_short = {n: np.array(sorted(x), np.uint64) for n, x in self.short.items()}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def hits(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, item) of maximal runs in the concatenated texts; texts lie at [starts, ends) between zeros."""
        found: list[tuple[int, int, int]] = []
        if len(self.known) and len(ids) >= WINDOW:
            hashes = gram_hashes(ids)
            at = winnow(hashes)
            at = at[_inside(self.known, hashes[at])]
            done: dict[tuple[int, int], int] = {}
            for p in at.tolist():
                for k, q in self.places[int(hashes[p])]:
                    item = self.items[k]
                    if done.get((k, p - q), -1) >= p or (ids[p : p + GRAM] != item[q : q + GRAM]).any():
                        continue
                    back = min(p, q)
                    differ = np.flatnonzero(ids[p - back : p] != item[q - back : q])
                    first = p - back + (int(differ[-1]) + 1 if len(differ) else 0)
                    ahead = min(len(ids) - p, len(item) - q)
                    differ = np.flatnonzero(ids[p : p + ahead] != item[q : q + ahead])
                    last = p + (int(differ[0]) if len(differ) else ahead)
                    done[k, p - q] = last
                    if last - first >= WINDOW:
                        found.append((first, last, k))
        for n, known in self.known_short.items():
            if len(ids) < n:
                continue
            hashes = gram_hashes(ids, n)
            for p in np.flatnonzero(_inside(known, hashes)).tolist():
                found += [(p, p + n, k) for k in self.short[n][int(hashes[p])] if (ids[p : p + n] == self.items[k]).all()]
        return found


def _inside(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def scan(index: Index, parts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: its number of words, its hit spans (in words, merged) and the items that occur."""
    words = [words_of(p) for p in parts]
    counts = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(counts + 1) - counts  # a zero, which no item has, stands before each text
    ids = np.zeros(int(counts.sum() + len(counts)) + 1, np.int64)
    ids[ranges(starts, counts)] = index.numbers([w for ws in words for w in ws])
    spans: list[list[tuple[int, int]]] = [[] for _ in parts]
    items: list[set[int]] = [set() for _ in parts]
    for first, last, k in index.hits(ids, starts, starts + counts):
        doc = int(np.searchsorted(starts, first, side="right")) - 1
        spans[doc].append((first - int(starts[doc]), last - int(starts[doc])))
        items[doc].add(k)
    for n, own, found in zip(counts, spans, items, strict=True):
        yield int(n), _merge(own), sorted(found)


def index_of(benchmark: DataFrame, limit: int = BROADCAST_WORDS) -> Index | None:
    """The index of a benchmark of at most about ``limit`` words (its bytes are counted first), else None."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    return Index([(r["item"], bytes(r["text"])) for r in rows.collect()]) if size <= 4 * limit else None


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def find(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, n_words, spans (hit word ranges, merged) and items (ids, sorted as strings) of every document."""
    spark = docs.sparkSession
    ready(spark)
    index = index_of(benchmark, limit)
    if index is None:
        found = _joined(docs, benchmark)
        rows = docs.select("doc_id", _node().alias("__node"))
        return rows.join(found, "__node", "left").select("doc_id", F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"), *[F.coalesce(c, F.array().cast(_FOUND[c].dataType)).alias(c) for c in ("spans", "items")])
    shared = spark.sparkContext.broadcast(index)
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *_FOUND.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = binary_column(batch, "text")
            found = [x for a, b in slices(column) for x in scan(shared.value, texts(column, a, b))]
            yield pa.record_batch([batch.column(0), *_columns(shared.value, found)], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def _columns(index: Index, found: list) -> list[pa.Array]:
    items = [sorted({n for k in x[2] for n in index.names[k]}) for x in found]
    return [pa.array([x[0] for x in found], pa.int64()), pa.array([[list(s) for s in x[1]] for x in found], pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]


def _node():
    return F.md5(F.col("text").cast("binary"))


def fingerprints(text: bytes, known: WordHash, short: list[int], own: bool) -> tuple[int, np.ndarray]:
    """Words of a text, and its fingerprints: kept five-word grams, and whole grams of the lengths ``short``; an item (``own``) has those of its own length."""
    words = words_of(text)
    ids = np.fromiter((known[w] for w in words), np.uint64, len(words))
    if own and len(words) < WINDOW:
        lengths, out = [len(words)] if words else [], []
    else:
        hashes = gram_hashes(ids)
        lengths, out = [] if own else short, [hashes[winnow(hashes)]]
    out += [mixed(gram_hashes(ids, n) + np.uint64(n)) for n in lengths if len(words) >= n]
    return len(words), np.unique(np.concatenate(out)).view(np.int64) if out else np.zeros(0, np.int64)


def _joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """__node, n_words, spans, items of each distinct text, by a shuffled join of fingerprints. Nothing is broadcast or collected but the lengths of short items."""
    full = docs.where(F.col("text").isNotNull()).groupBy(_node().alias("__node")).agg(F.first("text").alias("text"))
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text").withColumn("id", F.md5(F.concat_ws(" ", F.coalesce("item", F.lit("")), "text")))

    def printed(short: list[int], own: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHash()
            for batch in batches:
                column = binary_column(batch, "text")
                found = [fingerprints(t, known, short, own) for a, b in slices(column) for t in texts(column, a, b)]
                yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([h.tolist() for _, h in found], pa.list_(pa.int64()))], names=["id", "n_words", "prints"])

        return run

    shape = "id string, n_words long, prints array<bigint>"
    of_items = materialize(items.select("id", "text").mapInArrow(printed([], True), shape))
    short = [r["n_words"] for r in of_items.where(F.col("n_words").between(1, WINDOW - 1)).select("n_words").distinct().collect()]
    of_texts = materialize(full.select("__node", "text").mapInArrow(printed(short, False), shape))
    left = of_texts.select(F.col("id").alias("__node"), F.explode_outer("prints").alias("h")).where(F.col("h").isNotNull())
    right = of_items.select("id", F.explode_outer("prints").alias("h")).where(F.col("h").isNotNull())
    pairs = left.join(right, "h").select("__node", "id").distinct()
    work = pairs.join(items.dropDuplicates(["id"]).withColumnRenamed("text", "item_text"), "id").join(full, "__node")
    work = work.select("__node", "id", "item", "item_text", "text").repartition("__node").sortWithinPartitions("__node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["__node"]):
            group = group_of(table, ["__node"])
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = table.slice(a, b - a)
                index = Index(list(zip(part["item"].to_pylist(), (t.encode() for t in part["item_text"].to_pylist()), strict=True)))
                found = list(scan(index, [part["text"][0].as_py().encode()]))
                yield pa.record_batch([part["__node"].slice(0, 1).combine_chunks(), *_columns(index, found)[1:]], names=["__node", "spans", "items"])

    hits = work.mapInArrow(check, "__node string, spans array<array<bigint>>, items array<string>")
    return of_texts.select(F.col("id").alias("__node"), "n_words").join(hits, "__node", "left")


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_WORDS) -> DataFrame:
    """The documents without any hit, with all their columns."""
    spark = docs.sparkSession
    ready(spark)
    index = index_of(benchmark, limit)
    if index is None:
        bad = _joined(docs, benchmark).where(F.size("spans") > 0).select(F.col("__node").alias("__bad"))
        return docs.join(bad, _node() == F.col("__bad"), "left_anti")
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = binary_column(batch, "text")
            clean = [not spans for a, b in slices(column) for _, spans, _ in scan(shared.value, texts(column, a, b))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
