"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles (ASCII-lower-cased
words between white space) is 0.8 or more. A text with one to four words has one shingle, all of them.

1. Copies: documents of equal text are one node, so copies are never paired with each other.
2. Every node gets 128 MinHash values of one byte; 32 bands of four values are its buckets. A pair at
   the threshold shares no bucket with a probability of 5e-8.
3. A bucket is cut into blocks of about 256 nodes and each pair of blocks is a unit of work, so no
   bucket of any size meets in one task. In a unit, all pairs are compared value by value: a pair is
   dropped as soon as the posterior probability (uniform prior) that its similarity reaches the
   threshold is below ``TOLERANCE``. A pair counts only in the first band that it shares.
4. What is left is verified exactly on the shingle sets, unit by unit. A unit returns for each node its number of
   links and the root of its local tree, never the pairs.
5. Classes are the connected components of the links.

Defined results for odd input: a null text or one without a word is its own class with no link, and so
is not a copy of others like it. Null ids are returned with the class of their text. Repeated rows are copies of each other. The class
id is the least doc_id of the class (null if the class has none). Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER, WordHash, binary_column, group_of, groups, materialize, mixed, ranges, slices, ready, texts
from plumbline.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
BANDS = 32
BLOCK = 256
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-6
#: Hashes compared between two looks at the posterior.
STEP = 16
PAIRS_AT_ONCE = 100_000
#: Cells of digests by which texts without a candidate pair are told before they move.
SIEVE = 1 << 19
_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(parts: list[bytes], known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one after the other, and how many each has (repeats included)."""
    words = [p.translate(LOWER).split() for p in parts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[w] for ws in words for w in ws), np.uint64, int(counts.sum()))
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    out = np.zeros(int(sizes.sum()), np.uint64)
    first = np.cumsum(counts) - counts
    at = ranges(first, np.where(counts >= SHINGLE, sizes, 0))
    full = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        full = full * np.uint64(0x9E3779B97F4A7C15) + flat[at + j]
    where = np.cumsum(sizes) - sizes
    long = counts >= SHINGLE
    out[ranges(where[long], sizes[long])] = full
    for i in np.flatnonzero((counts > 0) & ~long):
        total = np.uint64(counts[i])
        for x in flat[first[i] : first[i] + counts[i]]:
            total = np.uint64((int(total) * 0x9E3779B97F4A7C15 + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[where[i]] = total
    return mixed(out), sizes


def signatures(parts: list[bytes], known: WordHash) -> list[bytes | None]:
    """128 one-byte MinHash values of each text; None for a text without words."""
    hashes, sizes = shingles(parts, known)
    has = np.flatnonzero(sizes)
    out: list[bytes | None] = [None] * len(parts)
    if len(has):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(sizes[has]) - sizes[has]
        values = np.empty((len(has), HASHES), np.uint8)
        for k in range(HASHES):
            least = np.minimum.reduceat(low * _MULTIPLY[k] + _ADD[k], starts)
            values[:, k] = (least * np.uint32(2654435761)) >> np.uint32(24)
        for i, v in zip(has, values, strict=True):
            out[i] = v.tobytes()
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values: the fewest matches with which a pair stays.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) distributed after m matches in n,
    and its probability of being t or more is that of at most m successes in n + 1 trials of t.
    One-byte values match by chance once in 256, which raises the threshold on matches.
    """
    t = threshold + (1 - threshold) / 256
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def _nodes(docs: DataFrame, text: str = "text") -> Column:
    """The node of a row: a digest of its text, null if it has no word."""
    return F.when(F.col(text).rlike(r"[^ \t-\r]"), F.unhex(F.md5(F.col(text).cast("binary"))))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHash()
    for batch in batches:
        column = binary_column(batch, "text")
        found = [s for a, b in slices(column) for s in signatures(texts(column, a, b), known)]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["node", "sig"])


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


_KEYS = ["key", "i", "j"]


def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows key, i, j, c, band, node, sig of units to rows key, i, j, pos, node, partners that may be linked."""
    least = least_matches()
    for table in groups(batches, _KEYS):
        group = group_of(table, _KEYS)
        sig = _fixed(table["sig"], HASHES)
        words = sig.view(np.uint32)
        c, i, j, band = (table[k].to_numpy() for k in ("c", "i", "j", "band"))
        size = np.bincount(group)
        start = np.cumsum(size) - size
        pos = np.arange(len(group)) - start[group]
        more = size[group] - 1 - pos
        kept_a, kept_b = [], []
        begun = 0
        while begun < len(group):
            stop = max(begun + 1, int(np.searchsorted(np.cumsum(more[begun:]), PAIRS_AT_ONCE, side="right")) + begun)
            a = np.repeat(np.arange(begun, stop), more[begun:stop])
            b = ranges(np.arange(begun, stop) + 1, more[begun:stop])
            begun = stop
            ok = (i[a] == j[a]) | (c[a] != c[b])
            a, b = a[ok], b[ok]
            matches = np.zeros(len(a), np.int64)
            for n in range(STEP, HASHES + 1, STEP):
                matches += (sig[a, n - STEP : n] == sig[b, n - STEP : n]).sum(1)
                ok = matches >= least[n]
                if n == STEP and ok.any():
                    # near copies share many bands, and are compared in full in the first of them alone
                    at = np.flatnonzero(ok)
                    ok[at] = (words[a[at]] == words[b[at]]).argmax(1) == band[a[at]]
                a, b, matches = a[ok], b[ok], matches[ok]
            if len(a):
                kept_a.append(a)
                kept_b.append(b)
        if not kept_a or not sum(map(len, kept_a)):
            continue
        a, b = np.concatenate(kept_a), np.concatenate(kept_b)
        rows = np.unique(np.concatenate([a, b]))
        counts = np.bincount(np.searchsorted(rows, a), minlength=len(rows))
        partners = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(pos[b].astype(np.int32)))
        part = table.take(pa.array(rows))
        yield pa.record_batch([*(part[k].combine_chunks() for k in _KEYS), pa.array(pos[rows].astype(np.int32)), part["node"].combine_chunks(), partners], names=[*_KEYS, "pos", "node", "partners"])


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets a[k] and b[k]."""
    if len(a) <= 4 * len(sets):
        out = np.zeros(len(a), np.int64)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            s, t = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
            out[k] = (t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()
        return out
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    names, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1  # only shingles of two sets or more can meet
    use = times[ids] > 1
    of, ids = of[use], shared[ids[use]]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 8192
    order = np.argsort(ids, kind="stable")
    of, ids = of[order], ids[order]
    for first in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        at = slice(*np.searchsorted(ids, [first, first + width]))
        one = np.zeros((len(sets), width), np.float32)
        one[of[at], ids[at] - first] = 1
        total += one @ one.T
    return np.rint(total[a, b]).astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verify(batches: Iterator[pa.RecordBatch], threshold: float = THRESHOLD) -> Iterator[pa.RecordBatch]:
    """Sorted rows key, i, j, pos, node, partners, text of units to node, links, root: exact counts of links of each node in the unit."""
    known = WordHash()
    for table in groups(batches, _KEYS):
        group = group_of(table, _KEYS)
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = table.slice(start, end - start)
            pos = part["pos"].to_numpy()
            hashes, sizes = shingles([x or b"" for x in part["text"].cast(pa.binary()).to_pylist()], known)
            sets = [np.unique(x) for x in np.split(hashes, np.cumsum(sizes)[:-1])]
            partners = part["partners"].to_pylist()
            a = np.repeat(np.arange(len(pos)), [len(p) for p in partners])
            b = np.searchsorted(pos, np.array([x for p in partners for x in p], np.int64))
            size = np.array([len(s) for s in sets])
            common = _common(sets, a, b)
            linked = common >= threshold * (size[a] + size[b] - common) - 1e-9
            a, b = a[linked], b[linked]
            if not len(a):
                continue
            links = np.bincount(a, minlength=len(pos)) + np.bincount(b, minlength=len(pos))
            root = _roots(len(pos), a, b)
            rows = np.flatnonzero(links)
            nodes = part["node"].combine_chunks()
            yield pa.record_batch([nodes.take(pa.array(rows)), pa.array(links[rows].astype(np.int64)), nodes.take(pa.array(root[rows]))], names=["node", "links", "root"])


def _near(docs: DataFrame, maybe: DataFrame) -> DataFrame:
    """Rows whose node may be in ``maybe``, by one of ``SIEVE`` cells of its digest: a broadcast of bounded size, which keeps most texts from being shuffled."""
    cell = lambda node: F.pmod(F.xxhash64(node), F.lit(SIEVE)).cast("int")
    cells = maybe.select(cell("node").alias("__cell")).distinct()
    return docs.withColumn("__cell", cell("__node")).join(F.broadcast(cells), "__cell", "left_semi").drop("__cell")


def links(docs: DataFrame) -> DataFrame:
    """node, links, root of verified units over the distinct texts of ``docs`` (columns __node, text)."""
    spark = docs.sparkSession
    ready(spark)
    signed = docs.where(F.col("__node").isNotNull()).select(F.col("__node").alias("node"), "text").mapInArrow(_sign, "node binary, sig binary")
    signed = materialize(signed.groupBy("node").agg(F.first("sig").alias("sig")))
    width = HASHES // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    entries = signed.select("node", F.posexplode_outer(bands).alias("band", "key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    cells = F.ceil(F.col("m") / BLOCK).cast("int")
    units = entries.join(buckets, "key").withColumn("g", cells).withColumn("c", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    units = units.withColumn("o", F.explode_outer(F.sequence(F.lit(0), F.col("g") - 1)))
    units = units.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "band", "node").join(signed, "node")
    units = units.select(*_KEYS, "c", "band", "node", "sig").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    maybe = materialize(units.mapInArrow(prune, "key long, i int, j int, pos int, node binary, partners array<int>"))
    # equal texts meet before the shuffle, so copies move once for each task at most
    full = _near(docs.where(F.col("__node").isNotNull()), maybe).groupBy(F.col("__node").alias("node")).agg(F.first("text").alias("text"))
    # one plan at every size: a broadcast would be pushed below the aggregation only while it is small
    full = full.join(maybe.select("node").distinct().hint("merge"), "node", "left_semi")
    work = maybe.join(full, "node").select(*_KEYS, "pos", "node", "partners", "text").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "pos")
    return materialize(work.mapInArrow(verify, "node binary, links long, root binary"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links (linked different texts), n_copies (other documents of equal text) of every row."""
    rows = docs.select("doc_id", _nodes(docs).alias("__node"), "text")
    found = links(rows)
    rooted = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = rows.where(F.col("__node").isNotNull()).groupBy(F.col("__node").alias("node")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    each = each.join(rooted, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = each.groupBy("root").agg(F.min("least").alias("class_id"))
    each = each.join(ids, "root").select(F.col("node").alias("__node"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    kind = docs.schema["doc_id"].dataType
    known = F.col("copies").isNotNull()
    out = rows.select("doc_id", "__node").join(each, "__node", "left")
    return out.select("doc_id", F.when(known, F.col("class_id")).otherwise(F.col("doc_id")).cast(kind).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but the first document (by id, nulls first) of each class.

    Rows without words stay. Rows that repeat both id and text are one document, and stay or go together.
    """
    # the caller's row is one column, so no name in it can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _nodes(docs).alias("__node"))
    found = links(rows.select("__node", F.col("row.text").alias("text")))
    rooted = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    # copies meet as one row for each task at most
    least = rows.where(F.col("__node").isNotNull()).groupBy("__node").agg(F.min("row.doc_id").alias("least"), F.max(F.col("row.doc_id").isNull()).alias("null"))
    least = least.join(rooted.withColumnRenamed("node", "__node"), "__node", "left").withColumn("__root", F.coalesce("root", "__node"))
    order = F.struct(~F.col("null"), F.col("least"), F.col("__node"))
    first = least.groupBy("__root").agg(F.min_by(F.struct("__node", F.when(~F.col("null"), F.col("least")).alias("id")), order).alias("f"))
    first = first.select(F.col("f.__node").alias("keep"), F.col("f.id").alias("id"))
    marked = rows.join(first, (F.col("__node") == F.col("keep")) & F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    return marked.where(F.col("__node").isNull() | F.col("keep").isNotNull()).select("row.*")
