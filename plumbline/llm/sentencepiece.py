"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary is read from a public ``.model`` file (a parameter; by default the one that the environment
provides) and never trained here. A unigram model's scores are used as they are. A
merge-ranked (BPE) model has ranks instead of probabilities, so its normal pieces get log scores by a fixed
rule: the logarithm of a Zipf-Mandelbrot law over their ranks, normalised over the vocabulary.

A space is encoded as the whitespace marker and one marker is put before the text. Of all ways to cut a
text into pieces the one with the greatest sum of log scores is chosen; of equal ones, that whose last piece is longest, and so on
backwards. A character that no piece covers is cut at a penalty and written as its UTF-8 bytes.
Decoding turns markers into spaces, drops the first, and restores bytes, so it gives every text back; a
marker character that stands in the text itself is written as bytes to keep it apart from a space.

Pieces have a marker at their start at most, so no piece crosses the start of a marker run: a text is cut into such units, equal units are encoded once
and all new units of a batch advance through the trie together.

Defined results for odd input: null is encoded as null and decoded as null; the empty text has no pieces. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plumbline.llm.common import binary_column, ranges, slices, ready

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁".encode()
#: Kinds of pieces in a model file, and what a unigram model costs a character without a piece.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0
#: Units longer than this many bytes are encoded one by one.
LONG = 48
#: Distinct units that a worker remembers.
REMEMBERED = 250_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of a protocol-buffer message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(data: bytes) -> tuple[list[tuple[bytes, float, int]], int]:
    """Pieces (text, score, kind) in the order of their ids, and the model type (1 unigram, 2 BPE)."""
    pieces, model_type = [], 1
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b""), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, 1)
    return pieces, model_type


def log_scores(pieces: list[tuple[bytes, float, int]], model_type: int) -> np.ndarray:
    scores = np.array([s for _, s, _ in pieces])
    if model_type == 1:
        return scores
    normal = [i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER)]
    rank = np.empty(len(normal))
    rank[np.argsort(-scores[normal], kind="stable")] = np.arange(len(normal))
    weight = -np.log(rank + 2.7)
    scores[normal] = weight - np.log(np.exp(weight).sum())
    return scores


@dataclass
class Pieces:
    """A double array: the child of node s by byte c is ``t = base[s] + c + 1`` if ``check[t] == s``; ``piece[t]`` is the id that ends there or -1."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    byte_id: np.ndarray
    unknown: float
    longest: int
    text: list[bytes]
    kind: np.ndarray
    newline_apart: bool
    single: frozenset = field(default_factory=frozenset)


def build(data: bytes) -> Pieces:
    """Read a model file and lay its pieces out as a double array, nodes in breadth-first order, each at the first free place."""
    pieces, model_type = read_model(data)
    scores = log_scores(pieces, model_type)
    byte_id = np.full(256, -1, np.int64)
    nodes: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    longest, newline_apart = 1, True
    plain: list[bytes] = []
    for i, (text, _, kind) in enumerate(pieces):
        if kind == BYTE:
            byte_id[int(text[1:-1], 16)] = i
            plain.append(bytes([int(text[1:-1], 16)]))
            continue
        spaced = text.replace(MARKER, b" ")
        plain.append(spaced)
        if kind not in (NORMAL, USER) or not text:
            continue
        if b" " in spaced.lstrip(b" "):
            raise ValueError("a piece has a whitespace marker after another character")
        newline_apart &= b"\n" not in spaced or spaced == b"\n"
        at = 0
        for c in spaced:
            if c not in nodes[at]:
                nodes.append({})
                nodes[at][c] = len(nodes) - 1
            at = nodes[at][c]
        ends.setdefault(at, i)
        longest = max(longest, len(spaced))
    if (byte_id < 0).any():
        raise ValueError("the model has no byte pieces")
    size = 2 * len(nodes) + 512
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    place, queue, free, crowded = {0: 0}, [0], 257, 257  # no child lies before 257, so every hole is in reach
    for node in queue:
        here, children = place[node], sorted(nodes[node])
        if not children:
            continue
        while used[free]:
            free += 1
        # lone children fill the holes; families start behind the crowded part
        at = (free if len(children) == 1 else max(free, crowded)) - children[0] - 1
        begun = at
        while any(used[at + c + 1] for c in children):
            at += 1
        if at - begun > 100:
            crowded = at
        base[here] = at
        for c in children:
            t = at + c + 1
            used[t], check[t], place[nodes[node][c]] = 1, here, t
            piece[t] = ends.get(nodes[node][c], -1)
            queue.append(nodes[node][c])
            if t + 600 > size:
                grow = size
                base, check, piece = np.append(base, np.zeros(grow, np.int32)), np.append(check, np.full(grow, -1, np.int32)), np.append(piece, np.full(grow, -1, np.int32))
                used.extend(bytes(grow))
                size += grow
    least = min(float(scores[i]) for i in ends.values())
    return Pieces(base, check, piece, scores, byte_id, least - UNKNOWN_PENALTY, longest, plain, np.array([k for _, _, k in pieces]), newline_apart)


def load(spark: SparkSession, path: str = MODEL) -> Pieces:
    """The pieces of a model file that the driver, or else Spark's file systems, can read."""
    try:
        with open(path, "rb") as f:
            return build(f.read())
    except FileNotFoundError:
        return build(bytes(spark.read.format("binaryFile").load(path).head()["content"]))


def _char_size(first: np.ndarray) -> np.ndarray:
    return 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)


def viterbi(p: Pieces, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all units, one after the other, and how many each has. All units advance together."""
    n = len(units)
    lengths = np.array([len(u) for u in units], np.int64)
    width = int(lengths.max(initial=0))
    data = np.zeros((n, width + 1), np.uint8)
    flat = np.frombuffer(b"".join(units), np.uint8)
    data[np.repeat(np.arange(n), lengths), ranges(np.zeros(n, np.int64), lengths)] = flat
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, width + 1), np.int32)  # the piece that ends here; -1 - size for a character without one
    last = np.zeros((n, width + 1), np.int32)  # where it begins
    for start in range(width):
        rows = np.flatnonzero((lengths > start) & (best[:, start] > -np.inf))
        if not len(rows):
            continue
        from_here = best[rows, start]
        size = _char_size(data[rows, start].astype(np.int16))
        covered = np.zeros(len(rows), bool)
        active, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for step in range(min(p.longest, width - start)):
            at = start + step
            target = p.base[node] + data[rows[active], at] + 1
            ok = (p.check[target] == node) & (lengths[rows[active]] > at)
            active, node = active[ok], target[ok]
            if not len(active):
                break
            found = p.piece[node]
            ends = found >= 0
            if ends.any():
                who, ids = active[ends], found[ends]
                covered[who] |= size[who] == step + 1
                value = from_here[who] + p.score[ids]
                r = rows[who]
                better = value > best[r, at + 1]
                r, v = r[better], value[better]
                best[r, at + 1], back[r, at + 1], last[r, at + 1] = v, ids[better], start
        lone = np.flatnonzero(~covered)
        r, s = rows[lone], size[lone]
        end = np.minimum(start + s, lengths[r])
        value = from_here[lone] + p.unknown
        better = value > best[r, end]
        r, e = r[better], end[better]
        best[r, e], back[r, e], last[r, e] = value[better], -1 - (e - start), start
    # walk back, all units together; a step gives one piece or up to four byte pieces
    at = lengths.copy()
    owner, ids, order = [], [], []
    alive, step = np.flatnonzero(at > 0), 0
    while len(alive):
        end = at[alive]
        found, begin = back[alive, end], last[alive, end]
        whole = found >= 0
        owner.append(alive[whole])
        ids.append(found[whole].astype(np.int64))
        order.append(np.full(int(whole.sum()), -step * 4, np.int64))
        for k in range(4):  # bytes of an uncovered character, the last first
            some = ~whole & (end - 1 - k >= begin)
            owner.append(alive[some])
            ids.append(p.byte_id[data[alive[some], end[some] - 1 - k]])
            order.append(np.full(int(some.sum()), -step * 4 - k, np.int64))
        at[alive] = begin
        alive = alive[begin > 0]
        step += 1
    if not owner:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    owner, ids, order = np.concatenate(owner), np.concatenate(ids), np.concatenate(order)
    return ids[np.lexsort((order, owner))], np.bincount(owner, minlength=n)


def viterbi_long(p: Pieces, unit: bytes) -> list[int]:
    """The same for one unit of any length, in memory proportional to it."""
    n = len(unit)
    base, check, piece, score = p.base, p.check, p.piece, p.score
    best, back, last = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for start in range(n):
        here = best[start]
        if here == -math.inf:
            continue
        first = unit[start]
        size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        covered, node = False, 0
        for at in range(start, min(n, start + p.longest)):
            target = int(base[node]) + unit[at] + 1
            if check[target] != node:
                break
            node = target
            found = int(piece[node])
            if found >= 0:
                covered |= at + 1 - start == size
                value = here + float(score[found])
                if value > best[at + 1]:
                    best[at + 1], back[at + 1], last[at + 1] = value, found, start
        if not covered:
            end = min(n, start + size)
            if here + p.unknown > best[end]:
                best[end], back[end], last[end] = here + p.unknown, -1, start
    out: list[int] = []
    at = n
    while at:
        if back[at] >= 0:
            out.append(back[at])
        else:
            out += [int(p.byte_id[b]) for b in reversed(unit[last[at] : at])]
        at = last[at]
    return out[::-1]


class Encoder:
    """Encodes texts, remembering the pieces of units seen before."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.cut = re.compile(rb" *[^ \n]+| +|\n" if pieces.newline_apart else rb" *[^ ]+| +").findall
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, units: list[bytes]) -> None:
        short = [u for u in units if len(u) <= LONG]
        short.sort(key=len)
        ids, counts = [self.ids], [self.count]
        for a in range(0, len(short), 20_000):
            found, n = viterbi(self.p, short[a : a + 20_000])
            ids.append(found.astype(np.int32))
            counts.append(n)
        long = [u for u in units if len(u) > LONG]
        for u in long:
            found = np.array(viterbi_long(self.p, u), np.int32)
            ids.append(found)
            counts.append(np.array([len(found)], np.int64))
        for u in short + long:
            self.place[u] = len(self.place)
        self.ids, self.count = np.concatenate(ids), np.concatenate(counts)
        self.start = np.cumsum(self.count) - self.count

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.place) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self.forget()
        cut = [self.cut(b" " + t) if t else [] for t in parts]
        new = {u for us in cut for u in us} - self.place.keys()
        if new:
            self._learn(sorted(new))
        where = np.fromiter((self.place[u] for us in cut for u in us), np.int64, sum(map(len, cut)))
        ids = self.ids[ranges(self.start[where], self.count[where])]
        ends = np.append(0, np.cumsum(self.count[where]))[np.cumsum([0] + [len(us) for us in cut])]
        return ids, np.diff(ends)


def decode_ids(p: Pieces, ids: list[int]) -> bytes:
    """The text of a sequence of ids: the first marker goes, other markers are spaces, byte pieces are bytes; control pieces have no text."""
    text = b"".join([p.text[i] for i in ids if p.kind[i] in (NORMAL, USER, BYTE)])
    return text[1:] if text[:1] == b" " else text


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, ids of every document (null for a null text)."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(pieces)
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), _encoded(encoder, binary_column(batch, "text"))], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def _encoded(encoder: Encoder, column: pa.Array) -> pa.Array:
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a, b in slices(column):
        found, n = encoder.encode([t or b"" for t in column.slice(a, b - a).to_pylist()])
        ids.append(found)
        counts.append(n)
    offsets = np.append(0, np.cumsum(np.concatenate(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)), mask=column.is_null())


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, text of every row of ``encode``'s result; bytes that are not UTF-8 become replacement characters."""
    spark = encoded.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(pieces)
    out = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if ids is None else decode_ids(shared.value, ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(text, pa.string())], names=out.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, out)


def round_trip(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """doc_id, ids, n_pieces, n_bytes (byte pieces among them), score (sum of the pieces' log scores) and exact (decoding gives the text back)."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(pieces)
    kind = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        encoder = Encoder(p)
        blob = np.frombuffer(b"".join(p.text), np.uint8)
        size = np.array([len(t) if k in (NORMAL, USER, BYTE) else 0 for t, k in zip(p.text, p.kind, strict=True)], np.int64)
        begin = np.cumsum([0] + [len(t) for t in p.text])[:-1]
        worth = np.where(p.kind == BYTE, 0.0, p.score)
        for batch in batches:
            column = binary_column(batch, "text")
            ids = _encoded(encoder, column)
            counts = np.asarray(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            flat = ids.flatten().to_numpy()
            ends = np.append(0, np.cumsum(counts))
            written = np.append(0, np.cumsum(size[flat]))[ends]
            whole = [t or b"" for t in column.to_pylist()]
            exact = []
            for i, t in enumerate(whole):
                own = flat[ends[i] : ends[i + 1]]
                exact.append(written[i + 1] - written[i] == len(t) + bool(t) and blob[ranges(begin[own], size[own])].tobytes() == (b" " + t if t else t))
            sums = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])
            yield pa.record_batch([batch.column(0), ids, pa.array(counts), pa.array(sums(p.kind[flat] == BYTE).astype(np.int64)), pa.array(sums(worth[flat]).astype(float)), pa.array(exact, pa.bool_())], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)
