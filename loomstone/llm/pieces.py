"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units where no piece can cross: before every pair of characters that stands in no piece.
The units' substrings of bounded length are exploded, joined to the piece table, grouped into the edges of
each unit's lattice, and folded with a higher-order aggregate. The vocabulary is one of merges, so the best
path isn't the one of largest sum: edges are taken in order of their score, the first of equals from the left,
and an edge joins when exactly two pieces fill it. Units whose fold leaves an edge that could still join, that
are too long for it, or that are too rare for the dictionary are merged one by one where they stand.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read, slices, written
from .registry import query
from .words import mixed, spans_hash

MODEL = "piece_bpe_32k.model"
#: The mark that stands for a space.
SPACE = "▁"
NONE = float("-inf")
#: Units of the broadcast dictionary at most, and characters of a unit in it.
DICTIONARY, LONGEST = 1 << 18, 60


class Vocabulary:
    """Pieces, ids and scores of a model file, and which characters may be neighbours in a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.zeros(256, np.int32)
        self.pieces: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.pieces.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.pieces.append(b"")
            else:
                self.pieces.append(piece.replace(SPACE, " ").encode())
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        self.longest = max(map(len, self.ids))
        characters = sorted({c for p in self.ids for c in p})
        inside = sorted({c for p in self.ids if len(p) > 1 for c in p})
        # each character that stands beside another in a piece has a number from 1, all others 0
        self.number = np.zeros(max(map(ord, characters)) + 2, np.int32)
        for k, c in enumerate(inside, 1):
            self.number[ord(c)] = k
        self.neighbours = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                self.neighbours[self.number[ord(a)], self.number[ord(b)]] = True

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """For each code point but the first, whether a unit begins there."""
        n = self.number[np.minimum(points, len(self.number) - 1)]
        return ~self.neighbours[n[:-1], n[1:]]

    def ids_of(self, pieces) -> list[int]:
        """Ids of pieces; what isn't one is given byte by byte."""
        out: list[int] = []
        for p in pieces:
            known = self.ids.get(p)
            if known is None:
                out += self.bytes[list(p.encode())].tolist()
            else:
                out.append(known)
        return out

    def merged(self, unit: str) -> list[int]:
        """A unit's ids by merging the best neighbours until none can be: the plain rule, for any length."""
        if len(unit) > LONGEST:
            return self.ids_of(self._merged_long(unit))
        score, parts = self.score.get, list(unit)
        found = [score(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while found and (best := max(found)) > NONE:
            i = found.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del found[i]
            if i:
                found[i - 1] = score(parts[i - 1] + parts[i], NONE)
            if i < len(found):
                found[i] = score(parts[i] + parts[i + 1], NONE)
        return self.ids_of(parts)

    def _merged_long(self, unit: str) -> list[str]:
        """The same with a queue, for units in which a search for the best would take too long."""
        parts: list[str | None] = list(unit)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list = []

        def offer(i: int):
            j = after[i]
            if j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-s, i, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while queue:
            _, i, whole = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else -1
            if j < 0 or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def decoded(self, ids) -> str:
        """The text of ids, without the space that stands before every text."""
        data = b"".join([self.pieces[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Units:
    """The units of a column of texts, each text with a space before it and spaces as marks; null is empty."""

    def __init__(self, column: pa.Array, words: Vocabulary):
        texts = [(SPACE + x.replace(" ", SPACE)) if x else "" for x in column.to_pylist()]
        self.text = "".join(texts)
        self.points = np.frombuffer(self.text.encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        starts = np.zeros(len(self.points), bool)
        if len(starts):
            starts[0] = True
            starts[1:] = words.cuts(self.points)
            starts[ends[ends < len(starts)]] = True
        self.begin = np.nonzero(starts)[0]
        self.end = np.append(self.begin[1:], len(self.points))[: len(self.begin)]
        self.first = np.searchsorted(self.begin, np.concatenate([[0], ends]))
        self.hash = spans_hash(mixed(self.points.view(np.uint64)), self.begin, self.end)

    def __getitem__(self, k: int) -> str:
        return self.text[self.begin[k] : self.end[k]]


def unit_counts(documents: DataFrame, path: str) -> DataFrame:
    """unit, n: how often each unit of at most LONGEST characters is there."""
    schema = pa.schema([("unit", pa.string()), ("n", pa.int64())])

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for part in slices(batch, "text"):
                units = Units(part.column(0), words)
                short = np.nonzero(units.end - units.begin <= LONGEST)[0]
                _, at, n = np.unique(units.hash[short], return_index=True, return_counts=True)
                yield pa.record_batch([pa.array([units[k] for k in short[at].tolist()], pa.string()), pa.array(n)], schema=schema)

    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, rank (small for a good score) of the pieces of two characters or more: at most as many rows as the vocabulary has."""
    words = vocabulary(path)
    return spark.createDataFrame([(p, -words.score[p]) for p in words.ids if len(p) > 1], "piece string, rank double")


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """unit, edges: the pieces of two characters or more in it as rank, start, ends (bits of both ends), inner (bits between); sorted.

    units must be partitioned by unit, so that a unit's edges are grouped where they are made.
    """
    n = F.length("unit")
    spans = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda k: F.struct(i.alias("start"), k.alias("size")))))
    exploded = units.filter(n > 0).select("unit", F.explode(spans).alias("s")).select("unit", "s.start", "s.size", F.expr("substring(unit, s.start + 1, s.size)").alias("piece"))
    # of the substrings of one character, which are no edges, the first keeps a unit without edges in the table
    kept = exploded.filter("size > 1 or start = 0")
    bit = lambda at: f"shiftleft(1L, {at})"
    edge = F.struct("rank", "start", F.expr(f"{bit('start')} | {bit('start + size')}").alias("ends"), F.expr(f"({bit('start + size')} - 1) ^ ({bit('start + 1')} - 1)").alias("inner"))
    joined = kept.join(F.broadcast(pieces), "piece", "left")
    return joined.groupBy("unit").agg(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), edge))).alias("edges"))


def folded(edges: DataFrame) -> DataFrame:
    """unit, edges -> unit, pieces, whole: the fold's pieces, and whether no edge was left that could join.

    The state is a number whose bits are the boundaries between pieces, at first all.
    """

    def joins(mask, e):
        inside = mask.bitwiseAND(e["inner"])
        return (mask.bitwiseAND(e["ends"]) == e["ends"]) & (inside != 0) & (inside.bitwiseAND(inside - 1) == 0)

    start = F.expr("shiftleft(1L, length(unit) + 1) - 1")
    mask = F.aggregate("edges", start, lambda m, e: F.when(joins(m, e), m.bitwiseXOR(m.bitwiseAND(e["inner"]))).otherwise(m))
    marked = edges.withColumn("mask", mask).withColumn("whole", ~F.exists("edges", lambda e: joins(F.col("mask"), e)))
    bounds = F.expr("filter(sequence(0, length(unit)), p -> (mask & shiftleft(1L, p)) != 0)")
    pieces = F.expr("transform(sequence(1, size(bounds) - 1), i -> substring(unit, bounds[i - 1] + 1, bounds[i] - bounds[i - 1]))")
    return marked.withColumn("bounds", bounds).select("unit", pieces.alias("pieces"), "whole")


class Dictionary:
    """Ids of many units by a hash of the unit, in an open table that numpy probes for many units at once."""

    def __init__(self, units: list[str], ids: list[list[int]]):
        self.at = np.cumsum([0, *map(len, ids), 0])
        self.ids = np.fromiter((i for x in ids for i in x), np.int32, self.at[-1])
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.uint64)
        ends = np.cumsum(lengths)
        keys = spans_hash(mixed(points), ends - lengths, ends)
        bits = max(4, (2 * len(units)).bit_length() + 1)
        self.slots, self.low = np.full(1 << bits, -1, np.int32), np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        left, at = np.arange(len(units)), (keys & self.low).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several for one slot the last stays
            won = self.slots[at] == left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & int(self.low)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 where it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), (keys & self.low).astype(np.int64)
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            left, at = left[more], (at[more] + 1) & int(self.low)
        return out


def dictionary(documents: DataFrame, path: str, most: int = DICTIONARY) -> Dictionary:
    """The units that occur at least twice, and so often that they are `most` at most, with their ids from the lattice."""
    spark = documents.sparkSession
    words = vocabulary(path)
    counts = written(unit_counts(documents, path).filter("n > 1"), "pieces-units")
    # a row for each power of two that a count reaches
    seen = {r["k"]: r["units"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("units")).collect()}
    least, total = 64, 0
    while least > 0 and total + seen.get(least - 1, 0) <= most:
        least -= 1
        total += seen.get(least, 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 20_000)
    chosen = counts.filter(F.floor(F.log2("n")) >= least).select("unit").repartition(parts, "unit")
    found = folded(lattice(chosen, piece_table(spark, path), words.longest)).filter("whole").select("unit", "pieces")
    units, ids = [], []
    for batch in found.toArrow().to_batches():
        units += batch.column(0).to_pylist()
        ids += map(words.ids_of, batch.column(1).to_pylist())
    return Dictionary(units, ids)


def encode_column(column: pa.Array, words: Vocabulary, known: Dictionary, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and where each text's begin."""
    units = Units(column, words)
    at = known.find(units.hash)
    begin = known.at[np.maximum(at, 0)]
    size = np.where(at >= 0, known.at[np.maximum(at, 0) + 1] - begin, 0) if len(at) else np.zeros(0, np.int64)
    extra: list[int] = []
    base = len(known.ids)
    for k in np.nonzero(at < 0)[0].tolist():
        unit = units[k]
        ids = memo.get(unit)
        if ids is None:
            if len(memo) > 100_000:
                memo.clear()
            ids = words.merged(unit)
            if len(unit) <= LONGEST:
                memo[unit] = ids
        begin[k], size[k] = base + len(extra), len(ids)
        extra += ids
    source = np.concatenate([known.ids, np.array(extra, np.int32)])
    total = np.concatenate([[0], np.cumsum(size)])
    out = source[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
    return out, total[units.first]


def encoded(documents: DataFrame, path: str, most: int = DICTIONARY, digest: bool = False) -> DataFrame:
    """documents with a column ids (array<int>): what the model's own encoder gives. Null and empty texts have none.

    Whole texts are encoded, however long; repeated rows are kept and equal texts have equal ids. An input column named
    ids is replaced, all others are kept. No documents give no rows. Units of one 64-bit hash are taken as equal.

    With digest, instead doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), round_trip (whether decoding
    gives the text).
    """
    held = documents.sparkSession.sparkContext.broadcast(dictionary(documents, path, most))
    names = ["doc_id", "text"] if digest else [c for c in documents.columns if c != "ids"]
    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

    new = [StructField("n_pieces", LongType()), StructField("ids_crc32", LongType()), StructField("round_trip", BooleanType())] if digest else [StructField("ids", ArrayType(IntegerType()))]
    schema = StructType([*(documents.schema[c] for c in names if not digest or c != "text"), *new])

    def run(batches):
        words, memo = vocabulary(path), {}
        for batch in batches:
            for part in slices(batch, "text"):
                column = part.column(part.schema.get_field_index("text"))
                ids, at = encode_column(column, words, held.value, memo)
                if not digest:
                    yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=[*part.schema.names, "ids"])
                    continue
                out = []
                for text, a, b in zip(column.to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    own = ids[a:b]
                    out.append((b - a, zlib.crc32(own.astype("<u4").tobytes()), words.decoded(own.tolist()) == (text or "")))
                n, crc, same = zip(*out) if out else ((), (), ())
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return documents.select(*[f"`{c}`" for c in names]).mapInArrow(lean(run), schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """rows with a column ids -> with a column text of what the ids say; null ids give a null text."""
    names = [c for c in rows.columns if c != "text"]
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            yield pa.record_batch([*batch.columns, pa.array([None if x is None else words.decoded(x) for x in ids], pa.string())], names=[*batch.schema.names, "text"])

    return rows.select(*[f"`{c}`" for c in names]).mapInArrow(lean(run), StructType([*(rows.schema[c] for c in names), StructField("text", StringType())]))


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf_dir):
    """All documents encoded by the lattice and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path(MODEL)
    return encoded(read(spark, sf_dir, "documents").select("doc_id", "text"), path, digest=True)
