"""Token ids of documents in files of range-coded chunks, and their reading.

A file set is a folder of Parquet files whose rows are chunks: part and chunk (their order), docs (ids and
token counts, in order) and data (what rangecoder.encode makes). Parquet only carries the chunks, so that any
store that Spark can write will do and lost executors leave no half written file. Texts become ids in Python; the
coder runs in Spark's JVMs (jvmcoder), which makes the same bytes.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import jvmcoder, rangecoder
from .common import fresh, lean, lengths, read, slices
from .registry import query
from .words import U, mixed, spans_hash

TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a worker remembers at most.
PIECES = 1 << 20
#: Ids from which a chunk is closed at the next end of a document.
CHUNK = rangecoder.BLOCK * 64
#: Bytes of text a partition.
PART_BYTES = 128 << 20
SCHEMA = "part int, chunk int, docs array<struct<doc_id:long,n:long>>, data binary"


OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """Whether each code point is a letter, a number, white space or none of them, as the byte-level rule has it."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"[\p{White_Space}]+")):
        for run in regex.finditer(pattern, every):
            a, b = ord(run[0][0]), ord(run[0][-1])
            out[a : b + 1] = kind
    return out


def cut(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, given all their code points and where each text ends.

    The byte-level rule: contractions after an apostrophe; runs of letters, of numbers and of other signs, each
    with a space before it; runs of white space, of which the last character before something else stays apart
    or, if it is a space, goes with what follows.
    """
    n = len(points)
    kind = kinds()[points]
    text_start = np.zeros(n + 1, bool)
    text_start[0] = True
    text_start[ends] = True
    new = text_start[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    space = points == 32
    joined = np.zeros(n, bool)  # a space stands right before, in the same text
    joined[1:] = space[:-1] & ~text_start[1:n]
    blank = kind == BLANK
    last = np.zeros(n, bool)  # the last white space before something else
    last[:-1] = blank[:-1] & ~blank[1:] & ~text_start[1:n]
    starts = new & (blank | ~joined) | last
    # apostrophes that begin a piece and are alone in it: the letters of a contraction go with them
    for i in np.nonzero((points == 39) & starts)[0].tolist():
        if i + 1 < n and kind[i + 1] == LETTER and not text_start[i + 1]:
            two = points[i + 1 : i + 3].tolist()
            size = 1 if two[0] in (115, 116, 109, 100) else 2 if two in ([114, 101], [118, 101], [108, 108]) and not text_start[i + 2] else 0
            if size:
                starts[i + 1] = False
                after = i + 1 + size
                if after < n:
                    starts[after] = True
    return np.nonzero(starts)[0]


class Known:
    """Ids of the pieces met so far, by a 64-bit hash of the piece, in an open table that numpy probes for many at once.

    Pieces of one hash are taken as equal.
    """

    def __init__(self, bits: int = 16):
        self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.at, self.ids, self.count, self.all = np.zeros(2, np.int64), np.zeros(1 << 10, np.int32), 0, np.zeros(0, np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        low = len(self.keys) - 1
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), (keys & U(low)).astype(np.int64)
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            left, at = left[more], (at[more] + 1) & low
        return out

    def add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct keys that aren't there, all their ids one after another, and how many each has."""
        end = int(self.at[self.count])
        if end + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:end], np.zeros(2 * (end + len(flat)), np.int32)])
        self.ids[end : end + len(flat)] = flat
        self.at = np.concatenate([self.at[: self.count + 1], end + np.cumsum(sizes), [0]])
        self.at[-1] = self.at[-2]
        first, self.count = self.count, self.count + len(keys)
        self.all = np.concatenate([self.all, keys])
        if 2 * self.count > len(self.keys):
            bits = (4 * self.count).bit_length()
            self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            first, keys = 0, self.all
        low = len(self.keys) - 1
        left, at = np.arange(len(keys)), (keys & U(low)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = first + left[free]  # of several for one slot the last stays
            won = self.slots[at] == first + left
            self.keys[at[won]] = keys[left[won]]
            left, at = left[~won], (at[~won] + 1) & low


class Encoder:
    """A tokenizer file's encoder for many texts.

    Where the tokenizer cuts texts by the byte-level rule before anything else, texts are cut with numpy, each
    distinct piece is encoded once and remembered; texts that hold an added token, and other tokenizers, are
    encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        rule = own.get("pre_tokenizer") or {}
        self.plain = rule.get("type") == "ByteLevel" and not rule.get("add_prefix_space") and rule.get("use_regex", True) and not own.get("normalizer")
        self.added = [t["content"] for t in own.get("added_tokens", [])]
        self.known = Known()
        # bytes of each id, if the vocabulary has every byte, so that ids cover the bytes of texts without gaps
        vocabulary = self.tokenizer.get_vocab()
        self.widths = None
        if self.plain and sum(len(x) == 1 for x in vocabulary) == 256:
            self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.widths[list(vocabulary.values())] = list(map(len, vocabulary))

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of all texts one after another, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As each(), of texts without added tokens: the library gives one list of ids for all, which the texts' bytes part."""
        if self.widths is None:
            return self.each(texts)
        ids = np.array(self.tokenizer.encode_batch_fast([texts], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum(lengths(pa.array(texts, pa.large_string())))
        after = np.cumsum(self.widths[ids])
        last = np.searchsorted(after, ends)
        if len(after) != last[-1] + 1 or (after[last] != ends).any():  # not what a byte-level vocabulary gives
            return self.each(texts)
        return ids, np.diff(last + 1, prepend=0)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if not self.plain or any(a in t for t in texts for a in self.added):
            return self.each(texts)
        text = "".join(texts)
        if not text:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begin = cut(points, text_ends)
        end = np.append(begin[1:], len(points))
        keys = spans_hash(mixed(points.astype(np.uint64)), begin, end)
        at = self.known.find(keys)
        miss = np.nonzero(at < 0)[0]
        if len(miss):
            new, first = np.unique(keys[miss], return_index=True)
            if self.known.count > PIECES:
                self.known = Known()
                new, first, miss = *np.unique(keys, return_index=True), np.arange(len(keys))
            pieces = [text[begin[k] : end[k]] for k in miss[first].tolist()]
            self.known.add(new, *self.pieces(pieces))
            at[miss] = self.known.find(keys[miss])
        start = self.known.at[at]
        size = self.known.at[at + 1] - start
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.known.ids[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
        first = np.searchsorted(begin, np.concatenate([[0], text_ends]))
        return ids, np.diff(total[first])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> str:
    """Encode doc_id, text (null: empty) with end_id after each, in ascending doc_id order, and write the files; returns path.

    Rows of a null id come first; repeated rows are all written; rows of one id are in the order of their texts. Whole
    texts are encoded, however long: a text longer than a batch is a chunk of its own; one of 2 ** 29 ids or more, beyond
    what an array of Spark's holds, is an error. Other columns are left out. No rows make no files. Without `parts` there are as many partitions as the texts' bytes need, and no fewer than the session has.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    kinds = pa.struct([("doc_id", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("docs", pa.list_(kinds)), ("data", pa.binary())])

    def run(batches):
        part, encode, chunk, docs, ids, held = TaskContext.get().partitionId(), encoder(tokenizer), 0, [], [], 0
        last = np.array([end_id], np.int32)

        def close():
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([docs], schema.field(2).type), pa.array([np.concatenate(ids).astype("<i4", copy=False).tobytes()], pa.binary())], schema=schema)

        for batch in batches:
            for piece in slices(batch, "text"):
                found, counts = encode(piece.column(1).to_pylist())
                at = 0
                for doc, n in zip(piece.column(0).to_pylist(), counts.tolist()):
                    ids += [found[at : at + n], last]
                    docs.append({"doc_id": doc, "n": n + 1})
                    held, at = held + n + 1, at + n
                    if held >= CHUNK:
                        yield close()
                        chunk, docs, ids, held = chunk + 1, [], [], 0
        if docs:
            yield close()

    chunks = ordered.mapInArrow(lean(run), SCHEMA)
    chunks.withColumn("data", jvmcoder.encoded(spark, F.col("data"))).write.parquet(path)
    return path


def read_back(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (or ids) of each document in the files.

    start counts the ids of all documents before: chunks' totals are summed within their part and parts' totals
    over parts, so one task sees no more rows than there are parts.
    """
    chunks = spark.read.schema(SCHEMA).parquet(path)
    totals = chunks.select("part", "chunk", F.aggregate("docs", F.lit(0).cast("long"), lambda a, d: a + d["n"]).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("part_start"))
    offsets = totals.select("part", "chunk", before(Window.partitionBy("part").orderBy("chunk")).alias("chunk_start")).join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("chunk_start")).alias("first"))
    last = "ids_crc32 long" if digest else "ids array<int>"
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, chunk, docs, data = (c[k].as_py() for c in batch.columns)
                ids = np.frombuffer(data, "<u4")
                ends = np.cumsum([d["n"] for d in docs])
                starts = ends - [d["n"] for d in docs]
                if digest:
                    found = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())
                else:
                    found = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
                n = len(docs)
                yield pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([chunk] * n, pa.int32()), pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array(starts, pa.int64()), pa.array([d["n"] for d in docs], pa.int64()), found], schema=schema)

    rows = chunks.withColumn("data", jvmcoder.decoded(spark, F.col("data"))).mapInArrow(lean(run), f"part int, chunk int, doc_id long, at long, n_tokens long, {last}")
    return rows.join(offsets, ["part", "chunk"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", last.split()[0])


@query("op2_token_output")
def op2_token_output(spark, sf_dir):
    """All documents' token ids, each followed by id 2, written in doc_id order and read back from the files."""
    import public_tokenizers

    return read_back(spark, write(read(spark, sf_dir, "documents"), fresh(spark, "tokens"), public_tokenizers.path(TOKENIZER), 2))
