import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomstone.llm import jvmcoder, rangecoder, tokenfile

PATH = public_tokenizers.path(tokenfile.TOKENIZER)


def table(spark, cases):
    return spark.createDataFrame([(k, None if x is None else bytearray(np.asarray(x).astype("<u4").tobytes())) for k, x in enumerate(cases)], "k int, raw binary")


@pytest.fixture(scope="module")
def real(documents):
    return tokenfile.Encoder(PATH)([r["text"] or "" for r in documents.collect()])[0]


def test_same_bytes_as_rangecoder(spark, real):
    r = np.random.default_rng(3)
    cases = [None, [], [0], [5], [0, 1, 65535], [7] * 9000, list(range(0, 65536, 13)) * 3, [(1 << 28) - 1, 1 << 16, 70_000, 1 << 20] * 3000, list(range(9000, 0, -1)), [0] * rangecoder.BLOCK]
    cases += [r.integers(0, most, n) for most, n in ((1 << 28, 9000), (3, 20_000), (5000, 2 * rangecoder.BLOCK), (6000, 1))] + [real]
    found = table(spark, cases).withColumn("data", jvmcoder.encoded(spark, F.col("raw"))).withColumn("back", jvmcoder.decoded(spark, F.col("data"))).collect()
    assert len(found) == len(cases)
    for row in found:
        assert row["back"] == row["raw"]
        assert row["data"] is None if cases[row["k"]] is None else bytes(row["data"]) == rangecoder.encode(np.asarray(cases[row["k"]], np.int64))


def test_damage_and_large_ids_fail(spark):
    data = rangecoder.encode(np.random.default_rng(0).integers(0, 50_000, 20_000))
    for at in (0, 20, 24, len(data) // 2, len(data) - 60):
        bad = bytearray(data)
        bad[at] ^= 0x40
        with pytest.raises(Exception, match="damaged|coded ids"):
            spark.createDataFrame([(bad,)], "data binary").select(jvmcoder.decoded(spark, F.col("data"))).collect()
    with pytest.raises(Exception, match="2 [*][*] 28"):
        table(spark, [[1, 1 << 28]]).select(jvmcoder.encoded(spark, F.col("raw"))).collect()


def test_files_hold_rangecoder_chunks(spark, documents, tmp_path, monkeypatch):
    """What is in the files is what rangecoder makes of the ids, in chunks that close at a document's end."""
    monkeypatch.setattr(tokenfile, "CHUNK", 20_000)
    path = tokenfile.write(documents, f"file://{tmp_path}/t", PATH, 2, 3)
    chunks = spark.read.parquet(path).orderBy("part", "chunk").collect()
    assert len(chunks) > 3
    want = {r["doc_id"]: r["ids_crc32"] for r in tokenfile.read_back(spark, path).collect()}
    for c in chunks:
        ids = rangecoder.decode(bytes(c["data"])).astype("<u4")
        assert rangecoder.encode(ids) == bytes(c["data"]) and len(ids) == sum(d["n"] for d in c["docs"])
        ends = np.cumsum([d["n"] for d in c["docs"]])
        assert [zlib.crc32(x.tobytes()) for x in np.split(ids, ends)[:-1]] == [want[d["doc_id"]] for d in c["docs"]]


def test_costs_less_than_numpy(spark, real):
    """Both ways of the file's coder take under half the CPU time of rangecoder's; op2's budget allows about a quarter."""
    ids = np.tile(real, -(-(1 << 21) // len(real)))[: 1 << 21]
    start = time.process_time()
    rangecoder.decode(rangecoder.encode(ids))
    numpy = time.process_time() - start
    once = table(spark, [ids]).coalesce(1).cache()
    assert once.count() == 1
    took = []
    for _ in range(2):  # the first call also compiles
        start = time.perf_counter()
        assert once.select(F.length(jvmcoder.decoded(spark, jvmcoder.encoded(spark, F.col("raw"))))).first()[0] == 4 * len(ids)
        took.append(time.perf_counter() - start)
    once.unpersist()
    assert min(took) < numpy / 2


def test_pieces_in_one_list():
    """Many pieces at once have the library's ids, each its own; where bytes and ids don't fit, pieces are encoded one by one."""
    encoder = tokenfile.Encoder(PATH)
    pieces = [" the", "the", "'s", "  ", "\n\n", " é", "🙂", "　", "12", " ..", "x" * 500, " naïve", "ſ", "the"]
    want = [encoder.tokenizer.encode(p, add_special_tokens=False).ids for p in pieces]
    for widths in (encoder.widths, encoder.widths + 1, None):
        encoder.widths = widths
        ids, counts = encoder.pieces(pieces)
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert tokenfile.Encoder(PATH).widths is not None
