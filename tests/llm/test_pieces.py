import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from loomstone.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)
ODD = ["", " ", "  ", "\n", "é𝄞 ▁x", "a\tb\r\n c", "x" * 500, "    lead", "trail   ", "1234567890" * 20, "\u0000a", "ａ①ﬁ", "!!!!!!!!!", "a.▁.b", "straße", "in" * 50, "a" * 61 + " " + "b" * 60]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéñß  .,!1\n'▁中") for _ in range(r.randint(1, 200))) for _ in range(200)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_plain_merges(texts, library):
    words = pieces.vocabulary(PATH)
    units = pieces.Units(pa.array(texts), words)
    for i, t in enumerate(texts):
        ids = [x for k in range(units.first[i], units.first[i + 1]) for x in words.merged(units[k])]
        assert ids == library.encode(t)
        assert words.decoded(ids) == library.decode(ids)
        long = [x for k in range(units.first[i], units.first[i + 1]) for x in words.ids_of(words._merged_long(units[k]))]
        assert long == ids


def test_lattice(spark, texts, library):
    words = pieces.vocabulary(PATH)
    units = pieces.Units(pa.array(texts), words)
    own = sorted({units[k] for k in range(len(units.begin)) if units.end[k] - units.begin[k] <= pieces.LONGEST})
    table = spark.createDataFrame([(u,) for u in own], "unit string").repartition(3, "unit")
    rows = pieces.folded(pieces.lattice(table, pieces.piece_table(spark, PATH), words.longest)).collect()
    assert sorted(r["unit"] for r in rows) == own
    assert all(words.ids_of(r["pieces"]) == words.merged(r["unit"]) and "".join(r["pieces"]) == r["unit"] for r in rows if r["whole"])
    assert sum(r["whole"] for r in rows) > 0.99 * len(rows)


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_documents(spark, odd_documents, texts, library, most):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    rows = odd_documents.select("doc_id", "text", "ids").unionByName(more, allowMissingColumns=True)
    got = pieces.encoded(rows, PATH, most)
    found = got.collect()
    assert len(found) == rows.count() and got.columns == ["doc_id", "text", "ids"]
    assert all(r["ids"] == library.encode(r["text"] or "") for r in found)
    back = pieces.decoded(got.select("doc_id", "ids"), PATH).collect()
    assert {r["doc_id"]: r["text"] for r in back if r["doc_id"] is not None} == {r["doc_id"]: library.decode(r["ids"]) for r in found if r["doc_id"] is not None}


def test_digests(spark, odd_documents, no_documents, library):
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    for r in pieces.encoded(odd_documents, PATH, digest=True).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_pieces"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
    assert pieces.encoded(no_documents, PATH).isEmpty()


def test_dictionary():
    units = [f"unit{i}" for i in range(3000)]
    known = pieces.Dictionary(units, [[i, i + 1] for i in range(3000)])
    from loomstone.llm.words import mixed, spans_hash

    points = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(u) for u in units])
    keys = spans_hash(mixed(points), ends - [len(u) for u in units], ends)
    assert known.find(keys).tolist() == list(range(3000)) and known.find(keys ^ np.uint64(1)).tolist() == [-1] * 3000
    assert pieces.Dictionary([], []).find(keys).tolist() == [-1] * 3000


def test_query(spark, sf_dir, library):
    """The registered query against the library, document by document."""
    from loomstone.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_pieces"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), library.decode(ids) == texts[r["doc_id"]])
