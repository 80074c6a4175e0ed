import hashlib
import random
import zlib

import numpy as np
import pytest

from loomstone.llm import matroska as m


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000, 576 * 300 + 5])
@pytest.mark.parametrize("lacing", [m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING])
def test_round_trip(size, lacing):
    data = random.Random(size).randbytes(size)
    found = m.demux(file := m.mux(m.padded(data), lacing))
    assert b"".join(file[a:b] for _, _, a, b in found["packets"]) == m.padded(data)
    assert [t for _, t, _, _ in found["packets"]] == [m.timestamp(i) for i in range(len(found["packets"]))]
    assert found["tracks"] == [1] and len(found["cues"]) == len(found["clusters"])


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACING])
@pytest.mark.parametrize("sizes", [[100, 300, 5, 70000, 1], [7], [0, 1], [255, 255, 254], [1, 100000, 0]])
def test_lacing(kind, sizes):
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    data = m.laced(frames, kind)
    assert [data[a:b] for a, b in m.unlace(data, 0, len(data), kind)] == frames


def test_integers():
    for value in (0, 1, 126, 127, 16382, 16383, 1 << 30):
        assert m.read_vint(m.vint(value), 0)[0] == value
    assert m.read_vint(b"\xff", 0)[0] == -1 and m.read_vint(b"\x1a\x45\xdf\xa3", 0, marker=True)[0] == m.EBML
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(ValueError):
            m.read_vint(bad, 0)


def test_foreign_files():
    """Clusters of unknown size, blocks in groups, unknown elements, several tracks."""
    block = lambda track, at, flags, data: m.vint(track) + at.to_bytes(2, "big", signed=True) + bytes([flags]) + data
    body = m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 1)) + m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, 2)))
    cluster = m.number(m.CLUSTER_TIMESTAMP, 1000) + m.element(0xEC, b"void") + m.element(m.SIMPLE_BLOCK, block(1, 5, 0x80, b"one")) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(2, -5, 0, b"two")))
    body += m.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster
    body += m.element(m.CLUSTER, m.number(m.CLUSTER_TIMESTAMP, 2000) + m.element(m.SIMPLE_BLOCK, block(1, 0, 0x84, b"\x01ababab")))
    file = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    found = m.demux(file)
    assert [(t, at, file[a:b]) for t, at, a, b in found["packets"]] == [(1, 1005, b"one"), (2, 995, b"two"), (1, 2000, b"aba"), (1, 2000, b"bab")]
    with pytest.raises(ValueError):
        m.demux(file + b"\xa3\x99\x00")


def test_malformed_files(spark):
    """Files that are cut off anywhere, changed, or no media at all: a row that says so, and the others are parsed."""
    whole = m.mux(m.padded(b"some payload " * 90))
    r = np.random.default_rng(0)
    bad = [whole[:k] for k in range(1, len(whole), 97)] + [bytes(r.integers(0, 256, 200).astype(np.uint8)) for _ in range(40)]
    bad += [whole[:k] + bytes([whole[k] ^ 0xFF]) + whole[k + 1 :] for k in range(0, 120)]
    rows = spark.createDataFrame([*enumerate(bad), (10_000, whole), (10_001, None), (10_002, b"")], "id long, media binary")
    found = m.packet_table(rows, "id").collect()
    assert {x["id"] for x in found} <= {*range(len(bad)), 10_000} and not [x for x in found if x["id"] == 10_000 and x["problem"]]
    broken = [x for x in found if x["problem"]]
    assert len(broken) > 20 and all(x["track"] is None for x in broken) and not {x["id"] for x in broken} & {x["id"] for x in found if not x["problem"]}
    assert b"".join(whole[x["first_byte"] : x["end_byte"]] for x in found if x["id"] == 10_000) == m.padded(b"some payload " * 90)


def test_tables(spark, odd_documents, no_documents):
    files = m.media(odd_documents, "doc_id", "text")
    packets = m.packet_table(files, "doc_id").groupBy("doc_id").count().collect()
    sizes = {r["doc_id"]: r["n_bytes"] for r in files.collect()}
    assert {p["doc_id"] for p in packets} == set(sizes)
    assert all(p["count"] % max(1, -(-sizes[p["doc_id"]] // 576)) == 0 for p in packets)
    assert m.media(no_documents, "doc_id", "text").isEmpty()


def test_query(spark, sf_dir, documents):
    from loomstone.llm.queries import QUERIES

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    for row in QUERIES["op5_media_matroska"](spark, sf_dir).collect():
        payload = m.padded(texts[row["doc_id"]])
        assert (row["n_bytes"], row["payload_bytes"]) == (len(texts[row["doc_id"]]), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-32:])
        assert row["media_sha256"] == hashlib.sha256(file := m.mux(payload)).hexdigest() and row["media_bytes"] == len(file)
