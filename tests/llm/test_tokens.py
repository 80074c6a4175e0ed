import bisect
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstone.llm import rangecoder, tokenfile, tokens

PATH = public_tokenizers.path(tokenfile.TOKENIZER)


@pytest.mark.parametrize("ids", [[], [5], [0, 1, 65535], [7] * 9000, list(range(0, 65536, 13)) * 3, [(1 << 28) - 1, 1 << 16, 70_000, 1 << 20] * 3000, list(range(9000, 0, -1))])
def test_round_trip(ids):
    ids = np.array(ids, np.int64)
    assert (rangecoder.decode(rangecoder.encode(ids)) == ids).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, (1 << 28) - 1) | st.integers(0, 65535) | st.integers(0, 3), max_size=300), st.integers(1, 64))
def test_round_trip_of_any(ids, block):
    ids = np.array(ids, np.int64)
    assert (rangecoder.decode(rangecoder.encode(ids, block)) == ids).all()


def test_coder_learns():
    assert len(rangecoder.encode(np.tile(np.array([5, 9, 300, 7]), 5000))) < 2500
    for bad in (1 << 28, -1):
        with pytest.raises(ValueError):
            rangecoder.encode(np.array([bad]))


def test_more_ids_than_the_table_keeps(monkeypatch):
    monkeypatch.setattr(rangecoder, "KEPT", 16)
    ids = np.random.default_rng(2).integers(0, 60, 6000)
    assert (rangecoder.decode(rangecoder.encode(ids, 1500)) == ids).all()


def test_coder_beats_deflate_and_nears_the_entropy_of_its_blocks(documents):
    """On the same blocks of real ids: fewer bytes than zlib makes of 16-bit ids, and near the entropy that leaves out the table."""
    encoder = tokenfile.Encoder(PATH)
    ids, _ = encoder([r["text"] or "" for r in documents.collect()])
    size = rangecoder.BLOCK
    blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
    own = len(rangecoder.encode(ids))
    assert own < 0.87 * sum(len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)
    counts = [np.unique(b, return_counts=True)[1] for b in blocks]
    assert own < 1.08 * sum(-(c * np.log2(c / c.sum())).sum() / 8 for c in counts)


def test_damage_is_found():
    data = bytearray(rangecoder.encode(np.random.default_rng(0).integers(0, 50_000, 9000)))
    data[len(data) // 2] ^= 0x40
    with pytest.raises(ValueError):
        rangecoder.decode(bytes(data))
    with pytest.raises(ValueError):
        rangecoder.decode(b"something else")


def test_blocks_are_independent():
    a, b = np.arange(100), np.arange(100, 200)
    one, two = rangecoder.encode(np.concatenate([a, b]), 100), rangecoder.encode(b, 100)
    assert one.endswith(two[28:])


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = ["", " ", "  \n a", "<|endoftext|> x", "it's we'll 'tis", "x" * 300, "🙂 é   z", "\n\n\n  \t b  ", "12 345  6", "a b c"]
    r = random.Random(1)
    for signs in ("ab'sltdrevm  \n\t1.é ", " \u00a0\u0085\u2028\u200b\u3000\x1c\x1f\x0bx1²Ⅳ·_中🙂", "''sre ll"):
        texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(300)]
    encoder = tokenfile.Encoder(PATH)
    for own in (texts, texts[1:3] + texts[4:], [""], []):
        ids, counts = encoder(own)
        want = [library.encode(t, add_special_tokens=False).ids for t in own]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_remembered_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokenfile, "PIECES", 5)
    encoder = tokenfile.Encoder(PATH)
    for k in range(5):
        texts = [f"some words {k} and {j}" for j in range(20)]
        ids, counts = encoder(texts)
        assert ids.tolist() == [i for t in texts for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]
    assert encoder.known.count < 60


def test_files(spark, odd_documents, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    path = tokenfile.write(odd_documents, f"file://{tmp_path}/t", PATH, 2, 4)
    got = tokenfile.read_back(spark, path, digest=False).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    assert [g["doc_id"] for g in got] == [d for d, _ in rows]
    for g, (_, text) in zip(got, rows):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert g["ids"] == ids and g["start"] == at and g["n_tokens"] == len(ids)
        at += len(ids)
    digest = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in tokenfile.read_back(spark, path).collect()}
    assert all(digest[g["doc_id"], g["start"]] == zlib.crc32(np.array(g["ids"], "<u4").tobytes()) for g in got)


def test_no_files(spark, no_documents, tmp_path):
    assert tokenfile.read_back(spark, tokenfile.write(no_documents, f"file://{tmp_path}/t", PATH, 2, 2)).isEmpty()


def test_counts_equal_the_library(documents):
    from tokenizers import Tokenizer

    library, path = Tokenizer.from_file(PATH), public_tokenizers.path(tokens.VOCABULARY)
    for row in documents.limit(60).collect():
        data = row["text"].encode()
        ends = tokens.line_ends(data)
        counts, _ = tokens.attributed(tokens.spans(row["text"], path), ends, "start")
        places, want = [len(data[:e].decode()) for e in ends], [0] * len(ends)
        for a, _ in library.encode(row["text"], add_special_tokens=False).offsets:
            want[bisect.bisect_right(places, a)] += 1
        assert counts.tolist() == want


def test_rules():
    ends, sections = np.array([2, 6, 9]), np.array([3, 9])
    assert tokens.attributed(ends, sections, "start")[0].tolist() == [2, 1]
    assert tokens.attributed(ends, sections, "most")[0].tolist() == [1, 2]
    assert tokens.attributed(ends, sections, "share")[0].tolist() == [1.25, 1.75] and tokens.attributed(ends, sections, "share")[1] == 1
    with pytest.raises(ValueError):
        tokens.counted(None, ["text"], "", "other")


def test_sections_of_odd_documents(odd_documents, no_documents):
    path = public_tokenizers.path(tokens.VOCABULARY)
    got = tokens.counted(odd_documents, ["text"], path).collect()
    assert {g["doc_id"] for g in got} == {r["doc_id"] for r in odd_documents.collect()}
    assert [(g["section"], g["tokens"]) for g in got if g["doc_id"] == 0] == [(0, 0.0)]
    fields = tokens.counted(odd_documents, ["lang", "text"], path, "share", by_line=False).filter("doc_id = 4").orderBy("field").collect()
    assert [g["field"] for g in fields] == ["lang", "text"] and sum(g["tokens"] for g in fields) == pytest.approx(len(tokens.spans("enOne two", path)))
    assert tokens.counted(no_documents, ["text"], path).isEmpty()


def test_query_of_token_output(spark, sf_dir, documents):
    """The registered query against the library, document by document."""
    from tokenizers import Tokenizer

    from loomstone.llm.queries import QUERIES

    library, at, want = Tokenizer.from_file(PATH), 0, []
    for r in documents.orderBy("doc_id").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op2_token_output"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_query_of_token_counts(spark, sf_dir, documents):
    """The registered query against the library's offsets: a token belongs to the line of its first character."""
    from tokenizers import Tokenizer

    from loomstone.llm.queries import QUERIES

    library, want = Tokenizer.from_file(PATH), []
    for r in documents.collect():
        lines = re.findall(r"[^\n]*\n|[^\n]+", r["text"] or "") or [""]
        counts, starts, first = [0] * len(lines), np.cumsum([0, *map(len, lines)]), np.cumsum([0, *(len(x.encode()) for x in lines)])
        offsets = library.encode(r["text"] or "", add_special_tokens=False).offsets
        for a, _ in offsets:
            counts[bisect.bisect_right(starts.tolist(), a) - 1] += 1
        want += [(r["doc_id"], k, int(first[k]), int(first[k + 1]), n) for k, n in enumerate(counts)]
    got = QUERIES["op6_token_counts"](spark, sf_dir).select("doc_id", "section", "first_byte", "end_byte", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(want)
