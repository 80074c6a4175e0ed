import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import same_rows

from loomstone.llm import substring
from loomstone.llm.words import Words


def brute(rows, size):
    """doc_id, words, words removed, digest of the rest for each row."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    owner = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                owner[key] = min(i, owner.get(key, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if owner[tuple(w[k : k + size])] < i:
                    gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = substring.finished(df, substring.repeated_windows(df, size), size, True).collect()
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    assert got(spark, rows, 13) == brute(rows, 13)
    out = substring.deduplicated(odd_documents, 13)
    assert out.columns == odd_documents.columns and out.count() == len(rows)
    assert substring.deduplicated(no_documents, 13).isEmpty() and substring.finished(no_documents, substring.repeated_windows(no_documents, 13), 13, True).isEmpty()


@pytest.mark.parametrize("most", [2048, 1])
def test_small_alphabet(spark, monkeypatch, most):
    """Few words, so that windows repeat everywhere, within documents and across; with and without crowded shards."""
    import random

    monkeypatch.setattr(substring, "CONTEXTS", most)
    r = random.Random(most)
    rows = [(i // 2 if i % 7 == 0 else i, " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))) for i in range(80)]
    assert got(spark, rows, 8) == brute(rows, 8)


def test_shared_passages(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'u{i}x{j}' for j in range(i % 5))} {passage if i % 3 else ''} {' '.join(f'v{i}x{j}' for j in range(20))}") for i in range(50)]
    assert got(spark, rows, 13) == brute(rows, 13)


def test_more_keys_than_a_filter_tells_apart(spark, monkeypatch):
    """Joins instead of filters, frequent keys by broadcast: the same result."""
    from loomstone.llm import bloom, common

    monkeypatch.setattr(bloom, "KEYS", 3)
    monkeypatch.setattr(common, "LEAST", 4)
    monkeypatch.setattr(common, "KEYS", 16)
    monkeypatch.setattr(substring, "CONTEXTS", 6)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'u{i}x{j}' for j in range(i % 9))} {passage} {' '.join(f'v{i % 4}x{j}' for j in range(20))}") for i in range(60)]
    assert got(spark, rows, 13) == brute(rows, 13)


def test_query(spark, duck, sf_dir):
    from loomstone.llm.queries import ORACLES, QUERIES

    same_rows(QUERIES["op9_substring_dedup"](spark, sf_dir), duck.sql(ORACLES["op9_substring_dedup"]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=12), max_size=6), st.text("ab", max_size=20), st.integers(1, 4))
def test_automaton(texts, query, size):
    automaton = substring.SuffixAutomaton()
    for i, t in enumerate(texts):
        automaton.add(t, i)
    for at, (matched, _) in enumerate(automaton.statistics(query), 1):
        assert matched == max(k for k in range(at + 1) if k == 0 or any(query[at - k : at] in t for t in texts))
    want = [next((i for i, t in enumerate(texts) if query[k : k + size] in t), None) for k in range(len(query) - size + 1)]
    assert automaton.owners(query, size) == want


def test_references(spark):
    df = spark.createDataFrame([(1, "keep this one two three four five and this"), (2, None), (3, "one two three")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring.without_references(df, ["x one two three four five y"], 4).collect()}
    assert out == {1: "keep this and this", 2: None, 3: "one two three"}
    with pytest.raises(ValueError):
        substring.without_references(df, ["a b c"], 2, most=2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(" \n\tab é", max_size=15), max_size=8))
def test_words(texts):
    words = Words(pa.array(texts, pa.string()))
    want = [(t or "").encode().split() for t in texts]
    assert [words.list(a, b) for a, b in zip(words.first[:-1], words.first[1:])] == want
    flat = [w for ws in want for w in ws]
    assert len(set(words.hash.tolist())) == len(set(flat))


def test_cut():
    import numpy as np

    assert substring.cut(b" a  b\nc d ", np.array([False, True, True, False])) == b" a  d "
    assert substring.cut(b"a b", np.array([True, True])) == b"" and substring.cut(b"a b", np.array([False, True])) == b"a "
