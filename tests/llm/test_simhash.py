import re

import numpy as np
import pytest
import xxhash

from loomstone.llm import simhash
from loomstone.llm.components import components


def brute(text, shingle):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(ids, marks, bits):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted(set(marks))
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for i, m in zip(ids, marks):
        if i is not None:
            least[find(m)] = min(i, least.get(find(m), i))
    return [least.get(find(m)) for m in marks]


def test_fingerprints(odd_documents):
    texts = [r["text"] for r in odd_documents.collect()]
    got = simhash.fingerprints([(t or "").encode() for t in texts], 3)[:, 0]
    assert [int(g) for g in got] == [brute(t, 3) for t in texts]


def test_odd_documents(spark, odd_documents, no_documents):
    got = simhash.near_groups(simhash.fingerprinted(odd_documents, 3), 3).collect()
    assert len(got) == odd_documents.count()
    assert [g["component_id"] for g in got] == reached([g["doc_id"] for g in got], [g["f0"] & (1 << 64) - 1 for g in got], 3)
    assert simhash.near_groups(simhash.fingerprinted(no_documents, 3), 3).isEmpty()
    kept = simhash.near_deduplicated(odd_documents)
    assert kept.columns == odd_documents.columns and kept.filter("doc_id = 5").count() == 1 and kept.filter("doc_id in (6, 7)").isEmpty()
    assert simhash.near_deduplicated(no_documents).isEmpty()


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_of_crowded_buckets(spark, monkeypatch, tile):
    """Fingerprints around a few centres, so that buckets go over tiles."""
    monkeypatch.setattr(simhash, "TILE", tile)
    r = np.random.default_rng(1)
    marks = []
    for centre in r.integers(0, 1 << 63, 3).tolist():
        for _ in range(120):
            marks.append(centre ^ sum({1 << int(b) for b in r.integers(0, 64, r.integers(0, 7))}))
    df = spark.createDataFrame([(i, simhash.signed(m)) for i, m in enumerate(marks)], "doc_id long, f0 long")
    got = {g["doc_id"]: g["component_id"] for g in simhash.near_groups(df, 3).collect()}
    assert [got[i] for i in range(len(marks))] == reached(range(len(marks)), marks, 3)


def test_every_close_pair_shares_a_bucket():
    r = np.random.default_rng(2)
    for bits, blocks in ((3, 4), (3, 5), (3, 6), (2, 5)):
        masks = [m & (1 << 64) - 1 for _, m in simhash.pigeonhole(bits, blocks)]
        for _ in range(200):
            flip = sum({1 << int(b) for b in r.integers(0, 64, bits)})
            assert any(flip & m == 0 for m in masks)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def survivors(rows):
    """Brute force: rows (doc_id, text) of which one of each component at similarity 0.8 or more stays."""
    sets = sorted({shingle_set(t) for _, t in rows}, key=lambda x: sorted(x))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if 9 * both >= 4 * (len(a) + len(sets[j])) and both:
                root[find(i)] = find(j)
    at = {s: find(i) for i, s in enumerate(sets)}
    return at


def edited(r, words, n):
    """The words with n of them changed, left out or put in, anywhere."""
    new = list(words)
    for _ in range(n):
        k = int(r.integers(0, len(new)))
        kind = r.integers(0, 3)
        if kind == 0:
            new[k] = f"changed{r.integers(0, 99)}"
        elif kind == 1 and len(new) > 6:
            del new[k]
        else:
            new.insert(k, f"more{r.integers(0, 99)}")
    return new


@pytest.mark.parametrize("group", [2048, 4])
def test_near_copies(spark, documents, monkeypatch, group):
    """Exactly what links of similarity 0.8 or more connect is thinned to one, over texts of 1 to many words and chains of edits."""
    monkeypatch.setattr(simhash, "GROUP_TEXTS", group)
    r = np.random.default_rng(3)
    rows = [(row["doc_id"] * 100, row["text"]) for row in documents.limit(60).collect()]
    for n in (5, 6, 7, 8, 9, 10, 12, 16, 20, 30, 45, 80, 200):
        for v in range(4):
            rows.append((10**6 + n * 100 + v, " ".join(f"w{n}v{v}x{i}" for i in range(n))))
    for i, text in list(rows):
        words = (text or "").split()
        for k in range(1, 8 if len(words) < 400 else 3):
            if len(words) >= 5:
                words = edited(r, words, max(1, int(len(words) * r.choice([0.005, 0.01, 0.02, 0.03]))))
                rows.append((i + k, " ".join(words)))
    at = survivors(rows)
    kept = [tuple(x) for x in simhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    least = {}
    for i, t in rows:
        component = at[shingle_set(t)]
        least[component] = min((i, t or ""), least.get(component, (i, t or "")))
    assert sorted((i, t or "") for i, t in kept) == sorted(least.values())


def test_alike_sets_share_a_part():
    """Sets at the edge of 0.8 agree in a part that isn't empty, at every size and across the classes."""
    r = np.random.default_rng(4)
    lost = tried = 0
    for n in [*range(2, 70), 100, 127, 128, 129, 250, 256, 300, 511, 512, 1000, 5000]:
        for _ in range(6):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            swap = n // 10 if r.integers(0, 2) else 0
            drop = 0 if swap else n // 5
            if drop and 5 * (n - drop) < 4 * n:
                drop -= 1
            b = np.concatenate([a[swap + drop :], r.integers(0, 1 << 63, swap).astype(np.uint64)])
            same = n - swap - drop
            if 9 * same < 4 * (len(a) + len(b)) or len(b) < 2:
                continue
            tried += 1
            found = [set(simhash.part_keys(np.sort(x), np.array([len(x)]))[1].tolist()) for x in (a, b)]
            lost += not found[0] & found[1]
    assert tried > 300 and not lost


def test_alike_brute_force():
    r = np.random.default_rng(5)
    for n in (1, 2, 30, 200):
        base = [r.integers(0, 1 << 60, 40) for _ in range(3)]
        sets = [np.unique(np.where(r.random(40) < r.choice([0.02, 0.06, 0.1]), r.integers(0, 1 << 60, 40), base[i % 3])).astype(np.uint64) for i in range(n)]
        a, b = simhash.alike(np.concatenate(sets), np.array(list(map(len, sets))), np.arange(n))
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        got = list(range(n))
        for x, y in zip(a.tolist(), b.tolist()):
            got[x] = y
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                    root[find(i)] = find(j)
        same = lambda f: {frozenset(i for i in range(n) if f(i) == k) for k in {f(i) for i in range(n)}}
        assert same(lambda i: got[i]) == same(find)


def test_rows_without_an_id(spark):
    """A null-id text unlike all others stays; copies of one stay once; copies of a document with an id go."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (None, text(1)), (2, text(2)), *[(None, text(k)) for k in (3, 4, 5, 6)], (None, text(4)), (3, text(7)), (3, text(2))]
    kept = [tuple(r) for r in simhash.near_deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([(1, text(1)), (2, text(2)), (3, text(7)), *[(None, text(k)) for k in (3, 4, 5, 6)]], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 100 < 99] + [(500, 501), (501, 500), (7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 100 * 100 for i in range(300) if i % 100) and got[501] == 500
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_query(spark, sf_dir, documents):
    """The registered query against fingerprints and components made plainly."""
    from loomstone.llm.queries import QUERIES

    rows = documents.collect()
    marks = [brute(r["text"], 3) for r in rows]
    want = [(r["doc_id"], f"{m:016x}", c) for r, m, c in zip(rows, marks, reached([r["doc_id"] for r in rows], marks, 3))]
    assert sorted(tuple(r) for r in QUERIES["op4_simhash"](spark, sf_dir).collect()) == sorted(want)
