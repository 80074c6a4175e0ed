import zlib

import numpy as np
import pytest

from loomstone.llm import quality


@pytest.fixture(scope="module")
def network():
    import duckdb

    p = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, quality, text FROM '{p}/documents.parquet' JOIN '{p}/labels.parquet' USING (doc_id)").fetchall()
    part = lambda held: [(y, np.frombuffer(t.encode(), np.uint8)) for i, y, t in rows if (zlib.crc32(str(i).encode()) % 4 == 2) == held]
    learned = part(False)[:1500]
    return quality.Network().train([t for _, t in learned], np.array([y for y, _ in learned], np.float32)), part(True)


def scores(net, texts):
    return net.score(np.concatenate(texts) if texts else np.zeros(0, np.uint8), np.array([len(t) for t in texts], np.int64))


def test_held_out_accuracy(network):
    net, held = network
    got = scores(net, [t for _, t in held])
    assert ((got >= 0.7) == np.array([y == 1 for y, _ in held])).mean() > 0.97
    assert (got >= 0).all() and (got <= 1).all()


def test_scores_depend_on_the_text_alone(network):
    net, held = network
    texts = [t for _, t in held[:20]] + [np.zeros(0, np.uint8)]
    alone = np.array([scores(net, [t])[0] for t in texts])
    assert np.allclose(scores(net, texts), alone, atol=1e-6) and np.allclose(scores(net, texts[::-1])[::-1], alone, atol=1e-6)


def test_the_whole_text_counts(network):
    net, held = network
    good = next(t for y, t in held if y == 1 and len(t) > 2000)
    bad = next(t for y, t in held if y == 0 and scores(net, [t])[0] < 0.1)
    assert scores(net, [np.concatenate([good] + [bad] * 40)])[0] < scores(net, [good])[0]


def test_convolution_equals_the_plain_form():
    net = quality.Network(3)
    text = np.frombuffer(b"some bytes to look at, more than one half of a chunk long, " * 9, np.uint8)
    laid, _, first = quality.placed(text, np.array([len(text)]))
    e = net.weights["embed"][laid]
    plain = sum(e[k : len(laid) - quality.SPAN + k] @ net.weights["filters"][k] for k in range(quality.SPAN))
    plain[-quality.SPAN + 1 :] = -np.inf
    want = plain.reshape(-1, quality.HALF, quality.FILTERS).max(axis=1)
    assert np.allclose(net.responses(laid, first, net.tables()), want, atol=1e-4)
    values, doc = quality.chunks(want, first)
    assert len(values) == len(want) - 1 and set(doc) == {0}


def test_gradients():
    net = quality.Network(1)
    r = np.random.default_rng(0)
    texts, labels = [r.integers(0, 256, n).astype(np.uint8) for n in (300, 40, 700)], np.array([1, 0, 1], np.float32)
    grads = net.gradients(texts, labels)

    def loss():
        p = scores(net, texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for name, at in (("out", 3), ("hidden", (5, 2)), ("filters", (1, 2, 4)), ("out_bias", 0)):
        old = net.weights[name][at]
        net.weights[name][at] = old + 1e-2
        up = loss()
        net.weights[name][at] = old - 1e-2
        down = loss()
        net.weights[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(grads[name][at]), abs=2e-3)


def test_odd_documents(spark, odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 5)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(15)] + [(None, 1, 0), (3, None, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classified(odd_documents, labels)
    rows = got.collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not r["text"]}) == 1 and got.columns.count("score") == 1
    assert quality.classified(no_documents, labels).isEmpty()
    assert quality.classified(odd_documents, labels.filter("false")).count() == len(rows)


def test_learns_from_its_part_of_the_labels_alone(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts, y = quality.sample(documents, labels, "quality")
    held = {r["text"] for r in documents.join(labels, "doc_id").filter(quality.held_out(documents["doc_id"])).collect()}
    free = {r["text"] for r in documents.join(labels, "doc_id").filter(~quality.held_out(documents["doc_id"])).collect()}
    assert {t.tobytes().decode() for t in texts} <= free and len(texts) == len(y)
    assert not {t.tobytes().decode() for t in texts} & (held - free)
    assert len(quality.sample(documents, labels, "quality", 7)[0]) <= 7


def test_query(spark, sf_dir, documents):
    """The registered query: which rows are held out, that equal texts have equal scores, and how well held out rows are told."""
    import zlib

    from loomstone.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = QUERIES["op7_quality"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 10 and sum(p == y for p, y in held) >= 0.8 * len(held)
