import random

import pytest

from loomstone.llm import mixing


def iterated(sizes, weights, share, epochs):
    """The rule as told: clamp, share the excess again, until none is above."""
    total, caps, out, clamped = share * sum(sizes), [epochs * s for s in sizes], [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in clamped]
        if not free:
            return out
        rest, weight = total - sum(caps[i] for i in clamped), sum(weights[i] for i in free)
        for i in free:
            out[i] = rest * weights[i] / weight
        above = [i for i in free if out[i] > caps[i]]
        if not above:
            return out
        for i in above:
            out[i] = caps[i]
            clamped.add(i)


@pytest.mark.parametrize("seed", range(8))
def test_water_fill(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 5, 100, 1000, 50_000]) for _ in range(r.choice([1, 2, 3, 5, 9]))]
    weights = [[3.0, 1.0, 2.0][i % 3] for i in range(len(sizes))]
    table = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.water_fill(mixing.source_weights(table, [3.0, 1.0, 2.0]), 1.5, 2.0).collect()}
    for i, t in enumerate(iterated(sizes, weights, 1.5, 2.0)):
        assert got[f"s{i}"] == pytest.approx(t, abs=1e-6)


def test_odd_documents(spark, odd_documents):
    plan = mixing.mixed(odd_documents, [3.0, 1.0, 2.0], 1.5, 2.0, "s", ["lang", "n_chars", "ids"])
    rows = plan.collect()
    assert len(rows) == odd_documents.count() and all(0 <= x["taken"] <= 2 * x["size"] for x in rows)
    assert {x["source"] for x in rows} == {"s0", "s1", "s2", None}
    assert len({x["source_size"] for x in rows if x["source"] is None}) == 1
    again = mixing.mixed(odd_documents.repartition(5), [3.0, 1.0, 2.0], 1.5, 2.0, "s").collect()
    key = lambda x: (str(x["doc_id"]), x["size"], x["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.repeated(odd_documents, [3.0, 1.0, 2.0], 1.5, 2.0, "s").columns == odd_documents.columns


def test_rows_without_words_keep_to_the_epochs(spark):
    rows = [(i, "a", "" if i < 5 else "some words here") for i in range(20)] + [(100 + i, "b", "word " * 50) for i in range(40)] + [(200, "c", None)]
    for share in (1.5, 40.0):
        table = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
        plan = {r["doc_id"]: r["copies"] for r in mixing.mixed(table, [3.0, 1.0, 2.0], share, 2.0, "s").collect()}
        assert max(plan.values()) <= 2 and min(plan[i] for i in range(20)) >= 1 and plan[200] == 0
        assert mixing.repeated(table, [3.0, 1.0, 2.0], share, 2.0, "s").count() == sum(plan.values())


def test_close_to_targets(spark, documents):
    rows = mixing.mixed(documents, [3.0, 1.0, 2.0], 1.5, 2.0, "s").collect()
    for source in {x["source"] for x in rows}:
        own = [x for x in rows if x["source"] == source]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= max(x["size"] for x in own)
    assert sum({x["source"]: x["target"] for x in rows}.values()) == pytest.approx(1.5 * sum(x["size"] for x in rows))


def test_no_documents(no_documents):
    assert mixing.mixed(no_documents, [3.0], 1.5, 2.0, "s").isEmpty() and mixing.repeated(no_documents, [3.0], 1.5, 2.0, "s").isEmpty()


def test_native(spark, sf_dir, capsys):
    from loomstone.llm.queries import QUERIES

    QUERIES["op1_mix_sources"](spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian"))
