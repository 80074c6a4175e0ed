import numpy as np
import pytest
from tests.conftest import same_rows

from loomstone.llm import topk


def brute(rows, asked, k):
    out = []
    for q, qv in asked:
        found = sorted((-int(np.dot(qv, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("n, same", [(300, 0), (120, 100), (5, 0), (1, 0)])
def test_equals_brute_force(spark, n, same, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    r = np.random.default_rng(n)
    vectors = [r.normal(size=6).tolist() for _ in range(n)]
    vectors[: min(same, n)] = [vectors[0]] * min(same, n)
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(4)
    rows = topk.usable(table, "vec_id", "embedding")
    got = topk.top_k(rows.filter("id % 10 = 0"), rows, 5, 1024.0).collect()
    ints = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in enumerate(vectors)]
    assert sorted(tuple(g) for g in got) == brute(ints, [x for x in ints if x[0] % 10 == 0], 5)


@pytest.mark.parametrize("seed", [7, 19])
def test_copies_below_a_few_better_rows(spark, seed):
    """300 rows of one score, over SPARE * k, below some that are slightly better: bins are refined."""
    r = np.random.default_rng(seed)
    query = np.floor(1024 * r.normal(size=8)).astype(np.int64)
    vectors = np.concatenate([np.repeat(query[None], 300, 0), query + r.integers(-3, 4, size=(20, 8)), np.floor(1024 * r.normal(size=(50, 8))).astype(np.int64)])
    ints = list(enumerate(vectors))
    rows = topk.usable(spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in ints], "vec_id long, embedding array<double>").repartition(4), "vec_id", "embedding")
    got = topk.top_k(rows.filter("id = 0"), rows, 10, 1.0).collect()
    assert sorted(tuple(g) for g in got) == brute(ints, ints[:1], 10)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [3.0, 1.0]), (5, [3.0, 1.0]), (None, [9.0, 9.0]), (100, [-1.0, -2.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    own = topk.usable(table, "vec_id", "embedding")
    got = [tuple(g) for g in topk.top_k(own.filter("id % 100 = 0"), own, 10, 1.0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 5), (0, 2, 5, 5), (0, 3, 100, -5), (100, 1, 0, -5), (100, 2, 5, -5), (100, 3, 5, -5)]
    assert topk.top_k(own.filter("false"), own, 10, 1.0).isEmpty() and topk.top_k(own.filter("false"), own.filter("false"), 10, 1.0).isEmpty()


def test_large_components(spark):
    """Scores up to 64 bits are exact, sums that run over on the way too; beyond them there is an error, not an answer."""
    a, b = np.array([[1 << 31, 1 << 31, 3]]), np.array([[1 << 31, -(1 << 31), 5], [(1 << 31) - 1, 7, 1]])
    assert topk.products(b, a).tolist() == [[15, (1 << 31) * ((1 << 31) + 6) + 3]]
    with pytest.raises(OverflowError):
        topk.products(np.array([[1 << 40, 3]]), np.array([[1 << 40, 3]]))
    with pytest.raises(OverflowError):
        topk.matrix(spark.createDataFrame([([1e17],)], "v array<double>").toArrow().column(0).combine_chunks(), 1, 1024.0)

    def found(*vectors):
        rows = topk.usable(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), "vec_id", "embedding")
        return topk.top_k(rows.filter("id = 0"), rows, 2, 1024.0).collect()

    large = [[1e6 * x] * 4 for x in (1, 2, 1e-6, -1)]
    ints = [(i, np.floor(1024 * np.array(v)).astype(object)) for i, v in enumerate(large)]
    assert [tuple(x) for x in found(*large)] == brute(ints, ints[:1], 2)
    with pytest.raises(Exception, match="64 bits"):
        found(*[[1e8 * x] * 4 for x in (1, 2, 1e-8, -1)])


def test_jobs_do_not_grow_with_queries(spark, monkeypatch):
    """As many passes for a block of queries as for many blocks."""
    passes = []
    counts = topk._counts
    monkeypatch.setattr(topk, "_counts", lambda width: passes.append(width) or counts(width))
    r = np.random.default_rng(0)
    rows = topk.usable(spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(400)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    for block in (400, 8):
        monkeypatch.setattr(topk, "BLOCK", block)
        passes.clear()
        assert topk.top_k(rows, rows, 3, 1024.0).count() == 1200 and len(passes) <= 3


def test_query(spark, duck, sf_dir):
    from loomstone.llm.queries import ORACLES, QUERIES

    same_rows(QUERIES["op3_top_k"](spark, sf_dir), duck.sql(ORACLES["op3_top_k"]))
