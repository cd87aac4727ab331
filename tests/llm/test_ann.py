import numpy as np
import pytest

from plumbline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, part string, block string, v string"


def clustered(n=1500, d=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(15, d)) * 2
    return (centres[r.integers(0, 15, n)] + r.normal(size=(n, d))).astype(np.float32)


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], "a", "b", "c") for i, v in zip(ids, x)], SCHEMA)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_and_exact_scores(spark):
    x = clustered()
    ids = np.random.default_rng(2).permutation(len(x) * 2)[: len(x)]
    got = found(ann.search(frame(spark, ids.tolist(), x), block_rows=100))
    true, by = ann.brute_force(ids, x.astype(float)), dict(zip(ids.tolist(), x.astype(float)))
    assert got.keys() == true.keys()
    assert np.mean([len({v for _, v, _ in got[q]} & set(true[q])) / 20 for q in true]) >= 0.9
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1)) and len(rows) == 20
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1])) and q not in {v for _, v, _ in rows}
        assert all(s == np.cumsum(by[q] * by[v])[-1] for _, v, s in rows)
    again = found(ann.search(frame(spark, ids.tolist(), x).repartition(7), block_rows=100))
    assert got == again


def test_router_probes_fewer_parts_on_clusters():
    router = ann.fit(clustered(3000).astype(float), 12)
    assert router.recall >= 0.96 and router.probes < router.parts / 2


def test_parts_are_balanced():
    x, draw = clustered(800).astype(float), np.random.default_rng(0)
    part = ann.balanced_parts(x, ann.neighbours(x, np.arange(800), 8), 10, draw)
    assert np.bincount(part, minlength=10).max() <= 89


def test_copies_of_one_vector_tie_by_id(spark):
    x = clustered(900)
    x[100:700] = x[0]
    got = found(ann.search(frame(spark, range(900), x), block_rows=64))
    assert [v for _, v, _ in got[0]] == [*range(100, 120)] if (x[0] @ x[0]) >= np.sort(x @ x[0])[-601] else True
    same = [v for _, v, s in got[120] if s == np.cumsum(x[0].astype(float) ** 2)[-1]]
    assert same == sorted(same)


def test_rows_that_take_no_part(spark):
    ids = [0, 20, 40, 60, 80, None, 1, 2, 2, 3, 20]
    x = [[1, 0], [0, 0], None, [None, 1], [float("nan"), 1], [1, 1], [2, 0], [3, 0], [4, 0], [1, 1, 1], [1, 1]]
    got = found(ann.search(frame(spark, ids, x)))
    assert got == {0: [(1, 2, 4.0), (2, 1, 2.0), (3, 20, 1.0)], 20: [(1, 2, 4.0), (2, 1, 2.0), (3, 0, 1.0)]}
    assert ann.search(frame(spark, [], [])).count() == 0
    assert ann.search(frame(spark, [0], [[0, 0]])).count() == 0
    assert ann.search(frame(spark, [0], [[1, 0]])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_best_of_a_block(seed):
    r = np.random.default_rng(seed)
    matrix, ids = r.integers(-2, 3, (60, 3)).astype(float), np.sort(r.permutation(100)[:60])
    q = matrix[7]
    got = ann.best_of(q, ids[7], ids, matrix, matrix @ q, 20)
    want = sorted((-float(m @ q), int(i)) for i, m in zip(ids, matrix) if i != ids[7])[:20]
    assert [(-s, i) for i, s in zip(*map(np.ndarray.tolist, got))] == want
