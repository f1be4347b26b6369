import numpy as np

from linkloom.llm.neighbours import nearest

VEC = "vec_id long, embedding array<float>, label int, candidate string"


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[0]  # many equal vectors: ties go to the smaller id
    x[120] *= 1000
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)]
    got = {}
    for r in nearest(spark.createDataFrame(rows, VEC), "vec_id % 20 = 0", block=64, query_block=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    d = x.astype(np.float64)
    for q in range(0, 300, 20):
        score = d @ d[q]
        want = [i for i in sorted(range(300), key=lambda i: (-round(score[i], 9), i)) if i != q][:20]
        assert [got[q][k][0] for k in range(1, 21)] == want
        np.testing.assert_allclose([got[q][k][1] for k in range(1, 21)], score[want])
    assert len(got) == 15


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], VEC)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (0, 3, 9, -1.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0), (20, 3, 9, 0.0)]
    assert nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert nearest(df.where("vec_id = 0"), "vec_id % 20 = 0").count() == 0


def test_close_and_extreme_vectors(spark):
    """Clusters within the quantisation error, a vector that most rows share, sizes from tiny to huge."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 24))
    x[:150] = x[0] + rng.normal(scale=1e-4, size=(150, 24))
    x[150:300] = x[150]
    x[300:310] *= 1e150
    x[310:320] *= 1e-300
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], VEC.replace("float", "double"))
    got = {}
    for r in nearest(df, "vec_id % 20 = 0", k=7, block=64, query_block=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in range(0, 400, 20):
        score = [0.0] * 400
        for i in range(400):
            for a, b in zip(x[q], x[i], strict=True):
                score[i] += float(a) * float(b)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:7]
        assert [got[q][k] for k in range(1, 8)] == [(i, score[i]) for i in want], q
