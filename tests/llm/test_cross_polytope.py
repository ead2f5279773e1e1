import numpy as np

from linkmill.llm import cross_polytope as X

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    use = {}
    for k, (i, v, label) in enumerate(rows):
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            use[k] = (i, np.array(v, dtype=np.float32).astype(np.float64), label)
    links, root = {k: 0 for k in range(len(rows))}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in use:
        for b in use:
            (i, x, p), (j, y, q) = use[a], use[b]
            if a < b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return sorted((r[0], links[k], find(r[0]), find(r[0]) == r[0]) for k, r in enumerate(rows))


def vectors(seed, n=200, dim=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[i % 12] + rng.normal(size=dim) * rng.choice([0, 0.03, 0.08, 2.0])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    return rows


def answers(spark, rows, **options):
    return sorted(tuple(r) for r in X.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), **options).collect())


def test_links_counts_and_components(spark, monkeypatch):
    rows = vectors(1)
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, rows[0][1], None), (1003, [float("nan")] * 64, 1), (1004, [None] + rows[0][1][1:], 0), (1005, [], 1), (1006, rows[0][1][:32], 0), (1007, [2 * x for x in rows[0][1]], 0)]
    want = brute(rows)
    got = answers(spark, rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert answers(spark, rows, block=5) == got  # blocks change nothing


def test_empty_and_repeated_rows(spark):
    assert answers(spark, []) == []
    one = [1.0, 2.0]
    got = X.near_vectors(spark.createDataFrame([(1, one, 1), (1, one, 1), (2, one, 1), (None, one, 1)], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got) == [(0, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(3, 16))
    assert np.allclose((X.hadamard(x) ** 2).sum(axis=1), 16 * (x**2).sum(axis=1))
    assert np.allclose(X.hadamard(X.hadamard(x)), 16 * x)
