"""Links and components against all pairs."""

import numpy as np

from quillpanel.llm import cosine

SCHEMA = "vec_id long, embedding array<float>, label int, node int, slot string"


def rows():
    rng = np.random.default_rng(4)
    out, n = [], 0
    for label in (1, 2, None):
        centres = rng.normal(size=(6, 16))
        for k in range(90):
            v = centres[k % 6] + rng.normal(size=16) * rng.choice([0.05, 0.25, 0.4, 2.0])
            out.append((n, [float(x) for x in v.astype(np.float32)], label, 1, "s"))
            n += 1
    out += [(900 + i, out[3][1], 1, 1, "s") for i in range(5)] + [out[3]]
    out += [(950, [2 * x for x in out[3][1]], 1, 1, "s"), (951, None, 1, 1, "s"), (952, [0.0] * 16, 1, 1, "s"), (953, [float("nan")] * 16, 1, 1, "s")]
    out += [(954, [None] * 16, 1, 1, "s"), (955, [], 1, 1, "s"), (956, out[3][1][:8], 1, 1, "s"), (957, [float("inf")] + [0.0] * 15, 1, 1, "s"), (958, [1e30] * 16, 2, 1, "s"), (959, [1e-30] * 16, 2, 1, "s")]
    return out


def plain(data):
    vectors = []
    for r in data:
        ok = r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])
        vectors.append(np.array(r[1], np.float32).astype(np.float64) if ok else None)
    n, root = len(data), list(range(len(data)))
    top = lambda i: i if root[i] == i else top(root[i])
    links = np.zeros(n, int)
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and data[i][2] == data[j][2] and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.93:
                links[[i, j]] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    best = {}
    for i, r in enumerate(data):
        best[top(i)] = min(best.get(top(i), r[0]), r[0])
    return sorted((r[0], int(links[i]), best[top(i)]) for i, r in enumerate(data))


def test_links_and_components(spark, monkeypatch):
    data = rows()
    for tile in (8, cosine.TILE):
        monkeypatch.setattr(cosine, "TILE", tile)
        got = cosine.near_vectors(spark.createDataFrame(data, SCHEMA)).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain(data)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert cosine.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forest_connects_as_all_links_do():
    kept = cosine.forest(np.array([0, 1, 0, 3]), np.array([1, 2, 2, 4]), 6)
    assert len(kept) == 3
