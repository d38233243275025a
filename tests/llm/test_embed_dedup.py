import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from planeframe.llm.embed_dedup import embedding_links, quantise, tile_links

SCHEMA = "vec_id long, embedding array<float>, label int, links string, rep int"


def brute(rows):
    ok = lambda v, label, i: v is not None and label is not None and i is not None and len(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0
    near = {}
    for a, (i, v, x) in enumerate(rows):
        for b, (j, w, y) in enumerate(rows):
            if a != b and ok(v, x, i) and ok(w, y, j) and x == y and len(v) == len(w):
                v64, w64 = np.float32(v).astype(float), np.float32(w).astype(float)
                if v64 @ w64 / (np.linalg.norm(v64) * np.linalg.norm(w64)) >= 0.98:
                    near.setdefault(a, []).append(b)
    out = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            now = todo.pop()
            for k, (n, _, _) in enumerate(rows):
                if n == now and n is not None:
                    todo += [rows[b][0] for b in near.get(k, []) if rows[b][0] not in seen]
                    seen |= {rows[b][0] for b in near.get(k, [])}
        low = None if i is None else min(seen)
        out.append((i, len(near.get(a, [])), low, i is None or i == low))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, "x", 0) for i, v, y in rows], SCHEMA)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    rows = [(k, (base[k % 6] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.25])).tolist(), int(k % 2)) for k in range(90)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [1.0, None] + [0.0] * 14, 0), (203, [float("nan")] * 16, 0), (204, rows[0][1], None), (205, [], 0), (None, rows[0][1], 0), (206, [1.0] * 5, 0), (7, rows[8][1], 0), (5, rows[5][1], 1)]
    for tile in (2048, 20):
        got = sorted((tuple(r) for r in embedding_links(table(spark, rows), tile=tile).collect()), key=str)
        assert got == brute(rows)


def test_hot_vector(spark):
    rows = [(k, [1.0, 0.0], 3) for k in range(500)] + [(1000, [1.0, 0.01], 3)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(table(spark, rows)).collect()}
    assert got[3] == (500, 0) and got[1000] == (500, 0)


def test_labels_of_text(spark):
    long = "a label of more than sixty-four bytes, which no key of a hash function would hold "
    rows = spark.createDataFrame([(1, [1.0, 0.0], long), (2, [1.0, 0.01], long), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], "")], "vec_id long, embedding array<float>, label string")
    assert {r.vec_id: r.component_id for r in embedding_links(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_empty(spark):
    assert embedding_links(table(spark, [])).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 3, 64, 1200]))
def test_bound_is_rigorous(seed, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, dim)) * rng.choice([1e-3, 1, 1e4], dim)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, s, a, r = quantise(unit)
    exact = unit @ unit.T
    near = (q.astype(float) @ q.T.astype(float)) * np.outer(s, s)
    assert (np.abs(exact - near) <= np.outer(a, r) + np.outer(r, a) + np.outer(r, r)).all()
    found = {(int(i), int(j)) for i, j in zip(*map(np.concatenate, zip(*tile_links(x, x, 0.5, 7))))}
    assert found >= {(int(i), int(j)) for i, j in zip(*np.nonzero(exact >= 0.5 + 1e-9))}
