import numpy as np
import pytest
from lorekeep.llm import cover_tree


def brute(rows, cosine):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [cover_tree.unit(np.array([v], float))[0] if k else None for (_, v), k in zip(rows, ok, strict=True)]
    near = [[k != j and ok[k] and ok[j] and len(unit[k]) == len(unit[j]) and float(unit[k] @ unit[j]) >= cosine for j in range(len(rows))] for k in range(len(rows))]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[k], *(root[j] for j in range(len(rows)) if near[k][j])]) for k in range(len(rows))]
        if new == root:
            break
        root = new
    least = {}
    for k, r in enumerate(root):
        if ids[k] is not None:
            least[r] = min(ids[k], least.get(r, ids[k]))
    out = []
    for k, r in enumerate(root):
        c = least.get(r)
        out.append((ids[k], sum(near[k]), c, ids[k] == c))
    return sorted(out, key=str)


def clustered(seed, n=120, dim=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 6, dim))
    x = base[r.integers(0, len(base), n)] + r.normal(size=(n, dim)) * r.choice([0, 1e-9, 0.05, 0.3, 1], (n, 1))
    x *= 10.0 ** r.integers(-3, 4, (n, 1))
    return [v.astype(np.float32).tolist() for v in x]


@pytest.mark.parametrize(("block", "pivots", "seed"), [(4096, 1, 1), (10, 5, 2), (7, 40, 3)])
def test_links_and_components_match_brute_force(spark, block, pivots, seed):
    x = clustered(seed)
    x += [x[0], x[0], x[5], [0.0] * 8, None, [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [], [1.0, 2.0], [2.0, 4.0], [1.0]]
    rows = [((i * 37) % len(x), v) for i, v in enumerate(x)] + [(3, x[0]), (None, x[1])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, label int, h1 double")
    got = sorted((tuple(r) for r in cover_tree.near_duplicates(df, 0.9, block, pivots).collect()), key=str)
    assert got == brute(rows, 0.9)


def test_dense_group_is_linked_as_a_whole():
    r = np.random.default_rng(0)
    x = cover_tree.unit(np.ones((300, 16)) + 0.01 * r.normal(size=(300, 16)))
    tree, many = cover_tree.Tree(x), np.ones(300, np.int64)
    links = cover_tree.traverse(tree, tree, many, many, 0.9, True)
    assert links.count.tolist() == [299] * 300 and len(links.edges) == 299


def test_levels_are_nested_nets_of_halving_radius():
    r = np.random.default_rng(1)
    x = cover_tree.unit(r.normal(size=(400, 3)))
    t = cover_tree.Tree(x)
    for i, children in enumerate(t.children):
        far = np.linalg.norm(x[t.points[i]] - x[t.centre[i]], axis=1)
        assert far.max() <= t.cover[i] + 1e-6
        if children:
            assert t.centre[children[0]] == t.centre[i]
            assert sorted(np.concatenate([t.points[c] for c in children]).tolist()) == sorted(t.points[i].tolist())
            assert max(t.cover[c] for c in children) < t.cover[i]


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cover_tree.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(4, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in cover_tree.near_duplicates(bad).collect()) == [(2, 0, 2, True), (4, 0, 4, True)]
