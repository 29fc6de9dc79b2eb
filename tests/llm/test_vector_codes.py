"""Product codes against plain Lloyd's rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from foliant.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, _rows int, n int"


def plain(rows, parts=8, k=16, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(len(r[1]) for r in kept) // parts)
    whole = [[math.floor(4096 * x) for x in np.float32(r[1]).tolist()] + [0] * (parts * width - len(r[1])) for r in kept]
    cells = [[q[p * width : (p + 1) * width] for p in range(parts)] for q in whole]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, [float(x) for x in kept[i][1]]))[:k]
    books = [[cells[i][p] for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = [near(p, c[p])[1] for c in cells]
            for e in range(len(books[p])):
                mine = [c[p] for c, at in zip(cells, of, strict=True) if at == e]
                books[p] = books[p][:e] + [[sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else books[p][e]] + books[p][e + 1 :]
    found = [[near(p, c[p]) for p in range(parts)] for c in cells]
    total = {}
    for r, f in zip(kept, found, strict=True):
        total[r[2]] = total.get(r[2], 0) + sum(d for d, _ in f)
    cut = lambda x: min(x, (1 << 63) - 1)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        (str(r[0]), "".join(f"{e:02x}" for _, e in f), cut(sum(d for d, _ in f)), cut(total[r[2]]), sha) for r, f in zip(kept, found, strict=True)
    )


def compressed(spark, rows, n=3):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(n)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df).collect())


def vectors(n, dims, spread, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(7)]
    return [[x + rng.gauss(0, spread / 9) for x in rng.choice(centres)] for _ in range(n)]


@pytest.mark.parametrize("spread", [0.001, 0.3, 3e4])
def test_rounds_equal_plain_ones(spark, spread):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors(500, 24, spread, 5))]
    rows += [(1000 + i, rows[3][1], 9) for i in range(400)]  # one vector in many rows; with the least spread ties abound
    assert compressed(spark, rows) == plain(rows)


def test_odd_vectors(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(30, 16, 1, 7))]
    rows += [(3, rows[4][1], 1), (3, rows[5][1], None), (None, rows[6][1], 2), (90, None, 1), (91, [float("nan")] * 16, 1), (92, [None, 1.0] * 8, 1)]
    rows += [(93, [float("inf")] * 16, 4), (94, [], 5), (95, [1.0, -0.5], 5), (96, [0.5] * 19, 5)]
    assert compressed(spark, rows) == plain(rows)
    assert compressed(spark, rows[:5]) == plain(rows[:5])  # fewer vectors than entries
    assert compressed(spark, [(1, [], 1), (2, [], 1)]) == [(str(i), "00" * 8, 0, 0, hashlib.sha256(b"," * 0).hexdigest()) for i in (1, 2)]
    assert compressed(spark, [(1, None, 1)]) == compressed(spark, []) == []


def test_numbers_beyond_64_bits(spark):
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(60, 8, 1, 9))]
    rows += [(100 + i, [x * 1e30 for x in v], i % 2) for i, v in enumerate(vectors(20, 8, 1, 11))]
    assert compressed(spark, rows, 2) == plain(rows)
    mixed = [(i, [x * 10.0 ** (i % 30) for x in v], 0) for i, v in enumerate(vectors(90, 8, 1, 13))]
    assert compressed(spark, mixed, 5) == plain(mixed)


def test_trees_agree_with_distances_and_assign_whole_nodes():
    rng = np.random.default_rng(1)
    for spread in (2, 40, 4000):
        x = (rng.integers(-spread, spread, (30, 8))[rng.integers(0, 30, 3000)] + rng.integers(-1, 2, (3000, 8))).astype(np.int64)
        entries = x[rng.integers(0, len(x), 16)]
        order, low, high, sums = vector_codes.grow(x)
        nodes, one, leaves, left = vector_codes.walk(low, high, vector_codes.EntryTree(entries))
        levels = vector_codes.offsets(len(x), vector_codes.LEAF)
        starts, ends = np.concatenate([a[:-1] for a in levels]), np.concatenate([a[1:] for a in levels])
        labels = np.full(len(x), -1)
        for node, e in zip(nodes, one, strict=True):
            assert (labels[order[starts[node] : ends[node]]] == -1).all() and (x[order[starts[node] : ends[node]]].sum(axis=0) == sums[node]).all()
            labels[order[starts[node] : ends[node]]] = e
        at, entry = vector_codes.nearest_open(x[order], levels[-1], len(starts) // 2, entries, leaves, left)
        assert (labels[order[at]] == -1).all()
        labels[order[at]] = entry
        assert (labels == ((x[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)).all()
        assert spread < 4000 or len(at) < len(x) // 2  # most are assigned with their nodes where clusters are apart
