import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.centroids import BOUND, cluster_vectors, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, clusters, rounds):
    kept = [(i, [max(-BOUND, min(BOUND, math.floor(256 * float(np.float32(x))))) for x in v]) for i, v in rows]
    name = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=name)[:clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = assign()
        for c in range(len(centres)):
            mine = [v for (_, v), (w, _) in zip(kept, where) if w == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    where = assign()
    total = sum(d for _, d in where)
    return [
        (i, w, d, sum(e for x, e in where if x == w), total,
         hashlib.sha256(",".join(map(str, centres[w])).encode()).hexdigest())
        for (i, _), (w, d) in zip(kept, where)
    ]


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_nearest_equals_all_distances_and_saves_some():
    rng = np.random.default_rng(1)
    centres = rng.integers(-50, 50, (40, 8))
    centres[7] = centres[3]
    vectors = np.concatenate([centres + rng.integers(-2, 3, centres.shape), rng.integers(-60, 60, (300, 8)), centres])
    which, best, seen = nearest(vectors, centres)
    d = ((vectors[:, None] - centres) ** 2).sum(axis=2)
    assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert seen[:40].mean() < 30


def test_like_plain_rounds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=64) + 3 * (i % 5)], 1) for i in range(90)]
    rows += [(7, rows[3][1], 1), (8, rows[8][1], 1), (None, rows[9][1], 1), (91, [0.0] * 64, None)]
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), clusters=12)
    assert ordered(got.collect()) == ordered(plain([r[:2] for r in rows], 12, 5))


def test_odd_vectors(spark):
    good = [float(x) for x in range(64)]
    bad = [None, [], good[:63], good + [1.0], [None] + good[1:], [math.nan] + good[1:], [math.inf] + good[1:]]
    rows = [(1, good, 1), (2, [1e30] * 64, 2), (3, [-1e30] * 64, 3)]
    df = spark.createDataFrame(rows + [(10 + k, v, 0) for k, v in enumerate(bad)], SCHEMA)
    df = df.withColumns({c: F.lit("extra") for c in ("cluster", "v", "distance", "inertia")})
    assert ordered(cluster_vectors(df).collect()) == ordered(plain([r[:2] for r in rows], 40, 5))
    assert cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
