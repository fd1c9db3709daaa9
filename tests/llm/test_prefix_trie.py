import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie as module
from tessera.llm.prefix_trie import prefix_trie, turn_digest

SCHEMA = "conv_id long, turn long, role string, text string"


def mark(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0, mark(role, text)), role or "", text or ""))
    for c in convs:
        convs[c] = [t[1:] for t in sorted(convs[c])]
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = convs.get(c - int(abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + own[h:]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        inside = [k for k in nodes if k[: len(node)] == node]
        own = lambda k: len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        born = {k[:-1] for k in nodes if k}
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(node))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
            sum(k[:-1] == node for k in nodes if k), sum(k not in born for k in inside),
            sum((len(nodes[k]) - 1) * own(k) for k in inside), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[1], r[0], r[7], r[2] is None, r[2:7]))


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        length = rng.choice([1, 2, 3, 5, 9])
        for t in range(length):
            text = "same first words" if t < 3 and rng.random() < 0.7 else f"w{rng.randint(0, 3)} x y"
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_plain_trie(spark, seed):
    rows = conversations(seed, 260)
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert ordered(got.collect()) == ordered(plain(rows))


@pytest.mark.parametrize("nodes, depth", [(1, 1024), (3, 1024), (1 << 16, 2)])
def test_small_skeletons(spark, monkeypatch, nodes, depth):
    """Borders that the skeleton has no room for are taken out: the same result."""
    monkeypatch.setattr(module, "SKELETON_NODES", nodes)
    monkeypatch.setattr(module, "SKELETON_DEPTH", depth)
    rows = conversations(3, 200)
    assert ordered(prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(plain(rows))


def test_one_path_of_most_conversations(spark):
    """Equal conversations are one row before the shards, their ids come in pieces."""
    rows = [(c, t, "user", f"t {t}") for c in range(20, 900) for t in range(4)]
    rows += conversations(4, 15)
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert ordered(got.collect()) == ordered(plain(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"),
        (None, 0, "user", "lost"), (2, 1, "user", ""), (3, None, "user", None), (-7, 0, "a", "b"), (-7, 1, "a", "c"),
        (-20, 0, "q", "r s"), (0, 0, "x", "y" * 100_000), (40, 0, "ab", "c"), (60, 0, "a", "bc"), (33, 5, None, "é  ü"),
    ]
    rows += [(5, t, "user", f"long {t % 3}") for t in range(5000)] + [(6, t, "user", f"long {t % 3}") for t in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = ("n", "words", "path", "mark", "shard", "depth", "own", "h")
    got = prefix_trie(df.withColumns({c: F.lit("extra") for c in extra})).collect()
    short = [r for r in rows if r[0] not in (5, 6)]
    assert len(got) == len({(d, p) for d, p in _nodes(rows)})
    want = ordered(plain(short))
    small = prefix_trie(spark.createDataFrame(short, SCHEMA).withColumn("least", F.lit(1))).collect()
    assert ordered(small) == want
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def _nodes(rows):
    convs = {}
    for r in rows:
        if r[0] is not None:
            convs.setdefault(r[0], []).append(r)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, mark(r[2], r[3])))
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(c - int(abs(c) % 20) * (1 if c > 0 else -1), [])
        key = hashlib.sha256()
        yield 0, key.hexdigest()
        for d, r in enumerate(base[:h] + own[h:]):
            key.update(mark(r[2], r[3]))
            yield d + 1, key.copy().hexdigest()


def test_digest_tells_role_from_text(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc")], "role string, text string")
    got = {bytes(r[0]) for r in df.select(turn_digest(F.col("role"), F.col("text"))).collect()}
    assert got == {mark(a, b) for a, b in (("ab", "c"), ("a", "bc"), ("", "abc"))}
