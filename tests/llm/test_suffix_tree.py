import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_tree
from tessera.llm.suffix_tree import DISCOUNT, score_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def symbols(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w] + [END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_scores(rows, depth, least):
    """The tree by dictionaries, each symbol scored by its longest state."""
    texts = [(i, symbols(t)) for i, t in rows]
    count = Counter()
    for i, s in texts:
        if not held(i):
            for at in range(len(s)):
                for d in range(min(depth, at) + 1):
                    count[tuple(s[at - d : at + 1])] += 1
    words = {k[0]: n for k, n in count.items() if len(k) == 1}
    total, kinds = sum(words.values()), len(words)
    base = {w: (n + 0.5) / (total + 0.5 * (kinds + 1)) for w, n in words.items()}
    new = 0.5 / (total + 0.5 * (kinds + 1))
    follow = {}
    for seq, n in count.items():
        if len(seq) > 1:
            follow.setdefault(seq[:-1], {})[seq[-1]] = n
    states, examined = {}, {()}

    def weight(ctx):
        after = follow[ctx]
        once = sum(n == 1 for n in after.values())
        return ((len(after) - once) * DISCOUNT + once) / sum(after.values())

    def prob(ctx, w):
        if not ctx:
            return base.get(w, new)
        n, all_ = follow[ctx].get(w, 0), sum(follow[ctx].values())
        return (n - DISCOUNT if n > 1 else 0) / all_ + states[ctx] * prob(ctx[1:], w)

    for d in range(1, depth + 1):
        found = {}
        for ctx in [c for c in follow if len(c) == d]:
            after, all_ = follow[ctx], sum(follow[ctx].values())
            if all_ < least or (d > 1 and ctx[1:] not in states) or ctx[:-1] not in examined:
                continue
            examined.add(ctx)
            lam, gain = weight(ctx), 0.0
            for w, n in after.items():
                q = prob(ctx[1:], w)
                if n >= 3:
                    gain += n * math.log(((n - 1 - DISCOUNT) / (all_ - 1) + lam * q) / q)
                else:
                    gain += n * math.log(lam)
            if gain > math.log(all_):
                found[ctx] = lam
        states.update(found)
    out = []
    for i, s in texts:
        score = 0.0
        for at, w in enumerate(s):
            ctx = next((tuple(s[at - d : at]) for d in range(min(depth, at), -1, -1) if d == 0 or tuple(s[at - d : at]) in states))
            score += math.log10(prob(ctx, w))
        out.append((
            i, held(i), len(s), sum(w in words for w in s), total,
            sum(math.log10(base.get(w, new)) for w in s), score,
        ))
    return out, states


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *map(lambda v: round(v, 6), r[2:]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def corpus(words, n=160):
    rng = random.Random(3)
    phrase = [rng.sample(words[:60], rng.randint(3, 6)) for _ in range(12)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 25)):
            text += rng.choice(phrase) if rng.random() < 0.6 else [rng.choice(words)]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("depth, least", [(3, 4), (1, 2), (2, 8)])
def test_like_dictionaries(spark, words, depth, least):
    rows = corpus(words)
    want, states = plain_scores(rows, depth, least)
    assert {len(s) for s in states} == set(range(1, depth + 1))
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), depth, least)
    same(got.collect(), want)


def test_small_blocks_and_spread_contexts(spark, words, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 300)
    monkeypatch.setattr(suffix_tree, "SPREAD", 4)
    rows = [(i, "the " + t.replace(" ", " the ", 3)) for i, t in corpus(words, 60)]
    want, _ = plain_scores(rows, 3, 4)
    same(score_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 4).collect(), want)


def test_scan_needs_no_copy(spark, words, tmp_path):
    rows = corpus(words, 80)
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    want, _ = plain_scores(rows, 3, 8)
    same(score_documents(spark.read.parquet(path), scan=True).collect(), want)


def test_odd_rows(spark, odd, odd_rows, none):
    want, _ = plain_scores([r[:2] for r in odd_rows], 3, 8)
    same(score_documents(odd.withColumn("score", F.lit("x")).withColumn("block", F.lit(1))).collect(), want)
    assert score_documents(none).count() == 0
    lone = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert score_documents(lone).first().n_tokens == 1


def test_held_out_documents_gain(spark, words):
    rows = corpus(words, 400)
    got = [r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.85 * sum(r.base_score for r in got)


def test_buckets_are_counted_in_slices(spark, words, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SLICE", 16)
    monkeypatch.setattr(suffix_tree, "BATCH_BYTES", 640)
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 2000)
    rows = [(i, "the " + t.replace(" ", " the ", 2)) for i, t in corpus(words, 120)]
    want, _ = plain_scores(rows, 3, 4)
    same(score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 4).collect(), want)


def test_a_bucket_takes_little_more_than_was_sent():
    """One bucket with eight blocks of pairs that are nearly all different."""
    rng, none = random.Random(7), np.zeros(0, dtype=np.uint64)
    sent = []
    for block in range(8):
        texts = [" ".join(str(rng.randrange(3000)) for _ in range(1000)).encode() for _ in range(80)]
        columns = [[block] * 80, list(range(80)), [True] * 80, texts]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["block", "doc", "train", "text"])
        sent += suffix_tree._sender(1, 1, none, 0, 1, None)([batch])
    size, most, found = sum(b.nbytes for b in sent), 0, Counter()
    tracemalloc.start()
    for batch in suffix_tree._counter(1, 1, 8, none)(iter(sent)):
        most = max(most, batch.nbytes)
        found.update(batch.column(0).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[suffix_tree._LIST] == 8
    assert size > 10e6 and peak < 4 * size
    assert most < 4 * suffix_tree.BATCH_BYTES


def test_order_keeps_equal_sequences_together():
    gram = np.array([5, 9, 5, 9, 2, 5, 7], dtype=np.uint64)
    key = np.array([3, 3, 3, 3, 8, 3, 1], dtype=np.uint64)
    got = gram[suffix_tree._ordered(gram, key)].tolist()
    assert got == [7, 5, 5, 5, 9, 9, 2]


def test_texts_are_not_read_again_for_their_lengths(spark, words, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame(corpus(words, 60), "doc_id long, text string").repartition(3).write.parquet(path)
    got = score_documents(spark.read.parquet(path), scan=True)
    read = re.findall(r"ReadSchema: struct<(.*?)>", got._jdf.queryExecution().executedPlan().toString())
    assert any("doc_id" in r for r in read) and not any("text" in r for r in read)


def test_order_is_that_of_a_stable_sort():
    rng = random.Random(5)
    for size in (0, 1, 2, 300):
        for bits in (3, 40, 64):
            key = np.array([rng.getrandbits(bits) for _ in range(size)], dtype=np.uint64)
            assert suffix_tree._order(key).tolist() == np.argsort(key, kind="stable").tolist()
    # What differs in the lowest bits only, where the places go.
    key = np.array([(rng.getrandbits(2) << 62) | rng.getrandbits(6) for _ in range(500)], dtype=np.uint64)
    assert suffix_tree._order(key).tolist() == np.argsort(key, kind="stable").tolist()


@pytest.mark.parametrize("group", [1, 60, 1 << 17])
def test_symbols_of_texts(group, monkeypatch):
    monkeypatch.setattr(suffix_tree, "GROUP_BYTES", group)
    long = "abcdefgh" * 8
    texts = ["", " \t\n", "A\x00 a a\x00\x00 \x1c\xa0 a", f"{long} {long}X {long}x {long[:-1]}", long * 9 + " " + long * 9 + "y", "É é"]
    texts += [" ".join("abcdefghijklmnopqr"[:n] for n in range(1, 19))]
    ids, lengths = suffix_tree.text_symbols([t.encode() for t in texts])
    want = [s for t in texts for s in symbols(t)]
    assert lengths.tolist() == [len(symbols(t)) for t in texts]
    found = dict(zip(want, ids.tolist()))
    assert [found[w] for w in want] == ids.tolist() and len(set(found.values())) == len(found)
