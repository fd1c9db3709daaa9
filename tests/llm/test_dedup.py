import hashlib
import math
import random
import re

import numpy as np
import pytest
from brute import groups
from pyspark.sql import functions as F

from tessera.llm import digest_index, neardup
from tessera.llm.components import components
from tessera.scratch import Scratch


def key(i):
    return (i is None, i or 0)


def exact(rows):
    groups: dict = {}
    for r in rows:
        text = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        groups.setdefault(hashlib.sha256(text.encode()).hexdigest(), []).append(r[0])
    out = []
    for digest, ids in groups.items():
        ids.sort(key=key)
        out += [(i, ids[0], len(ids), k == 0, digest) for k, i in enumerate(ids)]
    return sorted(out, key=lambda r: (*key(r[0]), r[3], r[4]))


@pytest.mark.parametrize("batches", [1, 3])
def test_exact(odd, odd_rows, batches):
    got = digest_index.index_documents(odd, batches=batches).collect()
    assert sorted(map(tuple, got), key=lambda r: (*key(r[0]), r[3], r[4])) == exact(odd_rows)


def test_exact_empty(none):
    assert digest_index.index_documents(none).collect() == []
    assert digest_index.drop_copies(none).collect() == []


def test_exact_stage_keeps_columns(odd, odd_rows):
    got = digest_index.drop_copies(odd)
    assert got.columns == odd.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted(
        (str(r[0]), t) for r, t in
        [(x, next(y[1] or "" for y in odd_rows if y[0] == x[0] and hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", y[1] or "").encode()).hexdigest() == x[4])) for x in exact(odd_rows) if x[3]]
    )


def test_index_goes_on_where_it_was(spark, tmp_path):
    place = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    more = spark.createDataFrame([(0, "b"), (4, "c"), (5, "c")], "doc_id long, text string")
    index = digest_index.DigestIndex(spark, place)
    index.append(digest_index.digests(docs))
    index.append(digest_index.digests(docs))
    index.close()
    index = digest_index.DigestIndex(spark, place)
    index.append(digest_index.digests(more))
    got = {(bytes(r.digest).hex(), r.keep_id) for r in index.plain().collect()}
    index.close()
    assert got == {(hashlib.sha256(t.encode()).hexdigest(), i) for t, i in (("a", 1), ("b", 2), ("c", 4))}
    assert index.plain().count() == 3


def test_buckets_follow_the_expected_size_and_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(digest_index, "BUCKET_ROWS", 10)
    docs = spark.createDataFrame([(k, str(k % 700)) for k in range(900)], "doc_id long, text string")
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/index", expected=300)
    assert index.buckets == 32
    index.append(digest_index.digests(docs))
    index.close()
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/index", expected=10**6)
    assert index.buckets == 32
    larger = index.rewritten(f"file://{tmp_path}/larger", 700)
    assert larger.buckets == 128
    assert sorted(map(tuple, larger.plain().collect())) == sorted(map(tuple, index.plain().collect()))
    index.append(digest_index.digests(docs))
    assert index.plain().count() == 700
    index.close()
    larger.close()


def test_anti_join_reads_buckets_as_they_are(spark, tmp_path):
    index = digest_index.DigestIndex(spark, f"file://{tmp_path}/index")
    docs = spark.createDataFrame([(k, str(k)) for k in range(50)], "doc_id long, text string")
    index.append(digest_index.digests(docs))
    new = digest_index.digests(docs).groupBy("digest").count().repartition(index.buckets, "digest")
    plan = new.join(index.bucketed().hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Bucketed: true" in text
    right = text[text.index("Bucketed: true") - 1500 :]
    assert text.count("Exchange hashpartitioning") <= 2 and "SelectedBucketsCount: 16 out of 16" in right
    index.close()


def near(rows, k):
    out = []
    found, sets = groups(rows, k)
    for group in found:
        least = min((rows[b][0] for b in group if rows[b][0] is not None), default=None)
        for a in group:
            mine = least if sets[a] else rows[a][0]
            out.append((rows[a][0], len(sets[a]), mine, mine is not None and rows[a][0] == mine))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_of_odd_rows(odd, odd_rows, k):
    got = neardup.near_duplicates(odd, words=k).collect()
    assert sorted(map(tuple, got), key=str) == near(odd_rows, k)


def chains(prose, words):
    """A hub with copies that resemble it more than each other, a chain, and loners."""
    hub = prose(7, 200).split()
    rows, n = [(0, " ".join(hub))], 1
    for c in range(25):
        copy = list(hub)
        for j in range(3):
            copy[(c * 7 + j * 60) % 200] = f"changed{c}x{j}"
        rows.append((n, " ".join(copy)))
        n += 1
    link = prose(8, 150).split()
    for c in range(12):
        link = list(link)
        for j in range(2):
            link[(c * 11 + 70 * j) % 150] = f"link{c}x{j}"
        rows.append((n, " ".join(link)))
        n += 1
    for c in range(30):
        rows.append((n, prose(100 + c, 80)))
        n += 1
    return rows


def test_near_duplicates_of_hubs_and_chains(spark, prose, words):
    rows = chains(prose, words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, words=4).collect()
    assert sorted(map(tuple, got), key=str) == near(rows, 4)


@pytest.mark.parametrize("turns", [(0, 0), (1, 1), (0, 3), (neardup.BAND_TURNS, neardup.RARE_TURNS)])
def test_links_that_the_first_centre_does_not_see(spark, prose, words, monkeypatch, turns):
    """All texts in one bucket, in families that have nothing in common, and chains: whatever
    the turns leave, the rarest shingles and the last pairs find."""
    monkeypatch.setattr(neardup, "BAND_TURNS", turns[0])
    monkeypatch.setattr(neardup, "RARE_TURNS", turns[1])
    monkeypatch.setattr(neardup.NearDuplicates, "_bands", staticmethod(lambda: F.array(F.lit(0).cast("long"))))
    rows = chains(prose, words)
    for family in range(12):
        text = prose(300 + family, 100)
        rows += [(1000 + 3 * family + k, text + " more" * k) for k in range(1 + family % 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, words=4).collect()
    assert sorted(map(tuple, got), key=str) == near(rows, 4)


def relatives(words, n, replaced, passage=0):
    """Copies of one text with some words replaced, or texts with one passage in common."""
    rng = random.Random(n + replaced)
    base = [rng.choice(words) + str(rng.randrange(9)) for _ in range(300)]
    rows = []
    for i in range(n):
        if passage:
            own = [rng.choice(words) + str(rng.randrange(9)) for _ in range(300 - passage)]
            copy = base[:passage] + own
        else:
            copy = list(base)
            for at in rng.sample(range(300), replaced):
                copy[at] = rng.choice(words) + str(rng.randrange(9))
        rows.append((i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("replaced, passage", [(0, 200), (9, 0), (5, 0)])
def test_relatives_below_the_threshold(spark, words, replaced, passage):
    """Families in which few or no pairs are linked: no link is lost, and texts that have only
    a passage in common cost a few comparisons each, however many they are."""
    made = []
    for n in (60, 120) if passage else (60,):
        rows = relatives(words, n, replaced, passage)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        work = neardup.NearDuplicates(docs, 4, 80, Scratch(spark))
        _, labels = work.links()
        made.append(work._tested.count())
        linked = labels.select("component").distinct().count() + n - labels.count()
        assert linked == len(groups(rows, 4)[0])
    if passage:
        assert made[0] <= 10 * 60 and made[1] <= 2.6 * made[0]


def test_near_stage(odd, odd_rows, none):
    got = neardup.drop_near_duplicates(odd, words=5)
    assert got.columns == odd.columns
    found, sets = groups(odd_rows, 5)
    kept = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert len(kept) == len(found)
    texts = {(str(r[0]), r[1] or "") for r in odd_rows}
    assert set(kept) <= texts
    for group in found:
        least = min((odd_rows[a][0] for a in group), key=key)
        assert sum(1 for i, t in kept if (i, t) in {(str(odd_rows[a][0]), odd_rows[a][1] or "") for a in group}) >= 1
        assert str(least) in {i for i, _ in kept}
    assert neardup.drop_near_duplicates(none).collect() == []
    assert neardup.near_duplicates(none).collect() == []


def test_one_of_each_group_stays(spark, prose):
    base = prose(1, 120)
    other = base + " more"
    rows = [(5, base), (5, other), (5, base), (None, base), (None, other), (2, prose(9, 60)), (None, prose(11, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in neardup.drop_near_duplicates(docs).collect()), key=str)
    assert len(got) == 3 and [g for g in got if g[0] == 2] == [(2, prose(9, 60))]
    assert sum(1 for g in got if g[0] == 5) == 1 and (None, prose(11, 30)) in got


def test_least_matches_follow_the_posterior():
    least = neardup.least_matches(128, 0.8, 1e-7)
    for n in (16, 64, 128):
        m = least[n - 1]

        def above(m):
            return sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(m + 1))

        assert above(m) >= 1e-7 and (m == 0 or above(m - 1) < 1e-7)
    # A pair at the threshold is hardly ever pruned.
    rng = np.random.default_rng(0)
    same = rng.random((20_000, 128)) < 0.8
    a = np.zeros((20_000, 128), dtype="<u4")
    assert len(neardup.likely(a, a + ~same, 0.8, 1e-7)) == 20_000
    low = rng.random((20_000, 128)) < 0.4
    assert len(neardup.likely(a, a + ~low, 0.8, 1e-7)) < 20


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(70, 71), (71, 70)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {(r.node, r.component) for r in got} == {
        *((k, 100) for k in range(100, 161)), *((k, 5) for k in range(5, 60)), (70, 70), (71, 70),
    }
    assert len(got) == 61 + 55 + 2
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).collect() == []
