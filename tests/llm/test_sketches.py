import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import sketches
from tessera.scratch import Scratch


def paragraphs(text):
    """Distinct paragraphs with how often each occurs."""
    return frozenset(Counter(re.findall(sketches.PARAGRAPH, text)).items())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, spark):
    texts = [r[1] or "" for r in rows]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    hashes = {r.t: r.h for r in frame.select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(zip((r[0] for r in rows), texts), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    out = []
    for k, (i, text) in enumerate(order):
        after, quarter = order[(k + 1) % len(order)][1], len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        mine = paragraphs(text)
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(),
            round(likeness(mine, paragraphs(edited)), 9), round(likeness(mine, paragraphs(after)), 9),
        ))
    return sorted(out, key=str)


def compare(got, rows, spark):
    made = [
        (r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9))
        for r in got.collect()
    ]
    assert sorted(made, key=str) == brute(rows, spark)


def test_odd_rows(spark, odd, odd_rows):
    compare(sketches.fingerprints(odd), odd_rows, spark)


def test_paragraphs_are_cut_by_content(spark, prose):
    """By a rule of its own: lines and sentences, wherever in a line they lie."""
    text = " ".join(f"Sentence {k} of a long line ends here." for k in range(40))
    more = "Put in front! " + text
    texts = [text, more, "One. Two?  Three\n\nfour.\n five... six!", prose(9, 300), " . a", "", "x" * 100_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: set(r.d) for r in frame.select("k", sketches.paragraph_digests(F.col("t")).alias("d")).collect()}
    for k, t in enumerate(texts):
        counts = Counter(p for p in re.split(r"\n|(?<=[.!?]) ", t) if p)
        want = spark.createDataFrame(list(counts.items()), "p string, n int") if counts else None
        assert got[k] == {r.d for r in want.select(F.xxhash64(F.xxhash64("p"), "n").alias("d")).collect()} if counts else got[k] == set()
    assert len(got[0] & got[1]) == 40 and len(got[1]) == 41


def test_rows_that_repeat(spark, prose):
    rows = [(1, prose(1, 80))] * 4 + [(2, prose(2, 50))] + [(3, prose(1, 80))] * 2
    compare(sketches.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), rows, spark)


@pytest.mark.parametrize("rows", [[(5, "One. Two.\nThree")], []])
def test_few_rows(spark, rows):
    compare(sketches.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), rows, spark)


def test_equal_texts_have_equal_fingerprints(odd, odd_rows):
    rows = sketches.fingerprints(odd).collect()
    assert len({r.fingerprint for r in rows if r.n_chars == len(odd_rows[0][1])}) == 1
    assert len({r.fingerprint for r in rows}) == len({paragraphs(r[1] or "") for r in odd_rows})


def test_differences_recover_the_digests(spark):
    """From nothing to thousands of differing digests, retried larger."""
    sides = {}
    for k, (both, left, right) in enumerate([(0, 0, 0), (9, 0, 0), (50, 3, 4), (10, 40, 0), (300, 700, 900), (2, 5000, 3000)]):
        sides[k] = ([f"s{i}" for i in range(both)] + [f"a{k}.{i}" for i in range(left)],
                    [f"s{i}" for i in range(both)] + [f"b{k}.{i}" for i in range(right)])
    rows = [(k, "\n".join(a), "\n".join(b)) for k, (a, b) in sides.items()]
    texts = Scratch(spark).write(spark.createDataFrame(rows, "pair long, x string, y string"), "texts")
    pairs = texts.select(
        "pair", sketches.paragraph_digests(F.col("x")).alias("a"), sketches.paragraph_digests(F.col("y")).alias("b")
    )
    pairs = Scratch(spark).write(pairs, "pairs")
    digests = {r.pair: (set(r.a), set(r.b)) for r in pairs.collect()}
    for r in sketches.differences(pairs, ["pair"], Scratch(spark)).collect():
        a, b = digests[r.pair]
        assert (len(r.only_a), len(r.only_b)) == (len(set(r.only_a)), len(set(r.only_b))) == (r.n_a, r.n_b)
        assert (set(r.only_a), set(r.only_b)) == (a - b, b - a)
        assert r.n_a + r.n_b == len(set(sides[r.pair][0]) ^ set(sides[r.pair][1]))


def test_no_python_on_the_executors(spark, odd):
    plan = sketches.fingerprints(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
