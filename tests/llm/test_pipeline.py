import hashlib
import re

import pytest
from brute import kept_by_brute_force

import __spark_entry__ as entry
import corpus_pipeline
from tessera.scratch import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage got and returned."""
    scratch, docs, made = Scratch(spark), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, SF), name.replace(" ", "-"))
        made[name] = (docs, out)
        docs = out
    return made


def test_stages_and_columns(steps, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "minhash near-dedup", "mixing", "packing",
    ]
    for name, (before, after) in steps.items():
        if name != "packing":
            assert after.schema == before.schema
            assert after.exceptAll(before).count() == 0 or name == "mixing"


def test_exact_stage(steps):
    before, after = steps["exact dedup"]
    least = {}
    for r in before.collect():
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", r.text).encode()).digest()
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())


def test_near_stage(steps):
    before, after = steps["minhash near-dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == kept_by_brute_force(rows, 5)


def test_mixture_keeps_every_document(steps):
    before, after = steps["mixing"]
    ids = [r.doc_id for r in after.collect()]
    assert set(ids) == {r.doc_id for r in before.collect()}
    assert max(map(ids.count, set(ids))) <= 2


def test_quality_keeps_clean_documents(steps, spark):
    before, after = steps["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i in bad) <= 0.2 * len(bad) + 1


def test_run_equals_its_stages(steps, spark):
    got = corpus_pipeline.run(spark, SF)
    want = steps["packing"][1]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.select("doc_id", "doc_tokens").distinct().exceptAll(want.select("doc_id", "doc_tokens").distinct()).count() == 0
    assert got.agg({"length": "sum"}).first() == want.agg({"length": "sum"}).first()
    assert set(columns) <= set(got.columns)


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
