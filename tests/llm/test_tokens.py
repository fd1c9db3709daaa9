import random
import zlib

import numpy as np
import pytest

from tessera.llm import binary, packing, tokens, words
from tessera.scratch import Scratch


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@pytest.fixture(scope="module")
def plain(tokenizer):
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_the_tokenizer(plain, prose, odd_rows):
    rng = random.Random(2)
    signs = " \n\t.,'sta1é! <日 \r"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [prose(k, 300) for k in range(20)] + [r[1] or "" for r in odd_rows]
    texts += ["a.\nB", "it's. don't,\nwon't", "<|endoftext|>", "a <|endoftext|>b c", "é,\nö", "1,\n2."]
    encoder = tokens.TextEncoder(tokens.default_path())
    assert encoder.cuttable
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == plain(text), text[:60]


def test_encoder_forgets_and_stays_right(plain, prose, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 50)
    encoder = tokens.TextEncoder(tokens.default_path())
    for k in range(10):
        assert encoder.encode([prose(k, 100)])[0].tolist() == plain(prose(k, 100))


def test_hashes_of_spans_across_blocks(prose, monkeypatch):
    raw = np.frombuffer((prose(3, 2000) + " " + "y" * 500 + " " + prose(3, 50)).encode(), dtype=np.uint8)
    edges = np.flatnonzero(raw == 32)
    starts, ends = np.append(0, edges + 1), np.append(edges, len(raw))
    whole = words.span_hashes(raw, starts, ends)
    by_word: dict = {}
    for a, b, h in zip(starts.tolist(), ends.tolist(), whole.tolist()):
        assert by_word.setdefault(raw[a:b].tobytes(), h) == h
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(words, "BLOCK", 64)
    words._kept.cache_clear()
    assert (words.span_hashes(raw, starts, ends) == whole).all()
    words._kept.cache_clear()


def test_encoder_without_cuts(plain, prose):
    encoder = tokens.TextEncoder(tokens.default_path())
    encoder.cuttable = False
    assert [i.tolist() for i in encoder.encode([prose(1, 40), ""])] == [plain(prose(1, 40)), []]


def test_room_and_assignment():
    assert packing.room(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    assert packing.room(0, 2048) == []
    rng = random.Random(4)
    lengths = [rng.randint(1, 2047) for _ in range(500)]
    placed = packing.assign(lengths, 2048)
    fill: dict = {}
    for piece, first, n, at, offset in sorted(placed, key=lambda p: (p[3], p[4])):
        assert offset == fill.get(at, 0)
        fill[at] = offset + n
    assert sorted(fill.values()) == sorted(packing.room(sum(lengths), 2048))
    cut = {}
    for piece, first, n, _, _ in sorted(placed):
        assert first == cut.get(piece, 0)
        cut[piece] = first + n
    assert [cut[k] for k in range(500)] == lengths
    cost = [0.0] * len(fill)
    for _, _, n, at, _ in placed:
        cost[at] += packing.estimate(n, 2048)
    full = [c for c, f in zip(cost, packing.room(sum(lengths), 2048)) if f == 2048]
    assert max(full) <= 1.6 * (sum(full) / len(full))


@pytest.mark.parametrize("group", [3000, 1 << 20])
def test_pack(odd, odd_rows, plain, group):
    rows = packing.pack(odd, group_tokens=group).collect()
    want = sorted((str(r[0]), len(plain(r[1])) + 1) for r in odd_rows)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    assert sum(r.length for r in rows) == sum(n for _, n in want)
    one = next(r for r in odd_rows if r[0] == 9)
    ids = plain(one[1]) + [1]
    pieces = sorted((r for r in rows if r.doc_id == 9), key=lambda r: r.start)
    at = 0
    for r in pieces:
        assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
        at += r.length
    assert at == len(ids)
    assert {r.ids_crc32 for r in rows if r.doc_id in (4, 5)} == {crc([1])}


def test_pack_empty_table(none):
    assert packing.pack(none).collect() == []


def test_shards_round_trip(spark, odd, odd_rows, plain):
    manifest = binary.write_shards(odd, Scratch(spark))
    got = binary.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 3 + [1, 2, 3, 3, 3, *range(4, 14)]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(r[0]), crc(plain(r[1]) + [2])) for r in odd_rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want


def test_one_document_of_a_shard(spark, plain, prose):
    docs = spark.createDataFrame([(k, prose(k, 60)) for k in range(40)], "doc_id long, text string")
    manifest = binary.write_shards(docs.coalesce(1), Scratch(spark)).collect()
    shard = binary.Shard(manifest[0].uri)
    k = int(np.searchsorted(shard.doc_ids, 7)) if len(manifest) == 1 else 0
    ((_, ids),) = shard.read(k, 1)
    assert ids.tolist() == plain(prose(int(shard.doc_ids[k]), 60)) + [2]


def test_changed_dictionary_is_noticed(spark, prose):
    docs = spark.createDataFrame([(k, prose(k, 60)) for k in range(40)], "doc_id long, text string")
    uri = binary.write_shards(docs, Scratch(spark)).first().uri
    from tessera.llm.common import open_uri

    with open(open_uri(uri)[1], "rb") as f:
        digest = f.read(44)[12:].hex()
    fs, path = open_uri(f"{uri.rpartition('/')[0]}/{digest}.zdict")
    with fs.open_output_stream(path, compression=None) as out:
        out.write(b"something else")
    with pytest.raises(ValueError, match="dictionary"):
        binary.Shard(uri)


def test_dictionary_of_few_samples():
    assert binary.train_dictionary([b"ab"] * 3) == b""


def test_shards_of_an_empty_table(none):
    assert binary.token_shards(none).collect() == []


def test_rows_without_id_spread_over_shards_and_windows_over_texts(spark):
    """A hot id, or none, is divided by the texts' hashes; the dictionary sees all of a text."""
    from pyspark.sql import functions as F

    from tessera.llm import binary
    from tessera.scratch import Scratch

    rows = [(None, f"text {k % 800} of no id") for k in range(4000)] + [(k, f"other {k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merge, "false")  # the table is small
    try:
        manifest = binary.write_shards(docs, Scratch(spark))
        sizes = [r.docs for r in manifest.collect()]
    finally:
        spark.conf.unset(merge)
    assert sum(sizes) == 4500 and len(sizes) > 4 and max(sizes) < 2000
    assert binary.read_shards(manifest).where("doc_id is null").count() == 4000
    long = spark.createDataFrame([(k, "a" * 40_000 + "b" * 40_000) for k in range(40)], "doc_id long, text string")
    windows = binary._windows(long.select("doc_id", F.col("text")))
    assert len(windows) == 40 and all(len(w) == binary.DICTIONARY_IDS for w in windows)
    assert any("b" in w for w in windows) and any("b" not in w for w in windows)
