"""Language identification by error-correcting output codes.

Every language has a codeword.  For each of its bits a binary classifier on hashed byte
trigrams tells the languages with a one from those with a zero.  A text gets the language
whose codeword has the smallest loss under all bits, each weighted by how far its
classifier can be trusted; near ties are flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches
from tessera.llm.ngrams import letters, trigram_counts

BITS = 13
"""Trigrams are hashed to 2**BITS buckets."""
CODE_BITS = 24
SAMPLE = 20_000
"""About so many documents of each language are learned from."""
SHARPNESS = 8.0
"""Margins are mean log-odds of a trigram, times this."""
AMBIGUOUS = 0.6
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean"

_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """The documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def codewords(count: int, bits: int = CODE_BITS) -> np.ndarray:
    """``count`` codewords of +1 and -1, far apart; every bit has both values.

    The best of many seeded draws; with few languages bits repeat, which only gives
    their classifiers more votes.
    """
    if count < 2:
        return np.ones((count, bits))
    rng = np.random.default_rng(11)
    bits = max(bits, 4 * count.bit_length())
    best, apart = None, -1
    for _ in range(200 if count <= 256 else 5):
        code = np.where(rng.random((count, bits)) < 0.5, -1.0, 1.0)
        same = np.abs(code.sum(axis=0)) == count
        code[0, same] *= -1
        near = ((bits - code @ code.T) / 2 + bits * np.eye(count)).min()
        if near > apart:
            best, apart = code, near
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """A margin for each text and bit; ``counts`` has a row of buckets for each text."""
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return SHARPNESS * (counts @ self.weights) / total

    def decode(self, counts: np.ndarray) -> list[tuple[str, float, str | None, bool]]:
        """Language, probability-like score, the next language, whether they are close."""
        margin = self.margins(counts)
        loss = np.stack([np.logaddexp(0, -margin * word) @ self.trust for word in self.code], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        out = []
        for row, near in zip(share, order):
            second = self.langs[near[1]] if len(near) > 1 else None
            out.append((self.langs[near[0]], float(row[near[0]]), second, bool(row[near[0]] < AMBIGUOUS)))
        return out


def _counter(bits: int):
    def run(batches):
        import pyarrow as pa

        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = trigram_counts(letters(text), bits)
                counts[lang] = counts[lang] + got if lang in counts else got
        for lang, got in counts.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int64)), pa.array(got[at])],
                names=["lang", "bucket", "n"],
            )

    return run


def _checker(model: Model, bits: int):
    def run(batches):
        import pyarrow as pa

        place = {lang: k for k, lang in enumerate(model.langs)}
        right, total = np.zeros(model.code.shape[1], dtype=np.int64), 0
        for batch in batches:
            langs = [place[x] for x in batch.column(0).to_pylist()]
            if langs:
                counts = np.stack([trigram_counts(letters(t), bits) for t in batch.column(1).to_pylist()])
                right += (model.margins(counts) * model.code[langs] > 0).sum(axis=0)
                total += len(langs)
        yield pa.RecordBatch.from_pydict({"bit": range(len(right)), "hits": right, "total": [total] * len(right)})

    return run


def train(docs: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> Model:
    """Learn from the text and language of documents that are not held out.

    About ``sample`` documents of each language are chosen by a hash of their id.  Tasks
    count buckets for each language before the shuffle; the driver receives one count for
    each language and bucket.  A bit's weights are log-odds of a bucket between the
    languages on its two sides, each language counting the same.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], codewords(0), np.zeros((1 << bits, CODE_BITS)), np.ones(CODE_BITS))
    place = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, sample / sizes[k]) * (1 << 20)))])
    chosen = rows.where(place < share[F.col("lang")]).select("lang", "text")
    counted = chosen.mapInArrow(_counter(bits), "lang string, bucket long, n long")
    learned = np.full((len(langs), 1 << bits), 0.5)
    at = {lang: k for k, lang in enumerate(langs)}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        learned[at[r["lang"]], r["bucket"]] += r["n"]
    learned /= learned.sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    high = ones.T @ learned / np.maximum(ones.sum(axis=0), 1)[:, None]
    low = zeros.T @ learned / np.maximum(zeros.sum(axis=0), 1)[:, None]
    weights = np.log(np.maximum(high, 1e-12)) - np.log(np.maximum(low, 1e-12)) if len(langs) > 1 else high * 0
    model = Model(langs, code, weights.T.copy(), np.ones(code.shape[1]))
    if len(langs) > 1:
        checked = chosen.mapInArrow(_checker(model, bits), "bit long, hits long, total long")
        got = checked.groupBy("bit").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total")).collect()
        for r in got:
            wrong = (r["total"] - r["hits"] + 1) / (r["total"] + 2)
            model.trust[r["bit"]] = max(0.0, 1 - 2 * wrong)
        model.trust *= len(model.trust) / max(model.trust.sum(), 1e-9)
    return model


def _predictor(model: Model, bits: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows = [
                k for k, t in enumerate(texts) if model.langs and t is not None and _LETTER.search(t)
            ]
            made: list = [(UNKNOWN, 0.0, None, False)] * len(texts)
            if rows:
                counts = np.stack([trigram_counts(letters(texts[k]), bits) for k in rows])
                for k, got in zip(rows, model.decode(counts)):
                    made[k] = got
            lang, score, second, close = zip(*made) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(second, pa.string()), pa.array(close, pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"],
            )

    return run


def identify(docs: DataFrame, model: Model | None = None, bits: int = BITS) -> DataFrame:
    """The language of every whole text of ``docs`` (``doc_id``, ``text``).

    Without a ``model`` one is trained on those that are not held out.  Null texts and
    texts without a letter are ``und`` with score 0, and so are all texts where no language
    was learned; with one language learned it is the answer, with score 1.  Equal losses go
    to the language that sorts first.  A row without ``doc_id`` is not held out.  Repeated
    rows stay repeated, an empty table gives no row, further columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = model or train(docs, bits)
    rows = docs.select(
        F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text"
    )
    return rows.mapInArrow(_predictor(model, bits), SCHEMA)
