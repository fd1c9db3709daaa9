"""Document quality from weak labels.

Heuristic labellers vote good or bad or abstain.  Expectation-maximisation estimates how
accurate each is, without any true label, and the posterior of a document's votes is the
label with which a linear scorer on hashed trigrams is trained.  The scorer judges.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, text_or_empty
from tessera.llm.ngrams import trigram_counts
from tessera.llm.words import span_hashes
from tessera.scratch import Scratch

BITS = 12
SAMPLE = 6_000
"""The scorer is fitted on about so many documents."""
STEPS = 300
LEAST_TRIGRAMS = 256
"""Shares of shorter texts are taken of so many trigrams: they tell less."""
GOOD, BAD = 1, 2
SHORT = 20
"""Shares are taken of so many words (or letters) more: a single odd word among few says little."""
LABELLERS = ("marks", "capitals", "bars", "repeats", "variety", "function_words", "punctuation", "length")

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for with was on as be by this are or from at an not "
    "de la que el en y los las del se por con una un para es al lo como su "
    "le les et des du est dans qui pour pas au sur il une par plus ce "
    "der die und den von zu das mit sich auf ist im dem nicht ein eine als auch".split()
)


_UPPER, _LOWER, _OTHER, _SPACE, _MARK = range(5)
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWER, _OTHER, _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


@functools.cache
def _function_words() -> np.ndarray:
    return np.sort(np.concatenate([word_hashes(w)[0] for w in FUNCTION_WORDS]))


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in lower case, the bytes of the text, the ends of the words."""
    raw = np.frombuffer(f" {text} ".encode(), dtype=np.uint8)
    space = _KIND[raw] == _SPACE
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    return span_hashes(_SMALL[raw], edges[::2], edges[1::2]), raw, edges[1::2]


def shape(text: str) -> dict[str, float] | None:
    """What the labellers look at; None for a text without words."""
    words, raw, ends = word_hashes(text)
    if not len(words):
        return None
    kinds = np.bincount(_KIND[raw], minlength=5)
    last = raw[ends - 1]
    doubled = (last == raw[ends - 2]) & (_KIND[last] == _MARK)
    known = _function_words()
    near = known[np.minimum(np.searchsorted(known, words), len(known) - 1)]
    n = len(words)
    # Code points by their first bytes: two of them from 0xC2, three and four from 0xE0.
    wide, beyond, other = (int((raw >= first).sum()) for first in (0xE0, 0xCA, 0xC2))
    letters = kinds[_UPPER] + kinds[_LOWER] + other
    return {
        "words": n,
        "beyond": beyond / max(letters, 1),
        "wide": wide / max(letters, 1),
        "marks": doubled.sum() / (n + SHORT),
        "capitals": kinds[_UPPER] / (kinds[_UPPER] + kinds[_LOWER] + SHORT),
        "bars": (np.diff(ends, prepend=0)[_KIND[last] == _MARK] == 2).sum() / (n + SHORT),
        "repeats": (words[1:] == words[:-1]).sum() / (n + SHORT),
        "variety": len(np.unique(words)) / n,
        "function_words": (near == words).sum() / n,
        "punctuation": kinds[_MARK] / (len(raw) - kinds[_SPACE] + 4 * SHORT),
        "length": (len(raw) - int(((raw & 0xC0) == 0x80).sum()) - kinds[_SPACE] - kinds[_MARK]) / n,
    }


def _vote(value: float, good_below: float, bad_from: float) -> int:
    return GOOD if value < good_below else BAD if value >= bad_from else 0


def votes(seen: dict[str, float] | None) -> tuple[int, ...]:
    """GOOD, BAD or 0 of each of LABELLERS.

    A text without function words may be of a language that has others: the labeller of
    those abstains if nothing else speaks against the text and it is of another script, or
    repeats words as any language does.  Length abstains on scripts that may do without spaces.
    """
    if seen is None:
        return (BAD,) * len(LABELLERS)
    long = seen["words"] >= 40
    cast = (
        _vote(seen["marks"], 0.02, 0.08),
        _vote(seen["capitals"], 0.15, 0.3),
        _vote(seen["bars"], 0.01, 0.05),
        _vote(seen["repeats"], 0.03, 0.1),
        _vote(1 - seen["variety"], 0.9, 0.97) if long else 0,
        _vote(0.1 - seen["function_words"], 0.0, 0.08) if long else 0,
        _vote(seen["punctuation"], 0.06, 0.12),
        _vote(abs(seen["length"] - 6.0), 2.5, 6.0) if long and seen["wide"] <= 0.5 else 0,
    )
    at = LABELLERS.index("function_words")
    natural = seen["beyond"] > 0.5 or seen["words"] < 100 or seen["variety"] <= 0.98
    if cast[at] == BAD and natural and cast.count(BAD) == 1:
        cast = (*cast[:at], 0, *cast[at + 1 :])
    return cast


def pattern(cast: tuple[int, ...]) -> int:
    """All votes as one number, base three."""
    code = 0
    for v in cast:
        code = 3 * code + v
    return code


def features(text: str, seen: dict[str, float] | None, bits: int) -> np.ndarray:
    """Square roots of trigram shares in hashed buckets; the last two buckets also hold how
    far the text repeats itself, which no trigram tells."""
    counts = trigram_counts(f" {text} ".encode(), bits)
    made = np.sqrt(counts / max(counts.sum(), LEAST_TRIGRAMS)).astype(np.float32)
    if seen is not None:
        made[-1] += min(1.0, 4 * seen["repeats"])
        made[-2] += min(1.0, 4 * max(0.0, 0.25 - seen["variety"]))
    return made


@dataclass
class LabelModel:
    """Bad documents are of several kinds, one for each labeller that can find it.

    ``on_good``: how often each labeller that does not abstain votes bad on good documents;
    ``on_bad``: the same for each kind of bad document, a row for each kind;
    ``shares``: of the good documents and of each kind.
    """

    on_good: np.ndarray
    on_bad: np.ndarray
    shares: np.ndarray

    def _each(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of good and of each kind, a row for each pattern."""
        cast = unpack(codes, len(self.on_good))
        rates = np.vstack([self.on_good, self.on_bad])
        log = np.log(self.shares) + (cast == BAD) @ np.log(rates).T + (cast == GOOD) @ np.log1p(-rates).T
        log -= log.max(axis=1, keepdims=True)
        return np.exp(log) / np.exp(log).sum(axis=1, keepdims=True)

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """Probability that documents with these vote patterns are good."""
        return self._each(codes)[:, 0]

    def accuracies(self) -> np.ndarray:
        """Of each labeller that does not abstain: right votes on good and on bad documents."""
        bad = self.shares[1:] / self.shares[1:].sum()
        return np.stack([1 - self.on_good, bad @ self.on_bad], axis=1)


def unpack(codes: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([codes // 3 ** (labellers - 1 - j) % 3 for j in range(labellers)], axis=1)


def fit_labels(codes: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100) -> LabelModel:
    """Expectation-maximisation on the counts of vote patterns.

    Labellers must be better than chance: on good documents they vote bad in at most a
    twentieth of cases, on their own kind in at least half, so kinds cannot swap.
    """
    own = np.eye(labellers, dtype=bool)
    model = LabelModel(
        np.full(labellers, 0.02), np.where(own, 0.9, 0.1), np.append(0.84, np.full(labellers, 0.16 / labellers))
    )
    cast = unpack(codes, labellers)
    voted, against = cast > 0, cast == BAD
    for _ in range(rounds if len(codes) else 0):
        weight = model._each(codes) * counts[:, None]
        rates = (weight.T @ against + 0.02) / (weight.T @ voted + 1)
        shares = weight.sum(axis=0) + 0.1
        model = LabelModel(
            np.clip(rates[0], 1e-4, 0.05),
            np.clip(np.where(own, np.maximum(rates[1:], 0.5), rates[1:]), 1e-3, 0.999),
            shares / shares.sum(),
        )
    return model


def fit_scorer(x: np.ndarray, good: np.ndarray, steps: int = STEPS, decay: float = 1e-5) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on soft labels."""
    weights, intercept = np.zeros(x.shape[1], dtype=np.float32), 0.0
    if not len(x):
        return np.append(weights, 20.0)
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + intercept, -30, 30)))
        miss = ((p - good) / len(x)).astype(np.float32)
        slope = np.append(miss @ x + decay * weights, miss.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        move = 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights = (weights - move[:-1]).astype(np.float32)
        intercept -= move[-1]
    return np.append(weights, intercept)


def _voter(batches):
    import pyarrow as pa

    for batch in batches:
        codes = [pattern(votes(shape(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int64())], names=["key", "votes"])


def _featurizer(bits: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made, codes = [], []
            for text in batch.column(0).to_pylist():
                seen = shape(text)
                codes.append(pattern(votes(seen)))
                made.append(features(text, seen, bits).astype("<f2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(made, pa.binary())], names=["votes", "x"])

    return run


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray
    bits: int


def train(docs: DataFrame, scratch: Scratch, bits: int = BITS, sample: int = SAMPLE) -> Model:
    """All documents are voted on; the driver receives the count of each vote pattern, of
    which there are at most 3**8.  About ``sample`` documents, chosen by a hash of their
    text, then teach the scorer; all rows of equal texts are chosen together as one."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text"))
    voted = scratch.write(rows.mapInArrow(_voter, "key long, votes long"), "votes")
    counted = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    labels = fit_labels(np.array([r["votes"] for r in counted], dtype=np.int64), np.array([r["n"] for r in counted], dtype=float))
    texts = voted.select("key").distinct().count()
    place = F.pmod(F.xxhash64(F.lit("quality sample"), "key"), F.lit(1 << 30))
    share = int(min(1.0, sample / max(texts, 1)) * (1 << 30))
    chosen = rows.where(place < share).dropDuplicates(["key"]).sortWithinPartitions("key")
    x, good = [], []
    for r in chosen.select("text").mapInArrow(_featurizer(bits), "votes long, x binary").toLocalIterator():
        x.append(np.frombuffer(r["x"], "<f2"))
        good.append(r["votes"])
    matrix = np.stack(x).astype(np.float32) if x else np.zeros((0, 1 << bits), np.float32)
    target = labels.posterior(np.array(good, dtype=np.int64))
    return Model(labels, fit_scorer(matrix, target), bits)


def _judge(model: Model, least: float):
    def run(batches):
        import pyarrow as pa

        weights, intercept = model.weights[:-1].astype(np.float32), float(model.weights[-1])
        for batch in batches:
            seen = [shape(t) for t in batch.column(1).to_pylist()]
            codes = np.array([pattern(votes(s)) for s in seen], dtype=np.int64)
            score = np.zeros(len(seen))
            for k, (text, s) in enumerate(zip(batch.column(1).to_pylist(), seen)):
                if s is not None:
                    z = float(features(text, s, model.bits) @ weights) + intercept
                    score[k] = round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes), pa.array(np.round(model.labels.posterior(codes), 6)),
                 pa.array(score), pa.array(score >= least)],
                names=["key", "votes", "weak_label", "score", "kept"],
            )

    return run


def judge(docs: DataFrame, model: Model | None = None, least: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """A row per document: ``doc_id``, ``votes`` (base-three number in the order of LABELLERS:
    1 good, 2 bad, 0 none), ``weak_label`` and ``score`` (probabilities of good quality, by the
    votes and by the scorer), ``kept``.

    Null texts and texts without a word have score 0 and are rejected.  Equal texts get
    equal scores; repeated rows stay repeated; rows without ``doc_id`` are judged like
    others; an empty table gives no row; further columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = model or train(docs, scratch or Scratch(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), text_or_empty().alias("text"))
    schema = "key long, votes long, weak_label double, score double, kept boolean"
    return rows.mapInArrow(_judge(model, least), schema).withColumnRenamed("key", "doc_id")


def keep_good(docs: DataFrame, least: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with all their columns, without the rows whose text is rejected."""
    scratch = scratch or Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    model = train(docs, scratch)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    schema = docs.select(row.alias("row")).schema["row"].dataType
    names = docs.columns

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        judged = _judge(model, least)
        for batch in batches:
            text = pc.fill_null(batch.column(names.index("text")), "")
            key = pa.nulls(batch.num_rows, pa.int64())
            got = next(judged([pa.RecordBatch.from_arrays([key, text], names=["key", "text"])]))
            yield batch.filter(got.column(4))

    return docs.mapInArrow(run, schema)
