"""Mixing sources to target weights by temperature.

The share of a source among all tokens, raised to an exponent and normalised, is its
weight.  Exponent 1 keeps the shares, smaller ones flatten them.  The exponent is bisected
to meet a target entropy or a limit on repetition, and the weights become budgets: every
source is read in permutations of blocks of its documents until its budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty
from tessera.scratch import Scratch, lookup_table

BLOCKS = 256
REPEAT_LIMIT = 2.0
CUTS = 64
"""A pass over the shares evaluates so many exponents: six halvings at a time."""
PASSES = 5


def words(name: str = "text") -> Column:
    """Tokens are counted as words."""
    return F.regexp_count(text_or_empty(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _evaluated(shares: DataFrame, low: float, high: float) -> list:
    """Entropy and repetition for exponents in steps from ``low`` to ``high``.

    Repetition is how often the source read most often is read for one time of the
    source read least often.
    """
    steps = [low + (high - low) * k / CUTS for k in range(CUTS + 1)]
    tried = shares.where("tokens > 0").select(
        "share", F.posexplode(F.array(*map(F.lit, steps))).alias("step", "e")
    )
    power = F.pow("share", F.col("e"))
    sums = tried.groupBy("step", "e").agg(
        F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"),
        (F.max(power / F.col("share")) / F.min(power / F.col("share"))).alias("repetition"),
    )
    entropy = F.log("z") - F.col("e") * F.col("s") / F.col("z")
    return sums.select("step", "e", entropy.alias("entropy"), "repetition").orderBy("step").collect()


def exponent(shares: DataFrame, entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT) -> float:
    """The largest exponent whose weights reach ``entropy`` (nats), or else the smallest one
    that keeps repetition within ``repeat_limit``.  A target out of reach gives the nearest
    end of the range from 0 to 1 (entropy: to 8)."""
    low, high = (0.0, 8.0) if entropy is not None else (0.0, 1.0)
    for _ in range(PASSES):
        tried = _evaluated(shares, low, high)
        if not tried:
            return 1.0
        if entropy is not None:
            good = [r["e"] for r in tried if r["entropy"] >= entropy]
            edge = max(good, default=low)
            low, high = edge, min((r["e"] for r in tried if r["e"] > edge), default=edge)
        else:
            good = [r["e"] for r in tried if r["repetition"] <= repeat_limit]
            edge = min(good, default=high)
            low, high = max((r["e"] for r in tried if r["e"] < edge), default=edge), edge
        if low == high:
            break
    return low if entropy is not None else high


class Mixture:
    """The rows of ``docs`` with source, tokens and block, and the schedule of the blocks."""

    def __init__(self, docs: DataFrame, scratch: Scratch, source: str = "source", blocks: int = BLOCKS):
        self.scratch = scratch
        # Names are changed before anything is added, so that no column can clash.
        self.rows = docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
            F.col("doc_id").alias("doc_id"), F.col(source).alias("source"), words().alias("tokens"),
            F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
        )

    def schedule(self, entropy: float | None, repeat_limit: float | None, budget: int | None, seed: int) -> DataFrame:
        """A row for each block that is read: ``source``, ``block``, ``epoch``, ``first`` (tokens
        of the source read before), ``size``, ``weight``, ``due`` (its budget)."""
        scratch = self.scratch
        blocks = scratch.write(
            self.rows.groupBy("source", "block").agg(F.sum("tokens").alias("size")), "blocks"
        )
        totals = scratch.write(blocks.groupBy("source").agg(F.sum("size").alias("tokens")), "totals")
        total = totals.agg(F.sum("tokens")).first()[0] or 0
        shares = totals.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
        self.exponent = exponent(shares, entropy, repeat_limit)
        power = F.when(F.col("tokens") > 0, F.pow("share", F.lit(self.exponent))).otherwise(0.0)
        mass = shares.select(F.sum(power)).first()[0] or 1.0
        weighed = shares.withColumn("weight", power / F.lit(mass))
        if budget is None:
            need = F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")))
            budget = weighed.agg(need).first()[0] or 0.0
        due = F.col("weight") * F.lit(float(budget))
        # The budget of a source that is read once is its tokens, up to rounding.
        due = F.when(F.abs(due - F.col("tokens")) <= 1e-6 * F.col("tokens"), F.col("tokens").cast("double")).otherwise(due)
        last = F.when(F.col("tokens") > 0, F.ceil(due / F.col("tokens")) - 1).otherwise(0)
        weighed = weighed.withColumn("due", due).withColumn("last", F.greatest(last, F.lit(0)))
        weighed = lookup_table(weighed, "weights", scratch)
        epochs = blocks.join(
            weighed.select(F.col("source").alias("of"), "weight", "due", "tokens", "last"),
            F.col("source").eqNullSafe(F.col("of")),
        ).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        shuffled = Window.partitionBy("source", "epoch").orderBy(
            F.xxhash64(F.lit(seed), "source", "epoch", "block"), "block"
        )
        before = F.coalesce(F.sum("size").over(shuffled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        planned = epochs.withColumn("first", F.col("epoch") * F.col("tokens") + before)
        whole = (F.col("epoch") == 0) & (F.col("due") >= F.col("tokens"))
        planned = planned.where(whole | (F.col("first") < F.col("due")))
        return lookup_table(
            planned.select(
                F.col("source").alias("of"), F.col("block").alias("of_block"), "epoch", "first", "size", "weight", "due"
            ), "schedule", scratch,
        )

    def dealt(self, schedule: DataFrame) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))
        return self.rows.join(schedule, same)


def mix(
    docs: DataFrame,
    entropy: float | None = None,
    repeat_limit: float | None = REPEAT_LIMIT,
    budget: int | None = None,
    blocks: int = BLOCKS,
    seed: int = 0,
    scratch: Scratch | None = None,
) -> DataFrame:
    """A row for each time that a document is read: ``doc_id``, ``source``, ``tokens``,
    ``weight``, ``epoch``, ``block`` and ``position``; in ascending ``position`` every stretch
    of the data has about the target weights.

    Without a ``budget`` (in tokens) every document is read at least once: the budget is the
    smallest that reads each source in full.  With one, blocks beyond it are left out, as a
    mixture to a size must.  A budget is met to within a block, 1/``blocks`` of a source.

    Documents fall into blocks by a hash, so a popular source is spread over ``blocks`` keys.
    Null is a source of its own.  Null and empty texts have no tokens and go with their
    blocks; a source without tokens has weight 0 and is read once.  Repeated rows stay
    together; an empty table gives no row; further columns are ignored.
    """
    mixture = Mixture(docs, scratch or Scratch(docs.sparkSession), blocks=blocks)
    dealt = mixture.dealt(mixture.schedule(entropy, repeat_limit, budget, seed))
    position = _position(seed)
    return dealt.select("doc_id", "source", "tokens", "weight", "epoch", "block", position.alias("position"))


def _position(seed: int) -> Column:
    within = F.pmod(F.xxhash64(F.lit(seed), "epoch", "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.col("first") + within * F.col("size")) / F.greatest("due", F.lit(1.0))


def mixed(docs: DataFrame, scratch: Scratch | None = None, seed: int = 0, **options) -> DataFrame:
    """``docs`` with all their columns, each row as often as ``mix`` reads it, in the order of
    its ``position``: written as files, every stretch of them has about the target weights.
    Rows of one position, as those of a source without tokens, are in the order of a hash."""
    mixture = Mixture(docs, scratch or Scratch(docs.sparkSession))
    options = {"entropy": None, "repeat_limit": REPEAT_LIMIT, "budget": None} | options
    dealt = mixture.dealt(mixture.schedule(seed=seed, **options))
    placed = dealt.select("row", _position(seed).alias("position"), F.xxhash64("epoch", "doc_id").alias("tie"))
    return placed.orderBy("position", "tie").select("row.*")
