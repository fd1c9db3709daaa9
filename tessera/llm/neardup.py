"""Near duplicates by MinHash bands and sequential Bayesian verification.

Equal shingle sets are one class.  Classes that share a band of their signatures are
candidates; a candidate's signatures are compared batch by batch, and it is pruned as
soon as the posterior probability of the wanted similarity falls below the accepted miss
probability; survivors are verified on their full shingle sets.

Within a bucket not all pairs are compared.  Each turn takes one centre from every bucket, the
member that meets most others in the component that has most members there, and compares it
with the members of other components; what is linked needs no further comparison.  Texts with a
passage in common meet in many buckets without one link.  So after a few turns, those that are
still in different components meet by the rarest shingles of their full sets instead.  Two
texts with a similarity of 0.8 share one of the rarest fifth of the longer one's shingles, and
that is one of the rarest ninth of the shorter one's (prefix filtering, exact); of the rest
of a text most shingles occur nowhere else.  There, too, centres go first; of what they leave,
the shorter ones' ninths are compared with the longer ones' fifths.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_key, small_batches, text_or_empty
from tessera.llm.components import components
from tessera.llm.words import mix, span_hashes
from tessera.scratch import Scratch, lookup_table

BANDS, ROWS = 32, 4
"""A pair of similarity 0.8 shares no band with probability (1 - 0.8**4)**32 < 5e-8."""
BATCH = 16
MISS = 1e-7
"""Accepted probability that a pruned pair is similar enough."""
BAND_TURNS = 2
"""Turns of centres in the buckets of the bands, before the rarest shingles take over."""
RARE_TURNS = 3
"""Turns of centres in the buckets of the rarest shingles, before what is left is compared."""

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the ``k``-word shingles, sorted.  A text of fewer words has
    its whole sequence as one shingle, one without words has none."""
    raw = _LOWER[np.frombuffer(f" {text} ".encode(), dtype=np.uint8)]
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    words = span_hashes(raw, starts, ends)
    n = max(1, len(words) - k + 1)
    made = np.full(n, len(words) if len(words) < k else 0, dtype=np.uint64)
    for j in range(min(k, len(words))):
        made = mix(made + words[j : j + n])
    return np.unique(made)


@functools.lru_cache(maxsize=2)
def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def signature(shingles: np.ndarray, count: int) -> np.ndarray:
    """The high halves of ``count`` minima."""
    a, b = _multipliers(count)
    low = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 256):
        low = np.minimum(low, (shingles[k : k + 256, None] * a + b).min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


@functools.lru_cache(maxsize=8)
def least_matches(count: int, threshold: float, miss: float) -> tuple[int, ...]:
    """For each number of compared hashes: the fewest matches with which a pair is kept.

    With a uniform prior the posterior of the similarity after m of n matches is
    Beta(m + 1, n - m + 1); its mass above ``threshold`` is the chance of at most m
    successes among n + 1 trials of that probability.
    """
    made = []
    for n in range(1, count + 1):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        made.append(m)
    return tuple(made)


def likely(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which rows of two signature arrays survive; each batch is compared for the rows that
    survived the batches before."""
    count = a.shape[1]
    least = least_matches(count, threshold, miss)
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k in range(0, count, BATCH):
        if not len(alive):
            break
        matches += (a[alive, k : k + BATCH] == b[alive, k : k + BATCH]).sum(axis=1)
        ok = matches >= least[min(k + BATCH, count) - 1]
        alive, matches = alive[ok], matches[ok]
    return alive


def _signer(k: int, count: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = {n: [] for n in ("doc_id", "text_hash", "hi", "lo", "n_shingles", "signature")}
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                shingles = shingle_hashes(text, k)
                both = xxhash.xxh3_128_digest(shingles.tobytes())
                out["doc_id"].append(doc_id)
                out["text_hash"].append(text_hash)
                out["hi"].append(int.from_bytes(both[:8], "little", signed=True))
                out["lo"].append(int.from_bytes(both[8:], "little", signed=True))
                out["n_shingles"].append(len(shingles))
                signed = signature(shingles, count) if len(shingles) else None
                out["signature"].append(signed if signed is None else signed.tobytes())
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip(out.values(), kinds)], names=list(out)
            )

    return run


def _pruner(threshold: float, miss: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            a, b = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u4").reshape(n, -1)
                for c in (2, 3)
            )
            alive = pa.array(likely(a, b, threshold, miss))
            yield batch.select([0, 1]).take(alive)

    return run


def _verifier(k: int, percent: int):
    def run(batches):
        import pyarrow as pa

        last, centre = None, None
        for batch in batches:
            keep = []
            columns = (c.to_pylist() for c in batch.columns)
            for row, (a, b, text_a, text_b) in enumerate(zip(*columns)):
                if b != last:
                    last, centre = b, shingle_hashes(text_b, k)
                mine = shingle_hashes(text_a, k)
                both = len(np.intersect1d(mine, centre, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(centre) - both):
                    keep.append(row)
            yield batch.select([0, 1]).take(pa.array(keep, type=pa.int64()))

    return run


def _listed(k: int):
    """Task: the shingles of each text, a row for each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for node, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = shingle_hashes(text, k).view(np.int64)
                for low in range(0, len(found), 1 << 16):
                    part = found[low : low + (1 << 16)]
                    columns = [np.full(len(part), node), np.full(len(part), len(found)), part]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "size", "s"])

    return run


class NearDuplicates:
    """The classes of equal shingle sets of ``docs`` and the links between them."""

    def __init__(self, docs: DataFrame, words: int, percent: int, scratch: Scratch, miss: float = MISS):
        self.scratch, self.words, self.percent, self.miss = scratch, words, percent, miss
        small_batches(docs.sparkSession)
        text = text_or_empty()
        self.docs = docs.select(
            F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")
        )
        schema = (
            "doc_id long, text_hash long, hi long, lo long, n_shingles long, signature binary"
        )
        self.rows = scratch.write(
            self.docs.mapInArrow(_signer(words, BANDS * ROWS), schema), "signatures"
        )
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
        whole = F.struct("n_shingles", "signature")
        grouped = self.rows.groupBy("hi", "lo").agg(
            F.min(order).alias("rep"), F.first(whole).alias("w"), F.count("*").alias("members")
        )
        node = F.monotonically_increasing_id()
        self.classes = scratch.write(
            grouped.select(
                "hi", "lo", "w.*", "members", F.col("rep.doc_id").alias("least"),
                F.col("rep.text_hash").alias("rep_text"),
            ).withColumn("node", node), "classes",
        )

    @staticmethod
    def _bands() -> Column:
        """The hash of each band of a signature, with its number."""

        def band(j: Column) -> Column:
            return F.xxhash64(F.substr("signature", 4 * ROWS * j + 1, F.lit(4 * ROWS)), j)

        return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Verified links (``a``, ``b``) that connect what the candidates connect, and the
        components (``node``, ``component``) that they make."""
        scratch = self.scratch
        banded = self.classes.where("n_shingles > 0").select(
            "node", F.explode(self._bands()).alias("bucket")
        )
        shared = lookup_table(
            banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"),
            "shared", scratch,
        )
        members = scratch.write(banded.join(shared, "bucket"), "members")
        degrees = lookup_table(
            members.groupBy("node").agg(F.sum("size").alias("degree")), "degrees", scratch
        )
        members = scratch.write(members.join(degrees, "node").drop("size"), "ranked")
        self._fetch(degrees.select("node"))
        empty = self.classes.sparkSession.createDataFrame
        self._tested = None
        self._found, self._labels = empty([], "a long, b long"), empty([], "node long, component long")
        members = self._turns(members, BAND_TURNS)
        if members is not None:
            members = self._by_rarest(members)
            members = self._turns(members, RARE_TURNS)
        if members is not None:
            self._compare(self._rest(members))
        return self._found, self._labels

    def _turns(self, members: DataFrame, turns: int) -> DataFrame | None:
        """Take centres so often; the members of buckets that are then still of more than one
        component, if there are any."""
        for turn in range(turns):
            centres = self._centres(members)
            self._compare(self._stars(members, centres))
            members = self.scratch.write(self._apart(members, centres), "apart")
            if members.isEmpty():
                return None
        return members

    def _compare(self, pairs: DataFrame) -> None:
        """Verify the pairs that were not compared before, and join up what they link."""
        scratch = self.scratch
        pairs = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
        pairs = pairs.dropDuplicates(["lo", "hi"])
        if self._tested is not None:
            pairs = pairs.join(self._tested, ["lo", "hi"], "left_anti")
        pairs = scratch.write(pairs.select("a", "b", "lo", "hi"), "pairs")
        if pairs.isEmpty():
            return
        now = pairs.select("lo", "hi")
        self._tested = now if self._tested is None else self._tested.union(now)
        good = self._verified(pairs.select("a", "b"))
        if good.isEmpty():
            return
        # What is known is kept as stars, so each turn adds only its own links.
        self._found = self._found.union(good)
        known = self._labels.where("node <> component").select("node", "component").toDF("a", "b")
        self._labels = lookup_table(components(known.union(good), scratch), "labels", scratch)

    def _labelled_members(self, members: DataFrame) -> DataFrame:
        label = F.coalesce("component", "node").alias("label")
        kept = [c for c in members.columns if c not in ("label", "component")]
        return members.join(self._labels, "node", "left").select(*kept, label)

    def _open(self, members: DataFrame) -> DataFrame:
        """Those in buckets with members of more than one component."""
        open_ = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        open_ = lookup_table(open_.where("lo < hi").select("bucket"), "open", self.scratch)
        return members.join(open_, "bucket")

    def _apart(self, members: DataFrame, centres: DataFrame) -> DataFrame:
        """Members that were no centre yet, in buckets in which those are of more than one
        component.  A centre has met all others, or is of their component."""
        used = centres.select("bucket", F.col("centre").alias("node"))
        members = members.join(used, ["bucket", "node"], "left_anti")
        return self._open(self._labelled_members(members))

    def _centres(self, members: DataFrame) -> DataFrame:
        """A member of the component with most members in each bucket: the one that meets most."""
        label = F.col("label" if "label" in members.columns else "node").alias("label")
        best = F.max(F.struct("degree", F.expr("-node").alias("low"))).alias("best")
        parts = members.groupBy("bucket", label).agg(F.count("*").alias("n"), best)
        most = parts.groupBy("bucket").agg(F.max(F.struct("n", "best", "label")).alias("c"))
        return lookup_table(
            most.select("bucket", F.expr("-c.best.low").alias("centre"), F.col("c.label").alias("core")),
            "centres", self.scratch,
        )

    def _stars(self, members: DataFrame, centres: DataFrame) -> DataFrame:
        """Each member with the centre of its bucket, if that is in another component."""
        if "label" not in members.columns:
            members = members.withColumn("label", F.col("node"))
        pairs = members.join(centres, "bucket").where("node <> centre AND label <> core")
        return pairs.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()

    def _by_rarest(self, members: DataFrame) -> DataFrame:
        """The same nodes in a bucket for each of their rarest shingles that another has, too."""
        scratch = self.scratch
        nodes = lookup_table(members.select("node").distinct(), "left", scratch)
        texts = self.texts.join(nodes, "node", "left_semi").select("node", "text")
        sets = scratch.write(texts.mapInArrow(_listed(self.words), "node long, size long, s long"), "sets")
        often = sets.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
        often = lookup_table(often, "often", scratch)
        shared = sets.join(often, "s").groupBy("node", "size").agg(
            F.sort_array(F.collect_list(F.struct("n", "s"))).alias("shared")
        )
        # The shingles that no other text has come first and meet nobody.
        alone = F.col("size") - F.size("shared")
        probed = F.col("size") - F.ceil(F.col("size") * self.percent / 100) + 1 - alone
        indexed = F.col("size") - F.ceil(F.col("size") * (2 * self.percent) / (100 + self.percent)) + 1 - alone
        probed = F.greatest(probed, F.lit(0)).cast("int")
        rare = shared.select("node", "size", "shared", indexed.alias("indexed"), F.posexplode(F.slice("shared", 1, probed)).alias("at", "r"))
        rare = rare.select(
            F.col("r.s").alias("bucket"), "node", F.lit(0).cast("long").alias("degree"), "size",
            (F.col("at") < F.col("indexed")).alias("short"),
            (F.col("size") - alone - F.col("at")).alias("rest"),
        )
        # A bucket in which nobody is the shorter one finds no pair.
        found = rare.groupBy("bucket").agg(F.count("*").alias("n"), F.max("short").alias("any"))
        found = lookup_table(found.where("n > 1 AND any").select("bucket"), "found", scratch)
        rare = scratch.write(rare.join(found, "bucket"), "rarest")
        return scratch.write(self._open(self._labelled_members(rare)), "members")

    def _rest(self, members: DataFrame) -> DataFrame:
        """The pairs of a bucket that are in different components and could be similar enough:
        one by its rarest ninth, another that is as long, or up to a quarter longer; and what
        is not rarer than the bucket's shingle must suffice for both (the first shingle that a
        pair has in common always passes)."""
        short = members.where("short").select(
            "bucket", F.col("node").alias("b"), F.col("label").alias("core"),
            F.col("size").alias("least"), F.col("rest").alias("remains"),
        )
        could = f"label <> core AND size >= least AND {self.percent} * size <= 100 * least"
        could += f" AND {100 + self.percent} * least(rest, remains) >= {self.percent} * (size + least)"
        pairs = members.join(short, "bucket").where(could)
        return pairs.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()

    def _fetch(self, nodes: DataFrame) -> None:
        """Texts of one document of each class that shares a bucket."""
        chosen = self.classes.join(nodes, "node").select("node", "least", "rep_text")
        chosen = lookup_table(chosen, "wanted", self.scratch)
        same = F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("text_hash") == F.col("rep_text"))
        # The wanted texts grow with the corpus: the same join at every size.
        texts = self.docs.join(chosen.hint("merge"), same).select("node", "text")
        self.texts = self.scratch.write(texts.dropDuplicates(["node"]), "texts")
        self.signed = self.scratch.write(
            self.classes.join(nodes, "node").select("node", "signature"), "signed"
        )

    def _verified(self, pairs: DataFrame) -> DataFrame:
        def with_both(p: DataFrame, table: DataFrame, value: str) -> DataFrame:
            mine = table.select(F.col("node").alias("a"), F.col(value).alias("of_a"))
            other = table.select(F.col("node").alias("b"), F.col(value).alias("of_b"))
            return p.join(mine, "a").join(other, "b").select("a", "b", "of_a", "of_b")

        prune = _pruner(self.percent / 100, self.miss)
        likely_ = with_both(pairs, self.signed, "signature").mapInArrow(prune, "a long, b long")
        check = _verifier(self.words, self.percent)
        good = with_both(likely_, self.texts, "text").mapInArrow(check, "a long, b long")
        return self.scratch.write(good, "verified")

    def labelled(self) -> DataFrame:
        """The classes with ``component_id``, the smallest ``doc_id`` of their component, and
        ``core``, the node of the class that has it."""
        _, labels = self.links()
        mine = self.classes.join(labels, "node", "left").select(
            "hi", "lo", "node", "least", "rep_text", "n_shingles",
            F.coalesce("component", "node").alias("label"),
        )
        mine = self.scratch.write(mine, "classes-labelled")
        order = F.struct(F.col("least").isNull().alias("none"), "least", "node")
        best = mine.groupBy("label").agg(F.min(order).alias("best"))
        best = lookup_table(
            best.select("label", F.col("best.least").alias("component_id"), F.col("best.node").alias("core")),
            "best", self.scratch,
        )
        return lookup_table(mine.join(best, "label"), "labelled", self.scratch)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None
) -> DataFrame:
    """A row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents whose sets of ``words``-word shingles share at least ``percent`` percent of
    their union are linked; a component's smallest ``doc_id`` is its id and stays.  A text
    with fewer words has its whole sequence as one shingle; one without words, or null, has
    none and is linked with nothing.  Equal sets are one class, however often they occur.
    A row without ``doc_id`` can be linked but names no component: its component's id is
    null if no other row has one, and it is not kept.  Repeated rows stay repeated, an empty
    table gives no row, further columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    work = NearDuplicates(docs, words, percent, scratch)
    found = work.labelled().select("hi", "lo", "component_id")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    rows = work.rows.select("doc_id", "hi", "lo", "n_shingles").join(found, ["hi", "lo"])
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, scratch: Scratch | None = None
) -> DataFrame:
    """``docs`` with all their columns, one document of each component: that with the
    smallest ``doc_id`` (nulls last, then by a hash of the text).  All rows without a word
    stay, as they are linked with nothing."""
    scratch = scratch or Scratch(docs.sparkSession)
    work = NearDuplicates(docs, words, percent, scratch)
    best = work.labelled().where("node = core AND n_shingles > 0")
    empty = work.rows.where("n_shingles = 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"))
    keep = best.select("least", "rep_text", F.lit(1).cast("long").alias("times")).union(empty)
    keep = lookup_table(keep.toDF("_doc", "_hash", "_times"), "keep", scratch)
    keep = keep.select(id_key("_doc").alias("_id"), "_hash", "_times")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        id_key("doc_id").alias("_id"), F.xxhash64(text_or_empty()).alias("_hash"),
    )
    copy = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy("_id"))
    kept = rows.join(keep.hint("merge"), ["_id", "_hash"]).withColumn("_n", copy)
    return kept.where("_n <= _times").select("_row.*")
