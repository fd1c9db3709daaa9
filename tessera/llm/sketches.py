"""Document fingerprints that subtract: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line, cut further after sentence ends.  Each distinct paragraph of a text,
together with how often it occurs, has a 64-bit digest.  The fingerprint holds 3 tables of
8 cells; a digest goes to one cell of each, which counts it and adds it to two running
exclusive-ors, of digests and of their check hashes.  Subtracted cell by cell, what two
versions share vanishes, and peeling recovers the digests that differ: a cell with one
digest left gives it away, and taking it out of its other cells frees the next.

Where more differs than a sketch can hold, it is retried four times larger, in the form of
four sketches of the same size, each for the digests of one value of two further bits; only
those that fail again are enlarged again.  So a sketch is always a short array, and the
paragraphs of a very long text spread over many rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import all_parts, id_key, ordered, text_or_empty
from tessera.scratch import Scratch, lookup_table

TABLES, CELLS = 3, 8
PEELS = 6
SPLIT_BITS = 2
PARAGRAPH = r"(?=[^\n])(?!(?<=[.!?]) )(?:[^\n.!?]++|[.!?]++(?! ))*+[.!?]*+"
"""What line ends, and single spaces after a full stop or such, leave between them."""
CELL = "struct<n: bigint, key: bigint, chk: bigint>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    each = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))

    def counted(a: Column) -> Column:
        n = F.size(a)
        begins = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1))
        )
        runs = let(begins, lambda at: F.transform(
            at, lambda s, k: F.xxhash64(F.get(a, s), F.coalesce(F.get(at, k + 1), n) - s)
        ))
        return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))

    return let(F.array_sort(F.transform(each, lambda p: F.xxhash64(p))), counted)


def sketch(digests: Column) -> Column:
    """The cells for an array of digests, a field for each table."""

    def table(t: int, es: Column) -> Column:
        empty = F.expr(f"cast(named_struct('n', 0L, 'key', 0L, 'chk', 0L) as {CELL})")
        return F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit(CELLS - 1).cast("long")),
            lambda c: F.aggregate(
                F.filter(es, lambda e: _place(e, t) == c), empty,
                lambda x, e: _cell(x["n"] + 1, x["key"].bitwiseXOR(e), x["chk"].bitwiseXOR(_check(e))),
            ),
        )

    return let(digests, lambda es: _tables(lambda t: table(t, es)))


def _tables(make: Callable[[int], Column]) -> Column:
    return F.struct(*[make(t).alias(f"t{t}") for t in range(TABLES)])


def _place(digest: Column, t: int) -> Column:
    """The cell of a digest in table ``t``."""
    bits = F.shiftrightunsigned(digest, 3 * t) if t else digest
    return bits.bitwiseAND(F.lit(CELLS - 1).cast("long"))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(1))


def _cell(n: Column, key: Column, chk: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), chk.alias("chk"))


def _less(x: Column, y: Column) -> Column:
    return _cell(x["n"] - y["n"], x["key"].bitwiseXOR(y["key"]), x["chk"].bitwiseXOR(y["chk"]))


def subtract(a: Column, b: Column) -> Column:
    """Cell by cell; each side is bound once, though every table reads it."""
    return let(a, lambda x: let(b, lambda y: _tables(lambda t: F.zip_with(x[f"t{t}"], y[f"t{t}"], _less))))


def peel(cells: Column) -> Column:
    """The ``cells`` that are left and what was ``found``: digests with +1 or -1."""

    def turn(state: Column, _: Column) -> Column:
        def lone(t: int) -> Column:
            held = F.filter(
                state["cells"][f"t{t}"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"]))
            )
            return held

        # With its check hash a lone cell is all that its other cells need.
        pure = F.array_distinct(F.concat(*[lone(t) for t in range(TABLES)]))

        def taken(p: Column) -> Column:
            left = _tables(lambda t: F.transform(
                state["cells"][f"t{t}"],
                lambda c, i: F.aggregate(F.filter(p, lambda x: _place(x["key"], t) == i), c, _less),
            ))
            now = F.struct(left.alias("cells"), F.concat(state["found"], p).alias("found"))
            return F.when(F.size(p) > 0, now).otherwise(state)

        return let(pure, taken)

    none = F.expr(f"cast(array() as array<{CELL}>)")
    start = F.struct(cells.alias("cells"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), start, turn)


def written(digests: Column) -> Column:
    """The fingerprint as text: number of digests, then count, key and check of each cell."""
    def line(cells: Column) -> Column:
        all_ = F.concat(*[cells[f"t{t}"] for t in range(TABLES)])
        return F.array_join(F.transform(all_, lambda c: F.concat_ws(
            ".", c["n"].cast("string"), F.hex(c["key"]), F.hex(c["chk"].bitwiseAND(F.lit(0xFFFFFFFF)))
        )), ",")

    return F.concat(F.size(digests).cast("string"), F.lit(":"), let(sketch(digests), line))


def _peeled(rows: DataFrame) -> DataFrame:
    """Add ``found`` and ``ok`` (nothing is left) for the digests ``a`` and ``b``."""
    rows = rows.withColumn("peeled", peel(subtract(sketch(F.col("a")), sketch(F.col("b")))))
    clean = F.lit(True)
    for t in range(TABLES):
        zero = F.forall(f"peeled.cells.t{t}", lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0))
        clean = clean & zero
    return rows.withColumn("ok", clean).withColumn("found", F.col("peeled.found")).drop("peeled")


def differences(pairs: DataFrame, keys: list[str], scratch: Scratch, digests: bool = True) -> DataFrame:
    """What differs between the digests ``a`` and ``b`` of each pair: ``keys``, ``n_a`` and
    ``n_b`` (how many only one side has) and, on request, the digests ``only_a``, ``only_b``.

    Sketches that do not peel are retried on four parts of their digests, as often as needed;
    each try is a written table.  The parts of one pair are added up by hash aggregation.
    """
    tries, depth, todo = [], 0, pairs.select(*keys, "a", "b")
    keep = F.col("found") if digests else F.expr(f"cast(null as array<{CELL}>)")
    while True:
        done = _peeled(todo)
        table = scratch.write(
            done.select(
                *keys, "ok", F.when(F.col("ok"), keep).alias("found"),
                F.size(F.filter("found", lambda x: x["n"] > 0)).alias("n_a"),
                F.size(F.filter("found", lambda x: x["n"] < 0)).alias("n_b"),
                F.when(~F.col("ok"), F.col("a")).alias("a"), F.when(~F.col("ok"), F.col("b")).alias("b"),
            ), f"try-{depth}",
        )
        tries.append(table.where("ok").select(*keys, "found", "n_a", "n_b"))
        failed = table.where("NOT ok")
        if failed.isEmpty():
            break
        shift = 9 + SPLIT_BITS * depth
        depth += 1
        if shift + SPLIT_BITS > 64:
            raise RuntimeError("digests cannot be told apart")

        def part(side: str, j: Column) -> Column:
            mask = F.lit((1 << SPLIT_BITS) - 1).cast("long")  # the next bits choose the part
            return F.filter(side, lambda e: F.shiftrightunsigned(e, shift).bitwiseAND(mask) == j)

        parts = F.transform(
            F.sequence(F.lit(0).cast("long"), F.lit((1 << SPLIT_BITS) - 1).cast("long")),
            lambda j: F.struct(part("a", j).alias("a"), part("b", j).alias("b")),
        )
        todo = failed.select(*keys, F.explode(parts).alias("p")).select(*keys, "p.a", "p.b")
        todo = todo.where("size(a) > 0 OR size(b) > 0")
    every = tries[0]
    for t in tries[1:]:
        every = every.union(t)
    sums = [F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")]
    if not digests:
        return every.groupBy(*keys).agg(*sums)
    found = F.flatten(F.collect_list("found")).alias("found")

    def side(sign: int) -> Column:
        return F.transform(F.filter("found", lambda x: x["n"] == sign), lambda x: x["key"])

    return every.groupBy(*keys).agg(found, *sums).select(
        *keys, "n_a", "n_b", side(1).alias("only_a"), side(-1).alias("only_b")
    )


def _neighbours(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """For each key (``k``, ``h``) the next and the one before, around the end, and the
    characters of the one before.  Only ids are ordered, in ranges; the ends of the ranges
    are as many rows as there were partitions."""
    table = ordered(scratch, keys, [F.col("doc_id").asc_nulls_first(), F.col("h")], "order")
    own = F.struct("k", "h", "n")
    ends = table.groupBy("_part").agg(
        F.min_by(own, "_at").alias("head"), F.max_by(own, "_at").alias("tail")
    )
    parts = all_parts()
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "_part", F.coalesce(F.lead("head").over(parts), F.first("head").over(whole)).alias("after"),
        F.coalesce(F.lag("tail").over(parts), F.last("tail").over(whole)).alias("before"),
    )
    ends = lookup_table(ends, "range-ends", scratch)
    line = Window.partitionBy("_part").orderBy("_at")
    near = table.withColumns({"up": F.lead(own).over(line), "down": F.lag(own).over(line)})
    near = near.join(ends, "_part")
    after, before = F.coalesce("up", "after"), F.coalesce("down", "before")
    return lookup_table(
        near.select(
            "doc_id", "k", "h", "copies", after["k"].alias("next_k"), after["h"].alias("next_h"),
            before["k"].alias("prev_k"), before["h"].alias("prev_h"), before["n"].alias("prev_n"),
        ), "neighbours", scratch,
    )


def fingerprints(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row per document: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has its last quarter (whole code points, rounded down) replaced by as
    many first ones of the next document, or all that has; ids ascend, the last is followed
    by the first.  Likeness is the Jaccard index of the paragraph digests as the subtracted
    fingerprints give it; of two texts without paragraphs it is 1.

    Null and empty texts are one text.  Rows without ``doc_id`` come first, equal ids are
    ordered by a hash of the text, and rows that repeat id and text follow each other.  One
    row alone follows itself.  An empty table gives no row; further columns are ignored.
    Whole texts are shuffled once, and once more the part of each that the one before takes.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    rows = rows.withColumns({"k": id_key("doc_id"), "h": F.xxhash64("text")})
    keys = rows.groupBy("doc_id", "k", "h").agg(
        F.count("*").alias("copies"), F.max(F.length("text")).cast("long").alias("n")
    )
    near = _neighbours(keys, scratch)
    copy = F.row_number().over(Window.partitionBy("k", "h").orderBy("k"))
    # Both readers of the texts take the same columns, so that they share the shuffle.
    joined = rows.select("k", "h", "text").join(near.hint("merge"), ["k", "h"]).withColumn("copy", copy)
    # Of rows that repeat, all but the last follow each other; one of those stands for them.
    joined = joined.where("copy >= copies - 1").withColumns({
        "last": F.col("copy") == F.col("copies"),
        "times": F.when(F.col("copy") == F.col("copies"), 1).otherwise(F.col("copies") - 1),
    })
    heads = joined.where("last").select(
        F.col("prev_k").alias("k"), F.col("prev_h").alias("h"),
        F.substring("text", F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"),
    )
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    taken = F.when(F.col("last"), F.col("head")).otherwise(F.substring("text", F.lit(1), quarter))
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), taken)
    base = scratch.write(
        joined.join(heads, ["k", "h"]).withColumn("edited", edited).select(
            "doc_id", "k", "h", "last", "times", n.cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"), paragraph_digests(F.col("text")).alias("own"),
            paragraph_digests(F.col("edited")).alias("changed"), "next_k", "next_h",
        ), "digests",
    )
    ids = ["k", "h", "last", "kind"]
    other = base.where("last").select(
        F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("own").alias("b")
    )
    followed = base.where("last").join(other, ["next_k", "next_h"])
    pairs = base.select(
        "k", "h", "last", F.lit(0).alias("kind"), F.col("own").alias("a"), F.col("changed").alias("b")
    ).union(followed.select("k", "h", "last", F.lit(1).alias("kind"), F.col("own").alias("a"), "b"))
    got = differences(pairs, ids, scratch, digests=False)
    by_kind = got.groupBy("k", "h", "last").agg(*[
        F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{c}_{kind}")
        for kind in (0, 1) for c in ("n_a", "n_b")
    ])

    def likeness(kind: int) -> Column:
        """What only one side has is known; the rest of its digests is shared."""
        shared = F.size("own") - F.col(f"n_a_{kind}")
        union = F.size("own") + F.col(f"n_b_{kind}")
        return F.when(union > 0, shared / union).otherwise(1.0)

    rows = base.join(by_kind, ["k", "h", "last"]).withColumn(
        "time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"),
        written(F.col("changed")).alias("edited_fingerprint"), likeness(0).alias("near_edited"),
        F.when(F.col("last"), likeness(1)).otherwise(1.0).alias("near_next"),
    )
