"""Blocks of equally owned cells, their liberties, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import tasks
from tessera.functions.geometry import neighbours, tile_of, tile_offset
from tessera.operators.ingest import CELL
from tessera.operators.last import related_blocks
from tessera.operators.regions import Split, split_by
from tessera.schema import TILE
from tessera.scratch import Scratch, joined, lookup_table

BLOCK = ["board_id", "bid"]


def label_blocks(
    df: DataFrame,
    owner: str | None = "uid",
    out: str = "bid",
    tie: str | None = None,
    tile: int = TILE,
    scratch: Scratch | None = None,
    written: bool = False,
) -> DataFrame:
    """Add ``out``: the smallest ``id`` of each cell's 4-connected component.

    Cells connect when they have the same ``owner`` (any, if None).  With ``tie``
    the cells sharing that column's value are one component wherever they lie, and
    the label is the component's smallest value of it.

    A board is cut into square tiles.  Components are first found inside each tile,
    which holds at most ``tile * tile`` cells however large its board, and only the
    pairs of tile components that touch across a tile edge are then joined up in
    rounds.  A stone without coordinates is a component of its own.

    The result reads intermediate tables; ``written`` makes it a table of its own.
    """
    seed = tie or "id"
    scratch = scratch or Scratch(df.sparkSession)
    df = df.drop(out) if out != seed else df
    rest = df.columns
    local_out = "_label"
    on_board = F.col("x").isNotNull() & F.col("y").isNotNull()
    helper = ["_tx", "_ty", "_lx", "_ly"]
    cut = df.filter(on_board).withColumns(
        {
            "_tx": tile_of("x", tile),
            "_ty": tile_of("y", tile),
            "_lx": tile_offset("x", tile),
            "_ly": tile_offset("y", tile),
        }
    )
    key = ["board_id", "_tx", "_ty"]
    schema = T.StructType([*df.schema.fields, T.StructField(local_out, T.LongType())])
    local = (
        cut.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(tasks.label_tiles(owner, seed, tile, local_out, helper), schema)
    )
    loose = df.filter(~on_board).withColumn(local_out, F.col(seed))
    local = scratch.write(local.unionByName(loose), "tile-labels")
    pairs = _touching(local, owner, tile)
    if tie:
        # Of stones that share a value, all but one at most carry it as another's id.
        shared = lookup_table(
            local.filter(F.col(tie) != F.col("id")).select("board_id", tie).distinct(),
            "shared", scratch,
        )
        tied = joined(
            local.filter(F.col(tie) != F.col(local_out)), shared, ["board_id", tie], "left_semi"
        )
        pairs = pairs.union(
            tied.select("board_id", F.col(tie).alias("u"), F.col(local_out).alias("v"))
        )
    pairs = scratch.write(pairs.distinct(), "touching")
    kept = [c for c in rest if c != out]
    if pairs.isEmpty():
        return local.select(*kept, F.col(local_out).alias(out))
    root = smallest_of_component(pairs, scratch).withColumnRenamed("u", local_out)
    labelled = joined(local, root, ["board_id", local_out], "left").select(
        *kept, F.coalesce("v", local_out).alias(out)
    )
    return scratch.write(labelled, "labels") if written else labelled


def _touching(local: DataFrame, owner: str | None, tile: int) -> DataFrame:
    """Pairs ``u > v`` of tile labels that meet across a tile edge."""
    match = CELL + ([owner] if owner else [])
    edge = tile - 1
    rim = local.select(*match, "_label", tile_offset("x", tile).alias("_lx"), tile_offset("y", tile).alias("_ly"))
    step = F.array_compact(
        F.array(
            F.when(F.col("_lx") == edge, F.struct((F.col("x") + 1).alias("x"), F.col("y").alias("y"))),
            F.when(F.col("_ly") == edge, F.struct(F.col("x").alias("x"), (F.col("y") + 1).alias("y"))),
        )
    )
    others = [c for c in match if c not in ("x", "y")]
    a = (
        rim.filter(f"_lx = {edge} or _ly = {edge}")
        .select(*others, F.col("_label").alias("_a"), F.explode(step).alias("_c"))
        .select(*others, "_a", "_c.x", "_c.y")
    )
    b = rim.filter("_lx = 0 or _ly = 0").select(*match, F.col("_label").alias("_b"))
    return (
        joined(a, b, match)
        .filter("_a != _b")
        .select("board_id", F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v"))
        .distinct()
    )


def smallest_of_component(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Map every non-minimal node ``u`` of a graph to its component's minimum ``v``.

    ``pairs`` holds edges ``u > v`` per board.  Alternates the large-star and
    small-star steps (Kiveris et al., 2014), each an aggregate with map-side combine
    and a join, until every component is a star around its minimum.  The aggregates are
    written, so the edges of a hub have a shuffle of their own that can be split.
    """
    node = ["board_id", "u"]
    while True:
        both = pairs.union(pairs.select("board_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = lookup_table(
            both.groupBy(*node).agg(F.min("v").alias("_m")).select(
                *node, F.least("_m", "u").alias("_m")
            ),
            "large-low", scratch,
        )
        large = (
            joined(both.filter("v > u"), low, node)
            .select("board_id", F.col("v").alias("u"), F.col("_m").alias("v"))
            .distinct()
        )
        large = scratch.write(large, "large-star")
        low = lookup_table(large.groupBy(*node).agg(F.min("v").alias("_m")), "small-low", scratch)
        small = (
            joined(large, low, node)
            .filter("v != _m")
            .select("board_id", F.col("v").alias("u"), F.col("_m").alias("v"))
            .union(low.select("board_id", "u", F.col("_m").alias("v")))
            .distinct()
        )
        pairs = scratch.write(small, "small-star")
        roles = pairs.select("board_id", F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).union(
            pairs.select("board_id", F.col("v").alias("n"), F.lit(0).alias("c"), F.lit(1).alias("p"))
        )
        unfinished = (
            roles.groupBy("board_id", "n")
            .agg(F.sum("c").alias("c"), F.max("p").alias("p"))
            .filter("c > 1 or (c = 1 and p = 1)")
        )
        if unfinished.isEmpty():
            return pairs


def block_neighbours(df: DataFrame) -> DataFrame:
    """Distinct cells adjacent to each block, free or not."""
    return neighbours(df.select(*BLOCK, "uid", "x", "y"), distinct=True)


def liberties(df: DataFrame) -> DataFrame:
    """Distinct empty cells adjacent to each block.

    The occupied cells are taken away first: both that join and the removal of
    duplicates then use the one partitioning by cell.
    """
    near = neighbours(df.select(*BLOCK, "uid", "x", "y"))
    return near.join(df.select(*CELL), CELL, "left_anti").distinct()


def liberty_counts(df: DataFrame) -> DataFrame:
    """``board_id, bid, uid, liberties`` per block, 0 kept."""
    return block_sizes(df).drop("stones")


def block_sizes(df: DataFrame) -> DataFrame:
    """``board_id, bid, uid, stones, liberties`` per block."""
    free = liberties(df).groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    blocks = df.groupBy(*BLOCK).agg(
        F.min("uid").alias("uid"), F.count(F.lit(1)).alias("stones")
    )
    return blocks.join(free, BLOCK, "left").select(
        *BLOCK, "uid", "stones", F.coalesce("_n", F.lit(0)).cast("long").alias("liberties")
    )


def weighted_liberties(df: DataFrame) -> DataFrame:
    """``board_id, bid, uid, weighted``: liberties times stones of the block.

    Zero exactly when the block has no liberties; not a count of cells otherwise.
    """
    return block_sizes(df).select(
        *BLOCK, "uid", (F.col("liberties") * F.col("stones")).alias("weighted")
    )


def sides(df: DataFrame, test) -> list[Column]:
    """``test(neighbour)`` for the four cells around each stone.

    ``neighbour(column)`` reads a column of the adjacent stone, NULL if the cell is
    empty.  Stones are ordered along their row and their column, so every stone is
    shuffled twice and none is copied; a row or column is bounded by the board.
    """

    def looking(along: str, across: str, step: int):
        order = Window.partitionBy("board_id", across).orderBy(along)
        read = F.lag if step < 0 else F.lead

        def neighbour(column: str) -> Column:
            return F.when(read(along).over(order) == F.col(along) + step, read(column).over(order))

        return neighbour

    return [
        test(looking(along, across, step))
        for along, across in (("x", "y"), ("y", "x"))
        for step in (-1, 1)
    ]


def any_of(tests: list[Column]) -> Column:
    """True if one of the tests is true; NULL counts as false."""
    return F.coalesce(*[F.when(t, True) for t in tests], F.lit(False))


def open_blocks(df: DataFrame) -> DataFrame:
    """Distinct blocks with at least one liberty."""
    placed = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    loose = df.filter(F.col("x").isNull() | F.col("y").isNull())
    empty = sides(placed, lambda near: near("bid").isNull())
    free = placed.select(*BLOCK, any_of(empty).alias("_free")).filter("_free")
    return free.select(*BLOCK).union(loose.select(*BLOCK)).distinct()


def open_among(some: DataFrame, occupied: DataFrame) -> DataFrame:
    """``open_blocks`` of a few blocks' stones on boards occupied by ``occupied``."""
    near = neighbours(some.select(*BLOCK, "x", "y"))
    return near.join(occupied.select(*CELL), CELL, "left_anti").select(*BLOCK).distinct()


def dead_blocks(df: DataFrame) -> DataFrame:
    """Blocks without any liberty."""
    return df.select(*BLOCK).distinct().join(open_blocks(df), BLOCK, "left_anti")


def sweep(df: DataFrame) -> Split:
    """Remove all blocks without liberties at once, judged on the one state."""
    return split_by(df, dead_blocks(df), BLOCK)


def dead_related_blocks(df: DataFrame) -> DataFrame:
    """Related blocks of the last stone without liberties; only these are examined."""
    related = related_blocks(df)
    related = lookup_table(related, "related")
    alive = open_among(df.join(related.select(*BLOCK), BLOCK, "left_semi"), df)
    return related.join(alive, BLOCK, "left_anti")


def need_clear(df: DataFrame) -> DataFrame:
    """Per board whether any related block of the last stone has no liberties."""
    dead = dead_related_blocks(df).groupBy("board_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        df.select("board_id")
        .distinct()
        .join(dead, "board_id", "left")
        .select("board_id", F.col("_n").isNotNull().alias("need"))
    )


def merge_last(df: DataFrame) -> DataFrame:
    """Give all own related blocks of the last stone the smallest of their labels."""
    own = related_blocks(df).filter("side = 'own'").select(*BLOCK)
    least = own.groupBy("board_id").agg(F.min("bid").alias("_new"))
    relabel = lookup_table(own.join(least, "board_id"), "relabel")
    return df.join(relabel, BLOCK, "left").select(
        *[F.coalesce("_new", "bid").alias("bid") if c == "bid" else F.col(c) for c in df.columns]
    )


def block_table(df: DataFrame) -> DataFrame:
    """The normalised block table ``board_id, bid, uid, qi`` (``qi``: liberties)."""
    return block_sizes(df).select(*BLOCK, "uid", F.col("liberties").alias("qi"))


def stones_with_block(block: DataFrame, cells: DataFrame) -> DataFrame:
    """Join cells ``board_id, x, y, bid`` to their block's owner."""
    owners = lookup_table(block.select(*BLOCK, "uid"), "owners")
    return cells.select(*CELL, "bid").join(owners, BLOCK).select(
        "uid", "bid", *CELL
    )


def orphan_cells(block: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells whose label names no block."""
    return cells.join(lookup_table(block.select(*BLOCK), "blocks"), BLOCK, "left_anti")
