"""Labels and liberties kept under batches of placed and removed stones.

A view is four tables under one folder: stones with their label, the free cells beside each
block with how many of its stones touch them, blocks with their number of liberties, and where
each block lies.  Stones are stored in buckets of tiles, the rest in buckets of blocks.  A batch
reads and rewrites only the buckets of the cells it changes and of the blocks it changes; what
it rewrites is a new version, and a manifest names the version of every bucket, so earlier
versions stay readable.

* A placed stone unites the labels beside it: a graph of the touched labels alone is closed.
* Only blocks that lose a stone may be cut; only their remaining stones are labelled again.
* A cell that is filled or freed changes the counts of the blocks beside it by one: signed
  changes, added to the stored counts.  A merged block takes over the counts of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.functions.geometry import neighbours, tile_of
from tessera.operators.blocks import BLOCK, label_blocks, smallest_of_component
from tessera.operators.ingest import CELL
from tessera.schema import TILE
from tessera.scratch import Scratch, joined, lookup_table

_TABLES = {
    "stones": "board_id long, id long, x long, y long, uid long, bid long",
    "free": "board_id long, bid long, x long, y long, n long",
    "blocks": "board_id long, bid long, uid long, stones long, qi long",
    "homes": "board_id long, bid long, home int",
}
_KEY = ["board_id", "id"]


class BlockView:
    """The blocks of all boards, kept up to date batch by batch.

    ``buckets`` must stay the same for one ``root``.  Stones have coordinates; a placed stone's
    cell is free, or freed by the same batch, and ids are unique per board.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, tile: int = TILE):
        self.spark, self.root, self.buckets, self.tile = spark, root.rstrip("/"), buckets, tile
        self.read_buckets: dict[str, set[int]] = {}

    # -- reading

    def version(self) -> int:
        """The last complete version; 0 before the first batch."""
        try:
            found = self.spark.read.parquet(f"{self.root}/manifest").agg(F.max("version")).first()[0]
        except AnalysisException:
            return 0
        return found or 0

    def _manifest(self, version: int) -> dict[str, dict[int, int]]:
        """For each table the version of every bucket that is not empty."""
        made: dict[str, dict[int, int]] = {name: {} for name in _TABLES}
        if version:
            schema = "name string, bucket int, since int"
            for r in self.spark.read.schema(schema).parquet(f"{self.root}/manifest/version={version}").collect():
                if r.bucket >= 0:
                    made[r.name][r.bucket] = r.since
        return made

    def table(self, name: str, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """A stored table as of a version (the last), all of it or some buckets."""
        now = self._manifest(self.version() if version is None else version)[name]
        return self._open(name, now, buckets)

    def _open(self, name: str, now: dict[int, int], buckets: set[int] | None = None) -> DataFrame:
        wanted = set(now) if buckets is None else set(now) & buckets
        paths = [f"{self.root}/{name}/version={now[b]}/bucket={b}" for b in sorted(wanted)]
        self.read_buckets.setdefault(name, set()).update(wanted)
        if not paths:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(*paths)

    def stones(self, version: int | None = None) -> DataFrame:
        return self.table("stones", version).select("board_id", "id", "x", "y", "bid", "uid")

    def blocks(self, version: int | None = None) -> DataFrame:
        """``board_id, bid, uid, qi``, as ``block_table`` gives them."""
        return self.table("blocks", version).select(*BLOCK, "uid", "qi")

    # -- changing

    def _by_tile(self) -> Column:
        tile = [tile_of("x", self.tile), tile_of("y", self.tile)]
        return F.pmod(F.xxhash64("board_id", *tile), F.lit(self.buckets)).cast("int")

    def _by_block(self) -> Column:
        return F.pmod(F.xxhash64("board_id", "bid"), F.lit(self.buckets)).cast("int")

    @staticmethod
    def _numbers(df: DataFrame, bucket: Column) -> set[int]:
        """At most as many as there are buckets."""
        return {r[0] for r in df.select(bucket.alias("b")).distinct().collect()}

    def apply(self, placed: DataFrame, removed: DataFrame | None = None) -> int:
        """Remove and place stones (``board_id, id, x, y`` and, if placed, ``uid``) at once; the
        number of the new version.  A batch that fails half way leaves the last version as it
        was; running it again overwrites what it wrote."""
        scratch = Scratch(self.spark)
        write = scratch.write
        last = self.version()
        now = self._manifest(last)
        placed = write(placed.select("board_id", "id", "x", "y", "uid"), "placed")
        if removed is None:
            removed = placed.limit(0)
        removed = write(removed.select("board_id", "id", "x", "y"), "removed")
        filled = joined(placed.select(*CELL), removed.select(*CELL), CELL, "left_anti")
        freed = joined(removed.select(*CELL), placed.select(*CELL), CELL, "left_anti")
        changed = write(
            filled.withColumn("step", F.lit(-1)).union(freed.withColumn("step", F.lit(1))), "changed"
        )
        cells = placed.select(*CELL).union(removed.select(*CELL))
        near_cells = self._numbers(neighbours(cells, 5), self._by_tile())
        local = self._open("stones", now["stones"], near_cells)

        # What goes, and what stays beside a changed cell.
        gone = write(joined(local, removed.select(*_KEY), _KEY, "left_semi"), "gone")
        stays = joined(local, removed.select(*_KEY), _KEY, "left_anti")
        sides = neighbours(changed.select("board_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "step", "x", "y"))
        beside = write(joined(sides, stays, CELL), "beside")
        cut = lookup_table(gone.select(*BLOCK).distinct(), "cut", scratch)
        touching = neighbours(placed.select("board_id", F.col("id").alias("new"), "uid", "x", "y"))
        same = write(joined(touching, stays, [*CELL, "uid"]).select("board_id", "new", "id", "bid"), "same")

        # The remaining stones of blocks that lost one, labelled again.
        labels = beside.select(*BLOCK).union(same.select(*BLOCK)).union(cut).distinct()
        labels = lookup_table(labels, "labels", scratch)
        by_block = self._numbers(labels, self._by_block())
        homes = self._open("homes", now["homes"], by_block)
        cut_homes = self._numbers(joined(homes, cut, BLOCK, "left_semi"), F.col("home"))
        wide = self._open("stones", now["stones"], near_cells | cut_homes)
        after = joined(wide, removed.select(*_KEY), _KEY, "left_anti")
        rest = write(joined(after, cut, BLOCK, "left_semi"), "rest")
        pieces = write(label_blocks(rest.drop("bid"), out="piece", tile=self.tile, scratch=scratch), "pieces")

        # Labels that placed stones unite.
        as_piece = pieces.select(*_KEY, "piece")
        old_label = F.coalesce("piece", "bid")
        pairs = joined(same, as_piece, _KEY, "left").select("board_id", F.col("new").alias("a"), old_label.alias("b"))
        both_new = joined(touching, placed.select(*CELL, "uid", "id"), [*CELL, "uid"])
        pairs = pairs.union(both_new.select("board_id", F.col("new").alias("a"), F.col("id").alias("b")))
        pairs = write(
            pairs.select("board_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
            "pairs",
        )
        united = pairs
        if not pairs.isEmpty():
            united = smallest_of_component(pairs, scratch)
        united = lookup_table(united.select("board_id", F.col("u").alias("bid"), F.col("v").alias("low")), "united", scratch)

        def renamed(df: DataFrame) -> DataFrame:
            """``bid`` replaced by the label of the block that it is part of now."""
            kept = [c for c in df.columns if c != "bid"]
            return joined(df, united, BLOCK, "left").select(*kept, F.coalesce("low", "bid").alias("bid"))

        new = write(renamed(placed.withColumn("bid", F.col("id"))), "new")
        parts = write(renamed(pieces.withColumnRenamed("piece", "bid")), "parts")

        # Stones: buckets with a changed cell, of blocks that were cut, and of absorbed ones.
        whole = joined(labels, cut, BLOCK, "left_anti")
        absorbed = joined(whole, united, BLOCK, "left_semi")
        absorbed_homes = self._numbers(joined(homes, absorbed, BLOCK, "left_semi"), F.col("home"))
        rewritten = self._numbers(cells, self._by_tile()) | cut_homes | absorbed_homes
        old = self._open("stones", now["stones"], rewritten)
        old = joined(old, removed.select(*_KEY), _KEY, "left_anti")
        kept = renamed(joined(old, cut, BLOCK, "left_anti"))
        stones = kept.unionByName(new).unionByName(parts)
        made = {"stones": (rewritten, stones.withColumn("bucket", self._by_tile()))}

        # Free cells: stored counts of whole blocks, changed by one for each side of a cell that
        # was filled or freed; those of cut blocks and placed stones are counted anew.
        seen = after.select(*CELL).union(placed.select(*CELL))
        fresh = new.select(*BLOCK, "x", "y").union(parts.select(*BLOCK, "x", "y"))
        counted = joined(neighbours(fresh), seen, CELL, "left_anti").withColumn("n", F.lit(1).cast("long"))
        signed = joined(beside, cut, BLOCK, "left_anti").select(
            *BLOCK, F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("step").cast("long").alias("n")
        )
        stored = joined(self._open("free", now["free"], by_block), whole, BLOCK, "left_semi")
        every = renamed(stored.union(signed)).select(*BLOCK, "x", "y", "n").union(counted.select(*BLOCK, "x", "y", "n"))
        free = every.groupBy(*BLOCK, "x", "y").agg(F.sum("n").alias("n")).where("n > 0")
        free = write(free, "free")

        qi = free.groupBy(*BLOCK).agg(F.count("*").alias("qi"))
        size = F.count("*").alias("stones")
        sizes = joined(self._open("blocks", now["blocks"], by_block), whole, BLOCK, "left_semi")
        sizes = renamed(sizes.select(*BLOCK, "uid", "stones")).select(*BLOCK, "uid", "stones")
        for some in (new, parts):
            sizes = sizes.union(some.groupBy(*BLOCK, "uid").agg(size).select(*BLOCK, "uid", "stones"))
        sizes = sizes.groupBy(*BLOCK).agg(F.min("uid").alias("uid"), F.sum("stones").alias("stones"))
        blocks = joined(sizes, qi, BLOCK, "left").select(
            *BLOCK, "uid", "stones", F.coalesce("qi", F.lit(0)).cast("long").alias("qi")
        )
        # A block's homes are the buckets of its stones and of the cells beside them.
        where = neighbours(fresh, 5).select(*BLOCK, self._by_tile().alias("home"))
        lies = renamed(joined(homes, whole, BLOCK, "left_semi")).select(*BLOCK, "home").union(where).distinct()

        affected = labels.union(united.select(*BLOCK)).union(fresh.select(*BLOCK)).distinct()
        affected = lookup_table(affected, "affected", scratch)
        touched = self._numbers(affected, self._by_block())
        for name, rows in {"free": free, "blocks": blocks, "homes": lies}.items():
            others = joined(self._open(name, now[name], touched), affected, BLOCK, "left_anti")
            columns = [c.split()[0] for c in _TABLES[name].split(", ")]
            full = others.select(*columns).union(rows.select(*columns))
            made[name] = (touched, full.withColumn("bucket", self._by_block()))
        self._commit(last + 1, now, made)
        scratch.discard()
        return last + 1

    def _commit(self, version: int, now: dict, made: dict) -> None:
        for name, (buckets, rows) in made.items():
            path = f"{self.root}/{name}/version={version}"
            # A bucket is one file, or as many as it needs.
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            there = self._numbers(self.spark.read.schema("bucket int").parquet(path), F.col("bucket")) if buckets else set()
            for b in buckets:
                now[name].pop(b, None)
            now[name].update({b: version for b in there})
        # One row is always there, so that a version without stones is one, too.
        rows = [("", -1, version)] + [(name, b, v) for name, of in now.items() for b, v in of.items()]
        self.spark.createDataFrame(rows, "name string, bucket int, since int").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{self.root}/manifest/version={version}")

    def changes(self, first: int, second: int) -> DataFrame:
        """Stones placed (``change`` 1) and removed (-1) between two versions, read only from
        buckets that differ."""
        before, after = (self._manifest(v)["stones"] for v in (first, second))
        differ = {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)}
        old, new = (self._open("stones", m, differ) for m in (before, after))
        cells = ["board_id", "id", "x", "y", "uid"]
        plus = joined(new, old.select(*_KEY), _KEY, "left_anti").select(*cells, F.lit(1).cast("long").alias("change"))
        minus = joined(old, new.select(*_KEY), _KEY, "left_anti").select(*cells, F.lit(-1).cast("long").alias("change"))
        return plus.union(minus)
