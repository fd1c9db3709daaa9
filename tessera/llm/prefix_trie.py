"""The trie of conversation prefixes, built from sorted shards and a skeleton.

A conversation is a path of turn digests.  Equal paths are one row, with the number of its
conversations.  Rows are range-partitioned by path and sorted, so the conversations of a node
lie next to each other, and a node that lies within one partition is finished there by one
pass with a stack.  Only nodes on both sides of a border between two partitions, the common
prefixes of the paths beside it, are in several: their trie, the skeleton, goes to all tasks,
which send what they know of its nodes, and these partial aggregates are reduced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ordered, spread
from tessera.scratch import Scratch, lookup_table

FAMILY = 20
"""A conversation begins with turns of the one whose id is the next lower multiple."""
BORROWED = 4
"""Fewer turns than that are taken over."""
MARK = 16
"""Bytes of a turn's digest."""
SKELETON_NODES = 1 << 16
"""Nodes of the skeleton; partitions whose border would exceed it are built as one."""
SKELETON_DEPTH = 1 << 10
"""Turns that two paths beside a border may have in common; else the same."""
_WORD = r"[^\x20\x09-\x0D]+"
_NODES = (
    "sid int, conv_id long, depth long, parent_sid int, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long"
)
_NONE = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """The first bytes of a hash of both; the length of the role tells where the text begins."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, MARK)


def rebuilt(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id``, ``path`` (a digest for each turn) and ``words`` (of each turn) of every
    conversation, after the turns it takes over from the first of its family."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    one = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_digest(role, text).alias("mark"), F.regexp_count(text, F.lit(_WORD)).alias("words"),
    )
    in_order = F.sort_array(F.collect_list(F.struct("turn", "mark", "words")))
    own = scratch.write(one.groupBy("conv_id").agg(in_order.alias("own")), "turns")
    base = own.where(F.col("conv_id") % FAMILY == 0).select(
        F.col("conv_id").alias("_base"), F.slice("own", 1, BORROWED - 1).alias("lent")
    )
    h = (F.crc32(F.col("conv_id").cast("string")) % BORROWED).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    both = own.withColumn("_base", first).join(base, "_base", "left")
    lent = F.coalesce(F.slice("lent", 1, h), F.slice("own", 1, 0))
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    both = both.select("conv_id", F.concat(lent, rest).alias("t"))
    path = F.unhex(F.array_join(F.transform("t.mark", F.hex), ""))
    return scratch.write(both.select("conv_id", path.alias("path"), F.col("t.words").alias("words")), "paths")


def _digester(batches):
    """Task: the hash of all ids of a path, from pieces in ascending order."""
    key, state, n, least, out = None, None, 0, None, []
    for batch in batches:
        for path, ids, count, low in zip(*(c.to_pylist() for c in batch.columns)):
            if path != key:
                if state is not None:
                    out.append((key, n, least, state.hexdigest()))
                key, state, n, least = path, hashlib.sha256(), 0, low
            else:
                state.update(b",")
            state.update(ids.encode())
            n += count
            if len(out) >= 4096:
                yield _rows(out)
                out = []
    if state is not None:
        out.append((key, n, least, state.hexdigest()))
    if out:
        yield _rows(out)


def _rows(out):
    import pyarrow as pa

    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    names = ["mark", "n", "least", "ends"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)


def distinct_paths(convs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row per path: ``path``, ``words``, ``n`` conversations, the smallest, ``ends``: the
    hash of all their ids.

    Ids are put in order over all partitions, so those of a path with very many make a piece
    of text in each; one task reads only these pieces.
    """
    marked = convs.select("conv_id", F.unhex(F.sha2("path", 256)).alias("mark"))
    in_order = ordered(scratch, marked, [F.col("mark"), F.col("conv_id")], "ends")
    ids = F.sort_array(F.collect_list("conv_id"))
    pieces = in_order.groupBy("mark", "_part").agg(
        F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.count("*").alias("count"),
        F.min("conv_id").alias("low"),
    )
    pieces = spread(pieces, "mark").sortWithinPartitions("mark", "_part")
    groups = pieces.select("mark", "ids", "count", "low").mapInArrow(
        _digester, "mark binary, n long, least long, ends string"
    )
    groups = lookup_table(groups, "groups", scratch)
    return convs.join(groups, convs.conv_id == groups.least).select("path", "words", "n", "least", "ends")


def _common(a: bytes, b: bytes) -> int:
    """Digests at the beginning that two paths share."""
    top = min(len(a), len(b)) // MARK
    low = 0
    while low < top:
        mid = (low + top + 1) // 2
        if a[: mid * MARK] == b[: mid * MARK]:
            low = mid
        else:
            top = mid - 1
    return low


def skeleton(table: DataFrame) -> tuple[dict[int, int], list[tuple[bytes, int]]]:
    """The shard of each partition, and the nodes in more than one: prefix and parent.

    Only the first ``SKELETON_DEPTH`` turns beside a border are looked at.  A border with more
    in common, or one that would make the skeleton too large, is taken out.
    """
    head = F.substring("path", 1, MARK * SKELETON_DEPTH)
    ends = table.groupBy("_part").agg(F.min(head).alias("low"), F.max(head).alias("high"))
    ends = sorted(ends.collect(), key=lambda r: r._part)
    shared = [_common(a.high, b.low) for a, b in zip(ends, ends[1:])]
    room, broken = SKELETON_NODES - 1, set()
    for at in sorted(range(len(shared)), key=lambda i: shared[i]):
        if shared[at] >= SKELETON_DEPTH or shared[at] > room:
            broken.add(at)
        else:
            room -= shared[at]
    shard, of = 0, {}
    nodes: list[tuple[bytes, int]] = [(b"", -1)]
    known = {b"": 0}
    for i, end in enumerate(ends):
        if i and i - 1 not in broken:
            shard += 1
            at = 0
            for d in range(1, shared[i - 1] + 1):
                prefix = bytes(end.low[: d * MARK])
                if prefix not in known:
                    known[prefix] = len(nodes)
                    nodes.append((prefix, at))
                at = known[prefix]
        of[end._part] = shard
    return of, nodes


class _Open:
    """A node whose conversations are being read."""

    __slots__ = ("sid", "depth", "least", "n", "children", "leaves", "saved", "ends", "words", "waiting")

    def __init__(self, sid, depth, words):
        self.sid, self.depth, self.words = sid, depth, words
        self.least, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.waiting = _NONE, []


def _builder(nodes: list[tuple[bytes, int]]):
    """Task: the nodes of sorted shards.  Those in the skeleton come with what this shard adds
    to them itself, without what their skeleton children get."""
    import pyarrow as pa

    names = [c.split()[0] for c in _NODES.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in _NODES.split(", ")]
    step = {}
    for sid, (prefix, parent) in enumerate(nodes):
        if sid:
            step[(parent, prefix[-MARK:])] = sid

    def run(batches):
        out: list[tuple] = []
        stack: list[_Open] = []
        path, shard = b"", None

        def close():
            node = stack.pop()
            above = stack[-1] if stack else None
            if node.sid is None:
                node.saved += (node.n - 1) * node.words
                node.leaves += not node.children
                above.n += node.n
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
                above.least = node.least if above.least is None else min(above.least, node.least)
                row = (node.least, node.depth, node.n, node.children, node.leaves, node.saved, node.ends)
                if above.sid is None:
                    above.waiting.append(row)
                else:
                    out.append(_finished(row, above.sid, None))
                out.extend(_finished(r, None, node.least) for r in node.waiting)
            elif node.n:
                out.append((
                    node.sid, node.least, node.depth, None, None, node.n, node.children, node.leaves,
                    node.saved, node.ends, node.words,
                ))

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names
            )

        for one in batches:
            for now, new, words, n, least, ends in zip(*(c.to_pylist() for c in one.columns)):
                if now != shard:
                    while stack:
                        close()
                    shard, path = now, b""
                    stack.append(_Open(0, 0, 0))
                for _ in range(len(stack) - 1 - _common(path, new)):
                    close()
                for d in range(len(stack) - 1, len(new) // MARK):
                    sid = stack[-1].sid
                    if sid is not None:
                        sid = step.get((sid, new[d * MARK : (d + 1) * MARK]))
                    stack.append(_Open(sid, d + 1, words[d]))
                path, top = new, stack[-1]
                top.n += n
                top.least = least if top.least is None else min(top.least, least)
                top.ends = ends
            if len(out) > 4096:
                yield batch()
                out.clear()
        while stack:
            close()
        if out:
            yield batch()

    return run


def _finished(row: tuple, parent_sid, parent_conv) -> tuple:
    least, depth, n, children, leaves, saved, ends = row
    return (None, least, depth, parent_sid, parent_conv, n, children, leaves, saved, ends, None)


def reduced(parts: DataFrame, nodes: list[tuple[bytes, int]]) -> list[tuple]:
    """The skeleton's nodes in full, from the sums of all shards (a row for each of its nodes)."""
    sums = parts.groupBy("sid").agg(
        F.min("conv_id").alias("least"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("words").alias("words"), F.max(F.when(F.col("ends_sha256") != _NONE, F.col("ends_sha256"))).alias("ends"),
    )
    at = {r.sid: r for r in sums.collect()}
    made = []
    for sid in range(len(nodes)):
        r = at.get(sid)
        made.append(
            [r.least, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.words, r.ends or _NONE]
            if r else [None, 0, 0, 0, 0, 0, _NONE]
        )
    for sid in range(len(nodes) - 1, -1, -1):  # children have larger numbers
        node, parent = made[sid], nodes[sid][1]
        node[3] += not node[2]
        node[4] += (node[1] - 1) * node[5]
        if sid:
            above = made[parent]
            above[0] = node[0] if above[0] is None else min(above[0], node[0])
            above[1] += node[1]
            above[2] += 1
            above[3] += node[3]
            above[4] += node[4]
    return [
        (sid, node[0], len(prefix) // MARK, made[parent][0] if sid else None, *node[1:5], node[6])
        for sid, ((prefix, parent), node) in enumerate(zip(nodes, made))
    ]


def prefix_trie(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """A row per node of the trie of rebuilt conversations: ``conv_id``, ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.

    Turns are in order of ``turn``, null first; equal ones in the order of a digest of role and
    text.  A null role or text is empty.  Rows without ``conv_id`` belong to no conversation.
    Repeated rows are turns of their own.  For a negative id the first of its family is that
    of the remainder with the sign of the id.  An empty table gives no row, as no conversation
    begins with the root; further columns are ignored.  A conversation is one row with some
    20 bytes for each turn.
    """
    scratch = scratch or Scratch(turns.sparkSession)
    spark = turns.sparkSession
    convs = rebuilt(turns, scratch)
    paths = distinct_paths(convs, scratch)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = paths.repartitionByRange(n, "path").withColumn("_part", F.spark_partition_id())
    table = scratch.write(table, "sorted")
    of, nodes = skeleton(table)
    if not of:
        return spark.createDataFrame([], _RESULT)
    shards = spark.createDataFrame(sorted(of.items()), "_part int, shard int")
    dealt = table.join(F.broadcast(shards), "_part").select("shard", "path", "words", "n", "least", "ends")
    dealt = dealt.repartitionById(len(of), F.col("shard")).sortWithinPartitions("shard", "path")
    built = scratch.write(dealt.mapInArrow(_builder(nodes), _NODES), "nodes")
    rows = reduced(built.where("sid is not null"), nodes)
    top = spark.createDataFrame(rows, "sid int, " + _RESULT)
    names = [c.split()[0] for c in _RESULT.split(", ")]
    # At most SKELETON_NODES rows.
    parents = F.broadcast(top.select(F.col("sid").alias("parent_sid"), F.col("conv_id").alias("_of")))
    lower = built.where("sid is null").join(parents, "parent_sid", "left")
    lower = lower.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_of"))
    return lower.select(*names).union(top.select(*names))


_RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
