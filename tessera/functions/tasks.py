"""Small helpers that run inside Spark tasks on Arrow batches.

They are pickled by value, so executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``keys`` into tables that never split a group.

    Only the last group of a batch is held over, so memory is one batch plus one
    group.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        code = group_starts(table, keys)
        if held and not _same_group(held[0], table, keys):
            yield pa.concat_tables(held)
            held = []
        cut = int(code[-1])
        if cut > 0:
            yield pa.concat_tables([*held, table.slice(0, cut)])
            held = []
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held)


def _same_group(a: pa.Table, b: pa.Table, keys: list[str]) -> bool:
    return all(a.column(k)[0].as_py() == b.column(k)[0].as_py() for k in keys)


def longs(table: pa.Table, name: str) -> np.ndarray:
    """A 64-bit column without NULLs as a numpy array."""
    return table.column(name).to_numpy()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins, in sorted input."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = longs(table, k)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def tile_labels(
    table: pa.Table, owner: str | None, seed: str, tile: int
) -> np.ndarray:
    """Smallest ``seed`` of each cell's 4-connected group within its tile.

    ``owner`` restricts a group to equal owners.  All tiles of the table are done
    at once: cells are matched by sorted position, and groups are found by hooking
    larger roots under smaller ones and halving paths until nothing changes.
    """
    n = table.num_rows
    starts = group_starts(table, ["board_id", "_tx", "_ty"])
    which = np.searchsorted(starts, np.arange(n), side="right") - 1
    lx, ly, value = longs(table, "_lx"), longs(table, "_ly"), longs(table, seed)
    by_seed = np.argsort(value, kind="stable")
    which, lx, ly, value = which[by_seed], lx[by_seed], ly[by_seed], value[by_seed]
    own = longs(table, owner)[by_seed] if owner else np.zeros(n, dtype=np.int64)

    place = (which * tile + lx) * tile + ly
    order = np.argsort(place, kind="stable")
    placed = place[order]

    def linked(step: int, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.flatnonzero(inner)
        at = np.searchsorted(placed, place[a] + step)
        ok = at < n
        a, at = a[ok], at[ok]
        b = order[at]
        ok = (place[b] == place[a] + step) & (own[a] == own[b])
        return a[ok], b[ok]

    right, up = linked(tile, lx < tile - 1), linked(1, ly < tile - 1)
    left_end = np.concatenate([right[0], up[0]])
    right_end = np.concatenate([right[1], up[1]])
    root = np.arange(n)
    while True:
        p, q = root[left_end], root[right_end]
        differ = p != q
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(p, q)[differ], np.minimum(p, q)[differ])
        while True:
            nxt = root[root]
            if np.array_equal(nxt, root):
                break
            root = nxt
    label = np.empty(n, dtype=np.int64)
    label[by_seed] = value[root]
    return label


PRESENT, MOVE, WALL_PRESENT, WALL_MOVE = 0, 1, 2, 3
PLACED, OCCUPIED, SUICIDE = 0, 1, 2


def fold_region(events: list[tuple[int, int, int, int, int, int]]):
    """Play one region's events ``(kind, id, x, y, uid, bid)`` in order.

    Stones already present come first, then moves by id.  A wall never loses its
    last liberty.  Returns the per-move results ``(kind, id, x, y, uid, outcome,
    captured, merged)`` and the region's surviving stones ``(id, x, y, uid, bid)``;
    ``bid`` is the label a stone entered with.

    Every group keeps a count of its stones' open sides, changed by at most four
    steps for each stone that comes or goes and summed when groups merge, so time
    grows in line with the events.
    """
    stone: dict[tuple[int, int], tuple[int, int, int, int, bool]] = {}
    group_of: dict[tuple[int, int], object] = {}
    members: dict[object, list[tuple[int, int]]] = {}
    open_sides: dict[object, int] = {}
    anchor: dict[object, tuple[int, int]] = {}
    immortal: set[object] = set()
    results = []

    def around(c):
        x, y = c
        return ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))

    def dead(g) -> bool:
        return g not in immortal and open_sides[g] == 0

    def remove(g) -> int:
        cells = members.pop(g)
        del open_sides[g]
        for c in cells:
            del stone[c], group_of[c]
        for c in cells:
            for n in around(c):
                if n in stone:
                    open_sides[group_of[n]] += 1
        return len(cells)

    def put(c, uid, sid, bid, wall, key) -> bool:
        """Place a stone, merge it with equal neighbours and with its label's other
        stones, report if a neighbour was equal."""
        beside = [n for n in around(c) if n in stone]
        for n in beside:
            open_sides[group_of[n]] -= 1
        stone[c] = (sid, c[0], c[1], uid, bid, wall)
        own = {group_of[n] for n in beside if stone[n][3] == uid}
        merged = bool(own)
        if key in anchor:
            own.add(group_of[anchor[key]])
        anchor.setdefault(key, c)
        big = max(own, key=lambda g: len(members[g])) if own else key
        members.setdefault(big, []).append(c)
        open_sides[big] = open_sides.get(big, 0) + 4 - len(beside)
        group_of[c] = big
        for g in own - {big}:
            for other in members[g]:
                group_of[other] = big
            members[big].extend(members.pop(g))
            open_sides[big] += open_sides.pop(g)
            if g in immortal:
                immortal.add(big)
        if wall:
            immortal.add(big)
        return merged

    for kind, sid, x, y, uid, bid in events:
        c = (x, y)
        if kind in (PRESENT, WALL_PRESENT):
            wall = kind == WALL_PRESENT
            put(c, uid, sid, bid, wall, ("w", sid) if wall else ("b", bid))
            continue
        if c in stone:
            results.append((kind, sid, x, y, uid, OCCUPIED, 0, False))
            continue
        wall = kind == WALL_MOVE
        merged = put(c, uid, sid, bid, wall, ("w" if wall else "m", sid))
        enemy = {group_of[n] for n in around(c) if n in stone and stone[n][3] != uid}
        captured = sum(remove(g) for g in [g for g in enemy if dead(g)])
        outcome = PLACED
        if not wall and dead(group_of[c]):
            remove(group_of[c])
            outcome = SUICIDE
        results.append((kind, sid, x, y, uid, outcome, captured, merged))
    left = [s[:5] for s in stone.values() if not s[5]]
    return results, left


def label_tiles(owner: str | None, seed: str, tile: int, out: str, drop: list[str]) -> Callable:
    """Arrow task: add the tile-local label ``out`` to rows sorted by tile."""

    def run(batches):
        for table in whole_groups(batches, ["board_id", "_tx", "_ty"]):
            label = tile_labels(table, owner, seed, tile)
            table = table.append_column(out, pa.array(label))
            yield from table.drop_columns(drop).combine_chunks().to_batches()

    return run


def fold_regions(batches):
    """Arrow task: play all regions of a partition sorted by (board, region, order)."""
    columns = ("kind", "id", "x", "y", "uid", "bid")
    for table in whole_groups(batches, ["board_id", "region"]):
        starts = group_starts(table, ["board_id", "region"]).tolist()
        rows = list(zip(*[longs(table, c).tolist() for c in columns]))
        board = longs(table, "board_id")
        out = []
        for a, b in zip(starts, [*starts[1:], table.num_rows]):
            home = int(board[a])
            results, left = fold_region(rows[a:b])
            out += [
                (home, sid, x, y, uid, sid, kind, outcome, captured, merged)
                for kind, sid, x, y, uid, outcome, captured, merged in results
            ]
            out += [(home, *s, PRESENT, PLACED, 0, False) for s in left]
        names = ("board_id", "id", "x", "y", "uid", "bid", "kind", "outcome", "captured")
        cols = list(zip(*out)) if out else [()] * 10
        arrays = [pa.array(c, pa.int64()) for c in cols[:9]] + [pa.array(cols[9], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, [*names, "merged"])
