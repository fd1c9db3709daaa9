"""Cost-balanced packing of documents into training sequences.

The cost of a piece is estimated as linear in its tokens plus quadratic for attention
within it.  Pieces go, longest first, to the sequence of lowest cost that still has room.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import small_batches, text_or_empty

CAPACITY = 2048
GROUP_TOKENS = 1 << 20
"""Tokens that are balanced together: what a task holds in memory at a time."""
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, cost double"
)


def room(total: int, capacity: int) -> list[int]:
    """Capacities of the sequences for ``total`` tokens: full ones, then powers of two,
    so that nothing is padded."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [
        1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1
    ]


def estimate(length, capacity: int):
    """Linear plus quadratic cost; a piece that fills a sequence costs twice its tokens."""
    return length + length * length / capacity


def assign(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, first token in it, tokens, sequence, offset) for all pieces.

    Pieces are taken in descending length (ties: as they came).  One that fits nowhere
    is cut to the room that is left, again in the sequences of lowest cost.
    """
    left = np.array(room(sum(lengths), capacity), dtype=np.int64)
    size, cost = left.copy(), np.zeros(len(left))
    placed = []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        done, rest = 0, lengths[piece]
        while rest:
            fits = left >= rest
            if not fits.any():
                fits = left == left.max()
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(rest, int(left[at]))
            placed.append((piece, done, take, at, int(size[at] - left[at])))
            left[at] -= take
            cost[at] += estimate(take, capacity)
            done, rest = done + take, rest - take
    return placed


def _packer(path: str, end_id: int, capacity: int, group_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = tokens.encoder(path)
        sequence = TaskContext.get().partitionId() << 32
        end = np.array([end_id], dtype="<u4")
        rows: list[tuple] = []
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens), each shorter than a sequence
        waiting = 0

        def emit(doc_id, start, ids, doc_tokens, at, offset):
            crc = zlib.crc32(ids.tobytes())
            cost = float(estimate(len(ids), capacity))
            rows.append((doc_id, start, len(ids), crc, doc_tokens, at, offset, cost))

        def balance():
            nonlocal sequence, waiting
            used = 0
            for piece, first, n, at, offset in assign([len(h[2]) for h in held], capacity):
                doc_id, start, ids, total = held[piece]
                emit(doc_id, start + first, ids[first : first + n], total, sequence + at, offset)
                used = max(used, at + 1)
            sequence += used
            held.clear()
            waiting = 0

        def table():
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            kinds = [pa.float64() if n == "cost" else pa.int64() for n in names]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            made = [pa.array(c, type=k) for c, k in zip(columns, kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            encoded = encoder.encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded):
                ids = np.concatenate([ids, end])
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    emit(doc_id, start, ids[start : start + capacity], len(ids), sequence, 0)
                    sequence += 1
                if whole < len(ids):
                    held.append((doc_id, whole, ids[whole:], len(ids)))
                    waiting += len(ids) - whole
                if waiting >= group_tokens:
                    balance()
                if len(rows) >= 10_000:
                    yield table()
        balance()
        yield table()

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    end_id: int = 1,
    capacity: int = CAPACITY,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row for each piece of each document (``doc_id``, ``text``).

    ``start`` and ``length`` are its place among the document's ids, to which ``end_id``
    is appended; ``offset`` its place in the sequence.  Full sequences are cut off long
    documents first; the rests of about ``group_tokens`` tokens are balanced together, in
    the task that has read them: nothing is shuffled, and memory is bounded by the group.
    The last sequences of a group are powers of two long, so no token of padding is needed.

    Null and empty texts consist of the end id alone; repeated rows and rows without a
    ``doc_id`` are packed as often as they occur; an empty table gives no row; further
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    run = _packer(tokenizer_path or tokens.default_path(), end_id, capacity, group_tokens)
    chosen = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return chosen.mapInArrow(run, SCHEMA)
