"""Probabilistic suffix tree: a language model with contexts of varying length.

A symbol is a word, or the end of a text.  A context is the last ``d`` words before a
symbol; the tree grows from the empty context, whose distribution is that of the words.
A longer context becomes a state if its suffix, one word shorter, is one, if it occurs at
least ``LEAST`` times, and if its next-symbol distribution diverges from its suffix's: the
log-likelihood ratio of the symbols that follow it, each judged with itself left out of the
counts, must exceed the logarithm of the context's count.  Distributions are smoothed by
absolute discounting: what symbols seen once, and the discount of the others, leave goes to
the distribution of the suffix.  A symbol is scored by the longest context that is a state.

Per depth the texts are read once.  A task sorts the symbols of a block of documents by
context and sends each context's share to one bucket; the contexts with more than a
4,096th of all symbols, so at most that many, are spread over all buckets by their next
symbol.  A bucket's task adds the counts up, one range of contexts after another, and keeps,
beside them, which documents hold each symbol.  Since log probabilities along the chain of suffixes are sums of one term for each
depth, the documents' scores are sums over these lists, and no text is looked up twice.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, text_or_empty
from tessera.llm.words import BASES, mix, span_hashes
from tessera.scratch import Scratch, lookup_table

DEPTH = 3
"""Words of the longest context."""
LEAST = 8
"""Occurrences that a context needs to be examined."""
DISCOUNT = 0.75
SPREAD = 4096
"""Contexts with more than this fraction of all symbols are spread over all buckets."""
BLOCK_DOCS = 1 << 14
BLOCK_BYTES = 8 << 20
"""Documents and bytes of text that a task sorts together (one text at least)."""
SLICE = 1 << 18
"""Sequences, as sent, that a bucket's task counts at a time (one context at least)."""
GROUP_BYTES = 1 << 17
"""Bytes of text that are cut into words together (one text at least): their arrays stay small
enough for a processor's cache."""
BATCH_BYTES = 1 << 20
"""Bytes of an Arrow batch of counts and lists (one row at least)."""
PARTS = 2
"""Pairs and triples of words, of which there are most, are counted in so many turns."""
FILTER_BITS = 1 << 28
"""Bits at most, 32 MB, of the filter that keeps contexts too rare to be examined from being
sent; where it fills up, more is sent and the result is the same."""
END = np.uint64(0x6A09E667F3BCC909)
"""The end of a text."""

_LOW = np.uint64((1 << 32) - 1)

_SPACE = bytes(b in b" \t\n\v\f\r" for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
"""What keeps the first bytes of eight."""
_SENT = "bucket int, block long, ctx binary, runs binary, par binary, n binary, m binary, docs binary"
_COUNTED = (
    "kind int, p int, id long, ctx long, par long, n long, k long, n1 long, n2 long, "
    "block long, entries binary, m binary, docs binary"
)
_GRAM, _STAT, _LIST, _SIZE = 0, 1, 2, 3
_SUMS = "block long, docs binary, score binary, base binary, known binary"


def text_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of each text, its end after them, and how many symbols each has."""
    made, first, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_BYTES or i + 1 == len(texts):
            made.append(_group_symbols(texts[first : i + 1]))
            first, size = i + 1, 0
    ids, lengths = (np.concatenate(a) for a in zip(*made))
    return ids, lengths


def _word_ids(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of ``raw``, eight bytes at a time; those beyond 64 bytes by ``span_hashes``.
    Eight more bytes follow the last span."""
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    sizes = ends - starts
    made = eight[starts] & _FIRST[np.minimum(sizes, 8)]
    made = mix(mix(made + sizes.astype(np.uint64) * np.uint64(BASES[0])))
    at = np.flatnonzero(sizes > 8)
    for done in range(8, 64, 8):
        more = eight[starts[at] + done] & _FIRST[np.minimum(sizes[at] - done, 8)]
        made[at] = mix(mix(made[at] + more))
        at = at[sizes[at] > done + 8]
        if not len(at):
            return made
    made[at] = span_hashes(np.frombuffer(raw, dtype=np.uint8), starts[at], ends[at])
    return made


def _group_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = (b" " + b" ".join(texts) + b" " * 9).translate(_LOWER)
    space = np.frombuffer(raw.translate(_SPACE), dtype=bool)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    after = 1 + np.cumsum([len(t) + 1 for t in texts])
    lengths = np.diff(np.searchsorted(starts, after), prepend=0) + 1
    ids = np.full(len(starts) + len(texts), END, dtype=np.uint64)
    word = np.ones(len(ids), dtype=bool)
    word[np.cumsum(lengths) - 1] = False
    ids[word] = _word_ids(raw, starts, ends)
    return ids, lengths


def joined(ctx: np.ndarray, par: np.ndarray) -> np.ndarray:
    """Ids of the sequences that ``par``, the same without the first word, ends."""
    return mix(ctx * np.uint64(3) + par)


def _sequences(ids: np.ndarray, lengths: np.ndarray, depth: int):
    """For each symbol with ``depth`` words before it in its text: its place, the id of these
    words, and that of the words but the first with the symbol."""
    if not depth:
        return np.arange(len(ids)), ids, ids
    first = np.cumsum(lengths) - lengths
    far = np.ones(len(ids), dtype=bool)
    for d in range(depth):
        far[first[lengths > d] + d] = False
    made = ids
    for _ in range(depth - 1):
        made = np.concatenate([made[:1], joined(made[:-1], made[1:])])
    return np.flatnonzero(far), made[:-1][far[1:]], made[far]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _share(key: np.ndarray, buckets: int, shares: int) -> np.ndarray:
    """Which of so many equal ranges inside its bucket holds each key."""
    inside = ((key >> np.uint64(32)) * np.uint64(buckets)) & _LOW
    return ((inside * np.uint64(shares)) >> np.uint64(32)).astype(np.int64)


def _among(ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Whether each id is in ``hot``, which ascends."""
    if not len(hot):
        return np.zeros(len(ids), dtype=bool)
    return hot[np.minimum(np.searchsorted(hot, ids), len(hot) - 1)] == ids


def _keyed(ctx: np.ndarray, par: np.ndarray, depth: int, hot: np.ndarray):
    """Ids of the sequences, and keys that order them: the upper half, which tells the bucket,
    is the context's, or where that is spread the sequence's own; the lower half is its own."""
    if not depth:
        return par, par
    gram = joined(ctx, par)
    upper = np.where(_among(ctx, hot), gram, ctx) if len(hot) else ctx
    return gram, (upper & ~_LOW) | (gram & _LOW)


def _order(key: np.ndarray) -> np.ndarray:
    """The order of a stable sort.  Keys are sorted together with their places, which numpy
    does much faster than it finds an order; the few whose lowest bits had to give way to the
    places are then put right."""
    if len(key) < 2:
        return np.arange(len(key))
    least, bits = key.min(), (len(key) - 1).bit_length()
    lost = max(0, int(key.max() - least).bit_length() + bits - 64)
    made = key - least
    made >>= np.uint64(lost)
    made <<= np.uint64(bits)
    made |= np.arange(len(key), dtype=np.uint64)
    made.sort()
    order = (made & np.uint64((1 << bits) - 1)).astype(np.int64)
    if lost:
        k = key[order]
        wrong = np.flatnonzero(k[1:] < k[:-1])
        if len(wrong):
            made >>= np.uint64(bits)
            of = np.cumsum(np.concatenate([[False], made[1:] != made[:-1]]), dtype=np.int32)
            mixed = np.zeros(of[-1] + 1, dtype=bool)
            mixed[of[wrong]] = True
            at = np.flatnonzero(mixed[of])
            order[at] = order[at][np.argsort(k[at], kind="stable")]
    return order


def _ordered(gram: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order by key in which equal sequences are neighbours, also where keys are equal by
    chance."""
    order = _order(key)
    g, k = gram[order], key[order]
    mixed = np.flatnonzero((k[1:] == k[:-1]) & (g[1:] != g[:-1]))
    if len(mixed):
        at = np.flatnonzero(np.isin(k, np.unique(k[mixed])))
        order[at] = order[at][np.lexsort((g[at], k[at]))]
    return order


def _steps(a: np.ndarray) -> bytes:
    """Differences of neighbours, small and alike where ``a`` ascends, so that they compress."""
    return np.diff(a, prepend=a.dtype.type(0)).tobytes()


def _from_steps(steps: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, dtype=kind), dtype=kind)


def _in_batches(rows, kinds, names):
    """Arrow batches of rows with blobs, each of about ``BATCH_BYTES``."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*held), kinds)], names=names)


def _starts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)


def _filter_bits(size: int):
    """Task: the part of a bit array that the ids of this partition set."""
    import pyarrow as pa

    def run(batches):
        bits: dict = {}
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            at = (ids & np.uint64(size - 1)).astype(np.int64)
            for slot in np.unique(at * 64 // size).tolist():
                mine = at[at * 64 // size == slot] - slot * (size // 64)
                bits.setdefault(slot, np.zeros(size // 64, dtype=bool))[mine] = True
        if bits:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(bits), type=pa.int32()), pa.array([np.packbits(b).tobytes() for b in bits.values()])],
                names=["slot", "bits"],
            )

    return run


def context_filter(ids: DataFrame) -> np.ndarray:
    """A bit array of bounded size, at least 32 times the number of ``ids`` while it can be:
    the bit at an id's low bits is set.  Each of 64 slices is made by one task."""
    n = ids.count()
    size = min(FILTER_BITS, 1 << max(10, (32 * n).bit_length()))
    low = F.col("id").bitwiseAND(F.lit(size - 1))
    slot = F.floor(low * 64 / size).cast("int")
    parts = ids.select("id").repartition(64, slot).mapInArrow(_filter_bits(size), "slot int, bits binary")
    made = np.zeros(size // 8, dtype=np.uint8)
    for r in parts.collect():
        made[r.slot * (size // 512) : (r.slot + 1) * (size // 512)] = np.frombuffer(r.bits, np.uint8)
    return made


def _may_be(made: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & np.uint64(len(made) * 8 - 1)
    byte = made[(at >> np.uint64(3)).astype(np.int64)]
    return (byte >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def _sender(depth: int, buckets: int, hot: np.ndarray, turn: int, turns: int, known):
    """Task: for each block of documents and bucket of this turn, the contexts, symbols, counts
    and the documents that hold them.  ``known``: the broadcast filter of contexts."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    names = ["bucket", "block", "ctx", "runs", "par", "n", "m", "docs"]

    def block_rows(block, texts, docs, train):
        ids, lengths = text_symbols(texts)
        if not depth:
            # How many symbols each document has, for the bucket that its block falls into.
            sizes = lengths.astype("<u4").tobytes()
            yield [block % buckets, block, b"", b"", b"", b"", sizes, _steps(np.array(docs, dtype=np.uint16))]
        at, ctx, par = _sequences(ids, lengths, depth)
        del ids
        if known is not None:
            may = _may_be(known.value, ctx)
            at, ctx, par = at[may], ctx[may], par[may]
        key = _keyed(ctx, par, depth, hot)[1]
        if turns > 1:
            now = _bucket(key, buckets) % turns == turn
            at, ctx, par, key = at[now], ctx[now], par[now], key[now]
        if not len(at):
            return
        # In the order of the texts where keys are equal, so that the documents ascend.
        order = _order(key)
        ctx, par, at, bucket = ctx[order], par[order], at[order], _bucket(key[order], buckets)
        del key, order
        new = (ctx[1:] != ctx[:-1]) | (par[1:] != par[:-1])
        start = np.flatnonzero(np.concatenate([[True], new]))
        doc = np.array(docs, dtype=np.uint16) * np.uint16(2) + np.array(train, dtype=np.uint16)
        doc = np.repeat(doc, lengths)[at]
        n = np.add.reduceat(doc & np.uint16(1), start, dtype=np.uint32)
        doc >>= np.uint16(1)
        ends = np.append(start, len(at))
        m = np.diff(ends)
        ctx, par, bucket = ctx[start], par[start], bucket[start]
        cut = np.append(_starts(bucket), len(bucket))
        for a, b in zip(cut[:-1], cut[1:]):
            run = _starts(ctx[a:b]) if depth else None
            yield [
                int(bucket[a]), block, ctx[a:b][run].tobytes() if depth else b"",
                np.diff(np.append(run, b - a)).astype("<u4").tobytes() if depth else b"", par[a:b].tobytes(),
                n[a:b].astype("<u4").tobytes(), m[a:b].astype("<u4").tobytes(),
                _steps(doc[ends[a] : ends[b]]),
            ]

    def run(batches):
        held, size, last = ([], [], []), 0, None

        def flush():
            yield from _in_batches(block_rows(last, *held), kinds, names)

        for batch in batches:
            block, doc, train, text = batch.columns
            for row in zip(block.to_pylist(), doc.to_pylist(), train.to_pylist(), text.to_pylist()):
                if held[0] and (row[0] != last or size > BLOCK_BYTES):
                    yield from flush()
                    held, size = ([], [], []), 0
                last = row[0]
                held[0].append(row[3])
                held[1].append(row[1])
                held[2].append(row[2])
                size += len(row[3])
        if held[0]:
            yield from flush()

    return run


def _counter(depth: int, buckets: int, least: int, spread: np.ndarray):
    """Task: the counts of a bucket's sequences, what each context has, and for each block the
    documents that hold the sequences that were kept.  What was sent is counted in slices, each
    a range of keys: a task holds the sent blobs and the arrays of one slice."""
    import pyarrow as pa

    names = [c.split()[0] for c in _COUNTED.split(", ")]
    kinds = [pa.int32()] * 2 + [pa.int64()] * 8 + [pa.binary()] * 3

    step = BATCH_BYTES // 64

    def batch(kind, p, rows, **columns):
        made = {"kind": np.full(rows, kind, np.int32), "p": np.full(rows, p, np.int32)}
        made |= {c: v.view(np.int64) for c, v in columns.items()}
        for low in range(0, rows, step):
            size = min(step, rows - low)
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[c][low : low + size], type=t) if c in made else pa.nulls(size, t) for c, t in zip(names, kinds)],
                names=names,
            )

    def run(batches):
        parts: dict = {}
        for one in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in one.columns)):
                parts.setdefault(bucket, []).append(row)
        for p in list(parts):
            yield from counted(p, parts.pop(p))

    def cut(row, slices):
        block, ctx, runs, par, n, m, docs = row
        par, n, m = (np.frombuffer(b, dtype=t) for b, t in ((par, "<u8"), (n, "<u4"), (m, "<u4")))
        ctx = np.repeat(np.frombuffer(ctx, dtype="<u8"), np.frombuffer(runs, dtype="<u4")) if depth else par
        docs = _from_steps(docs, "<u2")
        if slices == 1:
            return [(block, ctx, par, n, m, docs)]
        share = _share(_keyed(ctx, par, depth, spread)[1], buckets, slices)
        at = np.searchsorted(share, np.arange(slices + 1))
        held = np.append(0, np.cumsum(m, dtype=np.int64))[at]
        return [
            (block, ctx[a:b], par[a:b], n[a:b], m[a:b], docs[c:d])
            for a, b, c, d in zip(at[:-1], at[1:], held[:-1], held[1:])
        ]

    def counted(p, rows):
        if not depth:
            # Words have ids; what has none tells how many symbols the documents of a block have.
            sizes = ((r[0], np.frombuffer(r[5], dtype="<u4").astype("<f8"), _from_steps(r[6], "<u2")) for r in rows if not r[3])
            yield from _in_batches(
                ([_SIZE, p, *[None] * 7, block, None, m.tobytes(), docs.tobytes()] for block, m, docs in sizes), kinds, names
            )
            rows = [r for r in rows if r[3]]
        slices = 1 + sum(len(r[3]) for r in rows) // (8 * SLICE)
        rows = [cut(r, slices) for r in rows]
        lists: dict = {}
        before = 0
        for i in range(slices):
            mine = [r[i] for r in rows if len(r[i][2])]
            if mine:
                made, before = counted_slice(p, mine, lists, before)
                for one in made:
                    yield from one
        del rows
        found = ((block, *map(np.concatenate, zip(*got))) for block, got in lists.items())
        empty = [None] * 7
        yield from _in_batches(
            ([_LIST, p, *empty, block, _steps(entries), m.tobytes(), _steps(docs)] for block, entries, m, docs in found),
            kinds, names,
        )

    def counted_slice(p, rows, lists, before):
        """Batches of counts, and how many sequences were kept with the ``before`` ones."""
        ctx, par, n = (np.concatenate([r[j] for r in rows]) for j in (1, 2, 3))
        gram, key = _keyed(ctx, par, depth, spread)
        order = _ordered(gram, key)
        start = _starts(gram[order])
        which = np.empty(len(gram), dtype=np.int32)
        which[order] = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(gram))))
        total = np.add.reduceat(n[order], start, dtype=np.int64)
        pick = order[start]
        ctx, par, gram = ctx[pick], par[pick], gram[pick]
        del key, order, pick, n
        made = []
        if depth:
            by = _order(ctx)
            first = _starts(ctx[by])
            of = np.empty(len(ctx), dtype=np.int64)
            of[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ctx))))
            sums = [
                np.add.reduceat(v[by].astype(np.int64), first)
                for v in (total, total >= 1, total == 1, total == 2)
            ]
            home = ctx[by][first]
            # Contexts that are spread over the buckets have a share of their count here.
            enough = (sums[0] >= least) | _among(home, spread)
            keep = (total >= 2) & enough[of]
            made.append(batch(
                _STAT, p, int(enough.sum()), ctx=home[enough],
                **{c: v[enough] for c, v in zip(("n", "k", "n1", "n2"), sums)},
            ))
        else:
            keep = total >= 1
        rank = np.cumsum(keep) - 1 + before
        both = {"ctx": ctx[keep], "par": par[keep]} if depth else {}
        made.append(batch(_GRAM, p, int(keep.sum()), id=gram[keep], n=total[keep], k=rank[keep], **both))
        at = 0
        for block, _, _, _, m, docs in rows:
            w = which[at : at + len(m)]
            at += len(m)
            ok = keep[w]
            if ok.any():
                lists.setdefault(block, []).append((rank[w[ok]].astype("<u4"), m[ok], docs[np.repeat(ok, m)]))
        return made, before + int(keep.sum())

    return run


def _summer(values, lists):
    """Sums of a bucket's values over the documents of each block."""
    import pyarrow as pa

    rank = values.column("k").to_numpy()
    size = int(rank.max()) + 1 if len(rank) else 0
    table = {}
    for name in ("score", "base", "known"):
        table[name] = np.zeros(size)
        if name in values.column_names:
            table[name][rank] = values.column(name).to_numpy()
        elif "base" in values.column_names:
            table[name][rank] = 1  # words that are in the tree
    used = [v.any() for v in table.values()]
    out: dict = {c.split()[0]: [] for c in _SUMS.split(", ")}
    for block, entries, m, docs in zip(*(lists.column(c).to_pylist() for c in ("block", "entries", "m", "docs"))):
        entries, m = _from_steps(entries, "<u4"), np.frombuffer(m, dtype="<u4")
        docs = _from_steps(docs, "<u2")
        good = entries < size
        entries, docs, m = entries[good], docs[np.repeat(good, m)], m[good]
        entry = np.repeat(entries, m)
        sums = [
            np.bincount(docs, weights=v[entry], minlength=BLOCK_DOCS) if some else np.zeros(BLOCK_DOCS)
            for v, some in zip(table.values(), used)
        ]
        some = np.flatnonzero((sums[0] != 0) | (sums[2] != 0))
        if not len(some):
            continue
        out["block"].append(block)
        out["docs"].append(some.astype("<u2").tobytes())
        for name, v in zip(table, sums):
            out[name].append(v[some].tobytes() if v.any() else b"")
    kinds = [pa.int64()] + [pa.binary()] * 4
    return pa.table([pa.array(v, type=t) for v, t in zip(out.values(), kinds)], names=list(out))


def _adder(batches):
    """Task: the sums of each document, from those of all buckets and depths."""
    import pyarrow as pa

    total: dict = {}
    for batch in batches:
        for block, docs, *sums in zip(*(c.to_pylist() for c in batch.columns)):
            docs = np.frombuffer(docs, dtype="<u2")
            into = total.setdefault(block, np.zeros((4, BLOCK_DOCS)))
            for row, s in zip(into, sums):
                if s:
                    row[docs] += np.frombuffer(s, dtype="<f8")
    for block, sums in total.items():
        some = np.flatnonzero(sums.any(axis=0)).astype(np.int32)
        columns = [np.full(len(some), block), some, *(s[some] for s in sums)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["block", "doc", "score", "base", "known", "symbols"]
        )


class _Counted(NamedTuple):
    """Tables of one depth: counts of sequences, of contexts, and which documents hold them; of
    depth zero, how many symbols the documents have."""

    grams: DataFrame
    stats: DataFrame
    lists: DataFrame
    sizes: DataFrame | None = None


class SuffixTree:
    """The states of a tree learned from the rows of ``docs`` that are not ``held_out``, and the
    scores of all rows."""

    def __init__(self, docs: DataFrame, scratch: Scratch, depth: int, least: int, scan: bool):
        self.scratch, self.depth, self.least = scratch, depth, least
        spark = docs.sparkSession
        small_batches(spark)
        # Blobs make rows large: without it a batch holds all that a bucket gets.
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        text = text_or_empty()
        crc = F.crc32(F.col("doc_id").cast("string")) % 5
        wanted = [F.col("doc_id").cast("long"), F.coalesce(crc == 1, F.lit(False)).alias("held_out")]
        rows = docs.select(*wanted, text.alias("text"))
        place = F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")
        # Every row needs a place that stays the same each time the texts are read.
        rows = docs.select(*wanted, text.alias("text"), *place) if scan else (
            scratch.write(rows, "docs").select("*", *place)
        )
        self.docs = rows.select(
            "doc_id", "held_out", "text",
            F.xxhash64("_path", F.floor(F.col("_row") / BLOCK_DOCS)).alias("block"),
            (F.col("_row") % BLOCK_DOCS).cast("int").alias("doc"),
        )

    def _counted(self, depth: int, hot: np.ndarray, known=None) -> _Counted:
        source = self.docs.select(
            "block", "doc", (~F.col("held_out")).alias("train"), F.col("text").cast("binary").alias("text")
        )
        turns, task, made = (PARTS if depth in (1, 2) else 1), _counter(depth, self.buckets, self.least, hot), None
        for turn in range(turns):
            send = _sender(depth, self.buckets, hot, turn, turns, known)
            sent = source.mapInArrow(send, _SENT)
            mine = sent.repartitionById(-(-self.buckets // turns), F.expr(f"bucket div {turns}").cast("int"))
            mine = self.scratch.write(mine.mapInArrow(task, _COUNTED), f"counted-{depth}", by="kind")
            kinds = (_GRAM, _STAT, _LIST) if depth else (_GRAM, _STAT, _LIST, _SIZE)
            parts = [self.scratch.part(mine, "kind", k) for k in kinds]
            made = parts if made is None else [a.union(b) for a, b in zip(made, parts)]
        return _Counted(*made)

    def _hot(self, grams: DataFrame, tokens: int) -> np.ndarray:
        """Contexts that occur so often that there can't be more than ``SPREAD`` of them."""
        heavy = grams.where((F.col("n") * SPREAD > tokens) & (F.col("n") >= self.least)).select("id").collect()
        return np.sort(np.array([r.id for r in heavy], dtype=np.int64).view(np.uint64))

    def scores(self) -> DataFrame:
        """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
        ``score`` of every row."""
        scratch, d = self.scratch, F.lit(DISCOUNT)
        counted = self._counted(0, np.zeros(0, dtype=np.uint64))
        words, sizes = counted.grams, counted.sizes
        size = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        tokens, below = size[0], size[0] + 0.5 * (size[1] + 1)
        # prob: in the tree so far; g: what it adds to the score that the shorter context gives.
        prob = (F.col("n") + 0.5) / below
        grams = words.select("p", "id", "n", "k", prob.alias("prob"), F.log10(prob).alias("g"))
        hot, states, sums = self._hot(words, tokens), None, []
        for depth in range(1, self.depth + 2):
            found = following = next_grams = None
            if depth <= self.depth:
                may, known = self._contexts(grams, states), None
                if depth > 1:
                    known = self.docs.sparkSession.sparkContext.broadcast(context_filter(may))
                following = self._counted(depth, hot, known)
                hot = self._hot(following.grams, tokens)
                found, next_grams = self._grown(following, grams, may, d, depth)
            sums.append(self._summed(counted.lists, grams, found, depth == 1))
            scratch.drop(counted.lists, grams, *([states] if states is not None else []))
            counted, grams, states = following, next_grams, found
        return self._result(sums, sizes, tokens, below)

    def _contexts(self, grams: DataFrame, states) -> DataFrame:
        """The sequences that are examined as contexts: often enough, the suffix a state."""
        may = grams.where(F.col("n") >= self.least)
        if states is not None:
            may = may.join(states.select(F.col("id").alias("par")), "par", "left_semi")
        return self.scratch.write(may.select("id"), "contexts")

    def _grown(self, counted: _Counted, shorter: DataFrame, may: DataFrame, d, depth: int):
        """The states of this depth (``id``, ``lam``) and their symbols."""
        scratch = self.scratch
        share = counted.stats.groupBy("ctx").agg(
            *[F.sum(c).alias(c) for c in ("n", "k", "n1", "n2")]
        )
        lam = ((F.col("k") - F.col("n1")) * d + F.col("n1")) / F.col("n")
        stats = share.where(F.col("n") >= self.least).join(
            may.select(F.col("id").alias("ctx")), "ctx", "left_semi"
        )
        stats = lookup_table(
            stats.select("ctx", F.col("n").alias("big"), lam.alias("lam"), (F.col("n1") + 2 * F.col("n2")).alias("rare")),
            f"contexts-{depth}", scratch,
        )
        of_suffix = shorter.where("prob is not null").select(F.col("id").alias("par"), F.col("prob").alias("q"))
        grams = counted.grams.select("p", "id", "ctx", "par", "n", "k")
        # Contexts that came through the filter by chance have a suffix that is no state.
        grams = scratch.write(grams.join(of_suffix, "par"), f"symbols-{depth}")
        scratch.drop(counted.grams, counted.stats)
        n, big, q, lam = F.col("n"), F.col("big"), F.col("q"), F.col("lam")
        left_out = n * F.log(((n - 1 - d) / (big - 1) + lam * q) / q)
        often = grams.where("n >= 3").join(stats, "ctx")
        gains = often.groupBy("ctx").agg(F.sum(left_out).alias("gain"))
        # Without a symbol that comes three times there is nothing to gain.
        kept = stats.join(gains, "ctx").where(F.col("gain") + F.col("rare") * F.log("lam") > F.log("big"))
        kept = lookup_table(kept.select(F.col("ctx").alias("id"), "lam", "big"), f"states-{depth}", scratch)
        prob = (n - d) / big + lam * q
        mine = grams.join(kept.withColumnRenamed("id", "ctx"), "ctx", "left").select(
            "p", "id", "par", "n", "k", prob.alias("prob"),
            F.coalesce(F.log10(prob / (lam * q)), F.lit(0.0)).alias("g"),
        )
        # Symbols after a context that is no state add nothing, but may end a longer context.
        often = F.col("n") >= self.least
        mine = mine.where(F.col("prob").isNotNull() | often)
        mine = mine.withColumns({c: F.when(often, F.col(c)) for c in ("par", "n")})
        made = scratch.write(mine, f"tree-{depth}")
        scratch.drop(grams, stats, may)
        return kept, made

    def _summed(self, lists: DataFrame, grams: DataFrame, longer, first: bool) -> DataFrame:
        """What the symbols of one depth add to the scores of documents: their own term, and as
        contexts of the next depth the weight of what is not seen there."""
        weight = F.lit(0.0)
        if longer is not None:
            grams = grams.join(longer.select("id", F.log10("lam").alias("w")), "id", "left")
            weight = F.coalesce("w", F.lit(0.0))
        values = grams.select("p", "k", (F.col("g") + weight).alias("score"), *(["g"] if first else []))
        # Only the root's terms make up the score without a tree; later ones of zero add nothing.
        values = values.withColumnRenamed("g", "base") if first else values.where("score != 0")
        lists = lists.select(F.col("p").alias("at"), "block", "entries", "m", "docs")
        pairs = values.groupBy("p").cogroup(lists.groupBy("at"))
        return self.scratch.write(pairs.applyInArrow(_summer, _SUMS), "sums")

    def _result(self, sums: list[DataFrame], sizes: DataFrame, tokens: int, below: float) -> DataFrame:
        every = sizes.select("block", "docs", F.col("m").alias("symbols"))
        for more in sums:
            every = more.unionByName(every, allowMissingColumns=True)
        schema = "block long, doc int, score double, base double, known double, symbols double"
        added = every.repartition(self.buckets, "block").mapInArrow(_adder, schema)
        rows = self.docs.select("doc_id", "held_out", "block", "doc")
        made = rows.join(added, ["block", "doc"], "left").withColumn("n_tokens", F.col("symbols").cast("long"))
        known = F.coalesce(F.col("known"), F.lit(0.0)).cast("long")
        new = (F.col("n_tokens") - known) * F.log10(F.lit(0.5 / below))
        return made.select(
            "doc_id", "held_out", "n_tokens", known.alias("n_known"),
            F.lit(tokens).cast("long").alias("train_tokens"),
            (F.coalesce("base", F.lit(0.0)) + new).alias("base_score"),
            (F.coalesce("score", F.lit(0.0)) + new).alias("score"),
        )


def score_documents(
    docs: DataFrame,
    depth: int = DEPTH,
    least: int = LEAST,
    scan: bool = False,
    scratch: Scratch | None = None,
) -> DataFrame:
    """A row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score``.

    The tree learns from the documents whose crc32 of the id as text, modulo 5, is not 1; all
    are scored.  Texts are lower-cased in A-Z and cut at white space; the end is a symbol
    too, the only one of a null or empty text.  ``base_score`` is that of the root alone.  A
    row without ``doc_id`` is learned from.  Repeated rows stay repeated, and are learned from
    as often; an empty table gives no row; further columns are ignored.

    The texts are read once for each depth.  ``scan`` says that ``docs`` is a plain scan of
    Parquet files, whose rows keep their place; anything else is written to files first.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    return SuffixTree(docs, scratch, depth, least, scan).scores()
