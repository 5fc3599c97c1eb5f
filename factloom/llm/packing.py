"""Op 5. Best-fit packing by a grouping genetic algorithm on islands.

A chromosome is a packing, its genes are whole sequences ("bins"). Crossover injects well-filled bins of one parent into the
other, removes the bins that hold an injected piece a second time, and best-fits the pieces that lost their bin. Each
island is a bounded number of pieces in one task. After each round the well-filled bins are final; the others migrate:
they are dealt, whole, to fewer islands, where they form the first parent, so good partial bins compete with fresh ones.

Pieces are dealt to islands by hash, or, where their order counts, by their place in it: then an island is a stretch of that order.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import arrow_type, documents, in_parts, map_rows
from factloom.llm.tokens import encoder
from factloom.session import stored

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACE = "place bigint"
OPEN = "uid bigint, length bigint, bin bigint"
PLACED = "uid bigint, sequence_id bigint, offset bigint, final boolean, length bigint, bin bigint"


def pieces(df: DataFrame, path: str, pieces_of: str | None = "bytes", end: int = 0, capacity: int = 2048,
           id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None, keep: int = 450_000) -> DataFrame:
    """The pieces of each document: ids plus ``end``, cut only where longer than ``capacity``; then the first is the short one.

    With ``place_col`` each piece carries its document's ``place``. A worker keeps the ids of about ``keep`` to twice as many different words.
    """
    last = end.to_bytes(4, "little")
    placed = place_col is not None
    ddl, more = (f"{PIECE}, {PLACE}", [F.col(f"`{place_col}`").cast("bigint").alias("place")]) if placed else (PIECE, [])

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        rows: dict[str, list] = {name: [] for name in arrow_type(ddl).names}
        encode = encoder(path, pieces_of, keep).encode
        encoded = (row for part in in_parts(batch) for row in zip(
            part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), *([part.column("place").to_pylist()] if placed else [])))
        for doc, ids, *place in encoded:
            ids += last
            n, k, at = len(ids) // 4, 0, 0
            while at < n:
                stop = at + ((n - at) % capacity or capacity)
                for name, value in zip(rows, (doc, k, at, stop - at, zlib.crc32(ids[4 * at:4 * stop]), *place)):
                    rows[name].append(value)
                k, at = k + 1, stop
        return rows

    return map_rows(documents(df, id_col, text_col, *more), ddl, cut)


class _Bins:
    """Bins with best fit in constant time: the free room of open bins is a bit set over 0..capacity."""

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity, self.bins, self.room, self.mask = size, capacity, [], [[] for _ in range(capacity + 1)], 0

    def add(self, items: list[int]) -> None:
        free = self.capacity - sum(self.size[i] for i in items)
        self.bins.append((free, items))
        self.room[free].append(len(self.bins) - 1)
        self.mask |= 1 << free

    def fit(self, item: int) -> None:
        need = self.size[item]
        fitting = self.mask >> need
        if not fitting:
            self.add([item])
            return
        free = need + (fitting & -fitting).bit_length() - 1
        k = self.room[free].pop()
        if not self.room[free]:
            self.mask &= ~(1 << free)
        items = self.bins[k][1]
        items.append(item)
        self.bins[k] = (free - need, items)
        self.room[free - need].append(k)
        self.mask |= 1 << (free - need)

    def packing(self) -> list[list[int]]:
        return [items for _, items in self.bins]


def evolve(size: list[int], capacity: int, first: list[list[int]], seed: int, population: int = 4, generations: int = 12) -> list[list[int]]:
    """The best packing found of items 0..n-1 of the given sizes; ``first`` is a packing brought along, or empty."""
    rng = random.Random(seed)
    order = sorted(range(len(size)), key=lambda i: -size[i])

    def packed(items: list[int], kept: list[list[int]]) -> list[list[int]]:
        bins = _Bins(size, capacity)
        for b in kept:
            bins.add(list(b))
        for i in items:
            bins.fit(i)
        return bins.packing()

    def fill(b: list[int]) -> int:
        return sum(size[i] for i in b)

    def worth(p: list[list[int]]) -> tuple[int, float]:
        return -len(p), sum((fill(b) / capacity) ** 2 for b in p)

    bound = -(-sum(size) // capacity)
    alive = [packed(order, [])] + ([first] if first else [])
    while len(alive) < population:
        alive.append(packed(sorted(order, key=lambda i: -size[i] * rng.uniform(0.8, 1.0)), []))
    scored = sorted(((worth(p), p) for p in alive), key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if len(scored[0][1]) == bound:
            break
        mother, father = scored[0][1], rng.choice(scored[1:])[1]
        if rng.random() < 0.5:
            mother, father = father, mother
        good = sorted(father, key=fill, reverse=True)[:max(1, len(father) // 2)]
        injected = rng.sample(good, max(1, len(good) // 2))
        taken = {i for b in injected for i in b}
        kept, displaced = [list(b) for b in injected], []
        rest = [b for b in mother if taken.isdisjoint(b)]
        for b in mother:
            if not taken.isdisjoint(b):
                displaced += [i for i in b if i not in taken]
        weakest = sorted(rest, key=fill)[:max(1, len(rest) // 20)]  # mutation: the worst bins are opened again
        emptied = {id(b) for b in weakest}
        for b in rest:
            if id(b) in emptied:
                displaced += b
            else:
                kept.append(b)
        child = packed(sorted(displaced, key=lambda i: -size[i]), kept)
        scored = sorted([*scored, (worth(child), child)], key=lambda x: x[0], reverse=True)[:population]
    return scored[0][1]


def _islands(batches: Iterator[pa.RecordBatch], stage: int, capacity: int, last: bool, full: float, ordered: bool) -> Iterator[pa.RecordBatch]:
    rows: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("island", "uid", "length", "bin"))):
            rows.setdefault(row[0], []).append(row[1:])
    for island, items in rows.items():
        items.sort()
        size, brought = [x[1] for x in items], {}
        if stage:
            for i, x in enumerate(items):
                brought.setdefault(x[2], []).append(i)
        best = evolve(size, capacity, list(brought.values()), zlib.crc32(f"{stage}/{island}".encode()))
        out: dict[str, list] = {name: [] for name in ("uid", "sequence_id", "offset", "final", "length", "bin")}
        if ordered:  # ids are places, so a sequence is named by its first one, and its pieces keep their order
            best = [sorted(b) for b in best]
        for k, b in enumerate(sorted(best)):
            sequence, at = items[b[0]][0] if ordered else (stage << 58) | (island << 24) | k, 0
            final = last or sum(size[i] for i in b) >= full * capacity
            for i in b:
                for name, value in zip(out, (items[i][0], sequence, at, final, size[i], sequence)):
                    out[name].append(value)
                at += size[i]
        yield pa.RecordBatch.from_pydict(out, schema=arrow_type(PLACED))


def _in_order(parts: DataFrame) -> DataFrame:
    """``parts`` with a uid of 0, 1, ... in the order of (place, doc_id, piece): sorted ranges, whose totals are carried over."""
    ranged = stored(parts.repartitionByRange("place", "doc_id", "piece").sortWithinPartitions("place", "doc_id", "piece", "start", "length", "ids_crc32")
                    .withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", 33))
    rows = ranged.groupBy("part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))  # a row for each range
    carried = rows.select("part", "first", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("before"))
    return ranged.join(F.broadcast(carried), "part").withColumn("uid", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def pack(parts: DataFrame, capacity: int = 2048, island_rows: int = 2000, stages: int = 3, full: float = 0.998) -> DataFrame:
    """Adds sequence_id and offset to ``parts`` (rows with a length of 1 to ``capacity``; a piece is its own row, so repeated rows
    are packed as often as they occur). Sequences have no gap and hold at most ``capacity``. An empty table stays empty.

    ``parts`` must be stored: its rows get ids here that later rounds join on. Only (id, length, bin) rows travel between islands.

    Where ``parts`` has a column ``place``, that order counts: islands are stretches of it, pieces keep it within a sequence, and sequence ids
    follow it, a sequence having the number of its first piece. The first round's islands hold neighbours only; bins that are not full
    then meet those of neighbouring islands.
    """
    ordered = "place" in parts.columns
    numbered = stored(_in_order(stored(parts, "placed")) if ordered else parts.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    todo = numbered.select("uid", "length", F.col("uid").alias("bin"))
    done, total = None, numbered.count() if ordered else 0
    for stage in range(stages):
        n = max(1, -(-todo.count() // island_rows))
        last = stage + 1 == stages or n == 1
        island = F.floor(F.col("bin") * n / F.lit(max(total, 1))) if ordered else F.pmod(F.xxhash64("bin", F.lit(stage)), F.lit(n))
        dealt = todo.withColumn("island", island)
        placed = stored(dealt.repartition(min(n, 10_000), "island").mapInArrow(
            partial(_islands, stage=stage, capacity=capacity, last=last, full=full, ordered=ordered), PLACED), "islands")
        fixed = placed.filter("final").select("uid", "sequence_id", "offset")
        done = fixed if done is None else done.union(fixed)
        if last:
            break
        todo = placed.filter("not final").select("uid", "length", "bin")
    return numbered.join(done, "uid").drop("uid", "place")


def pack_documents(df: DataFrame, path: str, pieces_of: str | None = "bytes", end: int = 0, capacity: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None, keep: int = 450_000) -> DataFrame:
    """Encode and pack whole documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row for each piece.

    A null or empty text is one piece of the end token. Null ids and repeated rows are packed like any other row. With ``place_col`` the
    documents' order is kept as far as packing can: see ``pack``.
    """
    return pack(pieces(df, path, pieces_of, end, capacity, id_col, text_col, place_col, keep), capacity)
