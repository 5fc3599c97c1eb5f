"""Files that hold one JSON array each, read in byte ranges.

Where an element ends depends on everything before it: whether a byte stands in a string, and how deep in brackets. So a first pass sums up each range
for both cases (it starts in a string or not): whether it turns that around, and by how much it deepens. Running sums over the ranges of a file give the
state in which each starts, and a second pass cuts out the elements, each by the range that holds the border before it, reading on past its
end where an element does. Compressed files have no ranges; each is one stream of elements.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BYTES = 32 << 20
BLOCK = 1 << 20  # bytes read and scanned at once
TASKS_PER_CORE = 4
_DEEPER = np.zeros(256, np.int8)
_DEEPER[[ord("["), ord("{")]] = 1
_DEEPER[[ord("]"), ord("}")]] = -1
_STRUCTURE = _DEEPER != 0
_STRUCTURE[ord(",")] = True
_SPACE = b" \t\r\n"


@dataclass
class State:
    """Where a scan stands: whether an odd run of backslashes ends here, in a string (1) or not (0), and how many brackets are open."""

    odd: bool = False
    inside: int = 0
    depth: int = 0


def _quotes(block: np.ndarray, odd: bool) -> tuple[np.ndarray, bool]:
    """Places of the quotes that no backslash escapes, and whether the block ends in an odd run of backslashes."""
    slash = np.flatnonzero(np.diff(np.concatenate(([0], (block == 92).view(np.int8), [0]))))
    begin, end = slash[::2], slash[1::2]
    run = end - begin
    if odd and len(block):
        if len(begin) and begin[0] == 0:
            run[0] += 1
        else:
            begin, end, run = np.append(0, begin), np.append(0, end), np.append(1, run)
    single = run % 2 == 1
    quotes = np.flatnonzero(block == 34)
    quotes = quotes[~np.isin(quotes, end[single], assume_unique=True)]
    return quotes, (odd if not len(block) else bool(len(end)) and bool(end[-1] == len(block)) and bool(single[-1]))


def borders(block: np.ndarray, state: State) -> tuple[np.ndarray, np.ndarray]:
    """Places of the borders between elements in a block, with the depth behind each: 1 for the opening bracket and commas, 0 for the closing one. Moves the state on."""
    quotes, odd = _quotes(block, state.odd)
    places = np.flatnonzero(_STRUCTURE[block])
    places = places[(np.searchsorted(quotes, places) + state.inside) % 2 == 0]
    turn = _DEEPER[block[places]]
    depth = state.depth + np.cumsum(turn, dtype=np.int64)
    border = ((turn == 0) & (depth == 1)) | ((turn > 0) & (depth == 1)) | ((turn < 0) & (depth == 0))
    state.odd, state.inside = odd, (state.inside + len(quotes)) % 2
    if len(depth):
        state.depth = int(depth[-1])
        if depth.min() < 0:
            raise ValueError("more brackets are closed than opened")
    return places[border], depth[border]


def summary(block: np.ndarray, odd: bool) -> tuple[int, int, int, bool]:
    """Of a block: the quotes' parity, how much it deepens if it starts outside a string, and inside one, and whether it ends in an odd run of backslashes."""
    quotes, odd = _quotes(block, odd)
    places = np.flatnonzero(_DEEPER[block])
    turn, within = _DEEPER[block[places]].astype(np.int64), np.searchsorted(quotes, places) % 2
    return len(quotes) % 2, int(turn[within == 0].sum()), int(turn[within == 1].sum()), odd


def _open(path: str) -> pa.NativeFile:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _ends_odd(file: pa.NativeFile, end: int) -> bool:
    """Whether an odd run of backslashes ends before the place ``end``."""
    run = 0
    while end:
        size = min(end, 4096)
        block = file.read_at(size, end - size)
        here = size - len(block.rstrip(b"\\"))
        run, end = run + here, end - size
        if here < size:
            break
    return run % 2 == 1


def _blocks(file: pa.NativeFile, at: int, size: int) -> Iterator[bytes]:
    while at < size:
        block = file.read_at(min(BLOCK, size - at), at)
        if not block:
            return
        yield block
        at += len(block)


def _inflated(file: pa.NativeFile) -> Iterator[bytes]:
    """The blocks of a gzip file, of all its members."""
    unpack, given = zlib.decompressobj(31), b""
    while True:
        given = given or file.read(BLOCK)
        if not given:
            break
        block = unpack.decompress(given, BLOCK)
        given = unpack.unconsumed_tail
        if unpack.eof:
            given, unpack = unpack.unused_data, zlib.decompressobj(31)
        if block:
            yield block


def elements(blocks: Iterator[bytes], state: State, at: int, end: int | None, path: str) -> Iterator[tuple[int, bytes]]:
    """Place and text of each element whose opening border lies before ``end``, from blocks that begin at the place ``at`` in the given state.

    Without ``end`` the blocks reach to the end of the file, where the array must be closed.
    """
    part, since, first = [], None, at == 0
    for block in blocks:
        found, depth = borders(np.frombuffer(block, np.uint8), state)
        if first and block.strip(_SPACE):
            first = False
            if not block.lstrip(_SPACE).startswith(b"["):
                raise ValueError(f"{path} does not hold a JSON array")
        from_here = 0
        for place, behind in zip(found.tolist(), depth.tolist()):
            if since is not None:
                part.append(block[from_here:place])
                text = b"".join(part).strip(_SPACE)
                if text:
                    yield since, text
                part = []
            if end is not None and at + place >= end:
                return
            since, from_here = (at + place + 1 if behind else None), place + 1
        if since is not None:
            part.append(block[from_here:])
        at += len(block)
        if end is not None and at >= end and since is None and not first:
            return
    if first:
        raise ValueError(f"{path} does not hold a JSON array")
    if since is not None or (end is None and (state.depth or state.inside)):
        raise ValueError(f"{path} ends within its array")


_RANGE = "path string, start bigint, end bigint, size bigint, packed boolean"


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """A row for each range of each file. Only names and sizes are read here."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    packed = F.col("path").endswith(".gz")
    step = F.when(packed, F.greatest("size", F.lit(1))).otherwise(F.lit(range_bytes)).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0).cast("bigint")), step)
    rows = files.select("path", F.explode(starts).alias("start"), step.alias("step"), "size", packed.alias("packed"))
    return rows.select("path", "start", F.least(F.col("start") + F.col("step"), F.col("size")).alias("end"), "size", "packed")


def _tasks(ranges: DataFrame) -> int:
    """As many tasks as there are ranges, up to what keeps all cores busy, and more where a task would get more than ``RANGE_BYTES``."""
    count, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()
    return max(1, min(count, max(-(-size // RANGE_BYTES), TASKS_PER_CORE * ranges.sparkSession.sparkContext.defaultParallelism)))


def _dealt(ranges: DataFrame, tasks: int) -> DataFrame:
    return ranges.repartition(tasks, "path", "start")


def read_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, at, value: every element of the arrays in the files of ``path`` (a file, folder or pattern), with its file and place of its text there.

    Plain files are read in ranges of ``range_bytes``, ``.gz`` files whole, several small ranges by one task; an element may be longer than a range. An empty array has no
    element, nor has a file of no bytes. A file that holds no array, or ends within one, is an error. The place is a byte of the (unpacked) file, so places give the array's order.
    """
    ranges = _ranges(spark, path, range_bytes)
    tasks = _tasks(ranges)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                turns, outside, within = 0, 0, 0
                if not row["packed"]:
                    with _open(row["path"]) as file:
                        odd = _ends_odd(file, row["start"])
                        for block in _blocks(file, row["start"], row["end"]):
                            turn, straight, turned, odd = summary(np.frombuffer(block, np.uint8), odd)
                            outside, within = (outside + turned, within + straight) if turns else (outside + straight, within + turned)
                            turns ^= turn
                yield pa.RecordBatch.from_pylist([{**row, "turns": turns, "outside": outside, "within": within}], pa.schema(
                    [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("size", pa.int64()), ("packed", pa.bool_()),
                     ("turns", pa.int64()), ("outside", pa.int64()), ("within", pa.int64())]))

    # a row for each range, as many as a scan of the same files would have splits
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    summed = _dealt(ranges, tasks).mapInArrow(sum_up, _RANGE + ", turns bigint, outside bigint, within bigint")
    states = summed.withColumn("inside", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2)
    states = states.withColumn("deeper", F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within")))
    states = states.withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as file:
                    if row["packed"]:
                        found = elements(_inflated(file), State(), 0, None, row["path"])
                    else:
                        state = State(_ends_odd(file, row["start"]), row["inside"], row["depth"])
                        end = row["end"] if row["end"] < row["size"] else None
                        found = elements(_blocks(file, row["start"], row["size"]), state, row["start"], end, row["path"])
                    places, texts, weight = [], [], 0
                    for place, text in found:
                        places.append(place)
                        texts.append(text.decode("utf-8"))
                        weight += len(text)
                        if weight >= BLOCK:
                            yield _batch(row["path"], places, texts)
                            places, texts, weight = [], [], 0
                    if places:
                        yield _batch(row["path"], places, texts)

    return _dealt(states.select("path", "start", "end", "size", "packed", "inside", "depth"), tasks).mapInArrow(cut, "path string, at bigint, value string")


def _batch(path: str, places: list[int], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["path", "at", "value"])


def read_array(spark: SparkSession, path: str, schema: T.StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements as rows of ``schema``; one that does not parse is an error."""
    parsed = read_elements(spark, path, range_bytes).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))
    return parsed.select("row.*")
