"""Op 8. Near duplicates by BagMinHash: signatures of multisets of word shingles, then bands, then exact multiset overlap.

The weight of a shingle is its count, cut into intervals [0,1), [1,2), [2,4), [4,8), ... Each interval is a Poisson process of its own, whose rate is its
length: a point has a time, a component of the signature, and a place in the interval, and counts for a document if its place is below the document's
count. A component's value is the point that comes first. So two documents agree in a component with the chance of their weighted Jaccard
similarity, and a point later than the latest first one is never made. Documents that agree in a band become candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_type, documents, held, in_parts, map_rows, with_ids, without_ids
from factloom.llm.components import components
from factloom.session import stored

SIZE, ROWS, WORDS, SIMILARITY = 120, 5, 5, 0.8
GROUP_DOCS, GROUP_SHINGLES = 400, 2_000_000
_M1, _M2, _GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """A word's 64-bit hash; emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of all runs of ``words`` words (lower case, cut at white space), with repeats. A shorter text is one run; one without a word has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(held("words", Words).__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        out = mix(out * _GOLD + h[k:k + n])
    return np.sort(out)


def _counted(sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]))
    return sorted_hashes[first], np.diff(np.append(first, len(sorted_hashes)))


def signatures(bags: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """One row of ``size`` 64-bit values for each non-empty bag of sorted hashes."""
    out = np.zeros((len(bags), size), np.uint64)
    best = np.full((len(bags), size), np.inf)
    docs, items, counts, starts, rates = [], [], [], [], []
    for d, bag in enumerate(bags):
        values, n = _counted(bag)
        level = 0
        while len(values):  # intervals [0,1), [1,2), [2,4), ...: an item takes part in those that begin below its count
            low = 0 if level == 0 else 1 << (level - 1)
            values, n = values[n > low], n[n > low]
            docs.append(np.full(len(values), d)), items.append(mix(values + np.uint64(level * int(_GOLD) & (1 << 64) - 1))), counts.append(n)
            starts.append(np.full(len(values), low)), rates.append(np.full(len(values), max(low, 1)))
            level += 1
    if not docs:
        return out
    doc, state, count = np.concatenate(docs), np.concatenate(items), np.concatenate(counts)
    start, rate = np.concatenate(starts), np.concatenate(rates).astype(np.float64)
    weight = np.array([max(len(b), 1) for b in bags], np.float64)
    limit = size / weight * (np.log(size) + 3.0)  # by then nearly every component has had its first point
    time = np.zeros(len(doc))
    active = np.arange(len(doc))
    waiting: list[np.ndarray] = []
    while True:
        while len(active):
            state[active] = mix(state[active] + _GOLD)
            s = state[active]
            time[active] -= np.log(((s >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53) / rate[active]
            late = time[active] > limit[doc[active]]
            if late.any():
                waiting.append(active[late])  # its next point is known; it counts only if the document needs more time
                active, s = active[~late], s[~late]
            _take(active, s, doc, state, time, start, rate, count, best, out, size)
        open_ = np.isinf(best).any(axis=1) & (np.bincount(doc, minlength=len(bags)) > 0)
        held = np.concatenate(waiting) if waiting else np.zeros(0, int)
        held = held[open_[doc[held]]]
        if not len(held):
            return out
        limit[open_] *= 2
        waiting = []
        ready = held[time[held] <= limit[doc[held]]]
        waiting.append(held[time[held] > limit[doc[held]]])
        _take(ready, state[ready], doc, state, time, start, rate, count, best, out, size)
        active = ready


def _take(points, s, doc, state, time, start, rate, count, best, out, size) -> None:
    """Enter the current point of each process into its document's signature, if its place is below the item's count."""
    if not len(points):
        return
    u = mix(s ^ _M2)
    component = (u % np.uint64(size)).astype(np.int64)
    place = start[points] + np.floor(((u >> np.uint64(32)).astype(np.float64) / 2.0 ** 32) * rate[points])
    inside = place < count[points]
    d, c, t, v = doc[points][inside], component[inside], time[points][inside], s[inside]
    order = np.lexsort((v, t))[::-1]  # the earliest is written last and stays
    d, c, t, v = d[order], c[order], t[order], v[order]
    first = np.full(best.shape, np.inf)
    value = np.zeros(best.shape, np.uint64)
    first[d, c], value[d, c] = t, v
    better = first < best
    best[better], out[better] = first[better], value[better]


def sketch(batch: pa.RecordBatch, rows: int = ROWS, size: int = SIZE) -> dict[str, list]:
    """doc_id, the digest of the whole bag, its size, and a key for each band."""
    import xxhash

    ids, kept, bags, digests = batch.column("doc_id").to_pylist(), [], [], []
    bands: list = []
    for doc, text in zip(ids, batch.column("text").to_pylist()):
        bag = shingles(text)
        if doc is not None and len(bag):
            kept.append(doc)
            bags.append(bag)
            digests.append(xxhash.xxh3_128_digest(bag.tobytes()))
    at = 0
    while at < len(bags):  # so many bags at a time that their processes fit in some tens of MB
        stop, total = at, 0
        while stop < len(bags) and (stop == at or total + len(bags[stop]) < 150_000 and stop - at < 256):
            total += len(bags[stop])
            stop += 1
        found = signatures(bags[at:stop], size).reshape(stop - at, size // rows, rows)
        key = np.full(found.shape[:2], 0, np.uint64) + np.arange(found.shape[1], dtype=np.uint64)
        for k in range(rows):
            key = mix(key * _GOLD + found[:, :, k])
        bands += key.view(np.int64).tolist()
        at = stop
    return {"doc_id": kept, "digest": digests, "n": [len(b) for b in bags], "bands": bands}


def sketches(batch: pa.RecordBatch) -> dict[str, list]:
    """``sketch`` of a batch, a few texts at a time."""
    out: dict[str, list] = {"doc_id": [], "digest": [], "n": [], "bands": []}
    for part in in_parts(batch):
        for name, values in sketch(part).items():
            out[name] += values
    return out


def _units(bag: np.ndarray) -> np.ndarray:
    """The bag as a set: the j-th copy of an item is an item of its own, so that set overlap is multiset overlap."""
    values, n = _counted(bag)
    if len(values) == len(bag):
        return bag
    copy = np.arange(len(bag)) - np.repeat(np.cumsum(n) - n, n)
    return np.where(copy > 0, mix(bag + copy.astype(np.uint64) * _GOLD), bag)


def similar_pairs(bags: list[np.ndarray], similarity: float = SIMILARITY, columns: int = 4096) -> np.ndarray:
    """All pairs (i, j), i < j, of bags with a weighted Jaccard similarity of at least ``similarity``."""
    units = [_units(b) for b in bags]
    sizes = np.array([len(u) for u in units])
    if len(units) == 2:
        shared = len(np.intersect1d(units[0], units[1]))
        return np.array([[0, 1]]) if shared >= similarity * (sizes.sum() - shared) - 1e-9 else np.zeros((0, 2), int)
    items = np.concatenate(units)
    owner = np.repeat(np.arange(len(units)), sizes)
    _, place, many = np.unique(items, return_inverse=True, return_counts=True)
    keep = many[place] > 1
    column = np.full(len(many), -1)
    column[many > 1] = np.arange((many > 1).sum())
    column, owner = column[place[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((len(units), len(units)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [low, low + columns])
        block = np.zeros((len(units), columns), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        shared += block @ block.T
    total = sizes[:, None] + sizes[None, :] - shared
    return np.argwhere(np.triu(shared >= similarity * total - 1e-4, 1))


def _forest(ids: list[int], pairs: np.ndarray) -> list[tuple[int, int]]:
    """As few of the pairs as join the same documents."""
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in pairs:
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((ids[max(i, j)], ids[min(i, j)]))
    return out


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come by group; a group's links are worked out when it is complete."""
    schema = arrow_type("a bigint, b bigint")
    here, ids, bags = None, [], []

    def links() -> pa.RecordBatch:
        found = _forest(ids, similar_pairs(bags, similarity)) if len(ids) > 1 else []
        return pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=schema)

    for batch in (part for whole in batches for part in in_parts(whole)):
        for group, tile, doc, text in zip(*(batch.column(c).to_pylist() for c in ("root", "tile", "doc_id", "text"))):
            if (group, tile) != here:
                if len(ids) > 1:
                    yield links()
                here, ids, bags = (group, tile), [], []
            ids.append(doc)
            bags.append(shingles(text))
    if len(ids) > 1:
        yield links()


def classes(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, group_id, one row for each row of ``df`` with an id.

    ``class_id`` is the smallest id among documents with the same bag of five-word shingles, ``group_id`` the smallest id among all documents joined by
    links, a link being a weighted Jaccard similarity of at least ``similarity`` of two bags. A text of fewer than five words is one shingle, so it equals its exact copies only; texts without a
    word, null ones included, stay alone. Rows with a null id are left out, rows repeated under one id count once if equal.

    Copies are reduced to one representative before anything else. Its bands point to the smallest id in their bucket, one row each; the components of
    those rows are the groups to verify. A group is verified all against all in one task if small; a large one is dealt by size classes (bags whose sizes differ by more than
    the similarity allows cannot be linked) and into tiles of bounded size, each pair of tiles in a task of its own. A tile returns only as many links as
    it joins documents. Banding misses a link at 0.8 with a chance under one in ten thousand for one pair; links inside a group are exact.
    """
    docs = documents(df, id_col, text_col)
    drawn = stored(map_rows(docs, "doc_id bigint, digest binary, n bigint, bands array<bigint>", sketches), "sketches")
    first = stored(drawn.groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    reps = drawn.join(first, (drawn["digest"] == first["digest"]) & (drawn["doc_id"] == first["class_id"])).select("doc_id", "n", "bands").dropDuplicates(["doc_id"])
    banded = reps.select("doc_id", "n", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("doc_id").alias("b"), F.count("*").alias("many")).filter("many > 1")
    edges = banded.join(least, "band").filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    grouped = components(edges)
    sized = grouped.join(reps.select(F.col("doc_id").alias("node"), "n"), "node")
    # bags of one link differ in size by the factor ``similarity`` at most: they are in the same class of sizes or in neighbouring ones
    sized = stored(sized.withColumn("size", F.floor(F.log(F.col("n")) / F.lit(float(-np.log(similarity))) + 1e-9).cast("int")), "groups")
    totals = sized.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    by_size = sized.groupBy("root", "size").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    parts = F.ceil(F.greatest(F.col("docs") / (GROUP_DOCS // 2), F.col("shingles") / (GROUP_SHINGLES // 2))).cast("int")
    small = (F.col("docs") <= GROUP_DOCS) & (F.col("shingles") <= GROUP_SHINGLES)
    one = sized.join(totals.filter(small), "root").select("node", "root", F.lit("").alias("tile"))
    cut = by_size.join(totals.filter(~small).select("root"), "root").select("root", "size", parts.alias("parts"))
    above = cut.select("root", (F.col("size") - 1).alias("size"), F.col("parts").alias("above"))
    under = cut.select("root", (F.col("size") + 1).alias("size"), F.col("parts").alias("under"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    many = (sized.join(cut, ["root", "size"]).join(above, ["root", "size"], "left").join(under, ["root", "size"], "left").withColumn("own", own))

    def name(size, a, other, b):
        return F.concat_ws("/", size.cast("string"), a.cast("string"), other.cast("string"), b.cast("string"))

    none = F.array().cast("array<string>")
    s, o = F.col("size"), F.col("own")
    same = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: name(s, F.least(o, k), s, F.greatest(o, k)))
    up = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda k: name(s, o, s + 1, k))).otherwise(none)
    down = F.when(F.col("under").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("under") - 1), lambda k: name(s - 1, k, s, o))).otherwise(none)
    tiles = stored(one.union(many.select("node", "root", F.explode(F.concat(same, up, down)).alias("tile"))), "tiles")
    needed = with_ids(docs, "doc_id", sized.select("node")).dropDuplicates(["doc_id"])
    gathered = tiles.join(needed, tiles["node"] == needed["doc_id"]).select("root", "tile", "doc_id", "text")
    links = gathered.repartition("root", "tile").sortWithinPartitions("root", "tile", "doc_id").mapInArrow(partial(_verify, similarity=similarity), "a bigint, b bigint")
    joined = components(links)
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    member = drawn.select("doc_id", "digest").join(first, "digest").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = ids.join(member, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return (out.join(joined, out["class_id"] == joined["node"], "left")
            .select("doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id")))


def keep_one(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group the smallest id stays, as it is; rows with a null id stay."""
    gone = stored(classes(df, similarity, id_col, text_col).filter("group_id <> doc_id").select("doc_id"), "gone")
    return without_ids(df, id_col, gone)
