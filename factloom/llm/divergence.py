"""Op 12. Source divergence audit by token-start pointer sort.

A shard of texts stays one buffer of bytes. Pointers to its word starts are sorted by the words with a multikey quicksort that takes eight bytes for a
letter: pointers are parted by their next eight bytes, and only runs that are still equal and go on are parted again. Pointers enter the sort in the
order of their source and document, so in each run of equal words those of a source stand together, and counting the changes of document gives the
document frequency. Runs of all shards are added up, and what each source says more often than its language is scored with the triangular
discrimination (p - q)^2 / (p + q) of smoothed shares in parts of a thousand million, all in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.arrowtext import WORD, keys, raw, slices, strings
from factloom.llm.common import arrow_type
from factloom.session import stored

SLICE = 8 << 20  # bytes of text sorted at once; a longer text is sorted by itself
DEPTH = 8  # after so many steps of eight bytes, what remains of equal words is compared as a whole
SHARD = 200_000  # (term, source) entries of a language that one task compares
BLOCK = 2_000_000  # shares held at once while sources are compared
PARTS = 1_000_000_000
RUNS = "lang string, source string, term string, n bigint, docs bigint"
PAIRS = "lang string, source string, item string, value bigint"


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word (letters A-Z, a-z and all that is not ASCII), and the row it stands in."""
    text = data[:offsets[-1]]
    inside = ((text >= 0x61) & (text <= 0x7A)) | ((text >= 0x41) & (text <= 0x5A)) | (text >= 0x80)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(text))]  # a row's end also ends a word
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start, np.searchsorted(offsets, start, "right") - 1


def multikey_sort(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their words (equal words keep their order), and for each place whether a new word begins. Words hold no zero byte."""
    key = keys(data, start, length)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    places, depth = np.arange(len(order)), 0
    while True:
        # runs of two or more whose last eight bytes are all in use may go on
        run = np.cumsum(new[places]) - 1
        wide = np.bincount(run, minlength=1)[run] > 1 if len(places) else np.zeros(0, bool)
        places = places[wide & ((key & np.uint64(0xFF)) != 0)]
        if not len(places):
            return order, new
        depth += 1
        at, run = order[places], np.cumsum(new[places])
        rest = np.maximum(length[at] - WORD * depth, 0)
        if depth < DEPTH:
            key = keys(data, np.minimum(start[at] + WORD * depth, len(data) - WORD), rest)
        else:
            tails = [data[s:s + n].tobytes() for s, n in zip((start[at] + WORD * depth).tolist(), rest.tolist())]
            numbers = {tail: i for i, tail in enumerate(sorted(set(tails)))}
            key = np.array([numbers[tail] for tail in tails], np.uint64)
        by = np.lexsort((key, run))
        order[places], key = at[by], key[by]
        new[places[1:]] |= key[1:] != key[:-1]
        if depth >= DEPTH:
            return order, new


def runs_of(lang: pa.Array, source: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """Of one shard: every word of every (language, source) with its occurrences and documents."""
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(pair, len(groups)) for pair in zip(lang.to_pylist(), source.to_pylist())], np.int64)
    names = [pa.array([pair[i] for pair in groups], pa.string()) for i in (0, 1)]
    for first, part in slices(text, SLICE):
        data, offsets = raw(part)
        start, length, row = word_starts(data, offsets)
        if not len(start):
            continue
        by = np.argsort(group[first + row], kind="stable")
        start, length, row = start[by], length[by], row[by]
        order, new = multikey_sort(data, start, length)
        row = row[order]
        owner = group[first + row]
        new[1:] |= owner[1:] != owner[:-1]
        head = np.flatnonzero(new)
        another = new.copy()
        another[1:] |= row[1:] != row[:-1]
        named = pa.array(owner[head])
        yield pa.RecordBatch.from_arrays([
            names[0].take(named), names[1].take(named), strings(data, start[order[head]], length[order[head]]).cast(pa.string()),
            pa.array(np.diff(np.append(head, len(new)))), pa.array(np.add.reduceat(another, head, dtype=np.int64))], schema=arrow_type(RUNS))


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it) of every word; a null text, language or source is ''. Each row is a document."""
    plain = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
                        for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from runs_of(*batch.columns)

    return plain.mapInArrow(run, RUNS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (count + 2) / (total + 2 * terms)), null without terms."""
    over = (F.lit(PARTS).cast("decimal(19,0)") * (count + 2).cast("decimal(19,0)"))
    under = F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(19,0)")
    return F.call_function("div", over, under) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(lang: str, sources: list[str], absent: np.ndarray, term: np.ndarray, source: np.ndarray, share: np.ndarray) -> dict[str, list]:
    """Of the given terms of a language: (p - q)^2 / (p + q) of each source with each other, rounded down and added up.

    ``absent`` is the share of a term that a source does not hold; ``term``, ``source`` and ``share`` are those it does.
    """
    _, term = np.unique(term, return_inverse=True)
    by = np.argsort(term, kind="stable")
    term, source, share = term[by], source[by], share[by]
    terms, n = (int(term[-1]) + 1 if len(term) else 0), len(sources)
    total = np.zeros((n, n), np.int64)
    step = max(1, BLOCK // n)
    for first in range(0, terms, step):
        lo, hi = np.searchsorted(term, [first, first + step])
        p = np.repeat(absent[:, None], min(step, terms - first), axis=1)
        p[source[lo:hi], term[lo:hi] - first] = share[lo:hi]
        for i in range(n - 1):
            gap = p[i + 1:] - p[i]
            total[i, i + 1:] += (gap * gap // (p[i + 1:] + p[i])).sum(axis=1)
    total += total.T
    one, other = np.nonzero(~np.eye(n, dtype=bool))
    return {"lang": [lang] * len(one), "source": [sources[i] for i in one], "item": [sources[i] for i in other], "value": total[one, other]}


def _codes(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """The different values of a column, and for each row the number of its value."""
    coded = pa.array(column.combine_chunks(), pa.string()).dictionary_encode() if column.num_chunks else pa.array([], pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _compare(key: tuple, entries: pa.Table, groups: pa.Table) -> pa.Table:
    sources = groups.column("source").to_pylist()
    place = {name: i for i, name in enumerate(sources)}
    used, which = _codes(entries.column("source"))
    found = pair_sums(key[0].as_py(), sources, groups.column("absent").to_numpy(), _codes(entries.column("term"))[1],
                      np.array([place[name] for name in used], np.int64)[which], entries.column("p").to_numpy())
    return pa.Table.from_pydict(found, schema=arrow_type(PAIRS))


def audit(df: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its other sources, and the terms it overuses.

    Part ``pair`` has a row for each other source of the language, ``term`` the ``top`` terms whose share in the source passes that in the language.
    Terms count from ``least_docs`` documents of the language on. Nulls are '', a text without words still makes its group occur, repeated rows count
    each time, an empty table gives no row. A language without terms gives pairs of value 0; one with a single source gives no pair. Ties of value follow the item.

    Terms and sources shuffle as added-up counts, never as occurrences. Pairs are added up in shards of bounded entries of a language, whatever the
    language's share; a shard holds the language's list of sources, which is at most the square root of its result. The memory of a sort is some ten
    times a slice's bytes, or the longest text's.
    """
    counts = stored(term_counts(df, text_col, lang_col, source_col), "term_counts")
    wide = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = stored(counts.drop("docs").join(wide.drop("docs"), ["lang", "term"]), "kept_terms")
    occurring = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
                          F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source")).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(sums, ["lang", "source"], "left").fillna(0, ["total"])
    langs = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    entries = kept.groupBy("lang").agg(F.count("*").alias("entries"))
    groups = groups.join(langs.join(entries, "lang"), "lang", "left").fillna(0, ["terms", "lang_total", "entries"])
    groups = stored(groups.withColumn("shards", F.greatest(F.ceil(F.col("entries") / SHARD), F.lit(1)).cast("int"))
                    .withColumn("absent", F.coalesce(_share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")), F.lit(1).cast("bigint"))), "groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "shards", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"))
    sharded = shares.select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "source", "term", "p")
    copies = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "source", "absent")
    pairs = (sharded.groupBy("lang", "shard").cogroup(copies.groupBy("lang", "shard")).applyInArrow(_compare, PAIRS)
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair")))
    over = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"),
                                                         F.lit("term").alias("part"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(over.withColumn("rank", rank).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def oracle(least_docs: int = 10, top: int = 10) -> str:
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= {least_docs}),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
here AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sums AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN here USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(h.n, 0) AS n,
        1 + ({PARTS}::HUGEINT * (coalesce(h.n, 0) + 2)) // (s.total::HUGEINT + 2 * l.v) AS p,
        1 + ({PARTS}::HUGEINT * (k.n + 2)) // (l.total::HUGEINT + 2 * l.v) AS q
      FROM sums s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN here h ON h.lang = s.lang AND h.source = s.source AND h.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
         FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
