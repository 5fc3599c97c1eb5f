"""Op 10. Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language answers, letter by letter, how far a word goes on as something that
occurs in that text. A document is parsed greedily into longest matches; the language whose text explains it with the
fewest phrases, each weighed with the logarithm of the text's length (the size of a pointer into it), wins. Phrases end
at word boundaries, so the phrases of a word are counted once per worker and looked up after that.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_sample, documents, held, map_rows

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
FIELD = 48  # bits of a count in a packed sum


class SuffixAutomaton:
    """Accepts every substring of ``text``; one step for each letter."""

    def __init__(self, text: str):
        steps: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for letter in text:
            new = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and letter not in steps[at]:
                steps[at][letter] = new
                at = link[at]
            if at >= 0:
                to = steps[at][letter]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    twin = len(steps)
                    steps.append(dict(steps[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and steps[at].get(letter) == to:
                        steps[at][letter] = twin
                        at = link[at]
                    link[to] = link[new] = twin
            last = new
        self.steps, self.size = steps, len(text)

    def phrases(self, word: str) -> int:
        """Longest matches that make up ``word``; a letter that the text lacks is a phrase of its own."""
        steps, count, state = self.steps, 0, 0
        for letter in word:
            to = steps[state].get(letter)
            if to is None:
                count += 1
                to = steps[0].get(letter, 0)
                count += to == 0
            state = to
        return count + 1


class Model:
    """Languages in order of name; ``parse`` gives the phrases of a text in each."""

    def __init__(self, texts: dict[str, str], keep: int = 400_000):
        self.languages = sorted(texts)
        self.automata = [SuffixAutomaton(texts[name]) for name in self.languages]
        self.weight = [math.log2(a.size + 2) for a in self.automata]
        self.keep = keep
        self.known: dict[str, int] = {}

    def _packed(self, word: str) -> int:
        inside = f" {word} "
        return sum(a.phrases(inside) << (FIELD * k) for k, a in enumerate(self.automata))

    def parse(self, text: str) -> list[int] | None:
        words = WORDS.findall(text.lower())
        if not words:
            return None
        if len(self.known) > self.keep:
            self.known.clear()
        known, total = self.known, 0
        try:
            total = sum(map(known.__getitem__, words))
        except KeyError:
            for word in set(words):
                if word not in known:
                    known[word] = self._packed(word)
            total = sum(map(known.__getitem__, words))
        return [total >> (FIELD * k) & ((1 << FIELD) - 1) for k in range(len(self.automata))]

    def predict(self, text: str) -> tuple[str, float]:
        """The language of fewest weighed phrases, ties to the first name, and the rival's share of the two costs, twice less one half."""
        counts = self.parse(text) if self.automata else None
        if counts is None:
            return UNKNOWN, 0.0
        costs = sorted((n * w, k) for k, (n, w) in enumerate(zip(counts, self.weight)))
        rival = costs[1][0] if len(costs) > 1 else math.inf
        return self.languages[costs[0][1]], 1.0 if math.isinf(rival) else rival / (costs[0][0] + rival)


def model(texts: tuple[tuple[str, str], ...]) -> Model:
    """One set of automata per worker process."""
    return held(("languages", texts), lambda: Model(dict(texts)))


def labelled_texts(train: DataFrame, rows: int, letters: int) -> tuple[tuple[str, str], ...]:
    """Per language of ``train`` (text, lang): the different words of whole sampled texts, until ``letters`` are reached."""
    sample = bounded_sample(train, "text", rows, by="lang")
    out: dict[str, dict[str, None]] = {}
    size: dict[str, int] = {}
    for lang, text in sorted((r["lang"], r["text"]) for r in sample.select("lang", "text").toLocalIterator()):
        words = out.setdefault(lang, {})
        if size.get(lang, 0) < letters:
            for word in WORDS.findall(text.lower()):
                if word not in words:
                    words[word] = None
                    size[lang] = size.get(lang, 0) + len(word) + 1
    return tuple((lang, " " + " ".join(words) + " ") for lang, words in sorted(out.items()) if words)


def predict(df: DataFrame, train: DataFrame, rows: int = 100, letters: int = 100_000, id_col: str = "doc_id",
            text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score for every row of ``df``, learnt from ``train``.

    The automata are fitted on a bounded sample: about ``rows`` texts of each language (smallest hashes of the text), until their
    different words have ``letters`` letters. Rows of ``train`` with a null text or language teach nothing. Null texts and texts
    without a letter get ``und`` and 0. Nothing to learn from gives ``und`` everywhere. Ties go to the first name.
    """
    labelled = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts = labelled_texts(labelled.filter("text is not null and lang is not null"), rows, letters)

    def guess(batch: pa.RecordBatch) -> dict[str, list]:
        predict_one = model(texts).predict
        found = [predict_one(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id").to_pylist(), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_rows(documents(df, id_col, text_col), "doc_id bigint, lang_pred string, score double", guess)


def held_out(id_col: str, parts: int, part: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == part
