"""Op 7. Toxicity by noisy-channel deobfuscation.

Suspicious spans (letters beside look-alike digits and signs, letters spelt out with separators, fragments joined by separators,
words with a repeated letter) become character lattices: a sign may stand for a letter, a separator for nothing or a space, a repeated
letter for nothing. Fragments set apart by white space only are decoded where together they make a word or beginning that has a weight. Viterbi decoding under a trigram character model picks the likeliest restored text. A sparse logistic model over
the words of the text and of its restored spans, and over their beginnings, gives the score.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import arrow_type, bounded_sample, documents, held, in_parts, map_rows
from factloom.session import stored

WORDS = re.compile(r"[^\W\d_]+")
#: What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
SIGNS = "0-9@$!|+€£("
BITS = {"sign": 2.0, "gap": 0.3, "space": 7.0, "wide": 0.5, "repeat": 1.0, "double": 4.0, "stray": 7.0, "dropped": 14.0, "any": 3.0, "join": 3.0, "apart": 1.0}
TOKEN = re.compile(rf"[{SIGNS}*\w]+")
TAIL = re.compile(rf"(?:[*(!|+]+|([{SIGNS}*_])\1+)$")  # signs that end a word without meaning a letter
LETTER = re.compile(r"[^\W\d_]")
ENDING = re.compile(r"[*(!|+_]+$")  # of these, the ones that look like no doubled letter
REPEATED = re.compile(r"([^\W\d_])\1")
SPELT = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:(?:[^\w@$!|+]|_)+(?:[^\W_]|[@$!|+])){2,}(?![^\W_])")
#: Fragments on both sides of separators, without white space between them.
JOINED = re.compile(rf"[{SIGNS}\w]+(?:[^\w\s{SIGNS}]+[{SIGNS}\w]+)+")
LONGEST_KEPT = 64  # longer spans are decoded, but not kept in memory


class Characters:
    """Trigram costs in bits, with one space before and after each word; fewer characters of context weigh in where counts are thin."""

    def __init__(self, words: dict[str, int] | None = None, trigrams: tuple[tuple[str, int], ...] = ()):
        counted: Counter[str] = Counter(dict(trigrams))
        for word, n in (words or {}).items():
            padded = f"  {word} "
            for k in range(2, len(padded)):
                counted[padded[k - 2:k + 1]] += n
        grams: Counter[str] = Counter()
        for gram, n in counted.items():
            for size in (0, 1, 2):
                grams[gram[2 - size:]] += n
        above: Counter[str] = Counter()
        for gram, n in grams.items():
            above[gram[:-1]] += n
        self.grams, self.above = grams, above
        self.bits = functools.lru_cache(maxsize=50_000)(self._bits)

    def _bits(self, before: str, letter: str) -> float:
        p = 1e-4
        for size in (0, 1, 2):
            context = before[2 - size:]
            n = self.above.get(context, 0)
            p = (self.grams.get(context + letter, 0) + 4 * p) / (n + 4)
        return -math.log2(p)


def _gap(sign: str) -> bool:
    return bool(sign) and not sign.isalnum() and sign not in LOOKS


def _whole(span: str, k: int) -> bool:
    """Whether a fragment of two or more signs borders the single separator ``span[k]`` on one side, and letters both."""
    before, after = span[max(0, k - 2):k], span[k + 1:k + 3]
    return span[k] != "*" and bool(before and after) and not _gap(before[-1]) and not _gap(after[0]) and \
        (len(before) == 2 and not _gap(before[0]) or len(after) == 2 and not _gap(after[1]))


def restore(span: str, model: Characters) -> str:
    """The likeliest text behind ``span`` (lower case): Viterbi over its lattice, a state being the last two letters put out."""
    states: dict[str, tuple[float, tuple]] = {"  ": (0.0, ())}
    for k, sign in enumerate(span):
        options: list[tuple[str, float]] = []
        if sign.isalpha():
            options.append((sign, 0.0))
            if k and span[k - 1] == sign:
                options.append(("", BITS["repeat" if span[k - 2:k - 1] == sign or span[k + 1:k + 2] == sign else "double"]))
        elif _gap(sign):
            whole = _whole(span, k)  # a piece of a word, not one letter, stands before or after
            wide = k and _gap(span[k - 1]) or sign == " " and _gap(span[k + 1:k + 2])
            options += [("", BITS["join" if whole else "gap"]), (" ", BITS["apart" if whole else "wide" if wide else "space"])]
            if sign == "*":
                options += [(letter, BITS["any"]) for letter in "aeiou"]
        else:
            options += [(letter, BITS["sign"]) for letter in LOOKS.get(sign, "")]
            options.append(("", BITS["dropped" if sign in LOOKS else "stray"]))
        following: dict[str, tuple[float, tuple]] = {}
        for state, (cost, path) in states.items():
            for letter, extra in options:
                if letter == " " and state[1] == " ":
                    continue
                to = state if not letter else ("  " if letter == " " else state[1] + letter)
                total = cost + extra + (model.bits(state, letter) if letter else 0.0)
                if to not in following or total < following[to][0]:
                    following[to] = (total, (path, letter) if letter else path)
        states = following
    cost, path = min(((c + model.bits(s, " ") * (s[1] != " "), p) for s, (c, p) in states.items()), key=lambda x: x[0])
    letters: list[str] = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def beginnings(word: str) -> list[str]:
    """The features of a word: itself, and each proper beginning of four to eight letters."""
    return ["=" + word, *(">" + word[:k] for k in range(4, min(9, len(word))))]


@dataclass(frozen=True)
class Fitted:
    """What learning leaves: trigrams with counts for the character model, weights by feature, and the bias."""

    trigrams: tuple[tuple[str, int], ...]
    weights: tuple[tuple[str, float], ...]
    bias: float
    alone: tuple[tuple[str, float], ...] = ()  # the toxic share that one feature stands for by itself, by its lower bound


def _squeeze(word: str) -> str:
    """A word with each run of a letter cut to one."""
    return word[:1] + "".join(b for a, b in zip(word, word[1:]) if a != b)


class Scorer:
    def __init__(self, fitted: Fitted, keep: int = 200_000):
        self.characters, self.weights, self.bias, self.keep = Characters(trigrams=fitted.trigrams), dict(fitted.weights), fitted.bias, keep
        self.alone = dict(fitted.alone)
        self.restored: dict[str, tuple[str, ...]] = {}
        self.fragments: dict[str, bool] = {}
        self.chunks: dict[str, tuple[str, ...]] = {}
        self.known: dict[str, tuple[str, ...]] = {}
        self.pieces: dict[str, tuple[str, ...]] = {}
        self.idle: set[str] = set()  # pieces without a feature that has a weight
        self.fours = frozenset(f[1:5] for f in self.weights)
        self.squeezed = frozenset(_squeeze(f[1:]) for f in self.weights)
        # what fragments that white space sets apart may add up to
        self.ends = frozenset(self.weights)
        self.heads = frozenset(f[1:k] for f in self.weights for k in range(2, len(f)))
        self.stems = frozenset(f[1:k] for f in self.weights for k in range(2, min(7, len(f) + 1)))

    def _vain(self, word: str) -> bool:
        """Whether no reading of a word of letters can have a weight: a reading drops repeated letters only, so it is squeezed to the same letters."""
        squeezed = _squeeze(word[:2 * LONGEST_KEPT])
        return bool(self.weights) and word.isalpha() and len(word) <= LONGEST_KEPT and not any(squeezed[:k] in self.squeezed for k in range(1, len(squeezed) + 1))

    def restore(self, span: str) -> tuple[str, ...]:
        """The words behind ``span``; none where a model with weights could not weigh any of them."""
        found = self.restored.get(span)
        if found is None and self._vain(span):
            return ()
        if found is None:
            found = tuple(WORDS.findall(restore(span, self.characters)))
            if len(span) <= LONGEST_KEPT:
                if len(self.restored) > self.keep // 4:
                    self.restored.clear()
                self.restored[span] = found
        return found

    def spans(self, text: str) -> list[str]:
        """Suspicious spans of a lower-case text, but for fragments that only white space sets apart."""
        return [s for c in set(text.split()) for s in self._inside(c)] + [m[0] for m in SPELT.finditer(text)]

    def _inside(self, chunk: str) -> list[str]:
        """Suspicious spans of a text without white space; a span that ends in repeated signs is read with and without them."""
        out = [t for t in JOINED.findall(chunk) if LETTER.search(t)]
        for token in TOKEN.findall(chunk):
            for one in {TAIL.sub("", token), ENDING.sub("", token)}:
                if LETTER.search(one) and (REPEATED.search(one) or not one.isalpha()):
                    out.append(one)
        return out

    def chunk(self, chunk: str) -> tuple[str, ...]:
        """The words behind a text without white space."""
        found = self.chunks.get(chunk)
        if found is None:
            found = tuple({w for span in self._inside(chunk) for w in self.restore(span)})
            if len(chunk) <= LONGEST_KEPT:
                if len(self.chunks) > self.keep:
                    self.chunks.clear()
                self.chunks[chunk] = found
        return found

    def _reach(self, head: str, token: str) -> set[str]:
        """``head`` and what ``token`` may stand for, as far as it begins or makes something that has a weight."""
        out = {head}
        for sign in token:
            out = {one for h in out for letter in LOOKS.get(sign, sign) if (one := h + letter) in self.heads or self._made(one)}
        return out

    def _fragment(self, token: str) -> bool:
        """Whether a token with signs may begin something that has a weight."""
        if token not in self.fragments:
            if len(self.fragments) > self.keep:
                self.fragments.clear()
            self.fragments[token] = LETTER.search(token) is not None and bool(self._reach("", token) & self.heads)
        return self.fragments[token]

    def _made(self, word: str) -> bool:
        return any(f in self.ends for f in beginnings(word))

    def apart(self, tokens: list[str], plain: set[str]) -> set[str]:
        """Runs of neighbouring fragments that add up to a word or a beginning that has a weight; ``plain`` tokens are letters only."""
        found: set[str] = set()
        heads, odd = self.heads, {t for t in set(tokens) - plain if self._fragment(t)}
        starts = (heads & plain) | odd
        for i in [i for i, t in enumerate(tokens[:-1]) if t in starts] if starts else ():
            token = tokens[i]
            if token in odd or not tokens[i + 1].isalpha() or (token + tokens[i + 1])[:5] in self.stems:
                reached, k = self._reach("", token), i + 1
                while k < len(tokens) and (reached := {r for h in reached if h in heads for r in self._reach(h, tokens[k])}):
                    if any(map(self._made, reached)):
                        found.add(" ".join(tokens[i:k + 1]))
                    k += 1
        return found

    def _said(self, chunk: str) -> set[str]:
        """The words of a text without white space, as they stand and restored."""
        core = chunk.rstrip(".,;:?")
        if core.isalpha():  # nothing to decode but repeated letters, which belong to the features of a word
            return {core}
        out = {w for token in TOKEN.findall(chunk) for w in ((token,) if token.isalpha() else WORDS.findall(token))}
        out.update(self.chunk(chunk))
        return out

    def words(self, text: str) -> set[str]:
        """The words of a text, as they stand and restored, and what those with a repeated letter are without it; fragments apart are left out."""
        text = text.lower()
        out = {w for chunk in set(text.split()) for w in self._said(chunk)}
        for match in SPELT.finditer(text):
            out.update(self.restore(match[0]))
        return out.union(*(self.restore(w) for w in out if REPEATED.search(w)))

    def joined(self, text: str) -> set[str]:
        """The words that fragments apart in a lower-case text add up to."""
        listed = TOKEN.findall(text)
        return {w for span in self.apart(listed, set(filter(str.isalpha, listed))) for w in self.restore(span)} if self.heads else set()

    def all_features(self, word: str) -> list[str]:
        """The features of a word and, where a letter is repeated, of what it is without the repeat."""
        out = beginnings(word)
        for one in self.restore(word) if REPEATED.search(word) else ():
            out += beginnings(one)
        return out

    def weighted(self, word: str) -> tuple[str, ...]:
        """Of the features of a word those that have a weight."""
        found = self.known.get(word)
        if found is None:
            if word[:4] not in self.fours and (not REPEATED.search(word) or self._vain(word)):
                return ()
            if len(self.known) > self.keep:
                self.known.clear()
            found = self.known[word] = tuple(f for f in self.all_features(word) if f in self.weights)
        return found

    def features(self, text: str) -> set[str]:
        """The features with a weight in a text: one look for each different piece between white space, and the spans that reach over it."""
        text, pieces, idle, out = text.lower(), self.pieces, self.idle, set()
        for chunk in set(text.split()).difference(idle):
            found = pieces.get(chunk)
            if found is None:
                found = tuple({f for word in self._said(chunk) for f in self.weighted(word)})
                if len(chunk) <= LONGEST_KEPT:
                    if len(pieces) + len(idle) > 2 * self.keep:
                        pieces.clear(), idle.clear()
                    if found:
                        pieces[chunk] = found
                    else:
                        idle.add(chunk)
            out.update(found)
        for match in SPELT.finditer(text):
            for word in self.restore(match[0]):
                out.update(self.weighted(word))
        for word in self.joined(text):
            out.update(self.weighted(word))
        return out

    def score(self, text: str) -> float:
        """The logistic score, or the share that the surest single feature stands for, whichever is more."""
        features = sorted(self.features(text))
        logit = self.bias + sum(self.weights[f] for f in features)
        return max([1 / (1 + math.exp(-max(-40.0, min(40.0, logit)))), *(self.alone[f] for f in features if f in self.alone)])


def scorer(fitted: Fitted) -> Scorer:
    return held(("toxicity", fitted), lambda: Scorer(fitted))


def _decoded(sample: DataFrame, fitted: Fitted) -> DataFrame:
    """toxic, text (lower case) and words of the labelled texts, which are decoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(fitted)
        for batch in batches:
            texts = [t.lower() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(texts, pa.string()), pa.array([sorted(one.words(t)) for t in texts], pa.list_(pa.string()))],
                                             ["toxic", "text", "words"])

    return sample.select("toxic", "text").mapInArrow(run, "toxic int, text string, words array<string>")


def _counts(rows: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """How many of the decoded ``rows`` have each feature; with ``only``, of these features."""

    def count(batch: pa.RecordBatch) -> dict[str, list]:
        known: dict[str, list[str]] = {}
        seen: Counter[str] = Counter()
        for words in batch.column("words").to_pylist():
            for word in words:
                if word not in known:
                    known[word] = [f for f in beginnings(word) if only is None or f in only]
            seen.update({f for word in words for f in known[word]})
        return {"feature": list(seen), "n": list(seen.values())}

    return map_rows(rows.select("words"), "feature string, n bigint", count).groupBy("feature").agg(F.sum("n").alias("n"))


SLICE = 1 << 20  # characters counted at once


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters, as in ``WORDS``."""
    out = np.zeros(0x110000, bool)
    for word in WORDS.finditer("".join(map(chr, range(0x110000)))):
        out[word.start():word.end()] = True
    return out


def count_trigrams(text: str) -> dict[str, int]:
    """The trigrams of the words of a lower-case text, with two spaces before a word and one after it."""
    signs = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.concatenate([[32], np.where(_letters()[signs], signs, 32)])
    seen = np.flatnonzero(np.bincount(signs))
    place = np.zeros(seen[-1] + 1, np.int64)
    place[seen] = np.arange(len(seen))
    at, n = place[signs], len(seen)
    blank = place[32]
    a, b, c = at[:-2], at[1:-1], at[2:]
    code = ((np.where(b == blank, blank, a) * n + b) * n + c)[(b != blank) | (c != blank)]
    if n ** 3 <= 8 * SLICE:
        counts = np.bincount(code)
        codes = np.flatnonzero(counts)
        counts = counts[codes]
    else:
        codes, counts = np.unique(code, return_counts=True)
    sign = [chr(x) for x in seen]
    return {sign[x // n // n] + sign[x // n % n] + sign[x % n]: k for x, k in zip(codes.tolist(), counts.tolist())}


def trigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n over the words of all texts. The table is bounded by the alphabets in use, not by the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            waiting, size = [], 0
            for text in batch.column("text").to_pylist():
                waiting.append(text.lower())
                size += len(text)
                if size >= SLICE:
                    seen.update(count_trigrams("\n".join(waiting)))
                    waiting, size = [], 0
            seen.update(count_trigrams("\n".join(waiting)))
        yield pa.RecordBatch.from_pydict({"gram": list(seen), "n": list(seen.values())}, schema=arrow_type("gram string, n bigint"))

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, m: int, ridge: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Non-negative weights and a bias by full gradient steps with a step size per weight."""
    n, w = len(y), np.zeros(m)
    b = math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    share = np.where(y == 1, max(1.0, (n - y.sum()) / max(y.sum(), 1)), 1.0)  # both classes weigh the same
    gw, gb = np.full(m, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], n), -40, 40)))
        e = (p - y) * share
        g = np.bincount(cols, e[rows], m) / n + ridge * w / max(m, 1) ** 0.5
        gw += g * g
        w = np.maximum(0, w - 0.3 * g / np.sqrt(gw))
        d = e.mean()
        gb += d * d
        b -= 0.1 * d / math.sqrt(gb)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, least: int = 3, sure: float = 0.5, heavy: float = 0.5, surest: float = 0.97,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Fitted:
    """Learn from at most about ``rows`` labelled documents (smallest hashes of the id), a documented bound of the fit.

    A feature counts if at least ``least`` toxic texts have it and the lower bound (Wilson, one side, 95 %) of its toxic share is at
    least ``sure``; it counts alone if its weight is at least ``heavy`` and that bound at least ``surest``. The character model counts the words of all ``docs``. Null labels teach nothing; a document with
    several labels counts as toxic if any of them says so. Without labels every score is one half.
    """
    chosen = bounded_sample(labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
                            .filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", rows)
    # at most about ``rows`` pairs of numbers are broadcast
    sample = documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    start = Fitted(tuple(sorted((r["gram"], r["n"]) for r in trigrams(docs, text_col).collect())), (), 0.0)
    decoded = stored(_decoded(sample, start), "decoded")
    toxic = {r["feature"]: r["n"] for r in _counts(decoded.filter("toxic = 1"), None).filter(F.col("n") >= least).collect()}
    clean = {r["feature"]: r["n"] for r in _counts(decoded.filter("toxic = 0"), frozenset(toxic)).collect()}

    def lower(k: int, n: int, z: float = 1.645) -> float:
        p = k / n
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    kept = sorted(f for f, k in toxic.items() if lower(k, k + clean.get(f, 0)) >= sure)
    place = {f: k for k, f in enumerate(kept)}
    chosen_features = Fitted(start.trigrams, tuple((f, 1.0) for f in kept), 0.0)

    def found(batch: pa.RecordBatch) -> dict[str, list]:
        one = scorer(chosen_features)
        rows_, out = zip(batch.column("text").to_pylist(), batch.column("words").to_pylist()), []
        for text, words in rows_:  # the words hold what repeats stand for, so a word's own beginnings are all it adds
            held_ = {place[f] for w in words if w[:4] in one.fours for f in beginnings(w) if f in place}
            out.append(sorted(held_.union(place[f] for w in one.joined(text) for f in one.weighted(w))))
        return {"toxic": batch.column("toxic").to_pylist(), "found": out}

    table = sorted((r["toxic"], r["found"]) for r in map_rows(decoded, "toxic int, found array<int>", found).collect())
    if not table:
        return Fitted(start.trigrams, (), 0.0)
    y = np.array([t for t, _ in table], float)
    doc = np.repeat(np.arange(len(table)), [len(f) for _, f in table])
    cols = np.array([c for _, f in table for c in f], int)
    w, b = _logistic(doc, cols, y, len(kept))
    # the words of one much copied text share its weight, so none of them stands for much alone
    shares = {f: lower(toxic[f], toxic[f] + clean.get(f, 0)) for f, k in place.items() if w[k] >= heavy}
    alone = tuple((f, share) for f, share in shares.items() if share >= surest)
    return Fitted(start.trigrams, tuple((f, float(w[k])) for f, k in place.items() if w[k] > 0), float(b), alone)


def score(df: DataFrame, fitted: Fitted, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row; null texts are empty, empty texts get the bias alone. Repeated rows get a row each."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        one = scorer(fitted).score
        scores = [one(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id").to_pylist(), "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_rows(documents(df, id_col, text_col), "doc_id bigint, score double, predicted int", run)


def keep_clean(df: DataFrame, fitted: Fitted, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text scores below ``threshold``, as they are; one pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(fitted).score
        for batch in (part for whole in batches for part in in_parts(whole)):
            yield batch.filter(pa.array([one(t or "") < threshold for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)
