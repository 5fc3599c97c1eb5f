"""The operators against brute force, on rows that hold nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import ann, dac, html, langid, mixing, neardup, packing, pii, tokens, topk, toxicity, vectors
from factloom.llm.common import bounded_sample
from factloom.llm.components import components
from factloom.session import shared_folder, stored

LONG = "very long words, " * 4000
ODD = ["", "  a  b", "it's don't  I'm.", "x<|endoftext|>y", "á élan", "İstanbul ΑΣ ὈΔΥΣΣΕΎΣ", "日本語 テスト", "a\x1cb", "\n\n  x\t y 　z",
       "word.,word ..., 12,345.67", " nbsp  x", "naïve.", "' s 's", "Å é fi ſ ª º µ ß", LONG]
#: Names that operators use inside themselves.
CLASH = {"_m": 1, "_s": 2, "island": 3, "uid": 4, "block": 5, "slot": 6, "root": 7, "tile": 8, "score": 9.0, "n": 1, "_gone": 2, "_id": 3, "row": 1}


@pytest.fixture(scope="module")
def rows():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    rng = random.Random(3)
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts = ODD + base + base[:5] + [None, None]
    return [(i, t, ("en", "de", None)[i % 3], ("src0", "src1", "src0", None)[i % 4], len(t or "")) for i, t in enumerate(texts)] + \
        [(None, "no id", "en", "src0", 5), (3, ODD[3], "en", "src3", 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids_of(name, text, end):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name,pieces", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes"), ("byte_bpe_50k.json", None)])
def test_encoder_equals_library(name, pieces):
    encoder = tokens.Encoder(public_tokenizers.path(name), pieces, keep=40)
    for text in ODD * 2:
        assert encoder.encode([text])[0] == np.array(ids_of(name, text, 0)[:-1], "<u4").tobytes()


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2 ** 32 - 1], list(range(0, 200_000, 97))])
def test_codes_give_back_every_token(ids):
    reader = dac.Reader(dac.pack([5, 7], [np.array(ids, "<u4").tobytes(), b""]))
    assert reader.decode().tolist() == ids and reader.document(1) == []
    assert [reader.token(i) for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        reader.token(len(ids))


def test_token_store(spark, docs, rows, none):
    folder = shared_folder(spark, "dac-test")
    manifest = dac.write(docs, folder, public_tokenizers.path("word_bpe_49k.json"), "words", 2, shard_tokens=3000)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in dac.read(manifest, folder).collect()), key=lambda r: r[1])
    expected, at = [], 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of("word_bpe_49k.json", text, 2)
        expected.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == expected and manifest.count() > 1
    assert dac.digests(spark, none, public_tokenizers.path("word_bpe_49k.json"), "words", 2).count() == 0


def test_packing(docs, rows, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, capacity=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for doc, text, *_ in rows:
        ids = ids_of("byte_bpe_50k.json", text, 0)
        for piece, start, length, check in by_id[doc]:
            assert crc(ids[start:start + length]) == check and (length == 64 or piece == 0)
        assert max(s + n for _, s, n, _ in by_id[doc]) == len(ids)
    total = sum(r["length"] for r in got)
    assert len(filled) <= -(-total // 64) + 3
    assert packing.pack_documents(none, path).count() == 0


def test_genetic_packing_beats_or_equals_best_fit():
    rng = random.Random(5)
    size = [rng.randint(1, 100) for _ in range(400)]
    best = packing.evolve(size, 100, [], 1)
    assert sorted(i for b in best for i in b) == list(range(400)) and all(sum(size[i] for i in b) <= 100 for b in best)
    bins = packing._Bins(size, 100)
    for i in sorted(range(400), key=lambda i: -size[i]):
        bins.fit(i)
    assert len(best) <= len(bins.packing())


PAGE = """<html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">buy</div><article><h1>Head &amp; tail</h1>
<p>One  long,\n paragraph, with commas, &lt;b&gt; and <a href="y>z">a link</a>.<p><b>Unclosed bold<br>next</p><p>Last&nbsp;one &am</p><form>name<input></form></article>
<aside>side</aside><div id="comments"><p>I, love, this, so, much, indeed, really, truly, honestly, very</p></div><footer>&copy; me</footer>"""


def test_main_text(spark, none):
    assert html.extract(PAGE) == "Head & tail One long, paragraph, with commas, <b> and a link. Unclosed bold next Last one &am"
    assert html.extract("") == html.extract("<p") == html.extract("<nav>only a menu</nav>") == ""
    assert html.extract("<div>" * 3000 + "<p>deep, but text</p>").endswith("deep, but text")
    assert html.extract("plain words, no markup") == "plain words, no markup"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "<p>x, y</p>")], "page_id long, url string, html string")
    got = html.main_text(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.main_text(pages.limit(0)).count() == 0


PII_TEXTS = ["a@b.co,c@d.e.f@g.h x_y%+-@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "4" * 30,
             "+1 (555) 010-2000 +12 +1)))))) 3", "é😀 a@b.cc é", "9" * 20000, "aa@bb.cc" * 3, "a@b", "x" * 3000 + "a@b.cd " * 300, None, ""]


def base_spans(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(s))) % 10 == 0

    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            s = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(s) <= 19 and luhn(s) or k == 3 and 10 <= len(s) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark):
    df = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    model = pii.Model({2: ["1.0D * (if(f[0] <= 13.5, -1.0, 1.0))"]}, {2: 0.8})  # numbers of 14 digits and more are cards
    got = {r["doc_id"]: r for r in pii.report(df, model).collect()}
    for i, text in enumerate(PII_TEXTS):
        spans = base_spans(text or "")
        written = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest(), text
        assert [got[i][f"n_{kind}"] for kind in pii.KINDS] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert set(written.split(",")) <= set(got[i]["spans"].split(","))
    assert got[2]["spans"] != "" and not {"PythonUDF", "MapInArrow"} & set(re.findall(r"\w+", pii.report(df, model)._jdf.queryExecution().toString()))
    clean = {r["doc_id"]: r for r in pii.redact(df, pii.Model({}, {})).collect()}
    assert clean[0]["text"] == "[EMAIL],[EMAIL]@g.h [EMAIL]" and clean[10]["text"] is None and clean[0]["_m"] == 1
    assert pii.report(df.limit(0), model).count() == 0


def test_personal_data_fit(spark):
    rng = random.Random(1)
    texts = [f"pay 4{rng.randrange(10 ** 14):014d}{k % 10} or call +1 (55{k % 10}) 555-01{k:02d}, version {k}.{k}.1234567" for k in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert set(pii.fit(df, rounds=2).trees) <= {0, 2, 3} and pii.fit(df.limit(0)).trees == {}


def vectors_table(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12))
    x[50:90] = x[50] + 0.01 * rng.standard_normal((40, 12))
    x[100:110] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]
    extra = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [None] + [1.0] * 11), (None, [1.0] * 12), (rows[7][0], rows[7][1]), (1080, []),
             (1100, [float("inf")] * 12), (rows[100][0], rows[100][1])]
    return rows, spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "block": F.lit(3), "q": F.lit(4)})


@pytest.mark.parametrize("block_rows", [20_000, 90])
def test_exact_products(spark, block_rows, monkeypatch):
    rows, df = vectors_table(spark)
    monkeypatch.setattr(topk, "search", lambda *a: vectors.search(*a, block_rows=block_rows))
    got = [tuple(r) for r in topk.top_products(df, every=50).orderBy("query_id", "rank").collect()]
    x = {i: np.floor(256 * np.array(v, float)) for i, v in rows} | {1020: np.zeros(12)}
    expected = []
    for q in sorted(i for i in x if i % 50 == 0):
        best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:5]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == expected
    assert topk.top_products(df.limit(0)).count() == 0
    assert topk.top_products(df.filter("vec_id in (50, 51)")).count() == 1


@pytest.mark.parametrize("block_rows", [20_000, 90])
def test_nearest_vectors(spark, block_rows, monkeypatch):
    rows, df = vectors_table(spark)
    monkeypatch.setattr(ann, "search", lambda *a: vectors.search(*a, block_rows=block_rows))
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.array(v, float) for i, v in rows}
    found = 0
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-(x[q] @ x[i]), i) for i in x if i != q)[:20]
        mine = sorted(got[q])
        assert len(mine) == 20 and len({i for _, i, _ in mine}) == 20 and all(abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        found += len({i for _, i in best} & {i for _, i, _ in mine})
    assert set(got) == {i for i in x if i % 20 == 0} and found >= 0.9 * 20 * len(got)
    assert ann.nearest(df.limit(0)).count() == 0


def test_chi_square():
    x = np.random.default_rng(0).chisquare(8, 200_000)
    assert abs(ann.chi_square(np.array([7.0]))[0] - (x <= 7).mean()) < 0.01


def test_mixing(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a"] * 7 + ["b", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows + [rows[0]], "doc_id long, source string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.schedule(df, weights, block_docs=4, frame=20).collect()
    assert len(got) == 3000 and len({r["place"] for r in got}) == 3000
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    order = [next(iter(slots[k])) for k in range(len(slots))]
    seen = Counter()
    for source, block in order:
        assert block == seen[source]  # a source's blocks keep their order
        seen[source] += 1
    mean = 1 / 3
    quota = {s: max(1, int(w / (1 + mean) * 20 + 0.5)) for s, w in {**weights, None: mean}.items()}
    frames = min(seen[s] // quota[s] for s in quota)
    length, done = sum(quota.values()), Counter()
    for t, (source, _) in enumerate(order[:frames * length]):
        done[source] += 1
        assert all(abs(done[s] - q * (t + 1) / length) < 1 for s, q in quota.items())
    mixed = mixing.mix(docs, block_docs=2)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))
    assert mixing.schedule(none).count() == 0 and mixing.mix(none).count() == 0


WORDS = toxicity.Characters({w: 20 for w in "idiot loser moron stupid worthless the and of clown this you are a thing with other people".split()})


@pytest.mark.parametrize("span,text", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("m0r0n", "moron"), ("stuuuupid", "stupid"),
                                       ("w o r t h l e s s   c l o w n", "worthless clown"), ("idiot", "idiot"), ("m*ron", "moron")])
def test_restore(span, text):
    assert toxicity.restore(span, WORDS) == text


def test_viterbi_is_best_of_all_paths():
    def cost(text):
        padded = "  " + text
        return sum(WORDS.bits(padded[k - 2:k], padded[k]) for k in range(2, len(padded))) + WORDS.bits(padded[-2:], " ")

    texts = {a + "d" + b + c + d for a in "il" for b in "il" for c in "o" for d in "t"}
    assert toxicity.restore("1d10t", WORDS) == min(texts, key=cost)


def test_toxicity(spark):
    rng = random.Random(6)
    plain = "the and of this with other people thing are you green water stone house".split()
    texts, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "loser", "schimpfer", "schimpfung"])
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    more = ["", None, "you m0r0n", "an i d i o t", "the schimpfling", LONG, "the house", "the house"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts + more)], "doc_id long, text string, toxic int").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    table = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    fitted = toxicity.fit(df, table.filter("doc_id is null or doc_id < 300"))
    got = {r["doc_id"]: r for r in toxicity.score(df, fitted).collect()}
    assert all(got[i]["predicted"] == labels[i] for i in range(400))
    assert [got[400 + k]["predicted"] for k in range(8)] == [0, 0, 1, 1, 1, 0, 0, 0] and all(0 <= r["score"] <= 1 for r in got.values())
    clean = toxicity.keep_clean(df, fitted)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert {r["score"] for r in toxicity.score(df.limit(3), toxicity.fit(df, table.limit(0))).collect()} == {0.5}
    assert toxicity.score(df.limit(0), fitted).count() == 0


def test_signature_agreement_is_weighted_jaccard():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(20):
        items, a = rng.integers(0, 2 ** 63, 60).astype(np.uint64), rng.integers(1, 12, 60)
        b = np.maximum(0, a + rng.integers(-3, 4, 60))
        one, two = neardup.signatures([np.sort(np.repeat(items, a)), np.sort(np.repeat(items, b))], 1000)
        off.append((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.03


def near_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(6, 150))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts + ["one two", "One  TWO", "one", "", "", None, "x y z a b " * 50, "x y z a b " * 55, LONG, LONG + " end"]


@pytest.mark.parametrize("docs_in_task,shingles_in_task", [(400, 2_000_000), (4, 2_000_000), (400, 300)])
def test_near_duplicates(spark, monkeypatch, docs_in_task, shingles_in_task):
    monkeypatch.setattr(neardup, "GROUP_DOCS", docs_in_task)
    monkeypatch.setattr(neardup, "GROUP_SHINGLES", shingles_in_task)
    texts = near_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, texts[0]), rows[0]], "doc_id long, text string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    got = {r["doc_id"]: (r["class_id"], r["group_id"]) for r in neardup.classes(df).collect()}

    def bag(t):
        w = (t or "").lower().split()
        return Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()

    bags, parent = [bag(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            if bags[i] and shared >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - shared):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    assert {i: g for i, (_, g) in got.items()} == dict(enumerate(parent))
    assert all(got[i][0] == min([j for j in range(len(texts)) if bags[j] == bags[i] and bags[i]] or [i]) for i in got)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(parent) | {None}
    assert neardup.classes(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(900, k) for k in range(901, 990)] + [(k, k + 1) for k in range(2000, 2040)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}
    for a, b in edges:
        old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
        parent = {n: new if p == old else p for n, p in parent.items()}
    assert all(parent[n] == r for n, r in got.items()) and {n for n, p in parent.items() if list(parent.values()).count(p) > 1} <= set(got)


def test_suffix_automaton_against_substrings():
    rng = random.Random(9)
    text = "".join(rng.choice("abc ") for _ in range(300))
    automaton = langid.SuffixAutomaton(text)
    for _ in range(200):
        word = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12)))
        count, at = 0, 0
        while at < len(word):
            n = 1
            while at + n < len(word) and word[at:at + n + 1] in text:
                n += 1
            at, count = at + n, count + 1
        found = automaton.phrases(word)
        assert found >= count and (set(word) <= set(text)) <= (found == count), word


def test_language(spark, docs, none):
    rng = random.Random(4)
    vocabulary = {"aa": "kato mero silu tavo".split(), "bb": "xprz wyngth brogg flund".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    more = [(900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, "KATO mero! " * 3000, None), (904, "brogg, flund", None), (904, "brogg, flund", None)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string").withColumns({k: F.lit(v) for k, v in CLASH.items()})
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(df, df.filter("doc_id % 2 < 2 and doc_id < 40")).collect()]
    by_id = {i: lang for i, lang, _ in got}
    assert len(got) == 86 and all(by_id[i] == lang for i, _, lang in rows) and all(0 <= s <= 1 for *_, s in got)
    assert [by_id[i] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "aa", "bb"]
    assert {r["lang_pred"] for r in langid.predict(df, df.limit(0)).collect()} == {"und"} and langid.predict(none, df).count() == 0


def test_bounded_sample(spark):
    df = spark.range(5000).withColumn("k", F.when(F.col("id") < 4900, "big").otherwise("small"))
    assert 400 < bounded_sample(df, "id", 500).count() < 600
    assert bounded_sample(df, "id", 200, by="k").filter("k = 'small'").count() == 100


HIDDEN = ["a$$", "a55", "idi07", "1d107", '"1diot"', '"$tupid"', "lo-ser", "lo.ser", "lo_ser", "an id iot", "st u pid", "l,o,s,e,r", "l/o/s/e/r", "l    o    s    e    r",
          "idiioot", "y0u_are_a_m0r0n_and_a_l0s3r_" * 3, "x" * 60 + "_m0r0n"]


def test_every_disguise_reaches_the_lattice():
    bad = "idiot loser moron stupid ass".split()
    counted = toxicity.count_trigrams(" ".join(bad * 20 + "the and of clown this you are a thing with other people an id".split() * 20))
    one = toxicity.Scorer(toxicity.Fitted(tuple(sorted(counted.items())), tuple(("=" + w, 1.0) for w in bad), 0.0))
    assert [t for t in HIDDEN if not one.features(t)] == []
    assert [t for t in ("a thing", "the an", "2.0 by-nc", "good", "people!!!") if one.features(t)] == []


def test_character_model_counts_every_text(spark):
    texts = ["Über alles", "x" * 50 + " a", None, "l0ser, été", ""] + [f"word{chr(97 + i % 26)}z" for i in range(3000)]
    words = Counter(w for t in texts for w in toxicity.WORDS.findall((t or "").lower()))
    want = Counter()
    for word, n in words.items():
        for k in range(2, len(word) + 3):
            want[f"  {word} "[k - 2:k + 1]] += n
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["gram"]: r["n"] for r in toxicity.trigrams(df.repartition(3)).collect()} == want


def test_main_text_under_many_wrappers():
    wrap = "<div class='section'><div class='row'><div class='column'><div class='box'><div class='inner'><div>"
    parts = [f"Paragraph {i}, of one article, that runs on, with commas, for well over a hundred letters, so that it counts as text, number {i}." for i in range(4)]
    page = "<body><div><nav><a href='/'>home</a></nav><div>" + "".join(f"{wrap}<p>{t}</p>{'</div>' * 6}" for t in parts) + "</div></div><footer>me</footer></body>"
    assert html.extract(page) == " ".join(parts)


def test_mixing_keeps_true_weights_over_many_frames(spark):
    weights = {"a": 0.6037, "b": 0.3953, "c": 0.001}
    rows = [(i, "a") for i in range(12000)] + [(i, "b") for i in range(12000, 20000)] + [(i, "c") for i in range(20000, 20100)]
    slots = {r["slot"]: r["source"] for r in mixing.schedule(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_docs=1).collect()}
    assert sorted(slots) == list(range(20100))
    done, worst = Counter(), 0.0
    for t in range(19000):  # all sources last so long
        done[slots[t]] += 1
        worst = max([worst, *(abs(done[s] - w * (t + 1)) for s, w in weights.items())])
    assert worst < 2.5


def test_personal_data_is_learnt_from_every_text(spark):
    rng = random.Random(3)
    one = f"pay 4{rng.randrange(10 ** 14):014d}1 now"
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(one).alias("text"))
    got = pii.examples(df).groupBy("k").agg(F.sum("n").alias("n")).collect()
    assert got and {r["n"] for r in got} == {30_000}  # a sample of 20,000 documents before


def test_packing_follows_the_order_of_files(spark, tmp_path):
    """Mixed documents, written and read: neighbours share sequences, and sequence ids rise with the mix, whatever order tasks read files in."""
    rows = [(i, "w " * (3 + i % 9), "ab"[i < 900]) for i in range(1200)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), {"a": 0.5, "b": 0.5}, block_docs=1)
    mixed.write.parquet(str(tmp_path / "mixed"))
    docs = spark.read.parquet(str(tmp_path / "mixed")).withColumn("place", mixing.file_order())
    order = [r["doc_id"] for r in docs.orderBy("place").collect()]
    assert sorted(order) == list(range(1200)) and all(rows[a][2] != rows[b][2] for a, b in zip(order[:500], order[1:500]))
    parts = stored(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=64, place_col="place", keep=50))
    got = packing.pack(parts, capacity=64, island_rows=100).collect()
    assert len(got) == 1200 and len({(r["sequence_id"], r["offset"]) for r in got}) == 1200
    place, filled = {doc: k for k, doc in enumerate(order)}, {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], place[r["doc_id"]]))
    for sequence, parts in filled.items():
        parts.sort()
        assert [x[0] for x in parts] == [sum(y[1] for y in parts[:k]) for k in range(len(parts))] and sum(x[1] for x in parts) <= 64
        assert [x[2] for x in parts] == sorted(x[2] for x in parts) and parts[0][2] == sequence
    assert sum(x[-1][2] - x[0][2] for x in filled.values()) < 300 * len(filled)  # dealt by hash they reach over some 900
    assert len(filled) <= 1.05 * sum(r["length"] for r in got) / 64 + 1
