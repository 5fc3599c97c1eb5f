"""Op 3. Personal data by candidate gradient boosting, in DataFrame functions only.

Base rules find exact formats. Beside them, generators of high recall propose further spans, which may overlap; boosted trees weigh their format and
context, and a threshold for each kind, calibrated on held-back candidates, selects those that are added. The trees are fitted by
Spark's own boosting on the proposals of all texts and then written out as one SQL expression, so no row leaves its task for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import documents
from factloom.session import stored

KINDS = ["email", "ip", "card", "phone"]
#: The stated base patterns. Possessive where nothing that follows could use what is given back, so that long runs neither overflow the stack nor
#: get read again from each of their letters: an address starts where its run of letters starts, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Proposals: addresses with spelt-out signs, and numbers with any separators.
PROPOSED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[(\[{]\x20?at\x20?[)\]}]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:\x20?(?:\.|[(\[{]\x20?dot\x20?[)\]}]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}+){1,4}+",
    "number": r"(?<![0-9A-Za-z])(?:\+\x20?)?\(?[0-9](?:[\x20()./_-]{0,2}[0-9]){6,22}+(?![0-9A-Za-z])",
}
PROPOSED_HINT = {"email": r"(?i)@|(?:[(\[{]\x20?at\x20?[)\]}]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\.|[(\[{]\x20?dot|\x20dot)", "number": r"[0-9][\x20()./_-]{0,2}[0-9][\x20()./_-]{0,2}[0-9][\x20()./_-]{0,2}[0-9]"}
CONTEXT = 24
BLOCK = 256


def _scan(values: Column) -> Column:
    """Sums of the values before each one; quadratic, so for short arrays only."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum"))
    return F.aggregate(values, start, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum")))["out"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _before(values: Column) -> Column:
    """Sums of the values before each one, for arrays of any length: scans of blocks and of the blocks' totals."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
                         lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
    carried = F.arrays_zip(blocks.alias("part"), _scan(F.transform(blocks, _sum)).alias("base"))
    long = F.flatten(F.transform(carried, lambda z: F.transform(_scan(z["part"]), lambda x: x + z["base"])))
    return F.when(F.size(values) <= BLOCK, _scan(values)).otherwise(long)


def _found(df: DataFrame, name: str, pattern: str, hint: str) -> DataFrame:
    """Adds array ``name`` of (m, s): the matches of ``pattern`` in text and where they start, in code points."""
    none = F.array().cast("array<struct<m:string,s:bigint>>")
    p = F.lit(pattern)
    df = df.withColumn("_m", F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", p, F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_gap", F.when(F.size("_m") > 0, F.transform(F.slice(F.split("text", pattern, -1), 1, F.size("_m")), lambda x: F.length(x).cast("bigint"))))
    df = df.withColumn("_len", F.when(F.size("_m") > 0, F.zip_with("_gap", "_m", lambda g, m: g + F.length(m))))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.zip_with(_before(F.col("_len")), "_gap", lambda b, g: b + g)))
    placed = F.zip_with("_m", "_s", lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    return df.withColumn(name, F.when(F.size("_m") > 0, placed).otherwise(none)).drop("_m", "_gap", "_len", "_s")


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
        F.when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _good(kind: str, m: Column) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    return {"email": F.lit(True), "ip": m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), "card": F.when(n.between(14, 19), _luhn(digits)).otherwise(False),
            "phone": n.between(10, 15)}[kind]


def _base(df: DataFrame) -> DataFrame:
    """Adds an array of (s, e, k) for each kind, k being the place of the kind in the list."""
    for k, kind in enumerate(KINDS):
        df = _found(df, f"_{kind}", BASE[kind], HINT[kind])
        good = F.filter(f"_{kind}", lambda x: _good(kind, x["m"]))
        df = df.withColumn(f"_{kind}", F.transform(good, lambda x: F.struct(
            x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), F.lit(k).alias("k"))))
    return df.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_{kind}") for kind in KINDS]), _order))


def _order(a: Column, b: Column) -> Column:
    def sign(x: Column, y: Column, other: Column) -> Column:
        return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(other)

    return sign(a["s"], b["s"], sign(a["k"], b["k"], sign(a["e"], b["e"], F.lit(0))))


def _features(m: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a proposal, as numbers. None of them repeats a base rule whole."""
    digits, lower = _digits(m), F.lower(before)

    def times(pattern: str) -> Column:
        return F.length(F.regexp_replace(m, f"[^{pattern}]", ""))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return {
        "digits": F.length(digits), "length": F.length(m), "dots": times("."), "dashes": times("-"), "spaces": times(" "), "parens": times("()"),
        "slashes": times("/_"), "plus": flag(m.startswith("+")), "at": times("@"), "letters": times("A-Za-z"), "spelt": flag(m.rlike(r"(?i)\b(?:at|dot)\b")),
        "luhn": flag(F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)), "first": F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)),
        "says_card": flag(lower.rlike(r"card|visa|credit|karte|carte|tarjeta|iban")), "says_phone": flag(lower.rlike(r"tel|phone|call|fax|mobil|handy|whatsapp")),
        "says_mail": flag(lower.rlike(r"mail|contact|write|@")), "says_code": flag(lower.rlike(r"version|isbn|order|invoice|token|id|no\.|nr|#|=|:$")),
        "touches": flag(before.rlike(r"[\p{L}0-9=\"'/_]$") | after.rlike(r"^[\p{L}0-9=\"'/_@]")), "line_start": flag((F.length(before) == 0) | before.endswith("\n")),
    }


NAMES = ["digits", "length", "dots", "dashes", "spaces", "parens", "slashes", "plus", "at", "letters", "spelt", "luhn", "first", "says_card", "says_phone",
         "says_mail", "says_code", "touches", "line_start"]


def _proposals(df: DataFrame) -> DataFrame:
    """Adds array ``_cand`` of (s, e, k, f): overlapping proposals with their feature values; a number may be a card and a phone."""
    for name, pattern in PROPOSED.items():
        df = _found(df, f"_p_{name}", f"(?i){pattern}" if name == "email" else pattern, PROPOSED_HINT[name])

    def described(name: str, k: int, keep) -> Column:
        def one(x: Column) -> Column:
            end = x["s"] + F.length(x["m"])
            before = F.substring(F.col("text"), F.greatest(x["s"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(x["s"], F.lit(CONTEXT)).cast("int"))
            values = _features(x["m"], before, F.substring(F.col("text"), end.try_cast("int") + 1, F.lit(4)))
            return F.struct(x["s"].alias("s"), end.alias("e"), F.lit(k).alias("k"), F.array(*[values[n].cast("double") for n in NAMES]).alias("f"))

        return F.transform(F.filter(f"_p_{name}", lambda x: keep(x["m"])), one)

    def between(low: int, high: int):
        return lambda m: F.length(_digits(m)).between(low, high)

    return df.withColumn("_cand", F.concat(described("email", 0, lambda m: F.lit(True)), described("number", 2, between(12, 19)),
                                           described("number", 3, between(7, 15)))).drop("_p_email", "_p_number")


def _tree_sql(node, values: str) -> str:
    """A fitted tree as nested conditions over the array ``values``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return repr(float(node.prediction()))
    split = node.split()
    return f"if({values}[{split.featureIndex()}] <= {float(split.threshold())!r}, {_tree_sql(node.leftChild(), values)}, {_tree_sql(node.rightChild(), values)})"


def _score_sql(trees: list[str]) -> str:
    """The chance that boosted trees give: the logistic of twice their weighed sum."""
    return f"1 / (1 + exp(-2 * ({' + '.join(trees)})))" if trees else "0D"


class Model:
    """Trees as SQL over a lambda's ``c``, and a threshold for each kind; ``None`` adds nothing."""

    def __init__(self, trees: dict[int, list[str]], thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds


def examples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, label, held, the features and n: how many proposals of all texts have these values. Only proposals are shuffled, as numbers."""
    # the outer form with a filter after it: for the inner one Spark infers a filter on the array, which computes every pattern again many times over
    spans = _proposals(_base(documents(df, id_col, text_col))).select("doc_id", "_base", F.explode_outer("_cand").alias("c")).filter("c IS NOT NULL")
    overlap = F.exists("_base", lambda b: (b["k"] == F.col("c")["k"]) & (b["s"] < F.col("c")["e"]) & (F.col("c")["s"] < b["e"]))
    one = spans.select(F.col("c")["k"].alias("k"), overlap.cast("double").alias("label"), (F.pmod(F.xxhash64("doc_id", F.col("c")["s"]), F.lit(4)) == 0).alias("held"),
                       *[F.col("c")["f"][i].alias(n) for i, n in enumerate(NAMES)])
    return one.groupBy(*one.columns).agg(F.count("*").alias("n"))


def fit(df: DataFrame, precision: float = 0.95, rounds: int = 6, depth: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Boosted trees for each kind of proposal, from the proposals of all texts; equal ones are one row with a weight.

    There are no hand-made labels: a proposal that a base rule of its kind confirms is an example, one that only looks like it a counterexample. The trees learn
    from three quarters of the proposals; on the last quarter the threshold of a kind is the lowest at which all higher scores together
    reach ``precision``. Kinds with one class of examples only get no trees and add nothing.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows_ = stored(examples(df, id_col, text_col), "proposals")
    ready = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows_).cache()
    classes = {(r["k"], r["label"]) for r in ready.filter("not held").select("k", "label").distinct().collect()}
    trees, thresholds = {}, {}
    for k in sorted({k for k, _ in classes}):
        if {(k, 0.0), (k, 1.0)} <= classes:
            # each value of a feature may part the rows: there are far fewer than 1,024 of them
            boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, maxBins=1024, stepSize=0.5, seed=7, cacheNodeIds=False, weightCol="n")
            fitted = boosted.fit(ready.filter(f"k = {k} and not held"))
            trees[k] = [f"{w!r}D * ({_tree_sql(t._java_obj.rootNode(), 'f')})" for t, w in zip(fitted.trees, fitted.treeWeights)]
            scored = rows_.filter(f"k = {k} and held").withColumn("f", F.array(*NAMES)).withColumn("bin", F.floor(F.expr(_score_sql(trees[k])) * 50))
            bins = sorted(((r["bin"], r["n"], r["good"]) for r in scored.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()), reverse=True)
            n = good = 0
            for at, some, right in bins:
                n, good = n + some, good + right
                if good / n >= precision:
                    thresholds[k] = at / 50
    ready.unpersist()
    return Model({k: t for k, t in trees.items() if k in thresholds}, thresholds)


def find(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id, text, ``base`` and ``added``: arrays of (s, e, k) in order of start, then kind, for every row of ``df``.

    Positions count code points, ends are exclusive. Null texts are empty. A proposal is added if its score reaches the threshold of its kind and it overlaps no
    base span; of proposals of one place the likeliest kind stays. Nothing is shuffled: rows stay in the task that scanned them.
    """
    df = _proposals(_base(documents(df, id_col, text_col, *more)))
    cases = " ".join(f"WHEN c.k = {k} THEN {_score_sql([t.replace('f[', 'c.f[') for t in trees])} - {model.thresholds[k]!r}D" for k, trees in model.trees.items())
    margin = f"CASE {cases} ELSE -1D END" if cases else "-1D"
    free = F.filter("_cand", lambda c: ~F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    df = df.withColumn("_free", F.when(F.size("_cand") > 0, free).otherwise(F.array().cast(df.schema["_cand"].dataType)))
    df = df.withColumn("_won", F.expr(f"filter(transform(_free, c -> struct(c.s AS s, c.e AS e, c.k AS k, {margin} AS margin)), c -> c.margin >= 0)"))
    likeliest = F.filter("_won", lambda a: ~F.exists("_won", lambda b: (b["s"] < a["e"]) & (a["s"] < b["e"]) & (
        (b["margin"] > a["margin"]) | ((b["margin"] == a["margin"]) & (b["k"] < a["k"])) | ((b["margin"] == a["margin"]) & (b["k"] == a["k"]) & (b["s"] < a["s"])))))
    added = F.transform(likeliest, lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e"), a["k"].alias("k")))
    df = df.withColumn("added", F.array_sort(added, _order))
    kept = [c for c in df.columns if not c.startswith("_")]
    return df.select(*kept, F.col("_base").alias("base"), *[F.size(f"_{kind}").cast("bigint").alias(f"n_{kind}") for kind in KINDS])


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans. An empty table gives no row, repeated rows a row each."""
    found = find(df, model, id_col, text_col)
    return found.select("doc_id", *[f"n_{kind}" for kind in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.array_sort(F.concat("base", "added"), _order)).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def redact(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by its kind in brackets; of overlapping spans the first counts, and is widened to cover the others.

    All other columns are kept as they are, null texts stay null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    spans = F.array_sort(F.concat("base", "added"), _order)
    found = find(df, model, id_col, text_col, row).withColumn("spans", spans)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"].cast("int") + 1, (x["s"] - acc["at"]).cast("int"))
        piece = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.element_at(names, x["k"] + 1)))).otherwise(acc["out"])
        return F.struct(piece.alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"].cast("int") + 1, F.lit(2 ** 31 - 1))))
    text = F.when(F.col(f"row.`{text_col}`").isNull(), F.lit(None).cast("string")).when(F.size("spans") > 0, done).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns])
