"""One registered query for each operator, with production parameters over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, dac, divergence, html, langid, mixing, neardup, packing, phrases, pii, topk, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLE = "{}/{}.parquet"


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in directly addressable files; digests of what the files give back."""
    return dac.digests(spark, spark.read.parquet(TABLE.format(sf_dir, "documents")),
                       public_tokenizers.path("word_bpe_49k.json"), "words", 2)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2,048 tokens."""
    return packing.pack_documents(spark.read.parquet(TABLE.format(sf_dir, "documents")),
                                  public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from three quarters of the documents."""
    docs = spark.read.parquet(TABLE.format(sf_dir, "documents"))
    guessed = langid.predict(docs, docs.filter(~langid.held_out("doc_id", 4, 2)))
    return guessed.select("doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(spark.read.parquet(TABLE.format(sf_dir, "pages")))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the base spans' counts and digest, and all spans."""
    docs = spark.read.parquet(TABLE.format(sf_dir, "documents"))
    return pii.report(docs, pii.fit(docs))


@query
def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector, among all."""
    return ann.nearest(spark.read.parquet(TABLE.format(sf_dir, "embeddings")))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every text, learnt from two thirds of the labels."""
    docs = spark.read.parquet(TABLE.format(sf_dir, "documents"))
    fitted = fit_toxicity(spark, docs, sf_dir)
    return toxicity.score(docs, fitted).select("doc_id", langid.held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def fit_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Fitted:
    labels = spark.read.parquet(TABLE.format(sf_dir, "labels"))
    return toxicity.fit(docs, labels.filter(~langid.held_out("doc_id", 3, 1)))


@query
def op9_exact_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every fiftieth vector, among all."""
    return topk.top_products(spark.read.parquet(TABLE.format(sf_dir, "embeddings")))


ORACLES["op9_exact_top_products"] = topk.oracle()


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixed order of all sources."""
    return mixing.schedule(spark.read.parquet(TABLE.format(sf_dir, "documents")))


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal texts and group of near duplicates."""
    return neardup.classes(spark.read.parquet(TABLE.format(sf_dir, "documents")))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that each overuses."""
    return divergence.audit(spark.read.parquet(TABLE.format(sf_dir, "documents")))


ORACLES["op12_source_divergence"] = divergence.oracle()


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of 2 to 5 words that stick together most."""
    return phrases.collocations(spark.read.parquet(TABLE.format(sf_dir, "documents")))


ORACLES["op13_phrase_collocations"] = phrases.oracle()


#: The filter's rules: the longest that fits a url decides.
URL_RULES = (urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
             urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, else by the regression."""
    return urls.judge(spark.read.parquet(TABLE.format(sf_dir, "pages")), urls.fit(urls.labelled_urls(spark)), URL_RULES)
