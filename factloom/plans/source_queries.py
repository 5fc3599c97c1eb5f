"""File readers, each over files that its query writes to the shared folder from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import with_relation_name
from factloom.plans.docmodel_queries import text_sentences
from factloom.plans.registry import query
from factloom.session import shared_folder, stored
from factloom.sources import readers


RANGE_BYTES = 1 << 18  # small, so that the arrays written here are read in several ranges each


def write_arrays(df: DataFrame, path: str, per_file: int, packed: bool = False) -> None:
    """``df`` as files that hold one JSON array each, of about ``per_file`` rows dealt by hash."""
    files = max(1, -(-df.count() // per_file))
    line = F.to_json(F.struct(*df.columns))
    dealt = df.select(F.pmod(F.xxhash64(line), F.lit(files)).alias("file"), line.alias("line"))
    whole = dealt.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("line"), ",\n"), F.lit("]")).alias("value"))
    whole.write.partitionBy("file").option("compression", "gzip" if packed else "none").text(path)


def write_both(df: DataFrame, path: str) -> str:
    """Half of the rows in plain arrays, half in compressed ones; returns the pattern of all files."""
    packed = F.pmod(F.xxhash64(*df.columns), F.lit(2)) == 0
    write_arrays(df.filter(~packed), f"{path}/plain", 2000)
    write_arrays(df.filter(packed), f"{path}/packed", 500, packed=True)
    return f"{path}/*/*/*.txt*"


@query("s1_read_split", """
SELECT cast(s.doc AS varchar) AS doc, 'orders' AS split, s.n AS n_sents, s.text AS first_sent, m.n AS n_mentions, coalesce(l.n, 0) AS n_labels
FROM (SELECT doc, count(*) AS n, min_by(text, sent_id) AS text FROM oc_sentences GROUP BY doc) s
JOIN (SELECT doc, count(*) AS n FROM oc_mentions GROUP BY doc) m ON m.doc = s.doc
LEFT JOIN (SELECT doc, count(*) AS n FROM oc_labels GROUP BY doc) l ON l.doc = s.doc""")
def s1(t):
    path = write_both(stored(t.docs().drop("doc"), "docs"), shared_folder(t.spark, "split"))
    docs = readers.read_docs(t.spark, path, "orders", RANGE_BYTES)
    mentions = F.aggregate("vertexSet", F.lit(0), lambda acc, x: acc + F.size(x))
    return docs.select("doc", "split", F.size("sents").cast("bigint").alias("n_sents"), F.array_join(F.element_at("sents", 1), " ").alias("first_sent"),
                       mentions.cast("bigint").alias("n_mentions"), F.coalesce(F.size("labels"), F.lit(0)).cast("bigint").alias("n_labels"))


@query("s2_load_splits", """
SELECT cast(doc AS varchar) AS doc, split, n_sents, row_number() OVER (ORDER BY cast(doc AS varchar)) <= 500 AS first
FROM (SELECT doc, split FROM oc_splits) JOIN (SELECT doc, count(*) AS n_sents FROM oc_sentences GROUP BY doc) USING (doc)""")
def s2(t):
    """Two splits by their names in a catalog and one by its path, as one union, and which documents the first-n cap keeps."""
    folder = shared_folder(t.spark, "splits")
    tagged = stored(t.docs().join(t.oc_splits, "doc").drop("doc"), "docs")
    for split, name in (("train_annotated", "train.json"), ("dev_revised", "dev.json"), ("test_revised", "test_revised.json")):
        write_arrays(tagged.filter(F.col("split") == split).drop("split"), f"{folder}/{name}", 2000)
    catalog = {"train_annotated": f"{folder}/train.json", "dev_revised": f"{folder}/dev.json"}
    union = readers.load_docs(t.spark, ["train_annotated", "dev_revised", f"{folder}/test_revised.json"], catalog, RANGE_BYTES)
    union = stored(union.select("doc", "split", F.size("sents").cast("bigint").alias("n_sents")), "union")
    capped = readers.first_docs(union.select("doc"), 500).withColumn("first", F.lit(True))
    return union.join(capped, "doc", "left").fillna(False, ["first"])


@query("s3_read_relations", """
WITH d AS (SELECT p_brand AS code, max(p_type) AS name FROM part GROUP BY p_brand)
SELECT p_partkey, c.code, coalesce(name, c.code) AS relation_name
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || 'x' END AS code FROM part) c LEFT JOIN d USING (code)""")
def s3_read(t):
    path = shared_folder(t.spark, "relations")
    entries = F.map_from_entries(F.collect_list(F.struct("code", "name")))
    names = t.part.groupBy(F.col("p_brand").alias("code")).agg(F.max("p_type").alias("name"))
    names.groupBy(F.pmod(F.xxhash64("code"), F.lit(4)).alias("file")).agg(F.to_json(entries).alias("value")).write.partitionBy("file").text(path)
    coded = t.part.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("x"))).alias("code"))
    return with_relation_name(coded, readers.read_relations(t.spark, path), "code").select("p_partkey", "code", "relation_name")


@query("s6_read_sentences", """
SELECT cast(doc_id AS varchar) AS title, cast(pos AS varchar) AS sent_id, sentence, 'table' AS split FROM tx_sentences
UNION ALL SELECT cast(doc AS varchar), cast(sent_id AS varchar), text, 'orders' FROM oc_sentences""")
def s6_read(t):
    path = shared_folder(t.spark, "sentences")
    rows = text_sentences(t).select(F.col("doc_id").alias("title"), F.col("pos").alias("sent_id"), "sentence")
    rows.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_sentences(t.spark, path, "table", t.docs(), "orders")


@query("s7_read_predictions", """
SELECT head_id, relation_type, tail_id, document, confidence, evidence, evidence_source FROM tg_edges""")
def s7(t):
    path = shared_folder(t.spark, "triples")
    end = lambda c: F.struct(F.col(c).alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"))
    triples = t.tg_edges.select(
        end("head_id").alias("head"), F.struct(F.lit("R").alias("id"), F.lit(None).cast("string").alias("name"), F.col("relation_type").alias("code")).alias("relation"),
        end("tail_id").alias("tail"), "confidence", F.struct(F.col("document").alias("document_id")).alias("source"),
        F.array("evidence").alias("evidence"), "evidence_source")
    got = readers.read_predictions(t.spark, write_both(triples, path), RANGE_BYTES)
    return got.select(F.col("head.id").alias("head_id"), F.col("relation.code").alias("relation_type"), F.col("tail.id").alias("tail_id"),
                      F.col("source.document_id").alias("document"), "confidence", F.element_at("evidence", 1).alias("evidence"), "evidence_source")


@query("s8_read_jsonl", """
SELECT 'record' AS kind, head_id || '::' || document AS value, evidence AS text FROM tg_edges
UNION ALL SELECT 'rejected', '{"id": ' || c_custkey, NULL FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'rejected', '{"id":"' || c_custkey || '"}', NULL FROM customer WHERE c_custkey % 5 = 2""")
def s8(t):
    path = shared_folder(t.spark, "records")
    metadata = F.struct("head_id", F.col("relation_type").alias("relation_name"), "tail_id", "document")
    good = t.tg_edges.select(F.to_json(F.struct(F.concat("head_id", F.lit("::"), "document").alias("id"), F.col("evidence").alias("text"),
                                                metadata.alias("metadata"))).alias("value"))
    key = F.col("c_custkey").cast("string")
    bad = t.customer.select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('{"id": '), key))  # broken
                            .when(F.col("c_custkey") % 5 == 2, F.concat(F.lit('{"id":"'), key, F.lit('"}')))  # lacks fields
                            .otherwise(F.lit("  ")).alias("value"))
    good.unionByName(bad).write.text(path)
    records, rejected = readers.read_jsonl(t.spark, path)
    return records.select(F.lit("record").alias("kind"), F.col("id").alias("value"), "text").unionByName(
        rejected.select(F.lit("rejected").alias("kind"), F.col("line").alias("value"), F.lit(None).cast("string").alias("text")))
