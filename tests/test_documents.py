import gzip
import json

from pyspark.sql import functions as F

from factloom.operators import docmodel as dm
from factloom.operators import evidence as ev
from factloom.sources import readers


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_gzip_split_and_missing_labels(spark, docs, tmp_path):
    with gzip.open(tmp_path / "train.json.gz", "wt") as f:
        json.dump([{"title": "z", "sents": [["a"]], "vertexSet": []}], f)
    both = readers.load_docs(spark, ["train"], {"train": str(tmp_path / "train.json.gz")})
    assert rows(both, "title", "split") == [("z", "train")]
    assert both.first()["labels"] is None
    assert dm.labels(both).count() == 0
    relations = spark.createDataFrame([("P1", "made")], "code string, name string")
    out = {r["doc"]: r["labels"] for r in readers.normalise_labels(docs, relations).collect()}
    assert out["unlabelled"] == []
    assert [(x["relation_id"], x["relation_text"]) for x in out["given"]] == [("P1", "made"), ("P2", "P2")]


def test_evidence_cascade(docs):
    ments, labs = dm.mentions(docs), dm.labels(docs)
    out = {(r["doc"], r["label_no"]): (r["ids"], r["source"]) for r in ev.resolve_evidence(labs, ments).collect()}
    assert out == {
        ("given", 0): ([0, 9], "annotated"), ("given", 1): ([1], "inferred_cooccurrence"),
        ("bridge", 0): ([0, 2], "inferred_bridge"), ("tie", 0): ([0, 2], "inferred_bridge"), ("apart", 0): ([], "unresolved_multihop")}
    texts = ev.with_evidence_text(ev.resolve_evidence(labs, ments), ["doc", "label_no"], dm.sentences(docs))
    got = {(r["doc"], r["label_no"]): r["texts"] for r in texts.collect()}
    assert got[("given", 0)] == ["Ada built Lovelace Works ."]  # the id beyond the document is dropped
    assert got[("apart", 0)] == []


def test_prediction_cascade_trusts_a_stored_source(docs):
    preds = dm.labels(docs).withColumn("evidence_source", F.when(F.col("doc") == "tie", "inferred_bridge"))
    out = {(r["doc"], r["label_no"]): (r["ids"], r["source"]) for r in ev.resolve_prediction_evidence(preds, dm.mentions(docs)).collect()}
    assert out[("given", 0)] == ([0, 9], "model_provided")
    assert out[("tie", 0)] == ([], "inferred_bridge")
    assert out[("apart", 0)] == ([0, 1], "inferred_mention_union")


def test_canonical_ties(docs):
    out = {(r["doc"], r["entity"]): (r["name"], r["type"]) for r in dm.canonical(dm.mentions(docs)).collect()}
    assert out[("names", 0)] == ("one", "PER")
    assert out[("given", 1)] == ("Lovelace Works", "ORG")  # whitespace variants count together


def test_nested_mentions_overlap(docs):
    cats = {(r["doc"], r["h"], r["t"]): r["category"] for r in dm.edge_category(dm.mentions(docs)).collect()}
    assert cats[("unlabelled", 0, 1)] == 2 and cats[("given", 0, 1)] == 1
    assert ("apart", 0, 1) not in cats


def test_markers_shift_spans(docs):
    marked = dm.marked_tokens(dm.sentences(docs), dm.mentions(docs))
    text = {(r["doc"], r["sent_id"]): (r["text"], r["start"], r["end"]) for r in dm.marked_sentences(marked).collect()}
    assert text[("given", 0)] == ("* Ada * built * Lovelace Works * .", 0, 9)
    assert text[("given", 1)][1] == 9
    spans = {(r["doc"], r["entity"], r["mention"]): (r["start"], r["end"]) for r in dm.marked_spans(marked, dm.mentions(docs)).collect()}
    assert spans[("given", 1, 0)] == (4, 8)


def test_pair_graph_golden(spark):
    pairs = spark.createDataFrame([(1, a, b) for a in range(3) for b in range(3) if a != b], "doc long, h int, t int")
    edges = {(r["h1"], r["t1"], r["h2"], r["t2"], r["edge_type"]) for r in dm.pair_graph(pairs).collect()}
    assert (0, 2, 0, 1, "same_head") in edges and (0, 2, 1, 2, "same_tail") in edges and (0, 1, 1, 2, "bridge") in edges
    assert not any(e[:2] == e[2:4] for e in edges)


def test_sub_document_reindexes(docs, spark):
    keep = spark.createDataFrame([("bridge", 2), ("bridge", 3)], "doc string, sent_id int")
    sents, ents, ments = dm.sub_document(keep, dm.mentions(docs))
    assert rows(sents, "sent_id", "new_sent_id") == [(2, 0), (3, 1)]
    assert rows(ents, "entity", "new_entity") == [(1, 0), (2, 1)]
    assert rows(ments, "entity", "sent_id", "name") == [(0, 0, "Bob"), (0, 1, "Bob"), (1, 0, "Kent"), (1, 1, "Kent")]


def test_span_mass_over_long_and_empty_spans(spark):
    weights = spark.createDataFrame([(1, p, 1.0) for p in range(500)], "doc long, position long, weight double")
    spans = spark.createDataFrame([(1, 0, 500), (1, 63, 65), (1, 7, 7)], "doc long, start long, end long")
    assert rows(dm.span_mass(weights, spans, ["doc"], block=64), "start", "mass") == [(0, 500.0), (7, 0.0), (63, 2.0)]


def test_tolerant_jsonl(spark, tmp_path):
    good = {"id": "a", "text": "t", "metadata": {"head_id": "h"}}
    (tmp_path / "v.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps({"id": "b"}), json.dumps({**good, "id": "c"})]))
    records, rejects = readers.read_jsonl(spark, str(tmp_path / "v.jsonl"))
    assert sorted(r["id"] for r in records.collect()) == ["a", "c"]
    assert sorted(r["line"] for r in rejects.collect()) == [json.dumps({"id": "b"}), "{broken"]


def test_predictions_and_unknown_documents(spark, docs, tmp_path):
    import pytest
    triple = {"head": {"id": "E0", "name": "x", "type": "PER"}, "relation": {"id": "R1", "name": "r", "code": "P1"}, "tail": {"id": "E1", "name": "y", "type": "ORG"},
              "confidence": 0.9, "source": {"document_id": "nowhere", "sentence_id": [0], "is_revised": False}, "evidence": []}
    (tmp_path / "p.json").write_text(json.dumps([triple]))
    preds = readers.read_predictions(spark, str(tmp_path / "p.json")).withColumn("doc", F.col("source.document_id"))
    assert preds.first()["evidence_source"] is None
    with pytest.raises(ValueError, match="nowhere"):
        readers.assert_known_docs(preds, docs)


def test_global_positions_are_dense(spark):
    from factloom.functions.ordering import running_total, with_position
    df = spark.range(1000).withColumn("k", F.lit(1))
    got = with_position(df, ["id"]).select("id", "position").collect()
    assert all(r["id"] == r["position"] for r in got)
    total = running_total(df, ["k"], "id", F.lit(2), "before", block=64).select("id", "before").collect()
    assert all(r["before"] == 2 * r["id"] for r in total)


def test_windows_cover_every_position(spark):
    rows = spark.createDataFrame([(n, n) for n in (0, 1, 4, 5, 8, 9, 13, 100)], "doc int, n_tokens int")
    spans = {}
    for r in dm.overlap_windows(rows, 4).collect():
        spans.setdefault(r["doc"], []).append((r["window"], r["start"], r["end"]))
    assert spans[0] == [(0, 0, 0)] and spans[4] == [(0, 0, 4)] and spans[5] == [(0, 0, 4), (1, 1, 5)] and spans[8] == [(0, 0, 4), (1, 4, 8)]
    for n, found in spans.items():
        assert {p for _, a, b in found for p in range(a, b)} == set(range(n)) and [w for w, _, _ in found] == list(range(len(found)))


def test_stored_texts_stay(spark, docs):
    schema = "doc string, label_no int, h int, t int, evidence array<int>, evidence_source string, stored_texts array<string>"
    preds = spark.createDataFrame([("given", 0, 0, 1, [], None, ["as edited"]), ("given", 1, 0, 1, [1], None, []), ("given", 2, 0, 2, [], None, None)], schema)
    rows = ev.with_evidence_text(ev.resolve_prediction_evidence(preds, dm.mentions(docs)), ["doc", "label_no"], dm.sentences(docs))
    got = {r["label_no"]: (r["ids"], r["source"], r["texts"]) for r in rows.collect()}
    assert got[0] == ([], "model_provided", ["as edited"])
    assert got[1] == ([1], "model_provided", ["Lovelace Works sits in York ."])
    assert got[2][1].startswith("inferred") and got[2][0] == [0, 1] and len(got[2][2]) == 2


def test_json_lines_limit_follows_the_file(spark, tmp_path):
    lines = [json.dumps({"id": str(i), "text": "t", "metadata": {"document": "d"}}) for i in range(50)]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    records, _ = readers.read_jsonl(spark, str(tmp_path / "r.jsonl"), limit=7)
    assert sorted(int(r["id"]) for r in records.collect()) == list(range(7))
