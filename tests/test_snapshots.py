"""Bucketed snapshots: what an overlay writes, what stays, and what readers open."""

import random
import shutil

from pyspark.sql import functions as F

from factloom.sources import snapshots as sn


def edges_of(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "head_id string, relation_type string, tail_id string, document string, confidence double, seq long")


def nodes_of(spark, ids, kind="ORG"):
    return spark.createDataFrame([(i, i, kind) for i in ids], "id string, name string, type string")


def content(df):
    return {tuple(r)[:4]: r["confidence"] for r in df.collect()}


def test_overlay_rewrites_touched_buckets_only(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "graph")
    assert sn.read_graph(spark, path) == (None, None, 0)
    rows = [(f"h{rng.randrange(40)}", f"T{i % 12}", f"t{rng.randrange(40)}", f"d{i}", 0.5) for i in range(600)]
    first = sn.write_graph(nodes_of(spark, [f"h{i}" for i in range(40)]), edges_of(spark, rows), path, "rebuild")
    entities, edges, version = sn.read_graph(spark, path)
    assert version == 1 and content(edges) == {r[:4]: r[4] for r in rows} and entities.count() == 40 and edges.count() == 600
    late = [(*r[:4], 0.9) for r in rows if r[1] == "T3"][:4] + [("new", "T3", "t0", "d", 0.1)]
    second = sn.write_graph(nodes_of(spark, ["h1", "new"], "LOC"), edges_of(spark, late), path, "overlay")
    assert 0 < len(second["edges"]) <= 5 < len(first["edges"]) and len(second["entities"]) <= 2
    want = {r[:4]: r[4] for r in rows} | {r[:4]: r[4] for r in late}
    entities, edges, version = sn.read_graph(spark, path)
    assert version == 2 and content(edges) == want and edges.count() == len(want)
    assert {r["id"]: r["type"] for r in entities.collect()} == {f"h{i}": "ORG" for i in range(40)} | {"h1": "LOC", "new": "LOC"}
    known = sn.manifest(spark, path)[1]
    assert {b for (k, b), v in known.items() if k == "edges" and v == 2} == set(second["edges"])
    only = sn.read_graph(spark, path, ["T3", "none"])[1]
    assert content(only) == {k: v for k, v in want.items() if k[1] == "T3"}
    assert len(only.inputFiles()) < len(edges.inputFiles()) / 3
    assert content(sn.read_graph(spark, path, version=1)[1]) == {r[:4]: r[4] for r in rows}
    # the same overlay again changes nothing; a rebuild drops the edges that it lacks and keeps nodes
    sn.write_graph(nodes_of(spark, ["h1", "new"], "LOC"), edges_of(spark, late), path, "overlay")
    assert content(sn.read_graph(spark, path)[1]) == want
    sn.write_graph(nodes_of(spark, []), edges_of(spark, rows[:3]), path, "rebuild")
    entities, edges, version = sn.read_graph(spark, path)
    assert version == 4 and content(edges) == {r[:4]: r[4] for r in rows[:3]} and entities.count() == 41


def test_snapshot_without_manifest_is_not_there(spark, tmp_path):
    path = str(tmp_path / "graph")
    rows = [("a", "T", "b", "d", 0.5)]
    sn.write_graph(nodes_of(spark, ["a", "b"]), edges_of(spark, rows), path, "rebuild")
    sn.write_graph(nodes_of(spark, ["a"]), edges_of(spark, [("a", "T", "b", "d", 0.7)]), path, "overlay")
    shutil.move(f"{path}/manifest/v=2", str(tmp_path / "lost"))  # as if the job had died before it
    assert content(sn.read_graph(spark, path)[1]) == {rows[0][:4]: 0.5}
    sn.write_graph(nodes_of(spark, ["a"]), edges_of(spark, [("a", "T", "b", "d", 0.8)]), path, "overlay")
    assert content(sn.read_graph(spark, path)[1]) == {rows[0][:4]: 0.8}
    assert sn.read_graph(spark, path)[0].filter(F.col("id") == "b").count() == 1
