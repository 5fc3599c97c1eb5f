"""Graph snapshots in buckets: an overlay rewrites the buckets that it touches, and a manifest says which version of each bucket a snapshot consists of.

Edges are dealt into buckets by relation type and, within it, by key, nodes by id; a bucket of a version is one folder that never changes. A snapshot
is there once its manifest is written, so a failed job leaves the last one whole, and old ones stay readable.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.graph import EDGE_KEY, upsert_edges, upsert_entities
from factloom.session import stored

TYPE_PARTS, KEY_PARTS, NODE_BUCKETS = 16, 16, 64
MANIFEST = "kind string, bucket int, written int, v int"


def edge_bucket() -> Column:
    by_type, by_key = F.pmod(F.xxhash64("relation_type"), F.lit(TYPE_PARTS)), F.pmod(F.xxhash64(*EDGE_KEY), F.lit(KEY_PARTS))
    return (by_type * KEY_PARTS + by_key).cast("int")


def node_bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(NODE_BUCKETS)).cast("int")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[tuple[str, int], int]]:
    """The newest version (or the given one), and of each (kind, bucket) the version that wrote it; a few hundred numbers. (0, {}) before the first."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
        version = version or rows.agg(F.max("v")).first()[0] or 0
    except AnalysisException:
        return 0, {}
    return version, {(r["kind"], r["bucket"]): r["written"] for r in rows.filter(F.col("v") == version).collect()}


def _read(spark: SparkSession, path: str, kind: str, known: dict[tuple[str, int], int], wanted: set[int] | None = None) -> DataFrame | None:
    folders = [f"{path.rstrip('/')}/{kind}/v={written}/bucket={bucket}" for (k, bucket), written in sorted(known.items()) if k == kind and (wanted is None or bucket in wanted)]
    return spark.read.parquet(*folders) if folders else None


def write_graph(entities: DataFrame, edges: DataFrame, path: str, mode: str) -> dict[str, list[int]]:
    """Write the next snapshot and return the buckets written. ``rebuild`` replaces all edges, ``overlay`` merges them into those there; nodes are merged in both.

    Edges carry ``seq``, unique within their table.
    """
    if mode not in ("rebuild", "overlay"):
        raise ValueError(f"unknown mode {mode}")
    spark, root = entities.sparkSession, path.rstrip("/")
    version, known = manifest(spark, root)
    written: dict[str, list[int]] = {}
    for kind, given, bucket, merge in (("entities", entities, node_bucket(), upsert_entities), ("edges", edges, edge_bucket(), upsert_edges)):
        if kind == "edges" and mode == "rebuild":
            known = {key: v for key, v in known.items() if key[0] != kind}
        rows = stored(given.withColumn("bucket", bucket), kind)
        written[kind] = touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())
        new, base = rows.drop("bucket"), _read(spark, root, kind, known, set(touched))
        if base is not None:
            new = merge(base, new.select(*base.columns))
        # a bucket may hold very many edges, so each is several tasks
        new.withColumn("bucket", bucket).repartition("bucket", *(EDGE_KEY if kind == "edges" else ["id"])).write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/{kind}/v={version + 1}")
        known.update({(kind, b): version + 1 for b in touched})
    listed = [(kind, bucket, v) for (kind, bucket), v in sorted(known.items())]
    spark.createDataFrame(listed, "kind string, bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/v={version + 1}")
    return written


def read_graph(spark: SparkSession, path: str, relation_types: list[str] | None = None, version: int | None = None) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(entities, edges, version) of the newest snapshot or the given one; None for what is empty, version 0 before the first.

    With ``relation_types`` only the buckets of those types are opened.
    """
    version, known = manifest(spark, path, version)
    wanted = None
    if relation_types is not None:
        parts = spark.range(1).select(F.explode(F.array(*map(F.lit, relation_types))).alias("relation_type")).select(F.pmod(F.xxhash64("relation_type"), F.lit(TYPE_PARTS)))
        wanted = {int(r[0]) * KEY_PARTS + k for r in parts.collect() for k in range(KEY_PARTS)} if relation_types else set()
    edges = _read(spark, path, "edges", known, wanted)
    if edges is not None and relation_types is not None:
        edges = edges.filter(F.col("relation_type").isin(relation_types))
    return _read(spark, path, "entities", known), edges, version
