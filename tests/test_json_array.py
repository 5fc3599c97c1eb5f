"""The range reader of JSON arrays against the json module."""

import gzip
import json
import random

import numpy as np
import pytest
from pyspark.errors import PythonException

from factloom.schemas import DOC
from factloom.sources import json_array as ja
from factloom.sources.readers import read_docs

NASTY = ['"', "\\", '\\"', "[", "]", "{", "}", ",", "[{\"a\":1}]", "\\\\", "é日本", " ", "\n", "x" * 90, '\\\\\\"', "],[", ""]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choices(NASTY, k=rng.randint(0, 6)))
    if kind < 4:
        return rng.choice([None, True, -1.5e3, 17])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {"".join(rng.choices(NASTY, k=2)): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def dumped(rows, seed):
    rng = random.Random(seed)
    sep = rng.choice([",", " ,\n", ",\n  "])
    return rng.choice(["", " \n"]) + "[" + rng.choice(["", "\n"]) + sep.join(json.dumps(r, ensure_ascii=rng.random() < .5) for r in rows) + rng.choice(["", " "]) + "]" + rng.choice(["", "\n \n"])


def in_order(df):
    return [json.loads(r["value"]) for r in sorted(df.collect(), key=lambda r: (r["path"], r["at"]))]


@pytest.mark.parametrize("seed", range(12))
def test_blocks_cut_anywhere(seed):
    rng = random.Random(seed)
    rows = [value(rng) for _ in range(40)]
    data = dumped(rows, seed).encode()
    for step in (1, 2, 3, 7, 64, 10 ** 6):
        blocks = [data[i:i + step] for i in range(0, len(data), step)]
        assert [json.loads(t) for _, t in ja.elements(iter(blocks), ja.State(), 0, None, "f")] == rows
        whole = np.frombuffer(data, np.uint8)
        turns, outside, _, odd = ja.summary(whole, False)
        assert (turns, outside, odd) == (0, 0, False)


@pytest.mark.parametrize("range_bytes", [5, 64, 1 << 20])
def test_ranges_give_every_element_once(spark, tmp_path, range_bytes):
    expected = []
    for k in range(3):
        rows = [value(random.Random(100 * k + i)) for i in range(25)] if k else []
        expected += rows
        (tmp_path / f"{k}.json").write_bytes(dumped(rows, k).encode())
    assert in_order(ja.read_elements(spark, str(tmp_path / "*.json"), range_bytes)) == expected


def test_one_array_in_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [{"title": f"d{i}", "sents": [["a", '"', "\\"]] * (i % 7), "vertexSet": [], "labels": [{"r": "P1", "h": 0, "t": 1, "evidence": [0]}]} for i in range(2000)]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    with gzip.open(tmp_path / "one.json.gz", "wt") as f:
        json.dump(rows, f)
    plain = ja.read_array(spark, str(tmp_path / "one.json"), DOC, 8192)
    assert plain.select(F.spark_partition_id()).distinct().count() > 8
    assert sorted(map(str, plain.collect())) == sorted(map(str, ja.read_array(spark, str(tmp_path / "one.json.gz"), DOC).collect())) == sorted(
        map(str, spark.read.schema(DOC).option("multiLine", True).json(str(tmp_path / "one.json")).collect()))
    assert read_docs(spark, str(tmp_path / "one.json"), "dev").filter("split = 'dev'").count() == 2000


def test_stream_of_several_gzip_members(spark, tmp_path):
    data = json.dumps([["x" * 5000, i] for i in range(2000)]).encode()
    (tmp_path / "m.json.gz").write_bytes(gzip.compress(data[:70_001]) + gzip.compress(data[70_001:]))
    assert in_order(ja.read_elements(spark, str(tmp_path / "m.json.gz"))) == json.loads(data)


@pytest.mark.parametrize("text", ["  ", "{}", "   {}", '{"a": [1]}', "[1, 2", "[1]]", '["a]', "1, 2]"])
@pytest.mark.parametrize("range_bytes", [2, 1 << 20])
def test_no_whole_array_is_an_error(spark, tmp_path, text, range_bytes):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(PythonException):
        ja.read_elements(spark, str(tmp_path / "bad.json"), range_bytes).collect()


def test_element_that_does_not_parse_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"title": "a"}, {"title" "b"}]')
    with pytest.raises(Exception, match="MALFORMED"):
        ja.read_array(spark, str(tmp_path / "bad.json"), DOC).collect()


def test_small_ranges_share_tasks(spark, tmp_path):
    path = tmp_path / "many.json"
    path.write_text("[" + ",".join(f'{{"id": {i}}}' for i in range(4000)) + "]")
    read = ja.read_elements(spark, str(path), 64)
    assert ja._ranges(spark, str(path), 64).count() > 500
    assert read.rdd.getNumPartitions() <= ja.TASKS_PER_CORE * spark.sparkContext.defaultParallelism  # was a task for each range
    assert [r[0] for r in read.orderBy("at").selectExpr("cast(get_json_object(value, '$.id') AS int)").collect()] == list(range(4000))
