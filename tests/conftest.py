import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from factloom.session import build_session
    session = build_session("factloom-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    """Hand-written documents: every evidence branch, ties, odd shapes."""
    import json

    from factloom.sources.readers import read_docs

    def m(name, sent, start, end, kind):
        return {"name": name, "sent_id": sent, "pos": [start, end], "type": kind}

    two = [["Ada", "built", "Lovelace", "Works", "."], ["Lovelace", "Works", "sits", "in", "York", "."]]
    bridge = [["Ann", "met", "Bob", "."], ["It", "rained", "."], ["Bob", "likes", "Kent", "."], ["Bob", "saw", "Kent", "."]]
    rows = [
        {"title": "given", "sents": two, "vertexSet": [[m("Ada", 0, 0, 1, "PER")], [m("Lovelace  Works", 0, 2, 4, "ORG"), m("Lovelace Works", 1, 0, 2, "ORG")],
         [m("York", 1, 4, 5, "LOC")]], "labels": [{"h": 0, "t": 1, "r": "P1", "evidence": [0, 9]}, {"h": 1, "t": 2, "r": "P2", "evidence": []}]},
        # Ann (0) to Kent (2 and 3) over Bob: the nearer sentence wins
        {"title": "bridge", "sents": bridge, "vertexSet": [[m("Ann", 0, 0, 1, "PER")], [m("Bob", 0, 2, 3, "PER"), m("Bob", 2, 0, 1, "PER"), m("Bob", 3, 0, 1, "PER")],
         [m("Kent", 2, 2, 3, "LOC"), m("Kent", 3, 2, 3, "LOC")]], "labels": [{"h": 0, "t": 2, "r": "P1", "evidence": []}]},
        # two bridges at equal distance: the smaller head sentence wins
        {"title": "tie", "sents": [["x"], ["x"], ["x"], ["x"], ["x"]], "vertexSet": [[m("H", 0, 0, 1, "PER"), m("H", 4, 0, 1, "PER")], [m("T", 2, 0, 1, "ORG")],
         [m("Z", 0, 0, 1, "LOC"), m("Z", 2, 0, 1, "LOC"), m("Z", 4, 0, 1, "LOC")]], "labels": [{"h": 0, "t": 1, "r": "P1", "evidence": []}]},
        {"title": "apart", "sents": [["a"], ["b"]], "vertexSet": [[m("A", 0, 0, 1, "PER")], [m("B", 1, 0, 1, "ORG")]], "labels": [{"h": 0, "t": 1, "r": "P9", "evidence": []}]},
        {"title": "unlabelled", "sents": [["a", "b", "c"]], "vertexSet": [[m("a b c", 0, 0, 3, "MISC"), m("b", 0, 1, 2, "MISC")], [m("b c", 0, 1, 3, "LOC")]]},
        # tied names: first seen wins; name and type chosen independently
        {"title": "names", "sents": [["u"]], "vertexSet": [[m("one", 0, 0, 1, "PER"), m("two", 0, 0, 1, "ORG"), m("two", 0, 0, 1, "PER"), m("one", 0, 0, 1, "ORG")]], "labels": []},
        {"title": "empty", "sents": [], "vertexSet": [], "labels": []},
    ]
    path = tmp_path_factory.mktemp("docs") / "dev.json"
    path.write_text(json.dumps(rows))
    return read_docs(spark, str(path), "dev").cache()
