"""Registered queries against their oracle SQL at sf0.001. FACTLOOM_ALL=1 runs every one; the default is one per family."""

import os

import pytest

import __spark_entry__ as entry_module
from oracle_check import compare, duck

FOLDER = "/root/testdata/sf0.001"
SOME = ["d16_pair_distance", "e2_evidence_cascade", "g8_upsert_entities", "s17_pack_batches", "q10_relation_lookup", "r5_suffix_candidates",
        "m1_decode_adaptive", "v15_select_run", "a6_evidence_length"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("given tables not here")
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry_module.queries()) if os.environ.get("FACTLOOM_ALL") else SOME)
def test_oracle(spark, con, name):
    problem = compare(spark, con, FOLDER, name, entry_module.queries()[name], entry_module.oracle_sql().get(name))[0]
    assert problem is None, problem


def test_entry(spark):
    assert {r["source"] for r in entry_module.entry(spark).collect()} == {
        "annotated", "inferred_cooccurrence", "inferred_bridge", "unresolved_multihop"}
