"""Schemas, domains and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _INT, _DBL, _BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MENTION = _struct(name=_STR, sent_id=_INT, pos=T.ArrayType(_INT), type=_STR)
LABEL = _struct(r=_STR, h=_INT, t=_INT, evidence=T.ArrayType(_INT))
DOC = _struct(title=_STR, sents=T.ArrayType(T.ArrayType(_STR)),
              vertexSet=T.ArrayType(T.ArrayType(MENTION)), labels=T.ArrayType(LABEL))
_END = _struct(id=_STR, name=_STR, type=_STR)
TRIPLE = _struct(
    head=_END, relation=_struct(id=_STR, name=_STR, code=_STR), tail=_END, confidence=_DBL,
    source=_struct(document_id=_STR, sentence_id=T.ArrayType(_INT), is_revised=_BOOL),
    evidence=T.ArrayType(_STR), evidence_source=_STR,
    filter=_struct(band=_STR, action=_STR, llm_reason=_STR))
ENTITIES = _struct(id=_STR, name=_STR, type=_STR, aliases=T.ArrayType(_STR))
VECTOR_METADATA = _struct(
    head_id=_STR, head_name=_STR, head_type=_STR, relation_id=_STR, relation_name=_STR, tail_id=_STR, tail_name=_STR,
    tail_type=_STR, confidence=_DBL, split=_STR, document=_STR, sentence_id=T.ArrayType(_STR), evidence_source=_STR,
    is_revised=_BOOL)
VECTOR_RECORD = _struct(id=_STR, text=_STR, metadata=VECTOR_METADATA)

FLAT_COLUMNS = ("head_id head_name head_type relation_id relation_name relation_type tail_id tail_name tail_type "
                "confidence split document sentence_id evidence evidence_source is_revised").split()
TYPE_NAME_PATTERN = "^[A-Z][A-Z0-9_]*$"
ENTITY_TYPES = ("PER", "ORG", "LOC", "TIME", "NUM", "MISC")

# Fixed values the results depend on.
SEEDS_PER_MENTION = 3
MAX_HOPS = 5
FACTS_PER_HOP = 60
HUB_DEGREE = 40
RERANK_TOP_K = 80
FUZZY_CUTOFF = 80
BASELINE_HOPS, BASELINE_FACTS = 3, 200
HIGH_CONFIDENCE, LOW_CONFIDENCE = 0.95, 0.80
PRUNE_RATES = (0.10, 0.25, 0.50)
GAMMA_GRID = (-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0)
THRESHOLD_GRID = (0.3, 0.4, 0.5, 0.6, 0.7)
FUNCTIONAL_RELATIONS = ("DATE_OF_BIRTH", "INCEPTION", "PLACE_OF_BIRTH", "DISSOLVED_ABOLISHED_OR_DEMOLISHED")
FUNCTIONAL_FOR_MERGE = (
    "DATE_OF_BIRTH", "DATE_OF_DEATH", "PLACE_OF_BIRTH", "PLACE_OF_DEATH", "INCEPTION",
    "DISSOLVED_ABOLISHED_OR_DEMOLISHED", "HEADQUARTERS_LOCATION", "COUNTRY", "CAPITAL", "CAPITAL_OF")
HIERARCHY_RELATIONS = ("PARENT_ORGANIZATION", "SUBSIDIARY", "OWNED_BY", "PART_OF")
GEO_RELATIONS = (
    "LOCATED_IN_THE_ADMINISTRATIVE_TERRITORIAL_ENTITY", "COUNTRY", "COUNTRY_OF_CITIZENSHIP",
    "CONTAINS_ADMINISTRATIVE_TERRITORIAL_ENTITY", "COUNTRY_OF_ORIGIN", "APPLIES_TO_JURISDICTION", "CONTINENT",
    "HAS_PART", "PART_OF", "TERRITORY_CLAIMED_BY", "BASIN_COUNTRY")
RELATION_GROUPS = (("HEAD_OF_STATE", "HEAD_OF_GOVERNMENT"), ("PRODUCT_OR_MATERIAL_PRODUCED", "MANUFACTURER"))
LEGAL_SUFFIXES = (r"Incorporated", r"Inc\.?", r"Corporation", r"Corp\.?", r"Limited", r"Ltd\.?", r"L\.L\.C\.", r"LLC",
                  r"GmbH", r"Oyj", r"PLC", r"Plc", r"plc", r"AG")
