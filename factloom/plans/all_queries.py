"""Importing this module registers every query."""

from factloom.plans import (docmodel_queries, evaluation_queries, evidence_queries, graph_queries, repair_queries,  # noqa: F401
                            retrieval_queries, source_queries)
