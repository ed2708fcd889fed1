"""Registered queries: each a composition of operators over the tables of a folder, with the SQL that gives its rows."""

from . import changes, ingest, lineage, recall, report, restatement, rules, stateful, transcripts, trust, upkeep  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
