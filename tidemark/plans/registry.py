"""All queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans import evaluation, labelling, stores, streams

QUERIES = streams.QUERIES | labelling.QUERIES | evaluation.QUERIES | stores.QUERIES
ORACLE = streams.ORACLE | labelling.ORACLE | evaluation.ORACLE | stores.ORACLE
