"""All queries outside the training-data subpackage."""

from __future__ import annotations

from bytegrove.plans import graph, problems, scans

QUERIES = {**problems.QUERIES, **graph.QUERIES, **scans.QUERIES}
ORACLE = {**problems.ORACLE, **graph.ORACLE, **scans.ORACLE}
