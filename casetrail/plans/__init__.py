"""Questions asked of the given tables, each with the SQL that answers the same."""

from casetrail.plans import checks, gate, gate_forms, graph, money, people, streams, writing  # noqa: F401  (registers)
from casetrail.plans.registry import ORACLE, QUERIES  # noqa: F401
