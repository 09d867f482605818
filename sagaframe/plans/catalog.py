"""All queries of the library by name."""

from sagaframe.plans import aggregations, constraints, exports, graphs, interval_queries, joins, nested, rankings, scalars, texts  # noqa: F401
from sagaframe.plans.registry import ORACLES, QUERIES  # noqa: F401
