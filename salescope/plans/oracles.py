"""All DuckDB oracle queries, keyed like the registry, each wrapped in the star-schema prelude."""

from salescope.plans import (oracle_coverage, oracle_growth, oracle_integrated, oracle_order, oracle_patterns, oracle_questions,
                             oracle_reports, oracle_stock, oracle_targets)
from salescope.plans.oracle_base import wrap

_GROUPS = [oracle_stock.ORACLES, oracle_targets.ORACLES, oracle_growth.ORACLES, oracle_coverage.ORACLES,
           oracle_patterns.ORACLES, oracle_integrated.ORACLES, oracle_reports.ORACLES, oracle_questions.ORACLES,
           oracle_order.ORACLES]


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for g in _GROUPS:
        for k, body in g.items():
            out[k] = wrap(body)
    return out
