"""Every query of the library with its oracle."""

from __future__ import annotations

from millrace.plans import aggregates, decisions, joins, logs, scans, telemetry

QUERIES = {}
ORACLES = {}
for _group in (scans.G, aggregates.G, joins.G, logs.G, telemetry.G, decisions.G):
    QUERIES |= _group.queries
    ORACLES |= _group.oracles
