"""Registered queries: the operators run over the supplied tables, each with the SQL that checks it."""

from workload import catalog, learning, tables, telemetry, text

CASES = {**catalog.CASES, **telemetry.CASES, **text.CASES, **learning.CASES, **tables.CASES}
