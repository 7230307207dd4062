"""All registered queries, by name."""

from __future__ import annotations

from seriatim.plans import columns, graph, joins, links, listing, routing, sources, stream, visits, works
from seriatim.plans.registry import Run

MODULES = (sources, routing, links, columns, listing, joins, graph, works, stream, visits)


def queries() -> dict[str, Run]:
    return {name: run for module in MODULES for name, run in module.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.REGISTRY.oracle.items()}
