"""All queries of the library, by name, with the SQL that checks them."""

from __future__ import annotations

from trailmark.plans import behaviour, commands, ctx, deps, dlp, graph, hooks, more, stats, streaming, text

MODULES = (stats, behaviour, dlp, graph, deps, text, ctx, streaming, commands, more, hooks)


def queries() -> dict:
    return {name: plan[0] for module in MODULES for name, plan in module.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: plan[1] for module in MODULES for name, plan in module.PLANS.items() if plan[1]}
