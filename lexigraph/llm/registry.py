"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import canonical, groups, leakage, lookalike, mixing, quality, scanned, survivors, variants

#: Imported here, so that a module that cannot be imported fails with this one, where the entry looks for it.
MODULES = (groups, lookalike, survivors, canonical, variants, scanned, leakage, mixing, quality)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
