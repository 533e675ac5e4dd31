"""The policies: one row each, replaced as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schemas import TABLES
from ..state import State


def update_policy(state: State, name: str, **values) -> State:
    """Give columns of a policy new values; others stay."""
    unknown = set(values) - set(TABLES[name].names) | {"id"} & set(values)
    if unknown:
        raise ValueError(f"{name} has no {', '.join(sorted(unknown))} to set")
    return state.having(**{name: state[name].select(*((F.lit(values[c]) if c in values else F.col(c)).alias(c) for c in TABLES[name].names))})
