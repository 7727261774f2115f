"""The query catalogue: every reference operator as a runnable query, with its SQL."""

from __future__ import annotations

from folioforge.plans import editions, evaluation, exchange, guards, judgements, library, lifecycle, relational, retrieval, rules, text, upkeep  # noqa: F401
from folioforge.plans.registry import ORACLES, QUERIES  # noqa: F401
