"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from slipweave.catalog.registry import ORACLES, QUERIES
from slipweave.catalog import (  # noqa: F401  registration happens on import
    audits,
    editing,
    fields,
    output,
    reviews,
    routes,
    rulebook,
    searching,
    segmenting,
    shaping,
    spatial,
)

__all__ = ["QUERIES", "ORACLES"]
