"""Every operator as a named query over the benchmark tables, with its SQL twin."""

from __future__ import annotations

from lowtide.checks import (  # noqa: F401  (importing registers the queries)
    documents,
    functions,
    indicators,
    joins,
    merges,
    quality,
    reports,
    screens,
    sources,
    streams,
    universe,
)
from lowtide.checks.base import REGISTRY

__all__ = ["REGISTRY"]
