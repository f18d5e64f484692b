"""Queries over the given tables, each with its comparison SQL."""

from pagemill.plans.registry import QUERIES, SQL  # noqa: F401
from pagemill.plans import catalogue, changes, crawl, exports, extraction, identity, landing, library, quality, streams  # noqa: F401
