"""Registered queries over the driver tables, each with its SQL twin where one can be written."""

from siftline.catalog import funnel, gates, ingest, joins, keys, reports, scores, streams  # noqa: F401
from siftline.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
