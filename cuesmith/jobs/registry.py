"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import catalog, catalog_files, catalog_streams

QUERIES = {**catalog.QUERIES, **catalog_files.QUERIES, **catalog_streams.QUERIES}
ORACLES = {**catalog.ORACLES, **catalog_files.ORACLES, **catalog_streams.ORACLES}
