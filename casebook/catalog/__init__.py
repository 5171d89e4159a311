from casebook.catalog import access, files, ingest, search, streams, texts, welding
from casebook.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "access", "files", "ingest", "search", "streams", "texts", "welding"]
