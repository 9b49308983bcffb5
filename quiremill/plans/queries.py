"""Importing this module fills the registry."""

from . import (catalog_queries, font_queries, frame_queries, glyph_queries, layout_queries, stream_queries,  # noqa: F401
               table_queries, text_queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
