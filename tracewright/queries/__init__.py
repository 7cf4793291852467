"""The operators as queries over the driver's tables, with the SQL that says the same."""

from . import core, layout
from .base import QUERIES, SQL
from .core import trace_any

__all__ = ["QUERIES", "SQL", "core", "layout", "trace_any"]
