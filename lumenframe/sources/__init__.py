"""Reading and writing tables."""

from lumenframe.sources.io import register, table, tables
from lumenframe.sources.formats import read, write

__all__ = ["read", "register", "table", "tables", "write"]
