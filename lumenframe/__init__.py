"""lumenframe: an analytics engine expressed entirely in Spark DataFrames and SQL."""

from lumenframe.session import configure, get_spark

__all__ = ["configure", "get_spark"]
