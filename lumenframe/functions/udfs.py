"""User functions: a registry by name, and Arrow-batched examples of each kind.

A name that has a built-in equal is mapped to it, so calls stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Function names that built-in expressions replace.
BUILT_IN = {"urldecoder": F.url_decode, "urlencoder": F.url_encode, "sha256": lambda c: F.sha2(c, 256)}


def call(name: str, *columns: Column) -> Column:
    """The built-in of that name if there is one, else the registered function."""
    built_in = BUILT_IN.get(name.lower())
    return built_in(*columns) if built_in else F.call_function(name, *columns)


def register(spark: SparkSession) -> None:
    """Makes the mapped names callable from SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION UrlDecoder(s STRING) RETURNS STRING RETURN url_decode(s)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION UrlEncoder(s STRING) RETURNS STRING RETURN url_encode(s)")


@F.pandas_udf(T.DoubleType())
def plus_tax(price: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 + tax)


@F.pandas_udf(T.DoubleType())
def halved(x: pd.Series) -> pd.Series:
    return x / 2


@F.pandas_udf(T.DoubleType())
def doubled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Takes an iterator, so that costly preparation is done once per task."""
    for x in batches:
        yield x * 2


@F.pandas_udf(T.DoubleType())
def mean_of(x: pd.Series) -> float:
    return float(x.mean())


@F.udf(T.StringType())
def initials(name: str | None) -> str | None:
    return None if name is None else "".join(w[0] for w in name.split())


@F.udtf(returnType="word string, place int")
class Words:
    """Rows of a text's words."""

    def eval(self, text: str):
        for place, word in enumerate((text or "").split(" ")):
            yield word, place
