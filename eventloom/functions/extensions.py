"""Functions that a user plugs in, for the DataFrame API and for SQL: columns, aggregates and table functions, all on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType

from eventloom.session import reach


class Extensions:
    """Registers functions in a session under plain names; a name that is taken by this object is replaced."""

    def __init__(self, spark: SparkSession):
        reach(spark)
        self.spark, self.functions = spark, {}

    def _add(self, name: str, made):
        if not name.isidentifier():
            raise ValueError(f"not a plain name: {name!r}")
        self.functions[name] = made
        return made

    def column(self, name: str, kind: str, f: Callable[..., pa.Array]):
        """``f`` gets Arrow arrays of a batch and gives one of the same length."""
        def on_arrow(*columns: pa.Array) -> pa.Array:
            return f(*columns)

        return self._add(name, self.spark.udf.register(name, F.arrow_udf(on_arrow, kind)))

    def aggregate(self, name: str, kind: str, f: Callable):
        """``f`` gets the pandas Series of a whole group and gives a scalar; what can be said in built-in aggregates should be, as those combine on the
        map side."""
        return self._add(name, self.spark.udf.register(name, F.pandas_udf(f, kind, PandasUDFType.GROUPED_AGG)))

    def table(self, name: str, kind: str, cls: type):
        """``cls`` has ``eval`` that yields rows for one row's arguments."""
        made = F.udtf(cls, returnType=kind, useArrow=True)
        self.spark.udtf.register(name, made)
        return self._add(name, made)
