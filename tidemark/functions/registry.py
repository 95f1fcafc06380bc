"""Functions of one's own beside the library's: known to `call` and to SQL by name from then on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import library


def register(name: str, builder: Callable[..., Column], plain: tuple[int, ...] = (), replace: bool = False) -> None:
    """A function that builds an expression from columns; arguments in the places `plain` come as Python values.

    Aggregates are registered the same way: their expression holds the aggregate.
    """
    name = name.lower()
    if not replace and (name in library.FUNCTIONS or name in library.AGGREGATES or name in library.WHOLE_COLUMN):
        raise ValueError(f"there is a function {name}")
    library.FUNCTIONS[name] = builder
    if plain:
        library.PLAIN[name] = tuple(plain)


def register_vectorised(spark: SparkSession, name: str, function, kind: str) -> None:
    """A function over pandas Series, in Arrow batches; one that returns a single value is an aggregate by its type
    hints. Known to Spark itself, so to SQL and to call()."""
    made = F.pandas_udf(function, kind)
    spark.udf.register(name, made)
    register(name, made, replace=True)


def register_table_function(spark: SparkSession, name: str, handler, kind: str) -> None:
    """A class whose eval() yields rows, for FROM clauses."""
    spark.udtf.register(name, F.udtf(handler, returnType=kind))


def unregister(name: str) -> None:
    library.FUNCTIONS.pop(name.lower(), None)
    library.PLAIN.pop(name.lower(), None)
