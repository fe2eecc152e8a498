"""How the driver's tables become collections, and texts become queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]


def session(spark: SparkSession, sf_dir: str, *names: str, observe: bool = False) -> Session:
    """The tables as collections; `props` of events, JSON text, as a document: of the type that its users declare, or with observe of the one that a pass over all rows finds."""
    s = Session(spark)
    for name in names:
        s.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), {"props": None if observe else "k bigint"} if name == "events" else None)
    return s


def named(*texts: str) -> list[str]:
    """The tables whose names stand in the texts: others needn't be looked at."""
    words = set(re.findall(r"\w+", " ".join(texts)))
    return [t for t in TABLES if t in words]


def dialect(sql: str, params: tuple = ()) -> Query:
    """A path with a wildcard or a star goes over whatever fields there are."""
    observe = ".*" in sql
    return lambda spark, sf_dir: session(spark, sf_dir, *named(sql), observe=observe).query(sql, params)


def script(*statements: str, then: str) -> Query:
    """Statements that change collections, and the query that shows what they left."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, *named(*statements, then))
        for x in statements:
            s.execute(x)
        return s.query(then)

    return run
