"""Places for outside models. Each has a default that needs none: a table, a rule, or the input as it is."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_vectors(texts: list[str]) -> list[list[float] | None]:
    """The default embedder: no vector, so that the text is left out of vector search rather than scored as zeros."""
    return [None] * len(texts)


def embedded(df: DataFrame, column: str, embed: Callable[[list[str]], list[list[float] | None]] = no_vectors, batch: int = 100) -> DataFrame:
    """Adds `embedding`, by batches; a text whose batch fails has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(b.schema.get_field_index(column)).to_pylist(), []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    out += embed(part)
                except (ConnectionError, TimeoutError, ValueError):
                    out += [None] * len(part)
            keep = [i for i, n in enumerate(b.schema.names) if n != "embedding"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(out, pa.list_(pa.float32()))], names=[*(b.schema.names[i] for i in keep), "embedding"])

    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if f.name != "embedding"]
    return df.mapInArrow(rows, T.StructType([*kept, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def same(df: DataFrame) -> DataFrame:
    """The default reranker."""
    return df


def pick_by_confidence(answers: DataFrame) -> DataFrame:
    """The default synthesis of two answers to a question: the one of the higher confidence, the first on ties."""
    order = F.struct(confidence(F.col("confidence")).alias("c"), (-F.col("answer")).alias("a"))
    return answers.groupBy("query_id").agg(F.max_by("text", order).alias("text"), F.max_by("confidence", order).alias("confidence"))


def confidence(level: Column) -> Column:
    return F.when(F.lower(level) == "high", 3).when(F.lower(level) == "medium", 2).when(F.lower(level) == "low", 1).otherwise(0)


@dataclass(frozen=True)
class Providers:
    """What an application plugs in."""

    embed: Callable = no_vectors
    rerank: Callable[[DataFrame], DataFrame] = same
    expand: Callable[[DataFrame], DataFrame] = same
    synthesise: Callable[[DataFrame], DataFrame] = pick_by_confidence
    page_offset: int = 0
    routes: dict[int, dict[str, list[str]]] = field(default_factory=dict)
