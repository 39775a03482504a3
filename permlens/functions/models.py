"""Hooks for a user's own embedding and re-ranking models over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlens.functions import text as T

# How many texts one model call takes.
EMBED_BATCH = 64
RERANK_BATCH = 4

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[list[str], list[str]], list[float]]


def embed_texts(df: DataFrame, text: str, load: Callable[[], Embed], batch: int = EMBED_BATCH) -> DataFrame:
    """Adds `vector`. `load` runs once per task and returns a function from texts to vectors."""

    @F.pandas_udf("array<float>")
    def embed(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in columns:
            calls = [model(texts.iloc[i : i + batch].tolist()) for i in range(0, len(texts), batch)]
            yield pd.Series([vector for call in calls for vector in call])

    return df.withColumn("vector", embed(text))


def score_pairs(pairs: DataFrame, keys: list[str], load: Callable[[], Score], batch: int = RERANK_BATCH) -> DataFrame:
    """(keys, query, content) to (keys, rerank_score). Each task's passages are sorted by length first, so that one call pads little."""
    names = [*keys, "rerank_score"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for rows in batches:
            calls = [model(rows["query"].iloc[i : i + batch].tolist(), rows["content"].iloc[i : i + batch].tolist()) for i in range(0, len(rows), batch)]
            yield rows[keys].assign(rerank_score=[float(s) for call in calls for s in call])[names]

    ready = pairs.withColumn("_words", T.word_count(F.col("content"))).sortWithinPartitions("_words").select(*keys, "query", "content")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema) + ", rerank_score double"
    return ready.mapInPandas(score, schema)
