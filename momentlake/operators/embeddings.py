"""Providers of embeddings and the store of vectors, one run for each provider and kind of item."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlake.operators import vectors
from momentlake.sources.tables import upsert


@dataclass(frozen=True)
class Provider:
    """``compute`` makes a column of vectors of a column of texts; a model comes in as a pandas UDF."""

    name: str
    dimension: int
    compute: Callable[[Column], Column]


def null_provider() -> Provider:
    """Empty vectors: whatever is compared with them scores 0."""
    return Provider("null", 0, lambda text: F.array().cast("array<double>"))


def hash_provider(dimension: int = 64) -> Provider:
    return Provider("hash", dimension, lambda text: vectors.hash_embedding(text, dimension))


def model_provider(name: str = "all-MiniLM-L6-v2", dimension: int = 384) -> Provider:
    """Vectors of a sentence model, loaded once in each worker; the library must be installed there."""

    @F.pandas_udf("array<double>")
    def encode(texts):
        import pandas as pd
        from sentence_transformers import SentenceTransformer

        model = _MODELS.setdefault(name, None) or SentenceTransformer(name)
        _MODELS[name] = model
        return pd.Series([[float(x) for x in v] for v in model.encode(texts.tolist(), show_progress_bar=False)])

    return Provider(name, dimension, encode)


_MODELS: dict = {}


def provider(name: str, dimension: int = 64) -> Provider:
    """The provider of this name; one that isn't known is the null provider."""
    return {"hash": hash_provider(dimension), "null": null_provider(), "sentence-transformers": model_provider()}.get(name, null_provider())


def embed(items: DataFrame, p: Provider, item_type: str = "moment") -> DataFrame:
    """vector_id, item_type, item_id, run_id, vector of items (item_id, text); blank texts have none."""
    run, told = f"embed:{p.name}:{item_type}", F.trim(F.coalesce("text", F.lit("")))
    return items.where(told != "").select(
        F.concat(F.lit(f"vec:{item_type}:"), F.col("item_id").cast("string")).alias("vector_id"), F.lit(item_type).alias("item_type"),
        F.col("item_id").cast("string").alias("item_id"), F.lit(run).alias("run_id"), p.compute(told).alias("vector"),
    )


def store(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors of the store with new ones in place of those of the same item."""
    return upsert(old, new, "vector_id")


def runs(stored: DataFrame) -> DataFrame:
    """run_id, provider, dimension, item_count of each run."""
    return stored.groupBy("run_id").agg(F.max(F.split("run_id", ":")[1]).alias("provider"), F.max(F.size("vector")).alias("dimension"), F.count("*").alias("item_count"))


def near(stored: DataFrame, p: Provider, query: str, item_type: str = "moment", k: int = 10) -> DataFrame:
    """item_id, score, rank of the items of a run nearest to a query."""
    own = stored.where((F.col("item_type") == item_type) & (F.col("run_id") == f"embed:{p.name}:{item_type}"))
    numbered = own.select("item_id", F.xxhash64("item_id").alias("vec_id"), F.col("vector").alias("embedding"))
    asked = stored.sparkSession.range(1).select(F.col("id").alias("query_id"), p.compute(F.lit(query)).alias("embedding"))
    found = vectors.cosine_top_k(asked, numbered.drop("item_id"), k)
    return numbered.select("item_id", "vec_id").join(F.broadcast(found), "vec_id").select("item_id", "score", "rank")  # k rows
