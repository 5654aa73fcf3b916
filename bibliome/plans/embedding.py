"""The upkeep of vectors: which papers need one, in bounded batches, encoded by one model, stored once per paper and model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions import text
from bibliome.functions.embedding import Encoder, embedded
from bibliome.operators import corpus

#: How many pending papers one run looks at, and how many make a batch.
SNAPSHOT, BATCH = 10_000, 32


def pending_papers(papers: DataFrame, vectors: DataFrame, model_key: str, *, limit: int | None = SNAPSHOT) -> DataFrame:
    """papers(id, updated_at), vectors(id, model_key, source_updated_at) -> ids without a vector of this model, or changed since; by id,
    no more than `limit` of them (a run's share: the next run finds the rest)."""
    done = vectors.where(F.col("model_key") == model_key).select("id", "source_updated_at")
    todo = corpus.pending(papers.select("id", "updated_at"), done).orderBy("id")
    return todo if limit is None else todo.limit(limit)


def batches(todo: DataFrame, model_key: str, size: int = BATCH) -> DataFrame:
    """ids -> (batch, ids, dedup_key): so many ids a batch in their order, with a key that is the same for the same batch."""
    numbered = todo.withColumn("n", F.row_number().over(Window.orderBy("id")) - 1)  # a run's bounded share
    each = numbered.groupBy(F.floor(F.col("n") / size).alias("batch")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    key = F.concat(F.lit(f"embed:{model_key}:"), F.substring(F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256), 1, 32))
    return each.select("batch", "ids", key.alias("dedup_key"))


def encoded(papers: DataFrame, ids: DataFrame, encoder: Encoder, model_key: str) -> DataFrame:
    """(id, model_key, text_hash, vector, title_only, source_updated_at) of the wanted papers(id, title, abstract, updated_at). A job
    that asks for another model than the encoder's is an error, not a mixture."""
    if encoder.model_key != model_key:
        raise ValueError(f"the job asks for {model_key!r}, the encoder is {encoder.model_key!r}")
    wanted = papers.join(ids.select("id").distinct(), "id", "left_semi")
    said = wanted.select("id", text.embedding_input(F.col("title"), F.col("abstract")).alias("text"))
    about = wanted.select("id", text.usable_abstract(F.col("abstract")).isNull().alias("title_only"), F.col("updated_at").alias("source_updated_at")).dropDuplicates(["id"])
    return embedded(said.dropDuplicates(["id"]), "id", "text", encoder).join(about, "id")


def refreshed(papers: DataFrame, vectors: DataFrame, encoder: Encoder, *, limit: int | None = SNAPSHOT) -> DataFrame:
    """vectors with those that were pending made anew: one row per paper and model, whatever is run again."""
    todo = pending_papers(papers, vectors, encoder.model_key, limit=limit)
    return corpus.upserted(vectors, encoded(papers, todo, encoder, encoder.model_key).select(*vectors.columns), ["id", "model_key"])


def invariant(vectors: DataFrame, encoder: Encoder) -> DataFrame:
    """Rows that break what an encoder promises: another size, or a length that is neither one nor zero."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return vectors.where(F.col("vector").isNull() | (F.size("vector") != encoder.dimension) | ((F.abs(square - 1) > 1e-3) & (square > 0)))


def merged_statistics(parts: list[Mapping[str, int]]) -> dict[str, int]:
    """Figures of several runs (vectors, title_only, seconds and the like) as one: sums by name."""
    out: dict[str, int] = {}
    for p in parts:
        for k, v in p.items():
            out[k] = out.get(k, 0) + v
    return out
