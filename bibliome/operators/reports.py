"""Figures about a corpus and about runs over it, and the filling of gaps from a second source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bibliome.functions import taxonomy


def counted(df: DataFrame, **what: Column) -> tuple[DataFrame, Observation]:
    """df with counters that fill while it is written, at no extra pass: what maps names to conditions."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in what.items()]), seen


def identifier_map(identifiers: DataFrame) -> DataFrame:
    """identifiers(paper, id_type, value) -> (paper, identifiers map): of several values of a type the least."""
    one = identifiers.where("value IS NOT NULL").groupBy("paper", "id_type").agg(F.min("value").alias("value"))
    return one.groupBy("paper").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id_type", "value")))).alias("identifiers"))


def field_report(topics: DataFrame, most: int = 40) -> DataFrame:
    """topics(paper, topics array<struct<scheme, value>>) -> (kind, name, papers): papers of each field, of none, and the `most`
    commonest values that map to no field."""
    x = topics.select("paper", taxonomy.fields_of(F.col("topics")).alias("fields"), taxonomy.unmapped(F.col("topics")).alias("odd"))
    per = x.select(F.explode("fields").alias("name")).groupBy("name").agg(F.count("*").alias("papers")).select(F.lit("field").alias("kind"), "name", "papers")
    none = x.where("size(fields) = 0").agg(F.lit("none").alias("kind"), F.lit("").alias("name"), F.count("*").alias("papers"))
    odd = x.select(F.explode("odd").alias("o")).groupBy(F.concat_ws(":", "o.scheme", "o.value").alias("name")).agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "name").limit(most)
    return per.unionByName(none).unionByName(odd.select(F.lit("unmapped").alias("kind"), "name", "papers"))


def vector_coverage(vectors: DataFrame, papers: int) -> DataFrame:
    """vectors(model_key, title_only) -> (model_key, vectors, title_only, coverage): coverage rounded to four digits."""
    return vectors.groupBy("model_key").agg(F.count("*").alias("vectors"), F.count_if("title_only").alias("title_only"), F.round(F.count("*") / F.lit(max(1, papers)), 4).alias("coverage"))


def filled(papers: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """papers with nulls in the columns filled from found (one row per key); what is there stays."""
    other = found.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return papers.join(other, key, "left").select(*[F.coalesce(F.col(c), F.col(f"new_{c}")).alias(c) if c in columns else papers[c] if c != key else F.col(key) for c in papers.columns])


def run_row(spark: SparkSession, source: str, started: str, finished: str, status: str, counts: dict[str, int], cursor: str | None = None, errors: Sequence[str] = (), samples: int = 10) -> DataFrame:
    """One run of one source as a row to append: its counts, how it ended, the cursor to go on from (kept only where it didn't fail),
    and the first few errors."""
    schema = "source_key string, started_at string, finished_at string, status string, counts map<string,bigint>, cursor string, errors array<string>"
    return spark.createDataFrame([(source, started, finished, status, counts, None if status == "failed" else cursor, [e[:300] for e in errors][:samples])], schema)


def recent_runs(runs: DataFrame, most: int = 20) -> DataFrame:
    """The last runs, the newest first."""
    return runs.orderBy(F.desc("started_at"), "source_key").limit(most)


def last_cursor(runs: DataFrame, source: str) -> str | None:
    """Where the last run of a source that didn't fail left off."""
    r = runs.where((F.col("source_key") == source) & (F.col("status") != "failed")).orderBy(F.desc("started_at")).select("cursor").first()
    return r.cursor if r else None


def harvested(spark: SparkSession, sources: Mapping[str, Callable[[], dict[str, int]]], now: Callable[[], str]) -> DataFrame:
    """Every source's run in turn, as rows: one that fails is told as failed and stops no other."""
    rows = []
    for name, run in sources.items():
        began = now()
        try:
            rows.append(run_row(spark, name, began, now(), "done", run()))
        except Exception as e:  # whatever a source does, the others run
            rows.append(run_row(spark, name, began, now(), "failed", {}, errors=[f"{type(e).__name__}: {e}"]))
    return reduce(DataFrame.unionByName, rows)


def enrichment_candidates(papers: DataFrame, asked: DataFrame, after: str | None = None, most: int | None = None) -> DataFrame:
    """papers(paper, doi, fields), asked(paper) -> papers with a doi and no field that weren't asked for yet, by paper; `after` and
    `most` make pages of them."""
    x = papers.where("doi IS NOT NULL AND coalesce(size(fields), 0) <= 0").join(asked.select("paper"), "paper", "left_anti")
    x = x if after is None else x.where(F.col("paper") > after)
    x = x.orderBy("paper")
    return x if most is None else x.limit(most)


def looked_up_works(papers: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """papers(paper, doi) -> raw records of the works an aggregator knows by these dois, fifty a request; each task paces itself. Dois
    it doesn't know, or whose text its query can't hold, give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bibliome.sources.transports import works_by_doi

        for b in batches:
            got = list(works_by_doi([d for d in b.column(0).to_pylist() if d], options))
            cols = [pa.array(["openalex"] * len(got)), pa.array([k for k, _ in got], pa.string()), pa.array([json.dumps(w, ensure_ascii=False, sort_keys=True) for _, w in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["source_key", "source_id", "payload"])

    return papers.select("doi").mapInArrow(run, "source_key string, source_id string, payload string")


def enrichment_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """before and after(paper, fields) of the papers asked for -> (outcome, papers): gained a field, still without, or merged away."""
    have = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    x = before.select("paper").distinct().join(after.select("paper", "fields", F.lit(True).alias("there")), "paper", "left")
    outcome = F.when(F.col("there").isNull(), "merged away").when(have("fields"), "gained").otherwise("still without")
    return x.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("papers"))
