"""Readers of landed files: recorded pages of each source as raw records, notices as CSV, judgments as JSON lines."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "source_key string, source_id string, payload string, fetched_at timestamp"


def openalex_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages {"results": [work, ...]}: one raw record per work."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "results array<string>").results).alias("payload"))
    return x.select(F.lit("openalex").alias("source_key"), F.get_json_object("payload", "$.id").alias("source_id"), "payload")


def biorxiv_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages {"collection": [record, ...]}."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "collection array<string>").collection).alias("payload"))
    return x.select(F.lit("biorxiv").alias("source_key"), F.concat_ws("v", F.get_json_object("payload", "$.doi"), F.get_json_object("payload", "$.version")).alias("source_id"), "payload")


def europepmc_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages {"resultList": {"result": [record, ...]}}."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "resultList struct<result: array<string>>").resultList.result).alias("payload"))
    return x.select(F.lit("europepmc").alias("source_key"), F.concat_ws(":", F.get_json_object("payload", "$.source"), F.get_json_object("payload", "$.id")).alias("source_id"), "payload")


_OAI = (
    "header struct<_status: string, identifier: string, datestamp: string, setSpec: array<string>>, metadata struct<arXiv: struct<id: string, created: string, updated: string, title: string, abstract: string,"
    " categories: string, comments: string, license: string, doi: string, `journal-ref`: string, authors: struct<author: array<struct<keyname: string, forenames: string, affiliation: string>>>>>"
)


def arxiv_pages(spark: SparkSession, path: str) -> DataFrame:
    """OAI-PMH ListRecords responses; deleted records are left out."""
    x = spark.read.format("xml").option("rowTag", "record").schema(_OAI).load(path)
    live = x.where("metadata.arXiv.id IS NOT NULL AND NOT (header._status <=> 'deleted')")
    return live.select(F.lit("arxiv").alias("source_key"), F.col("metadata.arXiv.id").alias("source_id"), F.to_json("metadata.arXiv").alias("payload"))


def notices_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV of retraction notices; rows without a record id, or without both doi and pmid, are left out."""
    x = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    named = [c for c in x.columns if c and not c.startswith("_c")]
    renamed = x.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().lower().replace(" ", "_")) for c in named])
    return renamed.where("record_id IS NOT NULL AND (originalpaperdoi IS NOT NULL OR originalpaperpubmedid IS NOT NULL)")


#: Source name -> reader of its landed pages.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"openalex": openalex_pages, "arxiv": arxiv_pages, "biorxiv": biorxiv_pages, "europepmc": europepmc_pages}


def read_source(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in READERS:
        raise ValueError(f"unknown source {name!r}; known are {sorted(READERS)}")
    return READERS[name](spark, path)


JUDGMENT = "query_id string, paper_id string, grade int, title string, canonical_doi string, retrieved_by array<string>, judge string, judged_at string, note string"


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines and those that start with // don't count, any other that can't be read is an error."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '//')")
    x = lines.select("value", F.from_json("value", JUDGMENT, {"mode": "PERMISSIVE"}).alias("j"))
    bad = F.when(F.col("j.query_id").isNull(), F.raise_error(F.concat(F.lit("not a judgment: "), "value"))).otherwise(F.col("j"))
    return x.select(bad.alias("j")).select("j.*")


def write_judgments(df: DataFrame, path: str) -> None:
    """One file in a stable order: query, title in lower case, paper."""
    keyed = df.orderBy("query_id", F.lower("title"), "paper_id").select(F.to_json(F.struct(*df.columns)).alias("value"))
    keyed.coalesce(1).write.mode("overwrite").text(path)


def write_report(report: dict, path: str) -> None:
    """A run's figures as one JSON file."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)
