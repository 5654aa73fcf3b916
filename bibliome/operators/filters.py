"""Filters that are applied before anything is ranked, as conjunctions of native predicates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that count as open access, and those that flag a paper.
OPEN = ("gold", "green", "hybrid", "bronze", "diamond")
FLAGGED = ("retracted", "corrected", "concern")


@dataclass(frozen=True)
class SearchFilters:
    """What a reader may narrow a search by; None or empty doesn't filter. retraction is 'exclude', 'all' or 'only'; preprints
    'any', 'only' or 'exclude'. Values of `columns` name the columns of the table at hand; a filter on a column the table doesn't have is an error, but for
    the default of leaving out retracted papers."""

    published_from: date | None = None
    published_to: date | None = None
    sources: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    preprints: str = "any"
    peer_reviewed_only: bool = False
    open_access_only: bool = False
    retraction: str = "exclude"


def conditions(f: SearchFilters, columns: dict[str, str]) -> list[Column]:
    """Predicates, one for each filter that is set; the sources filter is a semi-join, see filtered()."""
    asked = {
        "date": f.published_from or f.published_to, "preprint": f.preprints != "any", "reviewed": f.peer_reviewed_only, "oa": f.open_access_only, "fields": f.fields,
        "language": f.languages, "retraction": f.retraction == "only",
    }
    absent = [name for name, on in asked.items() if on and name not in columns]
    if absent:
        raise ValueError(f"no column to filter by: {absent}")
    col = lambda name: F.col(columns[name]) if name in columns else None
    out: list[Column | None] = []
    day, preprint, reviewed, oa, fields, lang, status = (col(n) for n in ("date", "preprint", "reviewed", "oa", "fields", "language", "retraction"))
    if day is not None:
        out += [day >= F.lit(f.published_from) if f.published_from else None, day <= F.lit(f.published_to) if f.published_to else None]
    if preprint is not None and f.preprints != "any":
        out.append(preprint if f.preprints == "only" else ~preprint)
    if reviewed is not None and f.peer_reviewed_only:
        out.append(reviewed)
    if oa is not None and f.open_access_only:
        out.append(oa.isin(*OPEN))
    if fields is not None and f.fields:
        out.append(F.coalesce(F.arrays_overlap(fields, F.array(*map(F.lit, f.fields))), F.lit(False)))
    if lang is not None and f.languages:
        out.append(lang.isin(*f.languages))
    if status is not None and f.retraction != "all":
        out.append(status.isin(*FLAGGED) if f.retraction == "only" else F.coalesce(status != "retracted", F.lit(True)))
    return [c for c in out if c is not None]


def filtered(df: DataFrame, f: SearchFilters, columns: dict[str, str], records: DataFrame | None = None, on: str = "paper_id") -> DataFrame:
    """df under all filters; a source filter keeps papers of which any record came from one of the sources."""
    found = conditions(f, columns)
    out = df.where(reduce(and_, found)) if found else df
    if f.sources:
        if records is None:
            raise ValueError("a filter by sources needs the records")
        out = out.join(records.where(F.col("source_key").isin(*f.sources)).select(on), on, "left_semi")
    return out


def newest_first(df: DataFrame, day: str, key: str, *, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(F.col(day).desc_nulls_last(), F.col(key).desc()).offset(offset).limit(limit)


def after_key(df: DataFrame, key: str, last: int, limit: int) -> DataFrame:
    """The next page by key, which needs no count of what came before."""
    return df.where(F.col(key) > last).orderBy(key).limit(limit)


def hydrate(ranked: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """Display columns for ranked survivors only, in ranked order; ids that have vanished are skipped."""
    return ranked.join(papers, key).orderBy("rank")


def field_counts(df: DataFrame, fields: str) -> DataFrame:
    """(slug, papers): how many papers each field has, and under 'unclassified' those with none."""
    some = df.select(F.explode(F.array_distinct(F.col(fields))).alias("slug")).groupBy("slug").agg(F.count("*").alias("papers"))
    none = df.where(F.coalesce(F.size(fields), F.lit(0)) <= 0).agg(F.lit("unclassified").alias("slug"), F.count("*").alias("papers"))
    return some.unionByName(none)
