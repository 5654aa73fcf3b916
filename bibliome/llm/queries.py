"""The queries of this package, by name, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibliome.llm import matching, mojibake, names, packing, reading, survivor, tokens, vectors
from bibliome.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, d, "paper_facts"), "facts_id", "vector")


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "paper_facts").select("facts_id", "vector")
    return vectors.search_by_lists(facts, facts.where(F.col("facts_id") % 20 == 0), "facts_id", "vector").select(F.col("id").alias("facts_id"), "rank", "other", F.round("similarity", 6).alias("similarity"))


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "source_record"), table(spark, d, "source_priority")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(*_records(spark, d)).select("paper_id", "field_name", "record_id")


def p3_consensus(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(*_records(spark, d)).select("paper_id", "field_name", F.col("closest_id").alias("record_id"))


def p3_papers(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivor_rows(*_records(spark, d))


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "epmc_article"), table(spark, d, "retraction_notice")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_names(*_named(spark, d))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.name_classes(*_named(spark, d))


_PREPRINT = ("preprint_id", "src", ("title", "abstract_text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged_texts(table(spark, d, "epmc_preprint"), *_PREPRINT).select(F.col("id").alias("preprint_id"), F.col("field").alias("field_name"))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired_texts(table(spark, d, "epmc_preprint"), *_PREPRINT).withColumnsRenamed({"id": "preprint_id", "field": "field_name"})


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "epmc_article"), table(spark, d, "openalex_work")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(*_sources(spark, d)).select("article_id", "work_id")


def p6_matched(spark: SparkSession, d: str) -> DataFrame:
    return matching.matched(*_sources(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encoded(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), "doc_id", "text")


def p9_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(p9_packed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_label"))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.level_profile(table(spark, d, "documents"), table(spark, d, "reading_label"))


_STAND_INS = ", ".join("'" + w.replace("'", "''") + "'" for w in survivor.STAND_INS)
_FIELD_STAND_INS = " ".join(f"WHEN '{f}' THEN plain IN (" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")" for f, words in survivor.FIELD_STAND_INS.items())
_P1_SQL = """
WITH f AS (SELECT facts_id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM paper_facts WHERE vector IS NOT NULL AND len(vector) = 96
  AND list_bool_and(list_transform(vector, lambda x: isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))),
s AS (SELECT a.facts_id AS a, b.facts_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM f a JOIN f b ON a.facts_id <> b.facts_id WHERE list_cosine_similarity(a.v, b.v) >= 0.8),
t AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s)
SELECT DISTINCT least(a, b) AS facts_a, greatest(a, b) AS facts_b FROM t WHERE n <= 5"""
_NEAREST_SQL = """
WITH f AS (SELECT facts_id, list_transform(vector, lambda x: x::DOUBLE) AS v FROM paper_facts WHERE vector IS NOT NULL AND len(vector) = 96
  AND list_bool_and(list_transform(vector, lambda x: isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))),
s AS (SELECT a.facts_id, b.facts_id AS other, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM f a JOIN f b ON a.facts_id <> b.facts_id WHERE a.facts_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY facts_id ORDER BY c DESC, other) AS rank FROM s)
SELECT facts_id, rank, other, round(c, 6) AS similarity FROM t WHERE rank <= 5"""
_P3_SQL = f"""
WITH inv AS (SELECT record_id, string_agg(w, ' ' ORDER BY p, w) AS abstract FROM (
    SELECT s.record_id, e.key AS w, unnest(CAST(e.value AS INTEGER[])) AS p FROM source_record s, json_each(s.payload::JSON, '$.abstract_inverted_index') e WHERE s.source_key = 'openalex') GROUP BY record_id),
r AS (SELECT s.* REPLACE (s.payload::JSON AS payload), inv.abstract AS inverted FROM source_record s LEFT JOIN inv USING (record_id)
  WHERE paper_id IS NOT NULL AND trim(paper_id) <> '' AND paper_id IN (SELECT paper_id FROM source_record GROUP BY paper_id HAVING count(*) > 1)),
v AS (
  SELECT record_id, paper_id, source_key, fetched_at, 'title' AS field_name, CASE source_key WHEN 'openalex' THEN coalesce(nullif(trim(payload ->> '$.display_name'), ''), payload ->> '$.title') ELSE payload ->> '$.title' END AS value FROM r
  UNION ALL SELECT record_id, paper_id, source_key, fetched_at, 'abstract', CASE source_key WHEN 'openalex' THEN inverted WHEN 'europepmc' THEN payload ->> '$.abstractText' ELSE payload ->> '$.abstract' END FROM r
  UNION ALL SELECT record_id, paper_id, source_key, fetched_at, 'doi', payload ->> '$.doi' FROM r
  UNION ALL SELECT record_id, paper_id, source_key, fetched_at, 'pub_date', CASE source_key WHEN 'openalex' THEN payload ->> '$.publication_date' WHEN 'europepmc' THEN payload ->> '$.firstPublicationDate' WHEN 'pubmed' THEN payload ->> '$.pub_date' WHEN 'biorxiv' THEN payload ->> '$.date' ELSE payload ->> '$.created' END FROM r
  UNION ALL SELECT record_id, paper_id, source_key, fetched_at, 'venue', CASE source_key WHEN 'openalex' THEN payload ->> '$.primary_location.source.display_name' WHEN 'europepmc' THEN payload ->> '$.journalInfo.journal.title' WHEN 'pubmed' THEN payload ->> '$.journal' WHEN 'biorxiv' THEN payload ->> '$.server' ELSE payload ->> '$."journal-ref"' END FROM r
  UNION ALL SELECT record_id, paper_id, source_key, fetched_at, 'licence', CASE source_key WHEN 'openalex' THEN payload ->> '$.primary_location.license' ELSE payload ->> '$.license' END FROM r),
p AS (SELECT *, trim(regexp_replace(regexp_replace(value, '<[^<>]{{1,60}}>', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g')) AS shown FROM v),
q AS (SELECT *, lower(shown) AS plain FROM p),
m AS (SELECT * FROM q WHERE value IS NOT NULL AND length(plain) > 0 AND plain NOT IN ({_STAND_INS}) AND NOT CASE field_name {_FIELD_STAND_INS} ELSE false END),
c AS (SELECT m.*, coalesce(sp.priority, -1) AS priority, regexp_matches(shown, '(\\[\\s*(\\.\\.\\.|…|truncated|cut|more)\\s*\\]|(\\.\\.\\.|…)\\s*(\\((more|truncated|cont(inued)?\\.?)\\)|\\[more\\])?)\\s*$')
   OR (field_name = 'abstract' AND NOT regexp_matches(shown, '[.!?。！？][\\s"''”’»)\\]]*$')) AS cut FROM m LEFT JOIN source_priority sp USING (source_key, field_name))
SELECT paper_id, field_name, record_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, field_name ORDER BY cut, priority DESC, fetched_at DESC NULLS LAST, record_id) AS n FROM c) WHERE n = 1"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_nearest, p3_found, p3_consensus, p3_papers, p4_found, p4_classes, p5_found, p5_repaired, p6_found, p6_matched, p8_ids, p9_packed, p9_summary, p10_found, p10_profile)}
ORACLES: dict[str, str] = {"p1_found": _P1_SQL, "p1_nearest": _NEAREST_SQL, "p3_found": _P3_SQL}
