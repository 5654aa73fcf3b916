"""Every query of the core, by name, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions import dates, ids, scores, taxonomy, text
from bibliome.functions.embedding import HashedWords, embedded
from bibliome.functions.vectors import cosine, similarities
from bibliome.operators import corpus, evaluation, filters, fusion, ingest, lexical, normalise, recommend, reports, semantic
from bibliome.operators.components import components
from bibliome.operators.shred import payload_children
from bibliome.operators.unpack import notice_values
from bibliome.plans import embedding as keeping
from bibliome.plans import feed as feeds
from bibliome.session import table
from bibliome.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The day the queries take for today, so that results don't move.
TODAY = "2025-06-01"
#: Event kinds of the driver's table, read as feedback.
POSITIVE, NEGATIVE, SHOWN = ("click", "signup", "purchase"), "error", "view"
SIGNALS = {"click": 0.2, "signup": 0.6, "purchase": 0.5, "error": -0.7, "view": 0.0}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("item", F.get_json_object("props", "$.k").cast("bigint"))


_EVENTS = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events)"
_DOI = "nullif(lower(regexp_replace(regexp_extract({c}, '(?i)(10\\.\\d{{4,9}}/[^\\s\"''<>]+)', 1), '[.,;:)\\]}}>]+$', '')), '')"


# ---- several values in one cell, nested records ------------------------------------------------------------------------------


def _unpack_sql() -> str:
    """The splitting of packed cells in SQL: the same folds over pieces between quotes; noncharacters stand for marks."""
    end, opening, closing, lone = (f"chr({n})" for n in range(64976, 64980))
    hidden = [(";", 64980), ("|", 64981), (",", 64982), ('"', 64983), ("；", 64984), ("\\", 64985)]
    space = r"[\s\p{Z}\x{FEFF}\x{200B}]"
    trim = lambda x: f"regexp_replace({x}, '^{space}+|{space}+$', '', 'g')"

    def hide(x: str) -> str:
        for char, n in reversed(hidden):
            x = f"replace({x}, '\\{char}', chr({n}))"
        return x

    def show(x: str) -> str:
        x = f"replace({x}, {closing} || {opening}, '\"')"
        for mark in (opening, closing, lone):
            x = f"replace({x}, {mark}, '\"')"
        for char, n in hidden:
            x = f"replace({x}, chr({n}), '{char}')"
        return x

    def cut(patterns: list[tuple[str, str]]) -> str:
        x = "p"
        for pattern, new in patterns:
            x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
        return f"string_split(array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i % 2 = 1 THEN {x} ELSE {opening} || p || {closing} END), ''), {end})"

    def values(raw: str) -> str:
        full = f"list_filter(list_transform({raw}, lambda v: {trim('v')}), lambda v: length(replace(replace(v, {opening}, ''), {closing}, '')) > 0)"
        unnumbered = "regexp_replace(v, '^\\(\\d+\\)', '')"
        numbered = f"list_transform({full}, lambda v, i: CASE WHEN regexp_extract(v, '^\\((\\d{{1,4}})\\)', 1) = CAST(i AS VARCHAR) THEN {trim(unnumbered)} ELSE v END)"
        bare = f"CASE WHEN left(v, 1) = {opening} AND right(v, 1) = {closing} AND NOT regexp_matches(v, {closing} || '[^' || {opening} || ']+' || {opening}) THEN v[2:length(v) - 1] ELSE v END"
        return f"list_filter(list_transform({numbered}, lambda v: {trim(show('(' + bare + ')'))}), lambda v: length(v) > 0)"

    primary = cut([("(^|\\s)//", f"'\\1' || {end}"), ("//(\\s|$)", f"{end} || '\\1'"), ("[;；|\\t\\r\\n•]", end)])
    comma, whole = cut([(",", end)]), f"[array_to_string(list_transform(pieces, lambda p, i: CASE WHEN i % 2 = 1 THEN p ELSE {opening} || p || {closing} END), '')]"
    joint = cut([("\\s*,\\s*(?:and|&)\\s+|\\s*,\\s*|\\s+(?:and|&)\\s+", end)])
    name = trim(show("v"))
    fields = " UNION ALL ".join(f"SELECT notice_id, '{f}' AS field_name, {f} AS cell FROM retraction_notice" for f in ("subject", "reason", "author", "institution"))
    return f"""WITH c AS ({fields}), t AS (SELECT notice_id, field_name, {trim('cell')} AS t FROM c),
e AS (SELECT *, CASE WHEN regexp_matches(t, '(?s)^\\[\\s*".*"\\s*\\]$') THEN try_cast(try_cast(t AS JSON) AS VARCHAR[]) END AS j, {hide('t')} AS e FROM t WHERE length(t) > 0),
s AS (SELECT *, string_split(CASE WHEN (length(e) - length(replace(e, '"', ''))) % 2 = 1 THEN regexp_replace(e, '"([^"]*)$', {lone} || '\\1') ELSE e END, '"') AS pieces FROM e),
o AS (SELECT *, array_to_string(list_filter(pieces, lambda p, i: i % 2 = 1), {lone}) AS outside, {comma} AS commas FROM s),
w AS (SELECT *, regexp_matches(outside, '[;；|\\t\\r\\n•]|(^|\\s)//|//(\\s|$)') AS has FROM o),
k AS (SELECT *, CASE WHEN j IS NOT NULL THEN 'json' WHEN has THEN 'primary' WHEN field_name = 'author' AND regexp_matches(outside, '\\s(and|&)\\s') THEN 'joint'
  WHEN contains(outside, ',') AND ((len(commas) > 1 AND list_bool_or(list_transform(commas, lambda v: left({trim('v')}, 1) = {opening} AND right({trim('v')}, 1) = {closing})))
    OR (field_name = 'author' AND list_bool_and(list_transform(commas, lambda v: length({trim('v')}) = 0 OR (len(regexp_split_to_array({name}, '\\s+')) > 1 AND NOT regexp_matches({name}, '\\s\\p{{Lu}}\\.?$')))))) THEN 'comma'
  WHEN contains(outside, ',') AND field_name IN ('subject', 'reason') THEN 'ask' ELSE 'one' END AS way FROM w),
v AS (SELECT notice_id, field_name, t, way, CASE way WHEN 'json' THEN list_filter(list_transform(j, lambda v: {trim('v')}), lambda v: length(v) > 0) WHEN 'primary' THEN {values(primary)} WHEN 'joint' THEN {values(joint)} WHEN 'comma' THEN {values(comma)} ELSE {values(whole)} END AS items, {values(comma)} AS parts FROM k),
known AS (SELECT DISTINCT field_name, unnest(items) AS item FROM v WHERE way <> 'ask'),
kl AS (SELECT field_name, list(item) AS items FROM known GROUP BY field_name),
r AS (SELECT notice_id, v.field_name, CASE WHEN way = 'ask' AND NOT list_has_any(kl.items, v.items) AND list_has_all(kl.items, parts) THEN parts ELSE v.items END AS items FROM v LEFT JOIN kl ON kl.field_name = v.field_name)
SELECT notice_id, field_name, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM r"""


@query(_unpack_sql())
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return notice_values(table(spark, d, "retraction_notice"))


def _payloads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "epmc_article"), table(spark, d, "epmc_preprint")


_PAYLOADS = r"""
WITH RECURSIVE raw AS (
  SELECT 'article' AS origin, article_id AS parent_id, payload FROM epmc_article WHERE payload IS NOT NULL
  UNION ALL SELECT 'preprint', preprint_id, payload FROM epmc_preprint WHERE payload IS NOT NULL),
a AS (SELECT origin, parent_id, try_cast(ltrim(payload, chr(65279) || ' ') AS JSON) AS j FROM raw),
b AS (SELECT origin, parent_id, CASE WHEN json_type(j) = 'VARCHAR' THEN try_cast(j ->> '$' AS JSON) ELSE j END AS j FROM a),
c AS (SELECT origin, parent_id, CASE WHEN json_type(j) = 'ARRAY' THEN j -> '$[0]' ELSE j END AS j FROM b),
e AS (SELECT origin, parent_id, CASE WHEN json_type(j -> '$.resultList') = 'OBJECT' THEN j -> '$.resultList.result' WHEN json_type(j -> '$.result') = 'OBJECT' THEN j -> '$.result' ELSE j END AS j FROM c),
r AS (SELECT origin, parent_id, CASE WHEN json_type(j) = 'ARRAY' THEN j -> '$[0]' ELSE j END AS j FROM e),
rec AS (SELECT * FROM r WHERE json_type(j) = 'OBJECT'),
lists AS (
  SELECT origin, parent_id, child, CASE WHEN json_type(x) = 'OBJECT' THEN x -> inside ELSE x END AS x FROM (
    SELECT origin, parent_id, 'author' AS child, '$.author' AS inside, j -> '$.authorList' AS x FROM rec
    UNION ALL SELECT origin, parent_id, 'author_id', '$.authorId', j -> '$.authorIdList' FROM rec
    UNION ALL SELECT origin, parent_id, 'full_text_url', '$.fullTextUrl', j -> '$.fullTextUrlList' FROM rec)),
members AS (
  SELECT origin, parent_id, child, unnest(x) AS m, generate_subscripts(x, 1) AS pos FROM (
    SELECT origin, parent_id, child, CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END AS x FROM lists)),
aff AS (
  SELECT origin, parent_id, pos, CASE WHEN json_type(x) = 'OBJECT' THEN x -> '$.authorAffiliation' ELSE x END AS x
  FROM (SELECT origin, parent_id, pos, m -> '$.authorAffiliationDetailsList' AS x FROM members WHERE child = 'author' AND json_type(m) = 'OBJECT')),
affs AS (
  SELECT origin, parent_id, pos, unnest(x) AS m, generate_subscripts(x, 1) AS sub_pos FROM (
    SELECT origin, parent_id, pos, CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END AS x FROM aff))
"""


@query(
    _PAYLOADS
    + """
SELECT origin, parent_id, child, pos, 0 AS sub_pos FROM members WHERE m IS NOT NULL AND json_type(m) <> 'NULL'
UNION ALL SELECT origin, parent_id, 'affiliation', pos, sub_pos FROM affs WHERE m IS NOT NULL AND json_type(m) <> 'NULL'
UNION ALL SELECT origin, parent_id, 'journal_info', 1, 0 FROM rec WHERE json_type(j -> '$.journalInfo') = 'OBJECT' AND len(json_keys(j, '$.journalInfo')) > 0"""
)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return payload_children(*_payloads(spark, d), values=False).select("origin", "parent_id", "child", "pos", "sub_pos")


@query(
    _PAYLOADS
    + """SELECT origin, parent_id, pos, m ->> '$.fullName' AS full_name, m ->> '$.firstName' AS first_name, m ->> '$.lastName' AS last_name, m ->> '$.initials' AS initials, m ->> '$.collectiveName' AS collective_name
FROM members WHERE child = 'author' AND json_type(m) = 'OBJECT'"""
)
def p7_authors(spark: SparkSession, d: str) -> DataFrame:
    names = ["full_name", "first_name", "last_name", "initials", "collective_name"]
    return payload_children(*_payloads(spark, d), ("author",)).select("origin", "parent_id", "pos", *names)


@query(_PAYLOADS + "SELECT origin, parent_id, pos, sub_pos, CASE WHEN json_type(m) = 'OBJECT' THEN m ->> '$.affiliation' ELSE m ->> '$' END AS affiliation FROM affs WHERE m IS NOT NULL AND json_type(m) <> 'NULL'")
def p7_affiliations(spark: SparkSession, d: str) -> DataFrame:
    return payload_children(*_payloads(spark, d), ("affiliation",)).select("origin", "parent_id", "pos", "sub_pos", "affiliation")


@query(_PAYLOADS + "SELECT origin, parent_id, pos, m ->> '$.type' AS id_type, m ->> '$.value' AS id_value FROM members WHERE child = 'author_id' AND json_type(m) = 'OBJECT'")
def p7_author_ids(spark: SparkSession, d: str) -> DataFrame:
    return payload_children(*_payloads(spark, d), ("author_id",)).selectExpr("origin", "parent_id", "pos", "type AS id_type", "value AS id_value")


@query(
    _PAYLOADS
    + """SELECT origin, parent_id, x ->> '$.issue' AS issue, x ->> '$.volume' AS volume, x ->> '$.yearOfPublication' AS year_of_publication, x ->> '$.journal.title' AS journal_title, x ->> '$.journal.issn' AS journal_issn
FROM (SELECT origin, parent_id, j -> '$.journalInfo' AS x FROM rec) WHERE json_type(x) = 'OBJECT' AND len(json_keys(x)) > 0"""
)
def p7_journal_info(spark: SparkSession, d: str) -> DataFrame:
    cols = ["issue", "volume", "year_of_publication", "journal_title", "journal_issn"]
    return payload_children(*_payloads(spark, d), ("journal_info",)).select("origin", "parent_id", *cols)


@query(
    _PAYLOADS
    + """SELECT origin, parent_id, pos, m ->> '$.url' AS url, m ->> '$.site' AS site, m ->> '$.documentStyle' AS document_style, m ->> '$.availability' AS availability, m ->> '$.availabilityCode' AS availability_code
FROM members WHERE child = 'full_text_url' AND json_type(m) = 'OBJECT'"""
)
def p7_full_text_urls(spark: SparkSession, d: str) -> DataFrame:
    cols = ["url", "site", "document_style", "availability", "availability_code"]
    return payload_children(*_payloads(spark, d), ("full_text_url",)).select("origin", "parent_id", "pos", *cols)


# ---- scans, projections, filters, pages ----------------------------------------------------------------------------------------


@query("SELECT a.article_id, a.title, a.pub_year, j.title AS venue, j.publisher FROM epmc_article a LEFT JOIN journal j USING (journal_key)")
def scan_hit_projection(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "journal").select("journal_key", F.col("title").alias("venue"), "publisher")
    return table(spark, d, "epmc_article").select("article_id", "title", "pub_year", "journal_key").join(j, "journal_key", "left").drop("journal_key")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'eng') AND source IN ('europepmc', 'pubmed') AND n_chars >= 500")
def filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    x = filters.filtered(table(spark, d, "documents"), filters.SearchFilters(languages=("en", "eng"), retraction="all"), {"language": "lang"})
    return x.where(F.col("source").isin("europepmc", "pubmed") & (F.col("n_chars") >= 500)).select("doc_id", "lang", "source", "n_chars")


@query("SELECT facts_id, paper_id FROM paper_facts p WHERE (retraction_status <> 'retracted' OR retraction_status IS NULL) AND EXISTS (SELECT 1 FROM source_record s WHERE s.paper_id = p.paper_id AND s.source_key IN ('pubmed', 'arxiv'))")
def filter_semi_sources(spark: SparkSession, d: str) -> DataFrame:
    f = filters.SearchFilters(sources=("pubmed", "arxiv"))
    return filters.filtered(table(spark, d, "paper_facts"), f, {"retraction": "retraction_status"}, table(spark, d, "source_record")).select("facts_id", "paper_id")


@query(f"SELECT article_id, {_DOI.format(c='a.doi')} AS doi_key FROM epmc_article a WHERE a.doi IS NOT NULL AND NOT EXISTS (SELECT 1 FROM openalex_work w WHERE {_DOI.format(c='w.doi')} = {_DOI.format(c='a.doi')})")
def filter_anti_unrecorded(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "openalex_work").select(ids.doi(F.col("doi")).alias("doi_key"))
    return table(spark, d, "epmc_article").where("doi IS NOT NULL").select("article_id", ids.doi(F.col("doi")).alias("doi_key")).join(w, "doi_key", "left_anti").select("article_id", "doi_key")


@query("""SELECT policy, count(*) AS papers FROM (SELECT unnest(CASE WHEN retraction_status IN ('retracted', 'corrected', 'concern') AND retraction_status <> 'retracted' THEN ['all', 'exclude', 'only']
 WHEN retraction_status = 'retracted' THEN ['all', 'only'] ELSE ['all', 'exclude'] END) AS policy FROM paper_facts) GROUP BY policy""")
def filter_flagged_policy(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "paper_facts").select("retraction_status")
    one = lambda p: filters.filtered(facts, filters.SearchFilters(retraction=p), {"retraction": "retraction_status"}).agg(F.lit(p).alias("policy"), F.count("*").alias("papers"))
    return one("exclude").unionByName(one("all")).unionByName(one("only"))


@query("SELECT facts_id, feed_date FROM paper_facts WHERE list_has_any(field_slugs, ['field-1', 'field-2']) AND (retraction_status <> 'retracted' OR retraction_status IS NULL) ORDER BY feed_date DESC NULLS LAST, facts_id DESC LIMIT 50")
def filter_array_overlap(spark: SparkSession, d: str) -> DataFrame:
    f = filters.SearchFilters(fields=("field-1", "field-2"))
    return filters.newest_first(filters.filtered(table(spark, d, "paper_facts"), f, {"fields": "field_slugs", "retraction": "retraction_status"}), "feed_date", "facts_id", limit=50).select("facts_id", "feed_date")


@query("SELECT facts_id, paper_id, feed_date FROM paper_facts ORDER BY feed_date DESC NULLS LAST, facts_id DESC LIMIT 20 OFFSET 40")
def page_newest_first(spark: SparkSession, d: str) -> DataFrame:
    return filters.newest_first(table(spark, d, "paper_facts"), "feed_date", "facts_id", limit=20, offset=40).select("facts_id", "paper_id", "feed_date")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def page_after_key(spark: SparkSession, d: str) -> DataFrame:
    return filters.after_key(table(spark, d, "orders"), "o_orderkey", 500, 100).select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE is_peer_reviewed AND NOT is_preprint) AS reviewed FROM paper_facts WHERE retraction_status <> 'retracted' OR retraction_status IS NULL")
def page_total(spark: SparkSession, d: str) -> DataFrame:
    x = filters.filtered(table(spark, d, "paper_facts"), filters.SearchFilters(), {"retraction": "retraction_status"})
    narrow = filters.conditions(filters.SearchFilters(preprints="exclude", peer_reviewed_only=True), {"preprint": "is_preprint", "reviewed": "is_peer_reviewed"})
    return x.agg(F.count("*").alias("total"), F.count_if(narrow[0] & narrow[1]).alias("reviewed"))


@query("""SELECT preprint_id, CASE WHEN s IS NULL OR length(s) <= 320 THEN s ELSE rtrim(s[1:320]) || '…' END AS preview
FROM (SELECT preprint_id, nullif(trim(regexp_replace(abstract_text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS s FROM epmc_preprint)""")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "epmc_preprint").select("preprint_id", text.preview(F.col("abstract_text")).alias("preview"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS cleaned FROM documents")
def text_query_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Every text, however long."""
    return table(spark, d, "documents").select("doc_id", text.clean_query(F.col("text")).alias("cleaned"))


# ---- scalar functions ---------------------------------------------------------------------------------------------------------------

_UNESC = "replace(replace(replace(replace(replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&ndash;', '–'), '&mdash;', '—'), '&amp;', '&')"
_STATUS_SQL = "(?i)^(\\s*(retracted(\\s+article)?|withdrawn|expression\\s+of\\s+concern|erratum|corrigendum)\\s*[:.\\-]\\s*)+"
_FOLD = (
    "trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(trim(regexp_replace(regexp_replace(regexp_replace(" + _UNESC + ", '<[^>]+>', ' ', 'g'), '\\\\[a-zA-Z]+\\s*', ' ', 'g'), '" + _STATUS_SQL + "', '')), 'ß', 'ss'), 'ł', 'l'))),"
    " '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' +', ' ', 'g'))"
)


@query()
def text_fold_title(spark: SparkSession, d: str) -> DataFrame:
    """Every title, in any script."""
    return table(spark, d, "openalex_work").select("work_id", text.fold_title(F.col("title")).alias("folded"))


@query()
def text_surname(spark: SparkSession, d: str) -> DataFrame:
    """Every author of every list, however the name is written."""
    x = table(spark, d, "epmc_article").select("article_id", F.explode(F.split("author_string", ", ")).alias("author"))
    return x.select("article_id", "author", text.surname(F.col("author")).alias("family"))


@query("SELECT doc_id, length(t) + 2 * len(regexp_extract_all(t, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}]')) AS weight FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)")
def text_blocking_weight(spark: SparkSession, d: str) -> DataFrame:
    """Every text, however long."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.blocking_weight(F.lower("text")).cast("bigint").alias("weight"))


@query("""SELECT preprint_id, CASE WHEN length(b) >= 40 THEN h || '[SEP]' || b ELSE h END AS input FROM (SELECT preprint_id, coalesce(nullif(trim(regexp_replace(regexp_replace(""" + _UNESC.format(c="title") + """, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ''), '') AS h,
 nullif(trim(regexp_replace(regexp_replace(""" + _UNESC.format(c="abstract_text") + """, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS b FROM epmc_preprint)""")
def embed_input(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "epmc_preprint").select("preprint_id", text.embedding_input(F.col("title"), F.col("abstract_text")).alias("input"))


@query(f"SELECT article_id, {_DOI.format(c='doi')} AS doi_key, nullif(ltrim(regexp_extract(pmid, '(\\d+)', 1), '0'), '') AS pmid_key, CASE WHEN regexp_matches(pmcid, '\\d') THEN 'PMC' || regexp_extract(pmcid, '(\\d+)', 1) END AS pmcid_key FROM epmc_article")
def id_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "epmc_article").select("article_id", ids.doi(F.col("doi")).alias("doi_key"), ids.pmid(F.col("pmid")).alias("pmid_key"), ids.pmcid(F.col("pmcid")).alias("pmcid_key"))


@query("SELECT work_id, nullif(upper(regexp_extract(openalex_id, '\\b([WwSsAaIiPpTtCcFfDd]\\d{4,})\\b', 1)), '') AS openalex_key, coalesce(regexp_matches(lower(doi), '^10\\.(1101|48550|31234|21203|26434)/'), false) AS preprint_doi FROM openalex_work")
def id_openalex(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "openalex_work").select("work_id", ids.openalex(F.col("openalex_id")).alias("openalex_key"), ids.is_preprint_doi(F.col("doi")).alias("preprint_doi"))


@query("SELECT record_id, sha256(payload) AS payload_hash, 'embed:' || source_key || ':' || substr(sha256(coalesce(paper_id, '')), 1, 32) AS batch_key FROM source_record WHERE payload IS NOT NULL")
def hash_content(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "source_record").where("payload IS NOT NULL")
    return x.select("record_id", F.sha2("payload", 256).alias("payload_hash"), F.concat(F.lit("embed:"), "source_key", F.lit(":"), F.substring(F.sha2(F.coalesce("paper_id", F.lit("")), 256), 1, 32)).alias("batch_key"))


@query("""SELECT record_id, nullif(regexp_extract(u, '\\b(\\d{4}\\.\\d{4,5})(?:v\\d+)?\\b', 1), '') AS arxiv_key
FROM (SELECT record_id, coalesce(nullif(regexp_extract(trim(source_id), '(?i)^10\\.48550/arxiv\\.(.+)$', 1), ''), trim(source_id)) AS u FROM source_record WHERE source_key = 'arxiv')""")
def id_arxiv(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "source_record").where("source_key = 'arxiv'")
    return x.select("record_id", ids.arxiv(F.col("source_id")).alias("arxiv_key"))


@query("SELECT notice_id, coalesce(try_strptime(retraction_date, '%m/%d/%Y %H:%M'), try_strptime(retraction_date, '%m/%d/%Y'), try_strptime(retraction_date, '%Y-%m-%d'))::DATE AS retracted_on FROM retraction_notice")
def date_notice(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "retraction_notice").select("notice_id", dates.notice_date(F.col("retraction_date")).alias("retracted_on"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate IS NOT NULL THEN least(o_orderdate::DATE, DATE '1996-01-01') END AS feed_date, o_orderdate::DATE <= DATE '1996-01-01' + 365 AS plausible, round(exp(-greatest(DATE '{TODAY}' - o_orderdate::DATE, 0) / 14.0), 6) AS freshness FROM orders")
def date_feed(spark: SparkSession, d: str) -> DataFrame:
    day, cut = F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date")
    return table(spark, d, "orders").select("o_orderkey", dates.feed_date(day, cut).alias("feed_date"), dates.plausible(day, cut).alias("plausible"), F.round(scores.freshness(day, F.lit(TODAY).cast("date")), 6).alias("freshness"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", "item")


def _slug_case(column: str) -> str:
    pairs = taxonomy.PREPRINT_CATEGORIES.items()
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in pairs) + " END"


@query(f"SELECT preprint_id, {_slug_case('category')} AS slug FROM epmc_preprint")
def taxonomy_fields(spark: SparkSession, d: str) -> DataFrame:
    topics = F.array(F.struct(F.lit("biorxiv").alias("scheme"), F.col("category").alias("value")))
    return table(spark, d, "epmc_preprint").select("preprint_id", F.get(taxonomy.fields_of(topics), F.lit(0)).alias("slug"))


# ---- aggregations ------------------------------------------------------------------------------------------------------------------------


@query("""SELECT slug, count(*) AS papers FROM (SELECT unnest(list_distinct(field_slugs)) AS slug FROM paper_facts) GROUP BY slug
UNION ALL SELECT 'unclassified', count(*) FROM paper_facts WHERE coalesce(len(field_slugs), 0) = 0""")
def agg_field_counts(spark: SparkSession, d: str) -> DataFrame:
    return filters.field_counts(table(spark, d, "paper_facts"), "field_slugs")


@query("SELECT doc_kind, count(*) AS texts, count(*) FILTER (WHERE text IS NULL) AS missing, count(*) FILTER (WHERE n_chars < 500) AS brief, round(avg(CASE WHEN paper_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS linked FROM documents GROUP BY doc_kind")
def agg_conditional(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("doc_kind").agg(
        F.count("*").alias("texts"), F.count_if(F.col("text").isNull()).alias("missing"), F.count_if(F.col("n_chars") < 500).alias("brief"), F.round(F.avg(F.col("paper_id").isNotNull().cast("double")), 4).alias("linked")
    )


@query(f"SELECT item, count(DISTINCT user_id) AS support FROM {_EVENTS} WHERE event_type IN {POSITIVE} GROUP BY item HAVING count(DISTINCT user_id) >= 3 ORDER BY support DESC, item LIMIT 50")
def agg_support_having(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).where(F.col("event_type").isin(*POSITIVE)).groupBy("item").agg(F.count_distinct("user_id").alias("support"))
    return x.where("support >= 3").orderBy(F.desc("support"), "item").limit(50)


_STATUS_OF = "CASE lower(trim(retraction_nature)) WHEN 'retraction' THEN 'retracted' WHEN 'expression of concern' THEN 'concern' WHEN 'correction' THEN 'corrected' WHEN 'reinstatement' THEN 'none' ELSE 'concern' END"
_SEVERITY = "CASE status WHEN 'retracted' THEN 3 WHEN 'concern' THEN 2 WHEN 'corrected' THEN 1 ELSE 0 END"


@query(f"""WITH n AS (SELECT notice_id, {_DOI.format(c='original_paper_doi')} AS doi, nullif(ltrim(regexp_extract(original_paper_pubmed_id, '(\\d+)', 1), '0'), '') AS pmid, {_STATUS_OF} AS status FROM retraction_notice),
p AS (SELECT article_id AS paper, {_DOI.format(c='doi')} AS doi, nullif(ltrim(regexp_extract(pmid, '(\\d+)', 1), '0'), '') AS pmid FROM epmc_article),
m AS (SELECT DISTINCT p.paper, n.notice_id, n.status FROM p JOIN n ON p.doi = n.doi OR p.pmid = n.pmid)
SELECT paper, status, notice_id FROM (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY {_SEVERITY} DESC, notice_id) AS r FROM m) WHERE r = 1""")
def agg_severity_argmax(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "retraction_notice")
    status = corpus.looked_up(corpus.NATURE_STATUS, F.lower(F.trim("retraction_nature")), "concern")
    notices = n.select("notice_id", ids.doi(F.col("original_paper_doi")).alias("doi"), ids.pmid(F.col("original_paper_pubmed_id")).alias("pmid"), status.alias("status"))
    papers = table(spark, d, "epmc_article").select(F.col("article_id").alias("paper"), ids.doi(F.col("doi")).alias("doi"), ids.pmid(F.col("pmid")).alias("pmid"))
    return corpus.worst_status(notices, papers)


@query(f"""WITH n AS (SELECT *, {_DOI.format(c='original_paper_doi')} AS d, nullif(ltrim(regexp_extract(original_paper_pubmed_id, '(\\d+)', 1), '0'), '') AS p, {_STATUS_OF} AS st FROM retraction_notice WHERE record_id IS NOT NULL)
SELECT record_id, arg_min_null(d, (imported_at, notice_id)) AS doi, arg_min_null(p, (imported_at, notice_id)) AS pmid, arg_max_null(st, (imported_at, notice_id)) AS status, arg_max_null(retraction_nature, (imported_at, notice_id)) AS nature, min(notice_id) AS notice_id FROM n GROUP BY record_id""")
def notices_upserted(spark: SparkSession, d: str) -> DataFrame:
    return corpus.latest_notices(table(spark, d, "retraction_notice"))


@query(f"SELECT slug, median(age) AS median_age, round(avg(CASE WHEN age <= 14 THEN 1.0 ELSE 0.0 END), 6) AS fresh_share FROM (SELECT unnest(list_distinct(field_slugs)) AS slug, DATE '{TODAY}' - feed_date AS age FROM paper_facts WHERE feed_date IS NOT NULL) GROUP BY slug")
def agg_median_age(spark: SparkSession, d: str) -> DataFrame:
    age = F.datediff(F.lit(TODAY).cast("date"), "feed_date")
    x = table(spark, d, "paper_facts").where("feed_date IS NOT NULL").select(F.explode(F.array_distinct("field_slugs")).alias("slug"), age.alias("age"))
    return x.groupBy("slug").agg(F.median("age").alias("median_age"), F.round(F.avg((F.col("age") <= 14).cast("double")), 6).alias("fresh_share"))


# ---- joins -----------------------------------------------------------------------------------------------------------------------------------


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.label IS NULL OR (d.n_chars % 10) IS DISTINCT FROM CAST(e.label AS BIGINT)")
def join_pending_null_safe(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 10).alias("updated_at"))
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("bigint").alias("source_updated_at"))
    return corpus.pending(papers, done).withColumnRenamed("id", "doc_id")


@query(f"""SELECT p.event_id, max_by(v.event_id, (v.ts, v.event_id)) AS seen_event FROM {_EVENTS} p LEFT JOIN {_EVENTS} v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id""")
def join_latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("event_id", "user_id", "event_type", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = e.where(F.col("event_type").isin("view", "purchase"))
    return both.withColumn("seen_event", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "seen_event")


@query("SELECT a.o_orderkey AS first_order, b.o_orderkey AS second_order FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(year(a.o_orderdate) - year(b.o_orderdate)) <= 1")
def join_range_residual(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("second_order"), F.col("y").alias("z"))
    return o.join(b, "o_custkey").where("o_orderkey < second_order AND abs(y - z) <= 1").select(F.col("o_orderkey").alias("first_order"), "second_order")


@query("SELECT coalesce(c.n_nationkey, s.n_nationkey) AS nation, c.customers, s.suppliers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.n_nationkey = s.n_nationkey")
def join_full_outer(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", "customers", "suppliers")


# ---- resolution and merging -------------------------------------------------------------------------------------------------------------------


@query()
def dedup_trigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every article with a title and authors, by the operator's own title folding and surname."""
    x = table(spark, d, "epmc_article").select(F.col("article_id").alias("id"), "title", text.first_surname(F.col("author_string")).alias("surname"), F.expr("try_cast(pub_year AS int)").alias("year"), "doi")
    return corpus.fuzzy_pairs(x).select("a", "b", F.round("similarity", 6).alias("similarity"))


_LINKS = f"""k AS (SELECT article_id AS id, unnest([{_DOI.format(c='doi')}, 'pmid:' || pmid, 'pmcid:' || pmcid]) AS i FROM epmc_article), e AS (SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.i = b.i WHERE a.i IS NOT NULL),
c AS (SELECT a AS id, a AS component FROM e UNION SELECT e.b, c.component FROM c JOIN e ON e.a = c.id)"""


@query(f"WITH RECURSIVE {_LINKS} SELECT id, min(component) AS component FROM c GROUP BY id HAVING count(*) > 1")
def dedup_components(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "epmc_article")
    k = a.select(F.col("article_id").alias("id"), F.explode(F.array(ids.doi(F.col("doi")), F.concat(F.lit("pmid:"), "pmid"), F.concat(F.lit("pmcid:"), "pmcid"))).alias("i")).where("i IS NOT NULL")
    hub = k.groupBy("i").agg(F.min("id").alias("hub"))
    return components(k.join(hub, "i").select("id", "hub"), "id", "hub")


@query(f"""WITH RECURSIVE {_LINKS}, r AS (SELECT id, min(component) AS component FROM c GROUP BY id), x AS (SELECT a.article_id AS record, {_DOI.format(c='a.doi')} AS doi, coalesce(r.component, a.article_id) AS component FROM epmc_article a LEFT JOIN r ON r.id = a.article_id),
s AS (SELECT k.i, x.component, min(x.doi) AS near FROM k JOIN x ON x.record = k.id WHERE x.doi IS NOT NULL AND k.i IS NOT NULL GROUP BY 1, 2), n AS (SELECT x.record, min(s.near) AS near FROM x JOIN k ON k.id = x.record JOIN s ON s.i = k.i AND s.component = x.component WHERE x.doi IS NULL GROUP BY 1),
l AS (SELECT component, min(doi) AS least FROM x GROUP BY 1) SELECT x.record, min(x.record) OVER (PARTITION BY x.component, coalesce(x.doi, n.near, l.least, '')) AS paper FROM x LEFT JOIN n ON n.record = x.record LEFT JOIN l ON l.component = x.component""")
def resolve_papers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "epmc_article")
    records = a.select(F.col("article_id").alias("record"), ids.doi(F.col("doi")).alias("doi"))
    known = a.select(F.col("article_id").alias("record"), F.explode(F.array(*[F.struct(F.lit(t).alias("id_type"), f(F.col(t)).alias("value")) for t, f in (("doi", ids.doi), ("pmid", ids.pmid), ("pmcid", ids.pmcid))])).alias("k")).select("record", "k.*")
    return corpus.resolved(records, known)


_CAND = f"""SELECT record_id, source_key, paper_id, fetched_at, nullif(trim(regexp_replace(regexp_replace({_UNESC.format(c="CASE source_key WHEN 'openalex' THEN coalesce(nullif(trim(payload ->> '$.display_name'), ''), payload ->> '$.title') ELSE payload ->> '$.title' END")}, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS title,
 {_DOI.format(c="payload ->> '$.doi'")} AS doi, try_strptime(substr(CASE source_key WHEN 'openalex' THEN payload ->> '$.publication_date' WHEN 'europepmc' THEN payload ->> '$.firstPublicationDate' WHEN 'pubmed' THEN payload ->> '$.pub_date' WHEN 'biorxiv' THEN payload ->> '$.date' ELSE payload ->> '$.created' END, 1, 10), '%Y-%m-%d')::DATE AS published,
 nullif(trim(regexp_replace({_UNESC.format(c="CASE source_key WHEN 'openalex' THEN payload ->> '$.primary_location.source.display_name' WHEN 'europepmc' THEN payload ->> '$.journalInfo.journal.title' WHEN 'pubmed' THEN payload ->> '$.journal' WHEN 'biorxiv' THEN payload ->> '$.server' ELSE payload ->> '$.\"journal-ref\"' END")}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '') AS venue FROM (SELECT * REPLACE (payload::JSON AS payload) FROM source_record)"""


@query(f"SELECT record_id, source_key, title, doi, published, venue FROM ({_CAND}) WHERE title IS NOT NULL")
def normalise_candidates(spark: SparkSession, d: str) -> DataFrame:
    return corpus.candidates(table(spark, d, "source_record")).select("record_id", "source_key", "title", "doi", "published", "venue")


# ---- whole candidates of each source ---------------------------------------------------------------------------------------------------------------

_SHOWN = "nullif(trim(regexp_replace(regexp_replace(" + _UNESC + ", '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '')"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return normalise.candidates_of(table(spark, d, "source_record"), named=False)


@query(
    "SELECT * FROM (SELECT record_id, CASE source_key WHEN 'openalex' THEN coalesce(" + _SHOWN.format(c="p ->> '$.title'") + ", " + _SHOWN.format(c="p ->> '$.display_name'") + ") ELSE " + _SHOWN.format(c="p ->> '$.title'") + " END AS title, "
    + _DOI.format(c="p ->> '$.doi'") + " AS doi, source_key IN ('arxiv', 'biorxiv') AS is_preprint, source_key = 'pubmed' OR (source_key = 'arxiv' AND " + _SHOWN.format(c="coalesce(p ->> '$.\"journal-ref\"', '')") + " IS NOT NULL) AS is_peer_reviewed,"
    " CASE source_key WHEN 'openalex' THEN 'unknown' WHEN 'europepmc' THEN 'closed' WHEN 'pubmed' THEN 'unknown' ELSE 'green' END AS oa_status, CASE WHEN source_key IN ('arxiv', 'biorxiv') THEN 'en' END AS language"
    " FROM (SELECT *, try_cast(payload AS JSON) AS p FROM source_record)) WHERE title IS NOT NULL"
)
def normalise_whole(spark: SparkSession, d: str) -> DataFrame:
    doi = F.get(F.filter("identifiers", lambda i: i["id_type"] == "doi"), F.lit(0))["value"]
    return _candidates(spark, d).select("record_id", "title", doi.alias("doi"), "is_preprint", "is_peer_reviewed", "oa_status", "language")


@query(
    "SELECT record_id, name, venue_type FROM (SELECT record_id, CASE source_key WHEN 'openalex' THEN " + _SHOWN.format(c="p ->> '$.primary_location.source.display_name'") + " WHEN 'europepmc' THEN " + _SHOWN.format(c="p ->> '$.journalInfo.journal.title'")
    + " WHEN 'pubmed' THEN " + _SHOWN.format(c="p ->> '$.journal'") + " WHEN 'arxiv' THEN 'arXiv' ELSE CASE lower(coalesce(p ->> '$.server', 'biorxiv')) WHEN 'biorxiv' THEN 'bioRxiv' WHEN 'medrxiv' THEN 'medRxiv' ELSE p ->> '$.server' END END AS name,"
    " CASE WHEN source_key IN ('europepmc', 'pubmed') THEN 'journal' WHEN source_key = 'openalex' THEN p ->> '$.primary_location.source.type' ELSE 'preprint_server' END AS venue_type,"
    " coalesce(" + _SHOWN.format(c="p ->> '$.title'") + ", CASE WHEN source_key = 'openalex' THEN " + _SHOWN.format(c="p ->> '$.display_name'") + " END) AS title FROM (SELECT *, try_cast(payload AS JSON) AS p FROM source_record)) WHERE name IS NOT NULL AND title IS NOT NULL"
)
def normalise_venues(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).where("venue IS NOT NULL").select("record_id", "venue.name", "venue.venue_type")


def _europepmc(spark: SparkSession, d: str) -> DataFrame:
    """(article_id, j): the articles' payloads as the source's own record; where one is wrapped, the record inside."""
    schema = normalise.PAYLOADS["europepmc"]
    wrapped = F.coalesce(F.get_json_object("payload", "$.resultList.result[0]"), F.get_json_object("payload", "$.result"))
    record = F.when(F.col("payload").contains('"result'), F.coalesce(wrapped, F.col("payload"))).otherwise(F.col("payload"))
    return table(spark, d, "epmc_article").where("payload LIKE '{%' AND get_json_object(payload, '$') IS NOT NULL").select("article_id", F.from_json(record, schema).alias("j"))


_EPMC = """e AS (SELECT article_id, CASE WHEN json_type(j -> '$.resultList.result[0]') = 'OBJECT' THEN j -> '$.resultList.result[0]' WHEN json_type(j -> '$.result') = 'OBJECT' THEN j -> '$.result' ELSE j END AS j
 FROM (SELECT article_id, try_cast(payload AS JSON) AS j FROM epmc_article WHERE payload LIKE '{%'))"""
_TYPE_RANK = "CASE t " + " ".join(f"WHEN '{k}' THEN {normalise.TYPE_ORDER.index(v)}" for k, v in normalise.PUBLICATION_TYPES.items()) + " END"


@query(
    f"""WITH {_EPMC}, t AS (SELECT article_id, lower(trim(unnest(CAST(CASE WHEN json_type(j -> '$.pubTypeList.pubType') = 'ARRAY' THEN j -> '$.pubTypeList.pubType' END AS VARCHAR[])))) AS t FROM e),
b AS (SELECT article_id, [{", ".join(f"'{x}'" for x in normalise.TYPE_ORDER)}][min({_TYPE_RANK}) + 1] AS work_type, bool_or(t IN ('retracted publication', 'retracted-article')) AS retracted FROM t GROUP BY article_id)
SELECT article_id, work_type, coalesce(retracted, false) AS retracted FROM e LEFT JOIN b USING (article_id) WHERE j IS NOT NULL"""
)
def normalise_work_types(spark: SparkSession, d: str) -> DataFrame:
    x = _europepmc(spark, d).where("j IS NOT NULL")
    retracted = F.arrays_overlap(normalise.publication_types(F.col("j")), F.array(*map(F.lit, normalise.RETRACTED_TYPES)))
    return x.select("article_id", normalise.work_type(F.col("j"), F.lit(False)).alias("work_type"), retracted.alias("retracted"))


@query(f"""WITH {_EPMC}, u AS (SELECT article_id, unnest(CAST(x AS JSON[])) AS u, generate_subscripts(CAST(x AS JSON[]), 1) AS n FROM (SELECT article_id, CASE WHEN json_type(j -> '$.fullTextUrlList.fullTextUrl') = 'ARRAY' THEN j -> '$.fullTextUrlList.fullTextUrl' ELSE '[]'::JSON END AS x FROM e)),
f AS (SELECT article_id, n, coalesce(u ->> '$.site', 'unknown') AS site, u ->> '$.url' AS url, coalesce(lower(u ->> '$.documentStyle') = 'pdf', false) AS pdf FROM u WHERE length(u ->> '$.url') > 0 AND u ->> '$.availabilityCode' IN ('OA', 'F')),
s AS (SELECT article_id, site, min(n) AS n, arg_min(url, n) FILTER (WHERE NOT pdf) AS page, arg_min(url, n) FILTER (WHERE pdf) AS pdf_url FROM f GROUP BY article_id, site)
SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY n) AS place, coalesce(page, pdf_url) AS url, pdf_url, replace(site, '_', ' ') AS source_name, site = coalesce(max(CASE WHEN site = 'Europe_PMC' THEN site END) OVER (PARTITION BY article_id), arg_min(site, n) OVER (PARTITION BY article_id)) AS is_best FROM s""")
def normalise_site_locations(spark: SparkSession, d: str) -> DataFrame:
    places = normalise.site_locations(F.col("j"), F.lit(False))
    x = _europepmc(spark, d).where("j IS NOT NULL").select("article_id", F.posexplode(places).alias("p", "x"))
    return x.select("article_id", (F.col("p") + 1).alias("place"), "x.url", "x.pdf_url", "x.source_name", "x.is_best")


_TRUST = "CASE source_key WHEN 'openalex' THEN 30 WHEN 'pubmed' THEN 25 WHEN 'europepmc' THEN 22 WHEN 'biorxiv' THEN 20 WHEN 'arxiv' THEN 10 ELSE 0 END"


@query(f"""WITH c AS (SELECT *, (-({_TRUST}), fetched_at, record_id) AS o FROM ({_CAND}) WHERE title IS NOT NULL AND paper_id IS NOT NULL)
SELECT paper_id, count(*) AS records, arg_min(title, o) AS title, arg_min(doi, o) FILTER (WHERE doi IS NOT NULL) AS doi, arg_min(published, o) FILTER (WHERE published IS NOT NULL) AS published, arg_min(venue, o) FILTER (WHERE venue IS NOT NULL) AS venue FROM c GROUP BY paper_id""")
def merge_field_precedence(spark: SparkSession, d: str) -> DataFrame:
    return corpus.folded(corpus.candidates(table(spark, d, "source_record"))).select("paper_id", "records", "title", "doi", "published", "venue")


@query(f"WITH RECURSIVE {_LINKS}, r AS (SELECT id, min(component) AS winner FROM c GROUP BY id) SELECT winner, id AS loser, 1 AS records FROM r WHERE winner <> id")
def merge_audit(spark: SparkSession, d: str) -> DataFrame:
    assigned = dedup_components(spark, d).select(F.col("id").alias("record"), F.col("component").alias("paper"))
    return corpus.merge_audit(assigned, table(spark, d, "epmc_article").select(F.col("article_id").alias("record"), F.col("article_id").alias("paper")))


@query(f"SELECT 'doi' AS id_type, doi AS value, arg_min(paper_id, (fetched_at, record_id)) AS paper FROM ({_CAND}) WHERE title IS NOT NULL AND doi IS NOT NULL AND paper_id IS NOT NULL GROUP BY doi")
def identifier_owners(spark: SparkSession, d: str) -> DataFrame:
    c = corpus.candidates(table(spark, d, "source_record")).where("doi IS NOT NULL AND paper_id IS NOT NULL")
    return corpus.identifier_owners(c.select(F.lit("doi").alias("id_type"), F.col("doi").alias("value"), F.col("paper_id").alias("paper"), F.col("fetched_at").alias("arrived"), F.col("record_id").alias("record")))


@query("SELECT paper_id, bool_and(source_key IN ('arxiv', 'biorxiv')) AS preprints_only, bool_or(source_key = 'pubmed') AS in_pubmed, count(*) AS records FROM source_record WHERE paper_id IS NOT NULL GROUP BY paper_id")
def corpus_provenance(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "source_record").where("paper_id IS NOT NULL").groupBy("paper_id")
    return x.agg(F.bool_and(F.col("source_key").isin("arxiv", "biorxiv")).alias("preprints_only"), F.bool_or(F.col("source_key") == "pubmed").alias("in_pubmed"), F.count("*").alias("records"))


@query(f"""WITH a AS (SELECT min(article_id) AS paper, {_DOI.format(c='doi')} AS doi FROM epmc_article WHERE doi IS NOT NULL GROUP BY 2), w AS (SELECT work_id, {_DOI.format(c='doi')} AS doi FROM openalex_work)
SELECT DISTINCT n.paper AS from_paper, a.paper AS to_paper FROM (SELECT {_DOI.format(c='retraction_doi')} AS f, {_DOI.format(c='original_paper_doi')} AS t FROM retraction_notice) x JOIN (SELECT 1000000 + min(notice_id) AS paper, {_DOI.format(c='retraction_doi')} AS doi FROM retraction_notice GROUP BY 2) n ON n.doi = x.f JOIN a ON a.doi = x.t WHERE n.paper <> a.paper""")
def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "retraction_notice").select("notice_id", ids.doi(F.col("retraction_doi")).alias("from_doi"), ids.doi(F.col("original_paper_doi")).alias("to_doi"))
    a = table(spark, d, "epmc_article").where("doi IS NOT NULL").groupBy(ids.doi(F.col("doi")).alias("doi")).agg(F.min("article_id").alias("paper"))
    own = n.groupBy(F.col("from_doi").alias("doi")).agg((F.min("notice_id") + 1000000).alias("paper"))
    return corpus.edges(n.select("from_doi", "to_doi"), a.unionByName(own))


@query(
    _PAYLOADS
    + """, u AS (SELECT origin || ':' || parent_id AS paper, m ->> '$.url' AS url, CASE m ->> '$.site' WHEN 'Repository' THEN 'repository' WHEN 'DOI' THEN 'publisher' ELSE 'unknown' END AS host_type, lower(m ->> '$.availability') AS licence, CASE WHEN m ->> '$.documentStyle' = 'pdf' THEN m ->> '$.url' END AS pdf_url, pos AS arrived FROM members WHERE child = 'full_text_url' AND json_type(m) = 'OBJECT' AND m ->> '$.url' IS NOT NULL),
o AS (SELECT paper, url, arg_min(host_type, arrived) AS host_type, arg_min(licence, arrived) FILTER (WHERE licence IS NOT NULL) AS licence, arg_min(pdf_url, arrived) FILTER (WHERE pdf_url IS NOT NULL) AS pdf_url, min(arrived) AS arrived FROM u GROUP BY paper, url)
SELECT paper, url, host_type, licence, pdf_url, arrived, row_number() OVER (PARTITION BY paper ORDER BY CASE host_type WHEN 'publisher' THEN 3 WHEN 'repository' THEN 2 ELSE 0 END DESC, CASE licence WHEN 'cc0' THEN 4 WHEN 'cc-by' THEN 3 ELSE 0 END DESC, arrived, url) = 1 AS is_best FROM o"""
)
def best_locations(spark: SparkSession, d: str) -> DataFrame:
    x = payload_children(*_payloads(spark, d), ("full_text_url",)).where("url IS NOT NULL")
    host = F.when(F.col("site") == "Repository", "repository").when(F.col("site") == "DOI", "publisher").otherwise("unknown")
    pdf = F.when(F.col("document_style") == "pdf", F.col("url"))
    return corpus.best_locations(x.select(F.concat_ws(":", "origin", "parent_id").alias("paper"), "url", host.alias("host_type"), F.lower("availability").alias("licence"), pdf.alias("pdf_url"), F.col("pos").alias("at"))).withColumnRenamed("at", "arrived")


# ---- the ingest step --------------------------------------------------------------------------------------------------------------------------------


@query("""SELECT record_id, CASE WHEN try_cast(payload AS JSON) IS NULL THEN 'bad' WHEN row_number() OVER (PARTITION BY source_key, source_id ORDER BY fetched_at DESC NULLS LAST, record_id DESC) > 1 THEN 'same' ELSE 'new' END AS state FROM source_record""")
def ingest_states(spark: SparkSession, d: str) -> DataFrame:
    """What each delivery is to an empty corpus: new, repeated or unreadable."""
    return ingest.delivered(table(spark, d, "source_record")).select("record_id", "state")


@query()
def ingest_papers(spark: SparkSession, d: str) -> DataFrame:
    """The whole step over all records: papers with fields from all their records."""
    made = ingest.ingested(table(spark, d, "source_record").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), F.lit(TODAY).cast("date"))
    return made.papers.select("paper", "records", "title", "doi", "published_date", "oa_status", "is_peer_reviewed", "is_preprint", "venue.name")


@query("SELECT name, count(*) AS records FROM (" + ORACLES["normalise_venues"].replace("SELECT record_id, name, venue_type FROM", "SELECT record_id, name FROM", 1) + ") GROUP BY name")
def ingest_venue_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates name each venue of the venue table."""
    c = _candidates(spark, d)
    known = ingest.venues(c).select("name")
    return c.where("venue IS NOT NULL").select("venue.name").join(known, "name", "left_semi").groupBy("name").agg(F.count("*").alias("records"))


@query(f"""WITH m AS (SELECT article_id AS record, 'doi' AS id_type, {_DOI.format(c='doi')} AS value FROM epmc_article UNION ALL SELECT article_id, 'pmid', nullif(ltrim(regexp_extract(pmid, '(\\d+)', 1), '0'), '') FROM epmc_article),
k AS (SELECT w.record, w.id_type, m.record AS paper FROM m w JOIN m ON w.id_type = m.id_type AND w.value = m.value), r AS (SELECT record, paper, max(CASE id_type WHEN 'doi' THEN 6 ELSE 4 END) AS strength FROM k GROUP BY 1, 2),
b AS (SELECT record, arg_min(paper, (-strength, paper)) AS winner FROM r GROUP BY record) SELECT record, winner, paper AS loser FROM r JOIN b USING (record) WHERE paper <> winner""")
def merge_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Of the articles that share an identifier with each one, itself included, the one with the strongest kind stays."""
    a = table(spark, d, "epmc_article")
    m = a.select(F.col("article_id").alias("record"), F.explode(F.array(*[F.struct(F.lit(t).alias("id_type"), f(F.col(t)).alias("value")) for t, f in (("doi", ids.doi), ("pmid", ids.pmid))])).alias("k")).select("record", "k.*").where("value IS NOT NULL")
    other = m.select("id_type", "value", F.col("record").alias("paper"))
    return ingest.survivors(m.join(other, ["id_type", "value"]).select("record", "id_type", "paper"))


@query("SELECT paper_id, doi_key FROM (SELECT paper_id, min(doi) AS doi_key, max(len(field_slugs)) AS f FROM (SELECT p.paper_id, p.field_slugs, d.doi FROM paper_facts p JOIN (" + f"SELECT paper_id, min(doi) AS doi FROM ({_CAND}) WHERE title IS NOT NULL AND doi IS NOT NULL GROUP BY paper_id" + ") d USING (paper_id)) GROUP BY paper_id) WHERE coalesce(f, 0) = 0 AND paper_id NOT IN (SELECT paper_id FROM source_record WHERE source_key = 'openalex' AND paper_id IS NOT NULL) ORDER BY paper_id")
def enrich_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Papers with a doi and no field that the aggregator never told of."""
    dois = corpus.candidates(table(spark, d, "source_record")).where("doi IS NOT NULL AND paper_id IS NOT NULL").groupBy(F.col("paper_id").alias("paper")).agg(F.min("doi").alias("doi"))
    p = table(spark, d, "paper_facts").where("paper_id IS NOT NULL").groupBy(F.col("paper_id").alias("paper")).agg(F.max_by("field_slugs", F.size("field_slugs")).alias("fields")).join(dois, "paper")
    asked = table(spark, d, "source_record").where("source_key = 'openalex' AND paper_id IS NOT NULL").select(F.col("paper_id").alias("paper")).distinct()
    return reports.enrichment_candidates(p, asked).select(F.col("paper").alias("paper_id"), F.col("doi").alias("doi_key"))


@query("SELECT preprint_id, coalesce(length(b) < 40, true) AS title_only, sha256(CASE WHEN length(b) >= 40 THEN h || '[SEP]' || b ELSE h END) AS text_hash FROM (SELECT preprint_id, coalesce(" + _SHOWN.format(c="title") + ", '') AS h, " + _SHOWN.format(c="abstract_text") + " AS b FROM epmc_preprint)")
def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the papers a first run takes up, and what they were made of."""
    p = table(spark, d, "epmc_preprint").select(F.col("preprint_id").alias("id"), "title", F.col("abstract_text").alias("abstract"), F.col("first_publication_date").cast("timestamp").alias("updated_at"))
    enc = HashedWords(64)
    none = keeping.encoded(p.limit(0), p.select("id").limit(0), enc, enc.model_key)
    return keeping.refreshed(p, none, enc, limit=None).select(F.col("id").alias("preprint_id"), "title_only", "text_hash")


# ---- sets --------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT paper_id, array_to_string(list_sort(list_distinct(flatten(list(topic_ids)))), ',') AS topics FROM paper_facts WHERE paper_id IS NOT NULL AND topic_ids IS NOT NULL GROUP BY paper_id")
def set_topic_union(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "paper_facts").where("paper_id IS NOT NULL").withColumn("seen", F.col("facts_id"))
    return corpus.united(x, "paper_id", "topic_ids", "seen").select("paper_id", F.array_join(F.array_sort("topic_ids"), ",").alias("topics"))


@query("SELECT paper_id FROM (SELECT paper_id FROM paper_facts WHERE is_preprint INTERSECT SELECT paper_id FROM source_record WHERE source_key = 'arxiv') EXCEPT SELECT paper_id FROM source_record WHERE source_key = 'pubmed'")
def set_intersect_except(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k: table(spark, d, "source_record").where(F.col("source_key") == k).select("paper_id")
    return table(spark, d, "paper_facts").where("is_preprint").select("paper_id").intersect(of("arxiv")).subtract(of("pubmed"))


# ---- retrieval ---------------------------------------------------------------------------------------------------------------------------------

_USABLE = "len(vector) = 96 AND list_bool_and(list_transform(vector, lambda x: isfinite(x))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))"
_FACTS = f"f AS (SELECT *, list_transform(vector, lambda x: x::DOUBLE) AS v FROM paper_facts WHERE vector IS NOT NULL AND {_USABLE})"
_INTERESTS = "q AS (SELECT facts_id AS qid, v AS qv, row_number() OVER (ORDER BY facts_id) - 1 AS n FROM f ORDER BY facts_id LIMIT 3)"


def _interests(spark: SparkSession, d: str) -> list[list[float]]:
    x = table(spark, d, "paper_facts").where("size(vector) = 96 AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(vector, x -> x <> 0)")
    return [[float(v) for v in r.vector] for r in x.orderBy("facts_id").limit(3).select("vector").collect()]


@query("WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM embeddings WHERE vec_id = 0) SELECT vec_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), qv), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), qv) DESC, vec_id LIMIT 20")
def retrieval_semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 0").first().embedding]
    top = semantic.semantic_search(e, "vec_id", "embedding", q, 20)
    return top.join(e.select(F.col("vec_id").alias("id"), "label"), "id").select(F.col("id").alias("vec_id"), "label", F.round("score", 6).alias("score"))


@query(f"""WITH {_FACTS}, {_INTERESTS}, s AS (SELECT facts_id AS id, max(list_cosine_similarity(v, qv)) AS score, arg_max(n, (list_cosine_similarity(v, qv), -n)) AS interest FROM f, q GROUP BY facts_id)
SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT 'top' AS kind, id, score, interest FROM s ORDER BY score DESC, id LIMIT 50) UNION ALL SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT 'band' AS kind, id, score, interest FROM s WHERE score BETWEEN 0.3 AND 0.4 ORDER BY score DESC, id LIMIT 50)""")
def set_union_top_band(spark: SparkSession, d: str) -> DataFrame:
    x = semantic.interest_scan(table(spark, d, "paper_facts"), "facts_id", "vector", _interests(spark, d), limit=50, band=(0.3, 0.4))
    return x.select("kind", "id", F.round("score", 6).alias("score"), F.col("interest").cast("bigint").alias("interest"))


@query("""WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS qv FROM embeddings WHERE vec_id = 1) SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), qv), 6) AS score FROM embeddings, q WHERE list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), qv) BETWEEN 0.1 AND 0.5""")
def retrieval_adjacent_band(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 1").first().embedding])
    return e.select("vec_id", cosine(F.col("embedding"), q).alias("s")).where("s BETWEEN 0.1 AND 0.5").select("vec_id", F.round("s", 6).alias("score"))


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))"


@query(f"SELECT doc_id AS id, 3 AS matched FROM documents WHERE list_has_all({_WORDS}, ['patients', 'hospitals', 'vaccines'])")
def retrieval_lexical_strict(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.postings(table(spark, d, "documents"), "doc_id", {"text": "C"}, stemmed=False)
    return lexical.evaluate(index, lexical.parse("patients hospitals the vaccines", stemmed=False)).select("id", "matched")


@query(f"SELECT doc_id AS id, len(list_intersect({_WORDS}, ['enantioselective', 'quasiparticles'])) AS matched FROM documents WHERE list_has_any({_WORDS}, ['enantioselective', 'quasiparticles'])")
def retrieval_lexical_relaxed(spark: SparkSession, d: str) -> DataFrame:
    index = lexical.postings(table(spark, d, "documents"), "doc_id", {"text": "C"}, stemmed=False)
    return lexical.evaluate(index, lexical.parse("enantioselective quasiparticles", stemmed=False).relaxed()).select("id", F.col("matched").cast("bigint").alias("matched"))


@query(f"SELECT doc_id AS id, 0 AS matched FROM documents WHERE NOT list_has_any({_WORDS}, ['patients', 'samples'])")
def retrieval_lexical_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Only exclusions: every text without the words, also those without any."""
    index = lexical.postings(table(spark, d, "documents"), "doc_id", {"text": "C"}, stemmed=False)
    return lexical.evaluate(index, lexical.parse("-patients -samples", stemmed=False)).select("id", F.col("matched").cast("bigint").alias("matched"))


@query()
def retrieval_cover_density(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "epmc_preprint")
    index = lexical.postings(p, "preprint_id", {"title": "A", "abstract_text": "C"})
    return lexical.lexical_search(index, 'marine "randomised trial" -hormones', 20)[0]


_LISTS = """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS query, v AS qv FROM e WHERE vec_id % 20 = 0),
s AS (SELECT query, vec_id AS id, list_cosine_similarity(v, qv) AS c, -list_sum(list_transform(list_zip(v, qv), lambda p: abs(p[1] - p[2]))) AS h FROM e, q),
r AS (SELECT query, 'cosine' AS method, id, c AS score, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM s UNION ALL SELECT query, 'taxicab', id, h, row_number() OVER (PARTITION BY query ORDER BY h DESC, id) FROM s),
l AS (SELECT * FROM r WHERE rank <= 50)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries (ids divisible by 20) against all rows, by two measures."""
    e = table(spark, d, "embeddings")
    one = lambda m: semantic.search_stated(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 50, measure=m).withColumn("method", F.lit(m))
    return one("cosine").unionByName(one("taxicab")).select("query", "method", "id", "rank", "score")


@query(f"WITH {_LISTS}, t AS (SELECT query, id, sum(1.0 / (60 + rank)) AS total FROM l GROUP BY query, id) SELECT query, id, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total DESC, id) AS k FROM t) WHERE k <= 10")
def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d), 10).select("query", "id", F.round("total", 6).alias("total"))


@query(f"""WITH {_LISTS}, n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM l WINDOW w AS (PARTITION BY query, method)), t AS (SELECT query, id, sum((CASE method WHEN 'taxicab' THEN 0.5 ELSE 1.0 END) * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END) AS total FROM n GROUP BY query, id)
SELECT query, id, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total DESC, id) AS k FROM t) WHERE k <= 10""")
def fusion_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_lists(spark, d), 10, how="weighted", weights={"taxicab": 0.5}).select("query", "id", F.round("total", 6).alias("total"))


# ---- recommendation ------------------------------------------------------------------------------------------------------------------------------


def _profile(spark: SparkSession, d: str) -> recommend.Profile:
    v = _interests(spark, d)
    made = tuple(recommend.Interest(f"i{n}", tuple(x), w, h, neg) for n, (x, w, h, neg) in enumerate(zip(v, (2.0, 1.0, 1.0), ("long", "short", "long"), (False, False, True), strict=False)))
    return recommend.Profile(made, topics=("T001", "T002"), fields=("field-1", "field-2"), recency=0.25, preprint_appetite=1.5)


_CLAMP = "least(1.0, greatest(0.0, {x}))"
_RESCALE = _CLAMP.format(x="({c} - 0.55) / 0.37")
_FEATURES = f"""{_FACTS}, {_INTERESTS}, a AS (SELECT facts_id, list_cosine_similarity(v, (SELECT qv FROM q WHERE n = 0)) AS c0, list_cosine_similarity(v, (SELECT qv FROM q WHERE n = 1)) AS c1, list_cosine_similarity(v, (SELECT qv FROM q WHERE n = 2)) AS c2 FROM f),
x AS (SELECT p.facts_id, coalesce({_RESCALE.format(c='c0')}, 0) AS affinity_long, coalesce({_RESCALE.format(c='c1')}, 0) AS affinity_short, coalesce({_RESCALE.format(c='c2')}, 0) AS negative_affinity,
 CASE WHEN c0 IS NULL THEN 1.0 WHEN c0 * 2 >= c1 THEN 1.0 ELSE 0.5 END AS interest_emphasis, len(list_intersect(list_distinct(coalesce(topic_ids, [])), ['T001', 'T002'])) / 2.0 AS topic_affinity,
 CASE WHEN list_has_any(field_slugs, ['field-1', 'field-2']) THEN 1.0 ELSE 0.0 END AS field_affinity, coalesce(exp(-greatest(DATE '{TODAY}' - feed_date, 0) / 14.0), 0.0) AS freshness,
 CASE WHEN list_has_any(topic_ids, ['T001', 'T002']) THEN 0.0 ELSE 1.0 END AS novelty,
 (CASE WHEN is_peer_reviewed THEN 1.0 ELSE 0.0 END + CASE WHEN has_abstract THEN 1.0 ELSE 0.0 END + {_CLAMP.format(x='coalesce(venue_mean_citedness, 0) / 10')}) / 3 AS quality_prior, CASE WHEN is_preprint THEN 0.75 ELSE 0.25 END AS preprint_fit,
 coalesce({_CLAMP.format(x='1 - seen_days_ago / 7')}, 0) AS seen_fatigue, CASE WHEN retraction_status = 'retracted' THEN 1.0 ELSE 0.0 END AS retracted FROM paper_facts p LEFT JOIN a USING (facts_id))"""
_NAMED = ("affinity_long", "affinity_short", "negative_affinity", "interest_emphasis", "topic_affinity", "field_affinity", "freshness", "novelty", "quality_prior", "preprint_fit", "seen_fatigue", "retracted")


def _featured(spark: SparkSession, d: str) -> DataFrame:
    return recommend.features(table(spark, d, "paper_facts"), _profile(spark, d), F.lit(TODAY).cast("date"))


@query(f"WITH {_FEATURES} SELECT facts_id, " + ", ".join(f"round({n}, 5) AS {n}" for n in _NAMED) + " FROM x")
def reco_features(spark: SparkSession, d: str) -> DataFrame:
    return _featured(spark, d).select("facts_id", *[F.round(n, 5).alias(n) for n in _NAMED])


_SCORE = "greatest(0, 0.35 * (0.75 * affinity_long + 0.25 * affinity_short) + 0.12 * interest_emphasis - 0.30 * negative_affinity + 0.15 * topic_affinity + 0.05 * field_affinity + 0.15 * freshness + 0.03 * novelty + 0.05 / 3 + 0.05 * quality_prior + 0.04 * preprint_fit - 0.20 * seen_fatigue - 0.60 * retracted) / 1.19"


@query(f"WITH {_FEATURES} SELECT facts_id, round({_SCORE}, 5) AS score FROM x")
def reco_scores(spark: SparkSession, d: str) -> DataFrame:
    return recommend.scored(_featured(spark, d)).select("facts_id", F.round("score", 5).alias("score"))


@query(f"WITH {_FACTS}, {_INTERESTS}, s AS (SELECT n AS interest, facts_id AS id, list_cosine_similarity(v, qv) AS score FROM f, q), t AS (SELECT *, row_number() OVER (PARTITION BY interest ORDER BY score DESC, id) AS rank FROM s) SELECT interest, rank, id, round(score, 6) AS score FROM t WHERE rank <= 100")
def reco_top_per_interest(spark: SparkSession, d: str) -> DataFrame:
    sims = similarities(table(spark, d, "paper_facts"), "facts_id", "vector", _interests(spark, d))
    return recommend.top_per_interest(sims).select("interest", "rank", "id", F.round("score", 6).alias("score"))


@query()
def reco_feed(spark: SparkSession, d: str) -> DataFrame:
    """A whole feed: all candidate sources, hard filters, features, score, varied order, reasons."""
    f = feeds.build_feed(table(spark, d, "paper_facts"), _profile(spark, d), F.lit(TODAY).cast("date"), window_days=3650)
    return f.items.select("rank", "id", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"), "exploring")


@query()
def reco_mmr(spark: SparkSession, d: str) -> DataFrame:
    s = recommend.scored(_featured(spark, d)).orderBy(F.desc("score"), "facts_id").limit(400)
    return recommend.diversified(s.select(F.lit(0).cast("bigint").alias("reader"), F.col("facts_id").alias("id"), "score", "interest", F.col("topic_ids").alias("topics"), "vector", (F.col("facts_id") % 7 == 0).alias("exploring")), 20)


@query(f"SELECT user_id, item, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {_EVENTS} WHERE event_type IN {POSITIVE}) WHERE n <= 12")
def reco_sequential(spark: SparkSession, d: str) -> DataFrame:
    return recommend.recent_positives(_events(spark, d), POSITIVE).select("user_id", "item", "event_id", "n")


@query(f"""WITH g AS (SELECT DISTINCT user_id, item FROM {_EVENTS} WHERE event_type IN {POSITIVE}), a AS (SELECT item FROM g WHERE user_id = 1), p AS (SELECT DISTINCT user_id FROM g WHERE user_id <> 1 AND item IN (SELECT item FROM a))
SELECT item, count(DISTINCT user_id) AS support, round(least(1.0, count(DISTINCT user_id) / 5.0), 6) AS strength FROM g WHERE user_id IN (SELECT user_id FROM p) AND item NOT IN (SELECT item FROM a) GROUP BY item HAVING count(DISTINCT user_id) >= 3 ORDER BY support DESC, item LIMIT 50""")
def reco_collaborative(spark: SparkSession, d: str) -> DataFrame:
    return recommend.collaborative(_events(spark, d), 1, POSITIVE, 50).select("item", "support", F.round("strength", 6).alias("strength"))


@query(f"SELECT user_id, item, round(greatest(0, 1 - epoch(TIMESTAMP '2024-02-01' - max(ts)) / 86400 / 7), 6) AS fatigue FROM {_EVENTS} WHERE event_type = 'view' GROUP BY user_id, item")
def reco_seen_fatigue(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).where("event_type = 'view'").groupBy("user_id", "item").agg(F.max("ts").alias("ts"))
    days = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86400e6
    return x.select("user_id", "item", F.round(scores.seen_fatigue(days), 6).alias("fatigue"))


@query(f"SELECT item AS id, count(DISTINCT event_type) AS agreement, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS origins FROM {_EVENTS} WHERE event_type IN {POSITIVE} GROUP BY item")
def reco_pool(spark: SparkSession, d: str) -> DataFrame:
    c = _events(spark, d).where(F.col("event_type").isin(*POSITIVE)).groupBy(F.col("item").alias("id"), F.col("event_type").alias("origin")).agg(F.count("*").cast("double").alias("strength"))
    return recommend.pooled(c).select("id", "agreement", F.array_join(F.transform("origins", lambda o: o["origin"]), ",").alias("origins"))


_NOW = "TIMESTAMP '2024-02-01'"


@query(f"""SELECT user_id, CAST(item % 5 AS VARCHAR) AS interest_key, round(3 * (exp(2 * t / 3) - 1) / (exp(2 * t / 3) + 1), 5) AS delta FROM (SELECT user_id, item % 5 AS item, sum((CASE event_type WHEN 'click' THEN 0.2 WHEN 'signup' THEN 0.6 WHEN 'purchase' THEN 0.5 WHEN 'error' THEN -0.7 ELSE 0.0 END) * pow(0.5, greatest(0, epoch({_NOW} - ts) / 86400) / 180)) AS t FROM {_EVENTS} GROUP BY 1, 2)""")
def feedback_decay(spark: SparkSession, d: str) -> DataFrame:
    x = _events(spark, d).withColumn("interest_key", (F.col("item") % 5).cast("string"))
    return recommend.interest_deltas(x, SIGNALS, F.lit("2024-02-01").cast("timestamp")).select("user_id", "interest_key", F.round("delta", 5).alias("delta"))


@query("SELECT user_id, round(coalesce(count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 0), 6) AS rate FROM events GROUP BY user_id")
def feedback_rate(spark: SparkSession, d: str) -> DataFrame:
    return recommend.impression_rate(table(spark, d, "events"), "click", "view").select("user_id", F.round("rate", 6).alias("rate"))


# ---- evaluation ----------------------------------------------------------------------------------------------------------------------------------

_GRADES = "g AS (SELECT q.vec_id AS query, e.vec_id AS id, CASE WHEN e.label = q.label THEN 3 WHEN abs(e.label - q.label) = 1 THEN 1 END AS grade FROM embeddings e JOIN embeddings q ON abs(e.label - q.label) <= 1 WHERE q.vec_id % 20 = 0)"


def _grades(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a stated query's label makes relevant: 3 for the same label, 1 for the next; judgments of 0 need no row."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    asked = e.where("id % 20 = 0").select(F.col("id").alias("query"), F.explode(F.array(F.col("label"), F.col("label") - 1, F.col("label") + 1)).alias("label"), F.col("label").alias("own"))
    near = asked.join(e, "label").select("query", "id", F.when(F.col("label") == F.col("own"), 3).otherwise(1).alias("grade"))
    return near


@query(f"""WITH {_LISTS}, {_GRADES}, j AS (SELECT l.query, l.method, l.rank, coalesce(g.grade, 0) AS g FROM l LEFT JOIN g USING (query, id)), o AS (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS place FROM g),
i AS (SELECT query, count(*) FILTER (WHERE grade >= 2) AS rel, sum(CASE WHEN place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS ideal FROM o GROUP BY query)
SELECT query, method, round(coalesce(1.0 / min(CASE WHEN g >= 2 THEN rank END), 0), 6) AS rr, round(count(*) FILTER (WHERE g >= 2 AND rank <= 10) / 10.0, 6) AS precision_10, round(coalesce(count(*) FILTER (WHERE g >= 2 AND rank <= 10) / nullif(any_value(rel), 0), 0), 6) AS recall_10,
 round(coalesce(sum(CASE WHEN rank <= 10 THEN (pow(2, g) - 1) / log2(rank + 1) ELSE 0 END) / nullif(any_value(ideal), 0), 0), 6) AS ndcg_10 FROM j JOIN i USING (query) GROUP BY query, method""")
def eval_precision_recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.metrics(_lists(spark, d), _grades(spark, d), (10,))
    return m.select("query", "method", *[F.round(c, 6).alias(c) for c in ("rr", "precision_10", "recall_10", "ndcg_10")])


@query(f"WITH {_LISTS} SELECT query, id, array_to_string(list_sort(list_distinct(list(method))), ',') AS methods FROM l GROUP BY query, id")
def eval_pool(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pool(_lists(spark, d)).withColumn("methods", F.array_join("methods", ","))


@query(f"WITH {_LISTS}, {_GRADES}, p AS (SELECT query, count(*) AS pooled, count(g.grade) AS judged FROM (SELECT DISTINCT query, id FROM l) x LEFT JOIN g USING (query, id) GROUP BY query) SELECT l.query, method, any_value(pooled) AS pooled, any_value(judged) AS judged, count(*) FILTER (WHERE g.grade IS NULL) AS unjudged FROM l LEFT JOIN g USING (query, id) JOIN p ON p.query = l.query WHERE rank <= 10 GROUP BY l.query, method")
def eval_coverage(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.coverage(_lists(spark, d), _grades(spark, d))


@query("""WITH a AS (SELECT user_id AS query, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 END) AS grade, list_sort(list_distinct(list(event_type))) AS methods FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
b AS (SELECT user_id AS query, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 1 END) AS grade, list_sort(list_distinct(list(event_type))) AS methods FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(a.query, b.query) AS query, coalesce(a.id, b.id) AS id, coalesce(a.grade, b.grade) AS grade, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.methods, []), coalesce(b.methods, [])))), ',') AS methods FROM a FULL JOIN b ON a.query = b.query AND a.id = b.id""")
def eval_merge_judgments(spark: SparkSession, d: str) -> DataFrame:
    grade = F.max(F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 1)).alias("grade")
    half = lambda n: _events(spark, d).where(F.col("event_id") % 2 == n).groupBy(F.col("user_id").alias("query"), F.col("item").alias("id")).agg(grade, F.array_sort(F.collect_set("event_type")).alias("methods"))
    return evaluation.merged_judgments(half(0), half(1)).withColumn("methods", F.array_join("methods", ","))


@query(f"""WITH s AS (SELECT source_key AS feed, p.facts_id, p.topic_ids, p.feed_date, p.venue_name FROM (SELECT DISTINCT source_key, paper_id FROM source_record WHERE paper_id IS NOT NULL) r JOIN paper_facts p USING (paper_id)),
t AS (SELECT feed, count(*) AS topics, max(c) AS most FROM (SELECT feed, t, count(*) AS c FROM (SELECT feed, unnest(topic_ids) AS t FROM s) GROUP BY 1, 2) GROUP BY 1)
SELECT s.feed, count(*) AS size, any_value(topics) AS topics, round(any_value(most) / count(*), 6) AS max_topic_share, median(DATE '{TODAY}' - feed_date) AS median_age, round(avg(CASE WHEN feed_date IS NULL THEN NULL WHEN DATE '{TODAY}' - feed_date <= 14 THEN 1.0 ELSE 0.0 END), 6) AS fresh_share, count(DISTINCT venue_name) AS interests FROM s LEFT JOIN t ON t.feed = s.feed GROUP BY s.feed""")
def eval_feed_description(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "source_record").where("paper_id IS NOT NULL").select(F.col("source_key").alias("feed"), "paper_id").distinct()
    f = r.join(table(spark, d, "paper_facts"), "paper_id").select("feed", F.col("facts_id").alias("id"), "topic_ids", "feed_date", F.col("venue_name").alias("interest"))
    return evaluation.feed_description(f, TODAY).select("feed", "size", "topics", F.round("max_topic_share", 6).alias("max_topic_share"), "median_age", F.round("fresh_share", 6).alias("fresh_share"), "interests")


# ---- streams, in their batch form; tests/ runs them as streams --------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_event_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ev.deduplicated(e.unionByName(e.where("event_id % 3 = 0"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return ev.tumbling(table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(table(spark, d, "events")).select("user_id", F.unix_micros("start").alias("start"), "n")


def _learning(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where(F.col("event_type").isin("purchase", "signup", "error"))
    return e.select("user_id", F.concat(F.lit("f"), (F.col("item") % 4).cast("string")).alias("feature"), "ts", "event_id", F.when(F.col("event_type") == "error", -1.0).otherwise(1.0).alias("direction"), (F.col("item") % 10 / 10.0).alias("value"))


@query(f"SELECT user_id, 'f' || (item % 4) AS feature, count(*) AS observations, round(sum(0.02 * (CASE event_type WHEN 'error' THEN -1 ELSE 1 END) * (item % 10) / 10.0), 6) AS weight FROM {_EVENTS} WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1, 2")
def stream_online_weights(spark: SparkSession, d: str) -> DataFrame:
    return ev.learned_weights(_learning(spark, d)).select("user_id", "feature", F.col("observations").cast("bigint").alias("observations"), F.round("weight", 6).alias("weight"))


@query()
def embed_hashing(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "epmc_preprint").select("preprint_id", text.embedding_input(F.col("title"), F.col("abstract_text")).alias("t"))
    return embedded(x, "preprint_id", "t", HashedWords(128))


# ---- relational parity on the star schema --------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def star_pricing(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
    return x.agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def star_local_suppliers(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    x = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g1, grouping(o_orderpriority) AS g2, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def olap_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("bigint").alias("g1"), F.grouping("o_orderpriority").cast("bigint").alias("g2"), F.count("*").alias("n"))


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ROLLUP (y, m)")
def olap_rollup(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m"))
    return x.rollup("y", "m").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def window_frames(spark: SparkSession, d: str) -> DataFrame:
    run = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(run), 2).alias("last_three"), F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint").alias("place"))


@query()
def agg_approximate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median_price"))
