"""From raw records to papers: normalised candidates, resolved identities, folded fields, notices and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions import dates, ids, text
from bibliome.operators.components import components
from bibliome.session import cut_lineage

#: Which source is believed for which field; a source that isn't listed ranks below all.
TITLE_TRUST = {"openalex": 30, "pubmed": 25, "europepmc": 22, "biorxiv": 20, "arxiv": 10}
ABSTRACT_TRUST = {"pubmed": 50, "europepmc": 40, "openalex": 30, "biorxiv": 20, "arxiv": 10}
#: How open a status is, how complete a version, a host and a licence are, and how grave a notice is.
OA_RANK = {"unknown": 0, "closed": 1, "bronze": 2, "green": 3, "hybrid": 4, "gold": 5, "diamond": 6}
VERSION_RANK = {"publishedVersion": 3, "acceptedVersion": 2, "submittedVersion": 1, "unknown": 0}
HOST_RANK = {"publisher": 3, "repository": 2, "preprint": 1, "unknown": 0}
LICENCE_RANK = {"cc0": 4, "cc-by": 3, "cc-by-sa": 2, "cc-by-nc": 1}
NATURE_STATUS = {"retraction": "retracted", "expression of concern": "concern", "correction": "corrected", "reinstatement": "none"}
SEVERITY = {"none": 0, "corrected": 1, "concern": 2, "retracted": 3}

_RECORD = (
    "id string, title string, display_name string, abstract string, abstractText string, abstract_inverted_index map<string,array<int>>, doi string, publication_date string, firstPublicationDate string,"
    " pub_date string, `date` string, created string, primary_location struct<source:struct<display_name:string>,license:string>, journalInfo struct<journal:struct<title:string>>, journal string, server string, `journal-ref` string, license string"
)


def looked_up(table: dict[str, int] | dict[str, str], c: Column, default: int | str | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(m[c], F.lit(default))


def candidates(records: DataFrame) -> DataFrame:
    """source_record -> one row per readable record: what each source's payload says, in one shape.

    An aggregator's abstract is put together from its inverted index; preprint servers always give preprints, and arXiv's are
    peer reviewed if they name a journal. Unreadable payloads and records without a title give no row.
    """
    j = F.from_json("payload", _RECORD)
    x = records.select("record_id", "source_key", "source_id", "paper_id", "fetched_at", j.alias("j")).where("j IS NOT NULL")
    key = F.col("source_key")
    pick = lambda **by: _by_source(key, by)
    title = F.when(key == "openalex", F.coalesce(F.nullif(F.trim("j.display_name"), F.lit("")), F.col("j.title"))).otherwise(F.col("j.title"))
    abstract = F.when(key == "openalex", text.inverted_text(F.col("j.abstract_inverted_index"))).when(key == "europepmc", F.col("j.abstractText")).otherwise(F.col("j.abstract"))
    day = pick(openalex="publication_date", europepmc="firstPublicationDate", pubmed="pub_date", biorxiv="date", arxiv="created")
    venue = pick(openalex="primary_location.source.display_name", europepmc="journalInfo.journal.title", pubmed="journal", biorxiv="server", arxiv="`journal-ref`")
    licence = pick(openalex="primary_location.license", europepmc="license", pubmed="license", biorxiv="license", arxiv="license")
    return x.select(
        "record_id", "source_key", "source_id", "paper_id", "fetched_at", text.display_text(title).alias("title"), text.display_text(abstract).alias("abstract"), ids.doi(F.col("j.doi")).alias("doi"),
        dates.iso_date(day).alias("published"), text.display_text(venue).alias("venue"), F.nullif(F.regexp_replace(F.lower(F.trim(licence)), r"[\s_]+", "-"), F.lit("")).alias("licence"),
        key.isin("arxiv", "biorxiv").alias("is_preprint"), (~key.isin("arxiv", "biorxiv") | ((key == "arxiv") & (F.length(F.trim(F.coalesce("j.journal-ref", F.lit("")))) > 0))).alias("is_peer_reviewed"),
    ).where("title IS NOT NULL")


def _by_source(key: Column, by: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for source, path in by.items():
        out = F.when(key == source, F.col(f"j.{path}")).otherwise(out)
    return out


def resolved(records: DataFrame, identifiers: DataFrame) -> DataFrame:
    """records(record, doi), identifiers(record, id_type, value) -> (record, paper): records that share an identifier are one
    paper, named by its least record, but two different dois never are: a component that holds several is cut by doi, and a
    record without one goes to the doi it shares an identifier with (the least of several).

    Components, not arrival order, decide, so the result doesn't depend on the order in which records came in.
    """
    known = identifiers.where("value IS NOT NULL").select("record", F.concat_ws(":", "id_type", "value").alias("ident"))
    hub = known.groupBy("ident").agg(F.min("record").alias("hub"))
    links = known.join(hub, "ident").where("record <> hub").select("record", "hub")
    comp = components(links, "record", "hub")
    x = records.join(comp.withColumnRenamed("id", "record"), "record", "left").select("record", F.nullif("doi", F.lit("")).alias("doi"), F.coalesce("component", "record").alias("component"))
    x = cut_lineage(x)
    shared = known.join(x.where("doi IS NOT NULL").select("record", "doi", "component"), "record").groupBy("ident", "component").agg(F.min("doi").alias("near"))
    near = known.join(x.where("doi IS NULL").select("record", "component"), "record").join(shared, ["ident", "component"]).groupBy("record").agg(F.min("near").alias("near"))
    least = x.where("doi IS NOT NULL").groupBy("component").agg(F.min("doi").alias("least"))
    full = x.join(near, "record", "left").join(least, "component", "left").withColumn("cut", F.coalesce("doi", "near", "least", F.lit("")))
    name = full.groupBy("component", "cut").agg(F.min("record").alias("paper"))
    return full.join(name, ["component", "cut"]).select("record", "paper")


def fuzzy_pairs(papers: DataFrame, *, least: float = 0.6, shortest: int = 12) -> DataFrame:
    """papers(id, title, surname, year, doi) -> (a, b, similarity), a < b: same first author, years at most one apart (an unknown
    year fits any), trigram similarity of folded titles at least `least`, and no two different dois.

    Candidates share one of the rarest trigrams of their titles: enough of them that no pair above the threshold is missed, and
    few enough that common trigrams never meet. Titles that weigh less than `shortest` letters match nothing.
    """
    t = papers.withColumn("folded", text.fold_title(F.col("title"))).where(text.blocking_weight(F.col("folded")) >= shortest).where("surname IS NOT NULL")
    t = cut_lineage(t.select("id", "surname", "year", "doi", text.trigrams(F.col("folded")).alias("grams")))
    each = t.select("id", F.explode("grams").alias("g"))
    freq = each.groupBy("g").agg(F.count("*").alias("n"))
    order = each.join(freq, "g").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "g"))), lambda x: x.g).alias("rare"))
    prefix = order.select("id", F.explode(F.slice("rare", F.lit(1), (F.size("rare") - F.ceil(F.size("rare") * least) + 1).cast("int"))).alias("g"))
    p = prefix.join(t.select("id", "surname", "year"), "id")
    near = (
        p.alias("a").join(p.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.surname") == F.col("b.surname")) & (F.col("a.id") < F.col("b.id")))
        .where("a.year IS NULL OR b.year IS NULL OR abs(a.year - b.year) <= 1").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    )
    full = near.join(t.select(F.col("id").alias("a"), F.col("grams").alias("ga"), F.col("doi").alias("da")), "a").join(t.select(F.col("id").alias("b"), F.col("grams").alias("gb"), F.col("doi").alias("db")), "b")
    return full.where(~ids.conflicting(F.col("da"), F.col("db"))).select("a", "b", text.jaccard(F.col("ga"), F.col("gb")).alias("similarity")).where(F.col("similarity") >= least)


def folded(c: DataFrame) -> DataFrame:
    """candidates with paper_id -> one row per paper: each field from the source most trusted for it.

    Title, date and venue follow title trust, then arrival; the abstract its own trust, then length; a paper is peer reviewed if
    any source says so and a preprint only as long as none does.
    """
    trust = -looked_up(TITLE_TRUST, F.col("source_key"), 0)
    told = -looked_up(ABSTRACT_TRUST, F.col("source_key"), 0)
    by = F.struct(trust.alias("t"), F.col("fetched_at").alias("f"), F.col("record_id").alias("r"))
    best = lambda col: F.min_by(F.col(col), F.when(F.col(col).isNotNull(), by)).alias(col)
    whole = F.struct(told.alias("t"), (-F.length("abstract")).alias("l"), F.col("record_id").alias("r"))
    return c.where("paper_id IS NOT NULL").groupBy("paper_id").agg(
        F.count("*").alias("records"), best("title"), F.min_by("abstract", F.when(F.col("abstract").isNotNull(), whole)).alias("abstract"), best("doi"), best("published"), best("venue"),
        F.bool_or("is_peer_reviewed").alias("is_peer_reviewed"), (F.bool_or("is_preprint") & ~F.bool_or("is_peer_reviewed")).alias("is_preprint"),
    )


def united(df: DataFrame, key: str, lists: str, at: str, *, same: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, lists): the distinct members of all lists of a key, each as it was first spelled, in order of arrival.

    `at` says when a row came in; `same` maps a member to what makes it equal to others (keywords: their folded form). Members
    are made distinct before they are gathered, so that a key with very many rows costs no more than its distinct members.
    """
    each = df.select(key, F.col(at).alias("_at"), F.posexplode(lists).alias("_place", "_member")).where("_member IS NOT NULL")
    each = each.withColumn("_same", same(F.col("_member")) if same else F.col("_member"))
    first = each.groupBy(key, "_same").agg(F.min(F.struct("_at", "_place", F.col("_member").alias("_shown"))).alias("f"))
    listed = F.array_sort(F.collect_list(F.struct("f._at", "f._place", "f._shown")))
    return first.groupBy(key).agg(F.transform(listed, lambda x: x["_shown"]).alias(lists))


def united_topics(df: DataFrame, key: str, topics: str, at: str) -> DataFrame:
    """The same for topics (structs with scheme and id): one per scheme and id, the first to come in wins."""
    return united(df, key, topics, at, same=lambda t: F.concat_ws(":", t.scheme, t.id))


def united_keywords(df: DataFrame, key: str, keywords: str, at: str) -> DataFrame:
    """The same for keywords: one per folded form, the first spelling wins."""
    return united(df, key, keywords, at, same=lambda k: F.lower(F.trim(k)))


def most_open(status: Column) -> Column:
    """An aggregate: of several open access statuses the most open one; an unknown word counts as unknown."""
    return F.max_by(status, F.coalesce(looked_up(OA_RANK, status, 0), F.lit(0)))


def merge_audit(assigned: DataFrame, stored: DataFrame) -> DataFrame:
    """assigned(record, paper), stored(record, paper) -> (winner, loser, records): stored papers that now belong to another."""
    x = assigned.withColumnRenamed("paper", "winner").join(stored.withColumnRenamed("paper", "loser"), "record")
    return x.where("winner <> loser").groupBy("winner", "loser").agg(F.count("*").alias("records"))


def identifier_owners(identifiers: DataFrame) -> DataFrame:
    """identifiers(id_type, value, paper, arrived, record) -> (id_type, value, paper): the first owner keeps a contested one."""
    first = F.struct("arrived", "record")
    return identifiers.groupBy("id_type", "value").agg(F.min_by("paper", first).alias("paper"))


def latest_notices(notices: DataFrame) -> DataFrame:
    """One row per record_id: identity from the first import, nature, reason and status from the last."""
    first, last = F.struct("imported_at", "notice_id"), F.struct("imported_at", "notice_id")
    status = looked_up(NATURE_STATUS, F.lower(F.trim("retraction_nature")), "concern")
    x = notices.withColumns({"doi": ids.doi(F.col("original_paper_doi")), "pmid": ids.pmid(F.col("original_paper_pubmed_id")), "status": status})
    return x.where("record_id IS NOT NULL").groupBy("record_id").agg(F.min_by("doi", first).alias("doi"), F.min_by("pmid", first).alias("pmid"), F.max_by("status", last).alias("status"), F.max_by("retraction_nature", last).alias("nature"), F.min("notice_id").alias("notice_id"))


def worst_status(notices: DataFrame, papers: DataFrame) -> DataFrame:
    """notices(notice_id, doi, pmid, status), papers(paper, doi, pmid) -> (paper, status, notice_id): the gravest notice of each
    paper, found by either identifier; of equally grave ones the first."""
    keyed = lambda df, *keep: df.select(*keep, F.explode(F.array(F.struct(F.lit("doi").alias("t"), F.col("doi").alias("v")), F.struct(F.lit("pmid").alias("t"), F.col("pmid").alias("v")))).alias("k")).select(*keep, "k.t", "k.v").where("v IS NOT NULL")
    met = keyed(papers, "paper").join(keyed(notices, "notice_id", "status"), ["t", "v"]).select("paper", "notice_id", "status").distinct()
    grave = F.struct((-looked_up(SEVERITY, F.col("status"), 0)).alias("s"), F.col("notice_id").alias("n"))
    return met.groupBy("paper").agg(F.min_by("status", grave).alias("status"), F.min_by("notice_id", grave).alias("notice_id"))


def best_locations(locations: DataFrame) -> DataFrame:
    """locations(paper, url, host_type, licence, pdf_url, at, and if known version, source_name) -> one row per paper and url, gaps
    filled in order of arrival, with is_best on the one of the best version, host and licence; of equal ones the first."""
    fill = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    more = [c for c in ("version", "source_name") if c in locations.columns]
    one = locations.groupBy("paper", "url").agg(*map(fill, ["host_type", "licence", "pdf_url", *more]), F.min("at").alias("at"))
    version = [F.desc(looked_up(VERSION_RANK, F.col("version"), 0))] if "version" in more else []
    rank = F.row_number().over(Window.partitionBy("paper").orderBy(*version, F.desc(looked_up(HOST_RANK, F.col("host_type"), 0)), F.desc(looked_up(LICENCE_RANK, F.lower("licence"), 0)), "at", "url"))
    return one.withColumn("is_best", rank == 1)


def edges(links: DataFrame, papers: DataFrame) -> DataFrame:
    """links(from_doi, to_doi), papers(paper, doi) -> (from_paper, to_paper): both ends known and different, each edge once."""
    end = lambda side: papers.select(F.col("doi").alias(f"{side}_doi"), F.col("paper").alias(f"{side}_paper"))
    return links.join(end("from"), "from_doi").join(end("to"), "to_doi").where("from_paper <> to_paper").select("from_paper", "to_paper").distinct()


def pending(papers: DataFrame, done: DataFrame) -> DataFrame:
    """papers(id, updated_at), done(id, source_updated_at) -> ids not done yet or changed since, the newest first by id."""
    x = papers.join(done, "id", "left")
    return x.where(F.col("source_updated_at").isNull() | ~F.col("updated_at").eqNullSafe(F.col("source_updated_at"))).select("id")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new rows put in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
