"""From raw deliveries to papers: what is new, whose paper it is, and everything a paper takes over from its records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions import dates, ids, text
from bibliome.operators import corpus, normalise
from bibliome.operators.components import components
from bibliome.session import cut_lineage

#: How alike titles and authors have to be for a match without identifiers, and how many letters a title needs.
TITLES_ALIKE, AUTHORS_ALIKE, SHORTEST = 0.92, 0.5, 12


def payload_hash(payload: Column) -> Column:
    """The same for payloads that differ only in the order of their keys and in white space; null where it can't be read."""
    return F.sha2(F.to_json(F.try_parse_json(payload)), 256)


def delivered(records: DataFrame, stored: DataFrame | None = None, *, force: bool = False) -> DataFrame:
    """records with content_hash and state: 'bad' (unreadable), 'same' (the stored record of that source and id has this payload)
    or 'new'. Of several deliveries of one record only the last fetched counts, the others are 'same'. `force` takes unchanged
    records as new, for when it is the rules that changed."""
    x = records.withColumn("content_hash", payload_hash(F.col("payload")))
    last = F.row_number().over(Window.partitionBy("source_key", "source_id").orderBy(F.desc_nulls_last("fetched_at"), F.desc("record_id")))
    x = x.withColumn("_n", last)
    if stored is not None:
        held = stored.groupBy("source_key", "source_id").agg(F.max("content_hash").alias("_held"))
        x = x.join(held, ["source_key", "source_id"], "left")
    else:
        x = x.withColumn("_held", F.lit(None).cast("string"))
    same = (F.col("_n") > 1) | (F.col("content_hash").eqNullSafe(F.col("_held")) & ~F.lit(force))
    return x.withColumn("state", F.when(F.col("content_hash").isNull(), "bad").when(same, "same").otherwise("new")).drop("_n", "_held")


def alike(candidates: DataFrame, *, titles: float = TITLES_ALIKE, authors: float = AUTHORS_ALIKE) -> DataFrame:
    """(a, b, confidence), a < b: candidates that share no identifier but tell of one paper: equal first surname, years at most one
    apart, no two dois, titles alike and enough surnames in common. Titles too short to name a paper match nothing."""
    names = F.transform("authors", lambda a: a["name"])
    first = F.get(names, F.lit(0))
    x = candidates.select(F.col("record_id").alias("id"), "title", text.surname(first).alias("surname"), F.year("published_date").alias("year"), _doi().alias("doi"), text.surnames(names).alias("names"))
    near = corpus.fuzzy_pairs(x.select("id", "title", "surname", "year", "doi"), least=titles, shortest=SHORTEST)
    of = lambda side: x.select(F.col("id").alias(side), F.col("names").alias(f"n{side}"))
    both = near.join(of("a"), "a").join(of("b"), "b").withColumn("shared", text.jaccard(F.col("na"), F.col("nb"))).where(F.col("shared") >= authors)
    return both.select("a", "b", (F.least(F.lit(1.0), "similarity") * F.greatest("shared", F.lit(0.5))).alias("confidence"))


def _doi() -> Column:
    return F.get(F.filter("identifiers", lambda i: i["id_type"] == "doi"), F.lit(0))["value"]


def resolved_candidates(candidates: DataFrame, *, fuzzy: bool = True) -> DataFrame:
    """(record, paper, rule, confidence): candidates that share an identifier are one paper, and so are those alike; two different
    dois never are. A paper is named by its least record; rule says how a record came to it ('identifier', 'fuzzy_title_author', or
    'created' for a paper's only record)."""
    c = candidates.select(F.col("record_id").alias("record"), _doi().alias("doi"), "identifiers")
    known = c.select("record", F.explode("identifiers").alias("i")).select("record", "i.*")
    by_id = cut_lineage(corpus.resolved(c.select("record", "doi"), known))
    if not fuzzy:
        return _ruled(by_id, None)
    near = alike(candidates)
    paper_doi = c.join(by_id, "record").groupBy("paper").agg(F.max("doi").alias("doi"))
    end = lambda side: by_id.select(F.col("record").alias(side), F.col("paper").alias(f"p{side}"))
    met = near.join(end("a"), "a").join(end("b"), "b").where("pa <> pb").groupBy(F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb")).agg(F.max("confidence").alias("confidence"))
    doi = lambda side: paper_doi.select(F.col("paper").alias(f"p{side}"), F.col("doi").alias(f"d{side}"))
    met = met.join(doi("a"), "pa").join(doi("b"), "pb").where(~ids.conflicting(F.col("da"), F.col("db"))).select("pa", "pb", "confidence", F.coalesce("da", "db").alias("doi"))
    # papers without a doi could join two papers with different ones: each goes to its surest partner that has one
    anchored = met.join(paper_doi.withColumnRenamed("paper", "pa").withColumnRenamed("doi", "da"), "pa").join(paper_doi.withColumnRenamed("paper", "pb").withColumnRenamed("doi", "db"), "pb")
    loose = anchored.where("da IS NULL OR db IS NULL").select(F.when(F.col("da").isNull(), F.col("pa")).otherwise(F.col("pb")).alias("x"), F.when(F.col("da").isNull(), F.col("pb")).otherwise(F.col("pa")).alias("y"), "confidence", F.coalesce("da", "db").alias("doi"))
    best = loose.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy(F.col("doi").isNull(), F.desc("confidence"), "y"))).where("n = 1").select("x", "y", "confidence")
    equal = anchored.where("da = db").select(F.col("pa").alias("x"), F.col("pb").alias("y"), "confidence")
    return _ruled(by_id, cut_lineage(best.unionByName(equal)))


def _ruled(by_id: DataFrame, links: DataFrame | None) -> DataFrame:
    size = by_id.groupBy("paper").agg(F.count("*").alias("n"))
    if links is None:
        return by_id.join(size, "paper").select("record", "paper", F.when(F.col("n") > 1, "identifier").otherwise("created").alias("rule"), F.lit(1.0).alias("confidence"))
    whole = components(links, "x", "y").withColumnRenamed("id", "paper")
    sure = links.select("x", "confidence").unionByName(links.select(F.col("y").alias("x"), "confidence")).groupBy(F.col("x").alias("paper")).agg(F.max("confidence").alias("confidence"))
    x = by_id.join(size, "paper").join(whole, "paper", "left").join(sure, "paper", "left")
    moved = F.col("component").isNotNull() & (F.col("component") != F.col("paper"))
    rule = F.when(moved, "fuzzy_title_author").when(F.col("n") > 1, "identifier").otherwise("created")
    return x.select("record", F.coalesce("component", "paper").alias("paper"), rule.alias("rule"), F.when(moved, F.col("confidence")).otherwise(1.0).alias("confidence"))


def survivors(matches: DataFrame) -> DataFrame:
    """matches(record, id_type, paper): stored papers that share an identifier with a record -> (record, winner, loser): the paper
    with the strongest kind of identifier stays, ties to the least; the others go into it."""
    rank = F.coalesce(normalise.mapped({t: str(len(ids.STRENGTH) - n) for n, t in enumerate(ids.STRENGTH)}, F.col("id_type")).cast("int"), F.lit(0))
    each = matches.groupBy("record", "paper").agg(F.max(rank).alias("rank"))
    first = each.groupBy("record").agg(F.min_by("paper", F.struct(-F.col("rank"), F.col("paper"))).alias("winner"))
    return each.join(first, "record").where("paper <> winner").select("record", "winner", F.col("paper").alias("loser")).distinct()


def merged(pairs: DataFrame, identifiers: DataFrame, locations: DataFrame, dois: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pairs(winner, loser) over identifiers(paper, id_type, value), locations(paper, url, ...) and dois(paper, doi) -> the same tables
    after the merge: identifiers and locations move, each once, and a winner without a doi takes the least of its losers'."""
    to = pairs.groupBy(F.col("loser").alias("paper")).agg(F.min("winner").alias("_to"))
    move = lambda df: df.join(to, "paper", "left").withColumn("paper", F.coalesce("_to", "paper")).drop("_to")
    places = move(locations)
    rest = [c for c in places.columns if c not in ("paper", "url")]
    own = dois.join(to, "paper", "left").select(F.coalesce("_to", "paper").alias("paper"), "doi", F.col("_to").isNotNull().alias("moved"))
    kept = own.groupBy("paper").agg(F.min_by("doi", F.when(F.col("doi").isNotNull(), F.struct("moved", "doi"))).alias("doi"))
    return move(identifiers).distinct(), places.groupBy("paper", "url").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest]), kept


def venues(candidates: DataFrame) -> DataFrame:
    """(venue_key, name, openalex_id, issn_l, publisher, venue_type, is_oa): one row per venue, known by its aggregator id, else by its
    name; what the first record to name it says stays."""
    v = candidates.where("venue IS NOT NULL").select("record_id", "fetched_at", "venue.*")
    by_name = v.where("openalex_id IS NOT NULL").groupBy("name").agg(F.min("openalex_id").alias("_named"))
    keyed = v.join(by_name, "name", "left").withColumn("venue_key", F.coalesce("openalex_id", "_named", F.concat(F.lit("name:"), "name")))
    at = F.struct("fetched_at", "record_id")
    cols = ["name", "openalex_id", "issn_l", "publisher", "venue_type", "is_oa"]
    return keyed.groupBy("venue_key").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols])


def linked_preprints(candidates: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, papers): papers(paper, doi, is_preprint, is_peer_reviewed) with the published ends of preprint links marked as reviewed
    and no preprint. An edge needs both papers, and different ones."""
    links = candidates.where("preprint_of_doi IS NOT NULL").select(_doi().alias("from_doi"), F.col("preprint_of_doi").alias("to_doi"))
    edges = corpus.edges(links, papers.where("doi IS NOT NULL").select("paper", "doi"))
    hit = edges.select(F.col("to_paper").alias("paper"), F.lit(True).alias("_hit")).distinct()
    x = papers.join(hit, "paper", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return edges, x.withColumns({"is_peer_reviewed": F.col("is_peer_reviewed") | F.col("_hit"), "is_preprint": F.col("is_preprint") & ~F.col("_hit")}).drop("_hit")


def folded_papers(candidates: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per paper from all its candidates: title, abstract, date and venue by trust; authors from the most trusted source that
    names any; topics and keywords united; the most open status; the earliest day online; flags of any source."""
    c = candidates.join(resolved.select(F.col("record").alias("record_id"), "paper"), "record_id")
    trust = -corpus.looked_up(corpus.TITLE_TRUST, F.col("source_key"), 0)
    by = F.struct(trust.alias("t"), F.col("fetched_at").alias("f"), F.col("record_id").alias("r"))
    best = lambda col, ok=None: F.min_by(F.col(col), F.when(F.col(col).isNotNull() if ok is None else ok, by)).alias(col)
    whole = F.struct((-corpus.looked_up(corpus.ABSTRACT_TRUST, F.col("source_key"), 0)).alias("t"), (-F.length("abstract")).alias("l"), F.col("record_id").alias("r"))
    reviewed, preprint = F.bool_or("is_peer_reviewed"), F.bool_or("is_preprint")
    one = c.withColumn("doi", _doi()).groupBy("paper").agg(
        F.count("*").alias("records"), best("title"), F.min_by("abstract", F.when(F.col("abstract").isNotNull(), whole)).alias("abstract"), best("doi"), best("published_date"), best("venue"), best("work_type"), best("language"),
        best("authors", F.size("authors") > 0), F.min("first_seen_online").alias("first_seen_online"), F.max("citation_count").alias("citation_count"), corpus.most_open(F.col("oa_status")).alias("oa_status"),
        reviewed.alias("is_peer_reviewed"), (preprint & ~reviewed).alias("is_preprint"), F.bool_or("is_retracted_hint").alias("is_retracted_hint"),
    )
    at = c.withColumn("_in", F.struct("fetched_at", "record_id"))
    topics = corpus.united_topics(at, "paper", "topics", "_in")
    return one.join(topics, "paper", "left").join(corpus.united_keywords(at, "paper", "keywords", "_in"), "paper", "left")


@dataclass(frozen=True)
class Ingested:
    """What a run made, as tables, and its figures."""

    records: DataFrame
    resolved: DataFrame
    papers: DataFrame
    identifiers: DataFrame
    locations: DataFrame
    venues: DataFrame
    edges: DataFrame

    def metrics(self) -> DataFrame:
        """(source_key, state, records): how many deliveries of each source were new, unchanged or bad."""
        return self.records.groupBy("source_key", "state").agg(F.count("*").alias("records"))


def ingested(records: DataFrame, today: Column, stored: DataFrame | None = None, *, force: bool = False) -> Ingested:
    """The whole step: what is new is normalised, dates nobody can believe are cleared, records find their papers, and papers take
    over fields, identifiers, locations, venues and links. A record that can't be read is counted and stops no other."""
    seen = cut_lineage(delivered(records, stored, force=force))
    c = normalise.candidates_of(seen.where("state = 'new'"))
    c = c.withColumns({n: dates.believed(F.col(n), today) for n in ("published_date", "first_seen_online")})
    c = cut_lineage(c)
    r = cut_lineage(resolved_candidates(c))
    papers = folded_papers(c, r)
    edges, papers = linked_preprints(c, papers)
    mine = c.join(r.select(F.col("record").alias("record_id"), "paper"), "record_id")
    owned = mine.select("paper", "fetched_at", "record_id", F.explode("identifiers").alias("i")).select("i.id_type", "i.value", "paper", F.col("fetched_at").alias("arrived"), F.col("record_id").alias("record"))
    places = mine.select("paper", F.struct("fetched_at", "record_id").alias("at"), F.explode("locations").alias("l")).select("paper", "at", "l.*")
    return Ingested(seen, r, papers, corpus.identifier_owners(owned), corpus.best_locations(places.drop("is_best")), venues(c), edges)
