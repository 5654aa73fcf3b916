"""Identifiers in one canonical form; what can't be read with confidence becomes null, since a guess would merge records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


#: The forms of identifiers, by the published grammar of each.


def doi(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(_found(c, r"(?i)(10\.\d{4,9}/[^\s\"'<>]+)"), r"[.,;:)\]}>]+$", "")), F.lit(""))


def pmid(c: Column) -> Column:
    return F.nullif(F.regexp_replace(_found(c.cast("string"), r"(\d+)"), r"^0+", ""), F.lit(""))


def pmcid(c: Column) -> Column:
    return F.concat(F.lit("PMC"), _found(c, r"(\d+)"))


def arxiv(c: Column) -> Column:
    """New and old style, without version; the registrant's doi form counts too."""
    body = F.coalesce(_found(F.trim(c), r"(?i)^10\.48550/arxiv\.(.+)$"), F.trim(c))
    return F.coalesce(_found(body, r"\b(\d{4}\.\d{4,5})(?:v\d+)?\b"), F.lower(_found(body, r"(?i)\b([a-z][a-z-]*(?:\.[A-Za-z]{2})?/\d{7})(?:v\d+)?\b")))


def openalex(c: Column) -> Column:
    return F.upper(_found(c, r"\b([WwSsAaIiPpTtCcFfDd]\d{4,})\b"))


def mag(c: Column) -> Column:
    return _found(c.cast("string"), r"(\d+)")


#: Identifier types, the strongest first for choosing a survivor.
STRENGTH = ("doi", "pmcid", "pmid", "arxiv", "openalex", "mag")
#: Registrants of preprint servers.
PREPRINT_PREFIXES = ("10.1101/", "10.48550/", "10.31234/", "10.21203/", "10.26434/")
NORMALISERS = {"doi": doi, "pmid": pmid, "pmcid": pmcid, "arxiv": arxiv, "openalex": openalex, "mag": mag}


def normalised(id_type: Column, raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, f in NORMALISERS.items():
        out = F.when(id_type == name, f(raw)).otherwise(out)
    return out


def arxiv_of_url(url: Column) -> Column:
    """The id in a link to arXiv itself; a link that only mentions it, to another host, has none."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    return F.when((host == "arxiv.org") | host.endswith(".arxiv.org"), arxiv(url))


def is_preprint_doi(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("^(?:" + "|".join(p.replace(".", r"\.") for p in PREPRINT_PREFIXES) + ")"), F.lit(False))


def conflicting(a: Column, b: Column) -> Column:
    """Two dois, both there and different, are two records."""
    return F.coalesce(a != b, F.lit(False))
