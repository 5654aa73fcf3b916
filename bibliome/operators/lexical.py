"""Full-text search over an inverted index: a web-style query language, weighted fields, and ranking by cover density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TOKEN = re.compile(r"[^\W_]+")
#: Words too common to be searched for, and the weights of fields by label.
STOP = frozenset("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split())
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
_VOWEL = re.compile("[aeiouy]")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """A light English stemmer: plurals, participles, adverbs and the commonest noun endings, as long as a syllable is left."""
    w = word
    if not w.isascii() or len(w) < 4:
        return w
    if w.endswith("ies"):
        w = w[:-3] + "y"
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith(("ss", "us", "is")):
        w = w[:-1]
    for end, new in (("ational", "ate"), ("ization", "ize"), ("isation", "ize"), ("fulness", "ful"), ("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ly", ""), ("ness", ""), ("ment", ""), ("ation", "ate")):
        left = w[: -len(end)]
        if w.endswith(end) and len(left) > 2 and _VOWEL.search(left):
            w = left + new
            if not new and len(w) > 3 and w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            break
    return w[:-1] if w.endswith("e") and len(w) > 4 else w


def terms_of(text: str, *, stemmed: bool = True) -> list[tuple[int, str]]:
    """(position, term) of the words that can be searched for; stop words keep their positions."""
    words = (m[0].lower() for m in _TOKEN.finditer(text))
    return [(i, stem(w) if stemmed else w) for i, w in enumerate(words, 1) if w not in STOP]


@dataclass(frozen=True)
class Atom:
    terms: tuple[str, ...]
    negated: bool = False


@dataclass(frozen=True)
class Query:
    """A conjunction of alternatives; an atom of several terms is a phrase."""

    clauses: tuple[tuple[Atom, ...], ...]

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t for c in self.clauses for a in c for t in a.terms))

    def relaxed(self) -> Query | None:
        """Any instead of all; None where that changes nothing or where something is excluded."""
        if len(self.clauses) < 2 or any(a.negated for c in self.clauses for a in c):
            return None
        return Query((tuple(a for c in self.clauses for a in c),))


def parse(text: str, *, stemmed: bool = True) -> Query:
    """Words are all required, "quoted words" must stand together, `or` joins alternatives, a leading minus excludes."""
    clauses: list[list[Atom]] = []
    joined = False
    for m in re.finditer(r'(-?)"([^"]*)"|(\S+)', text):
        negated, body = bool(m[1]), m[2] if m[2] is not None else m[3]
        if m[3] is not None:
            if body.lower() == "or":
                joined = bool(clauses)
                continue
            negated, body = body.startswith("-"), body.lstrip("-")
        terms = tuple(t for _, t in terms_of(body, stemmed=stemmed))
        if not terms:
            continue
        if joined:
            clauses[-1].append(Atom(terms, negated))
        else:
            clauses.append([Atom(terms, negated)])
        joined = False
    return Query(tuple(map(tuple, clauses)))


_HITS = "array<struct<pos:int, label:string>>"


def postings(df: DataFrame, id_col: str, fields: Mapping[str, str], *, stemmed: bool = True) -> DataFrame:
    """(term, id, hits, length): fields maps columns to weight labels; positions run on from field to field.

    Written once, partitioned by term, it serves every query; each posting holds one term of one text. Under the empty term stands
    every text, also one without words, for queries that only exclude.
    """
    columns = list(fields)
    labels = [fields[c] for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, ids, length, ends, pos, label = [], [], [], [0], [], []
            for i, *texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hits: dict[str, list[tuple[int, str]]] = {}
                at = size = 0
                for mark, text in zip(labels, texts, strict=True):
                    found = terms_of(text or "", stemmed=stemmed)
                    for p, t in found:
                        hits.setdefault(t, []).append((at + p, mark))
                    size += len(found)
                    at += (found[-1][0] if found else 0) + 8
                hits[""] = []
                for t, h in hits.items():
                    term.append(t)
                    pos += [p for p, _ in h]
                    label += [m for _, m in h]
                    ends.append(len(pos))
                ids += [i] * len(hits)
                length += [size] * len(hits)
            flat = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(label, pa.string())], ["pos", "label"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(ids, pa.int64()), lists, pa.array(length, pa.int32())], ["term", "id", "hits", "length"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), *columns).mapInArrow(run, f"term string, id bigint, hits {_HITS}, length int")


def cover_density(positions: Sequence[tuple[int, str, float]], required: int) -> float:
    """Sum over shortest stretches that hold all required terms: their mean weight, less for every word in between."""
    order = sorted(positions)
    held: dict[str, int] = {}
    total, left = 0.0, 0
    for right, (end, term, _) in enumerate(order):
        held[term] = held.get(term, 0) + 1
        if len(held) < required:
            continue
        while held[order[left][1]] > 1:
            held[order[left][1]] -= 1
            left += 1
        inside = order[left : right + 1]
        mean = len(inside) / sum(1.0 / w for _, _, w in inside)
        total += mean / (1 + max(0, end - order[left][0] + 1 - len(inside)))
        del held[order[left][1]]
        left += 1
    return total


def _holds(atom: Atom, at: Mapping[str, Sequence[int]]) -> bool:
    if not all(t in at for t in atom.terms):
        return False
    return len(atom.terms) == 1 or any(all(p + i in at[t] for i, t in enumerate(atom.terms)) for p in at[atom.terms[0]])


def matches(query: Query, at: Mapping[str, Sequence[int]]) -> bool:
    return all(any(_holds(a, at) != a.negated for a in clause) for clause in query.clauses)


def _read(query: Query) -> list[str]:
    """The terms whose postings a query needs: its own, and those of all texts if a text with none of them satisfies it."""
    return [*query.terms, *([""] if query.clauses and matches(query, {}) else [])]


def evaluate(index: DataFrame, query: Query) -> DataFrame:
    """(id, matched, score) of the texts that satisfy the query: matched counts its terms, score is cover density normalised
    by text length and mapped to 0..1. Only postings of the query's terms are read, unless exclusions alone can satisfy it: then
    those of all texts too, and a text with none of the terms scores 0."""
    wanted = _read(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, length, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = {x["term"]: {h["pos"] for h in x["hits"]} for x in found if x["term"]}
                if matches(query, at):
                    hits = [(h["pos"], x["term"], WEIGHTS[h["label"]]) for x in found for h in x["hits"] if x["term"]]
                    rank = cover_density(hits, len(at)) / (1 + math.log(max(1, length))) if hits else 0.0
                    out.append((i, len(at), rank / (rank + 1)))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.float64()), strict=True)], ["id", "matched", "score"])

    some = index.where(F.col("term").isin(wanted)) if wanted else index.limit(0)
    return some.groupBy("id").agg(F.max("length").alias("length"), F.collect_list(F.struct("term", "hits")).alias("found")).mapInArrow(run, "id bigint, matched int, score double")


def evaluate_many(index: DataFrame, queries: Mapping[str, Query], limit: int) -> DataFrame:
    """(query, id, score, rank): the best texts of each of a handful of queries, all in one pass over their terms' postings."""
    wanted = sorted({t for q in queries.values() for t in _read(q)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, length, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = {x["term"]: {h["pos"]: WEIGHTS[h["label"]] for h in x["hits"]} for x in found}
                for name, q in queries.items():
                    own = {t: at[t] for t in q.terms if t in at}
                    if q.clauses and matches(q, own):
                        rank = cover_density([(p, t, w) for t, h in own.items() for p, w in h.items()], len(own)) / (1 + math.log(max(1, length))) if own else 0.0
                        out.append((name, i, rank / (rank + 1)))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.float64()), strict=True)], ["query", "id", "score"])

    some = index.where(F.col("term").isin(wanted)) if wanted else index.limit(0)
    found = some.groupBy("id").agg(F.max("length").alias("length"), F.collect_list(F.struct("term", "hits")).alias("found")).mapInArrow(run, "query string, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit)


def lexical_search(index: DataFrame, text: str, limit: int, *, stemmed: bool = True, relax: bool = True) -> tuple[DataFrame, str]:
    """The best texts by score, then id, and the mode: 'strict', or 'relaxed' where nothing has all the terms."""
    query = parse(text, stemmed=stemmed)
    found, mode = evaluate(index, query), "strict"
    loose = query.relaxed()
    if relax and loose and found.isEmpty():
        found, mode = evaluate(index, loose), "relaxed"
    return found.orderBy(F.desc("score"), "id").limit(limit), mode
