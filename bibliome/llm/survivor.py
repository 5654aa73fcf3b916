"""One surviving record out of several that tell of the same thing, field by field, by token-level consensus.

The values of a field are laid side by side by progressive alignment, each column of tokens is put to a weighted vote, and the
winners form a consensus. The consensus tells which values are cut off (they stop where others, aligned with them, go on) and
which value lies closest to what the group says. A rule of precedence then picks among the whole values.

Values of the few papers with very many records are first made distinct, then aligned in chunks whose consensuses are aligned
in turn, so that no task ever holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliome.session import cut_lineage

FIELDS = ("title", "abstract", "doi", "pub_date", "venue", "licence")
#: Strings that stand in for "no value", in lower case, for any field and for single ones.
STAND_INS = ("n/a", "na", "null", "none", "nan", "nil", "unknown", "not available", "not applicable", "tbd", "tba", "pending", "missing", "undefined", "-", "--", "—", "?", ".", "…", "...")
FIELD_STAND_INS = {
    "title": ("untitled", "untitled record", "[no title]", "no title", "(title missing)", "title missing", "[untitled]", "[title missing]"),
    "abstract": ("[no abstract available]", "no abstract available", "no abstract available.", "no abstract.", "no abstract", "abstract not available", "abstract not available.", "see pdf", "see pdf.", "see full text", "[no abstract]"),
    "doi": ("10.", "doi:", "doi", "https://doi.example/", "http://doi.example/", "https://doi.org/", "http://doi.org/", "https://dx.doi.org/"),
    "pub_date": ("n.d.", "n.d", "0000-00-00", "1900-01-01", "no date"),
    "venue": ("no venue",),
    "licence": ("no licence", "no license"),
}
#: What marks the end of a value that was cut off.
CUT_MARK = r"\s*(?:\[\s*(?:\.\.\.|…|truncated|cut|more)\s*\]|(?:\.\.\.|…)\s*(?:\((?:more|truncated|cont(?:inued)?\.?)\)|\[more\])?)\s*$"
#: Values of one field that one alignment takes.
CHUNK = 64
#: Size of the bit set that tells papers with more records than CHUNK.
_SET_BITS = 1 << 20

_PAYLOAD = (
    "title string, display_name string, abstract string, abstractText string, abstract_inverted_index map<string,array<int>>, doi string,"
    " publication_date string, firstPublicationDate string, pub_date string, `date` string, created string,"
    " primary_location struct<source:struct<display_name:string>,license:string>, journalInfo struct<journal:struct<title:string>>,"
    " journal string, server string, `journal-ref` string, license string"
)
_FROM_INDEX = (
    "array_join(transform(array_sort(flatten(transform(map_entries(j.abstract_inverted_index),"
    " e -> transform(e.value, p -> struct(p AS p, e.key AS w))))), x -> x.w), ' ')"
)
_VALUE = {
    "title": "CASE source_key WHEN 'openalex' THEN coalesce(nullif(trim(j.display_name), ''), j.title) ELSE j.title END",
    "abstract": f"CASE source_key WHEN 'openalex' THEN {_FROM_INDEX} WHEN 'europepmc' THEN j.abstractText ELSE j.abstract END",
    "doi": "j.doi",
    "pub_date": "CASE source_key WHEN 'openalex' THEN j.publication_date WHEN 'europepmc' THEN j.firstPublicationDate WHEN 'pubmed' THEN j.pub_date WHEN 'biorxiv' THEN j.`date` ELSE j.created END",
    "venue": "CASE source_key WHEN 'openalex' THEN j.primary_location.source.display_name WHEN 'europepmc' THEN j.journalInfo.journal.title WHEN 'pubmed' THEN j.journal WHEN 'biorxiv' THEN j.server ELSE j.`journal-ref` END",
    "licence": "CASE source_key WHEN 'openalex' THEN j.primary_location.license ELSE j.license END",
}


def field_values(records: DataFrame) -> DataFrame:
    """(paper_id, record_id, source_key, fetched_at, field_name, value): a row per field of each record that names a paper, the value null
    where the payload lacks it or can't be read."""
    read = records.where("paper_id IS NOT NULL AND trim(paper_id) <> ''").select("paper_id", "record_id", "source_key", "fetched_at", F.from_json("payload", _PAYLOAD).alias("j"))
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.expr(e).alias("value")) for f, e in _VALUE.items()])
    return read.select("paper_id", "record_id", "source_key", "fetched_at", F.explode(each).alias("x")).select("paper_id", "record_id", "source_key", "fetched_at", "x.*")


def _plain(value: Column) -> Column:
    """Without tags and outer white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"<[^<>]{1,60}>", " "), r"[\s\p{Z}]+", " "))


def says_something(field: Column, plain: Column) -> Column:
    plain = F.lower(plain)
    by_field = F.lit(False)
    for name, words in FIELD_STAND_INS.items():
        by_field = by_field | ((field == name) & plain.isin(*words))
    return (F.length(plain) > 0) & ~plain.isin(*STAND_INS) & ~by_field


def marked_cut(field: Column, plain: Column) -> Column:
    """The value itself shows that it was cut off: by a mark at its end, or, of an abstract, by ending within a sentence."""
    return plain.rlike(CUT_MARK) | ((field == "abstract") & ~plain.rlike(r"[.!?。！？][\s\"'”’»)\]]*$"))


def folded(field: Column, plain: Column) -> Column:
    """The tokens of a value, without what only decorates it; the same for values that differ only so."""
    plain = F.regexp_replace(F.lower(plain), CUT_MARK, "")
    plain = F.when(field == "doi", F.regexp_replace(plain, r"^(?:https?://[^/]+/|doi:\s*)", "")).when(field == "abstract", F.regexp_replace(plain, r"^abstract\s*[:.]?\s+", "")).otherwise(plain)
    return F.trim(F.when(field.isin("doi", "pub_date"), plain).otherwise(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")))


def align(columns: list[dict[str, float]], tokens: Sequence[str], weight: float) -> list[dict[str, float]]:
    """The profile with one more value laid against it: equal stretches share columns, what is new gets its own."""
    top = [_top(c) for c in columns]
    n = min(len(top), len(tokens))
    s = next((i for i in range(n) if top[i] != tokens[i]), n)
    e = 0
    while e < n - s and top[-1 - e] == tokens[-1 - e]:
        e += 1
    out = [_vote(c, t, weight) for c, t in zip(columns[:s], tokens[:s], strict=True)]
    mid_c, mid_t = columns[s : len(columns) - e], list(tokens[s : len(tokens) - e])
    if mid_c and mid_t:
        for op, a, b, x, y in SequenceMatcher(None, top[s : len(top) - e], mid_t, autojunk=False).get_opcodes():
            if op in ("equal", "replace"):
                both = min(b - a, y - x)
                out += [_vote(c, t, weight) for c, t in zip(mid_c[a : a + both], mid_t[x : x + both], strict=True)]
                a, x = a + both, x + both
            out += mid_c[a:b] + [_Votes(t, weight) for t in mid_t[x:y]]
    else:
        out += mid_c + [_Votes(t, weight) for t in mid_t]
    return out + [_vote(c, t, weight) for c, t in zip(columns[len(columns) - e :], tokens[len(tokens) - e :], strict=True)]


class _Votes(dict):
    """A column's votes, which keeps its leading token: the first to have come among those with most votes."""

    def __init__(self, t: str, weight: float) -> None:
        super().__init__({t: weight})
        self.top = t


def _top(c: dict[str, float]) -> str:
    return c.top if isinstance(c, _Votes) else max(c, key=c.get)


def _vote(c: dict[str, float], t: str, weight: float) -> dict[str, float]:
    known = t in c
    c[t] = c.get(t, 0.0) + weight
    if isinstance(c, _Votes) and t != c.top:
        if c[t] > c[c.top]:
            c.top = t
        elif known and c[t] == c[c.top]:
            c.top = max(c, key=c.get)
    return c


def consensus(values: Sequence[tuple[Sequence[str], float, bool]]) -> list[str]:
    """(tokens, weight, cut) of distinct values -> the tokens most of the weight stands for.

    A column stays if the values that reach it give it at least half their weight; a value doesn't vote on what comes after its
    own end, so that values that were cut off don't shorten the others.
    """
    ordered = sorted(values, key=lambda v: (v[2], -v[1], -len(v[0]), list(v[0])))
    top, votes = _profile((tokens, weight) for tokens, weight, _ in ordered)
    reach = [0.0] * (len(top) + 1)
    for tokens, weight, _ in ordered:  # the last column of a value, found from its end
        reach[_ends(top, tokens)] += weight
    return _kept(top, votes, reach)


def _profile(ordered: Iterable[tuple[Sequence[str], float]]) -> tuple[list[str], list[float]]:
    """Each column's leading token, ties by the token, and its votes, of values aligned one after the other."""
    columns: list[dict[str, float]] = []
    for tokens, weight in ordered:
        columns = align(columns, tokens, weight) if columns else [_Votes(t, weight) for t in tokens]
    return [max(sorted(c), key=c.get) for c in columns], [sum(c.values()) for c in columns]


def _kept(top: Sequence[str], votes: Sequence[float], reach: Sequence[float]) -> list[str]:
    """The leading tokens of the columns that have at least half the weight of the values that reach them."""
    live, out = 0.0, []
    for i in range(len(top) - 1, -1, -1):
        live += reach[i + 1]
        if votes[i] * 2 >= live:
            out.append(top[i])
    return out[::-1]


def _ends(top: Sequence[str], tokens: Sequence[str]) -> int:
    """How many columns a value spans: to the last column that its own last tokens lead up to, three of them if they stand together
    anywhere, else two or one; a frequent last word alone doesn't carry a value that was cut off to the end."""
    n = min(len(top), len(tokens))
    if list(top[:n]) == list(tokens[:n]):
        return n
    for m in (3, 2, 1):
        tail = list(tokens[-m:])
        if len(tail) == m:
            for i in range(len(top) - m, -1, -1):
                if list(top[i : i + m]) == tail:
                    return i + m
    return n


def stops_short(tokens: Sequence[str], agreed: Sequence[str]) -> bool:
    """The value agrees with the consensus up to its own end, where the consensus goes on; its last token may be a piece."""
    n = len(tokens)
    if not n or n > len(agreed) or list(tokens[: n - 1]) != list(agreed[: n - 1]) or not agreed[n - 1].startswith(tokens[-1]):
        return False
    return n < len(agreed) or tokens[-1] != agreed[n - 1]


def distance(tokens: Sequence[str], agreed: Sequence[str]) -> float:
    same = sum(m.size for m in SequenceMatcher(None, list(agreed), list(tokens), autojunk=False).get_matching_blocks())
    return 1.0 - 2.0 * same / max(1, len(tokens) + len(agreed))


_ITEM = "struct<less_priority:int, less_fetched:bigint, record_id:bigint, text:string, cut:boolean, ended:boolean, votes:bigint>"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """paper_id, field_name, records, items -> the surviving record of each group, and the one closest to the consensus."""
    for b in batches:
        papers, names, lists = b.column(0), b.column(1), b.column(2)
        offsets = lists.offsets.to_pylist()
        flat = lists.values
        cols = {n: flat.field(n).to_pylist() for n in ("less_priority", "less_fetched", "record_id", "text", "cut", "ended", "votes")}
        best, close = [], []
        for g in range(len(lists)):
            span = range(offsets[g], offsets[g + 1])
            order = lambda i: (cols["cut"][i], cols["less_priority"][i], cols["less_fetched"][i], cols["record_id"][i])  # noqa: B023, E731
            groups: dict[tuple, float] = {}
            for i in span:
                key = (cols["text"][i], cols["cut"][i])
                groups[key] = groups.get(key, 0.0) + cols["votes"][i] * (100 + max(0, -cols["less_priority"][i]))
            if len({t for t, _ in groups}) > 1:
                split = {t: t.split() for t, _ in groups}
                agreed = consensus([(split[t], w, c) for (t, c), w in groups.items()])
                short = {t for t in split if stops_short(split[t], agreed)}
                far = {t: distance(split[t], agreed) for t in split}
                for i in span:
                    if cols["text"][i] in short and not cols["ended"][i]:
                        cols["cut"][i] = True
                close.append(cols["record_id"][min(span, key=lambda i: (far[cols["text"][i]], *order(i)))])  # noqa: B023
            else:
                close.append(cols["record_id"][min(span, key=order)])
            best.append(cols["record_id"][min(span, key=order)])
        yield pa.RecordBatch.from_arrays([papers, names, pa.array(best, pa.int64()), pa.array(close, pa.int64())], ["paper_id", "field_name", "record_id", "closest_id"])


_JUDGED = "paper_id string, field_name string, record_id bigint, closest_id bigint"


def _ranked(records: DataFrame, priority: DataFrame) -> DataFrame:
    """One row per field of each record, with its place in the order of precedence; text is null where nothing is said."""
    trust = priority.groupBy("source_key", "field_name").agg(F.max("priority").alias("priority"))
    v = field_values(records).join(trust, ["source_key", "field_name"], "left")
    v = v.withColumn("plain", _plain(F.col("value")))  # each of the following steps reads the one before, once
    v = v.withColumn("plain", F.when(says_something(F.col("field_name"), F.col("plain")), F.col("plain")))
    return v.select(
        "paper_id", "field_name",
        F.struct(
            (-F.coalesce("priority", F.lit(-1))).cast("int").alias("less_priority"),
            F.coalesce(-F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(2**62)).alias("less_fetched"),
            "record_id",
            F.when(F.col("plain").isNotNull(), folded(F.col("field_name"), F.col("plain"))).alias("text"),
            marked_cut(F.col("field_name"), F.col("plain")).alias("cut"),
            F.col("plain").rlike(r"[.!?。！？][\s\"'”’»)\]]*$").alias("ended"),
            F.lit(1).cast("bigint").alias("votes"),
        ).alias("item"),
    )


def survivors(records: DataFrame, priority: DataFrame) -> DataFrame:
    """(paper_id, field_name, record_id, closest_id) of every paper with two or more records.

    record_id has the surviving value: whole values before cut-off ones, then the greater priority (none counts least), the
    later fetched_at (none counts as earliest), the smaller record_id. closest_id has the existing value closest to the
    consensus. Only values that say something count; a field without any gives no row. Repeated records count as records; an
    unreadable payload says nothing; an empty table gives no row.
    """
    busy = records.where("paper_id IS NOT NULL").groupBy("paper_id").count().where(F.col("count") > CHUNK)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(_SET_BITS)).cast("int")
    bits = sorted(r.bit for r in busy.select(bit("paper_id").alias("bit")).distinct().collect())  # at most _SET_BITS numbers
    ranked = _ranked(records, priority)
    in_set = _member(bit("paper_id"), bits)
    few = (
        ranked.where(~in_set).groupBy("paper_id", "field_name").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("item.text").isNotNull(), F.col("item"))).alias("items"))
        .where("n > 1 AND size(items) > 0").select("paper_id", "field_name", "items").mapInArrow(_judge, _JUDGED)
    )
    return few if not bits else few.unionByName(_crowded(ranked.where(in_set)))


def _member(c: Column, bits: Sequence[int]) -> Column:
    """Membership in a bit set whose size doesn't depend on the data."""
    if not bits:
        return F.lit(False)
    if len(bits) <= 1000:
        return c.isin(list(bits))
    held = bytearray(_SET_BITS // 8)
    for b in bits:
        held[b >> 3] |= 1 << (b & 7)
    text = F.unhex(F.lit(held.hex()))
    byte = F.conv(F.hex(F.substring(text, F.floor(c / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.expr("1").cast("int") == F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(c, F.lit(8)))), F.lit(2)).cast("int")


def _crowded(ranked: DataFrame) -> DataFrame:
    """The same for papers with many records: values made distinct before they meet, then the one vote of the other papers, its
    values read in their order and never held together. Weights are whole numbers, so no order of adding changes a tie."""
    one = ranked.select("paper_id", "field_name", "item.*")
    weight = F.sum(F.col("votes") * (100 + F.greatest(F.lit(0), -F.col("less_priority")))).cast("double")
    counts = one.groupBy("paper_id", "field_name", "text", "cut", "ended").agg(
        F.min(F.struct("less_priority", "less_fetched", "record_id")).alias("first"), F.count("*").alias("votes"), weight.alias("weight")
    )
    distinct = cut_lineage(counts)
    size = distinct.groupBy("paper_id", "field_name").agg(F.sum("votes").alias("n"), F.count_if(F.col("text").isNotNull()).alias("d"))
    group = ["paper_id", "field_name"]
    several = size.where("n > 1 AND d > 0").select(*group)
    live = distinct.where("text IS NOT NULL").join(several, group, "left_semi")
    values = live.groupBy(*group, "text", "cut").agg(F.sum("weight").alias("weight")).mapInArrow(_split, "paper_id string, field_name string, cut boolean, weight double, tokens array<string>")
    values = cut_lineage(values)
    ordered = values.repartition(*group).sortWithinPartitions(*group, "cut", F.desc("weight"), F.desc(F.size("tokens")), "tokens")
    profiles = cut_lineage(ordered.mapInArrow(_profiles, "paper_id string, field_name string, top array<string>, votes array<double>"))
    ends = values.join(profiles.select(*group, "top"), group).select(*group, "weight", "tokens", "top").mapInArrow(_reached, "paper_id string, field_name string, at int, weight double")
    ends = ends.groupBy(*group, "at").agg(F.sum("weight").alias("weight")).groupBy(*group).agg(F.collect_list(F.struct("at", "weight")).alias("reach"))
    agreed = profiles.join(ends, group).select(*group, "top", "votes", "reach").mapInArrow(_agree, "paper_id string, field_name string, agreed string")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, said = b.column(2).to_pylist(), b.column(3).to_pylist()
            pairs = [(t.split(), a.split()) for t, a in zip(text, said, strict=True)]
            cut = [c or (not e and stops_short(t, a)) for (t, a), c, e in zip(pairs, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(6), pa.array(cut), pa.array([distance(t, a) for t, a in pairs])], ["paper_id", "field_name", "first", "cut", "far"])

    first = "struct<less_priority:int, less_fetched:bigint, record_id:bigint>"
    judged = live.join(agreed, ["paper_id", "field_name"]).select("paper_id", "field_name", "text", "agreed", "cut", "ended", "first").mapInArrow(
        compare, f"paper_id string, field_name string, first {first}, cut boolean, far double"
    )
    return (
        judged.groupBy("paper_id", "field_name")
        .agg(F.min(F.struct("cut", "first")).alias("a"), F.min(F.struct("far", "cut", "first")).alias("b"))
        .select("paper_id", "field_name", F.col("a.first.record_id").alias("record_id"), F.col("b.first.record_id").alias("closest_id"))
    )


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = pa.array([t.split() for t in b.column(2).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(4), tokens], ["paper_id", "field_name", "cut", "weight", "tokens"])


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered values -> each group's profile; only one group's columns are held at a time."""
    rows = ((p, f, t, w) for b in batches for p, f, w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True))
    for (paper, field), part in groupby(rows, key=lambda r: r[:2]):
        top, votes = _profile((t, w) for _, _, t, w in part)
        yield pa.RecordBatch.from_arrays([pa.array([paper], pa.string()), pa.array([field], pa.string()), pa.array([top], pa.list_(pa.string())), pa.array([votes], pa.list_(pa.float64()))], ["paper_id", "field_name", "top", "votes"])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for s in range(0, big.num_rows, 256):  # each row has its group's profile beside it
            b = big.slice(s, 256)
            at = [_ends(top, t) for t, top in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), b.column(2)], ["paper_id", "field_name", "at", "weight"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's consensus from its profile and the weight that ends at each column."""
    for b in batches:
        said = []
        for top, votes, ends in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            reach = [0.0] * (len(top) + 1)
            for e in ends:
                reach[e["at"]] += e["weight"]
            said.append(" ".join(_kept(top, votes, reach)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string())], ["paper_id", "field_name", "agreed"])


def survivor_rows(records: DataFrame, priority: DataFrame) -> DataFrame:
    """One row per paper: its six fields as the surviving records tell them."""
    chosen = survivors(records, priority).select("paper_id", "field_name", "record_id")
    values = field_values(records).join(chosen, ["paper_id", "field_name", "record_id"])
    picked = [F.max(F.when(F.col("field_name") == f, F.trim("value"))).alias(f) for f in FIELDS]
    return values.groupBy("paper_id").agg(*picked)

