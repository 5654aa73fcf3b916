"""Variant spellings of people's and organisations' names, linked.

Every spelling is read into parts (family name and initials; kind, subject and town of an institution), spellings with equal
parts meet in one class, and a part that was mistyped is traced to the right one by a pigeonhole segment join: names are cut into
k + 1 segments, substrings of the doubtful name are looked up in an inverted index of segments at shifted positions, and what is
found is verified by banded edit distance.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.operators.components import components
from bibliome.operators.shred import child_tables
from bibliome.operators.unpack import notice_values
from bibliome.session import cut_lineage

#: Words that belong to a family name though they stand apart.
PARTICLES = frozenset("van von der den de del della di da do dos du la le al el bin ibn ben ter ten zu zur st".split())
TITLES = frozenset("dr prof professor mr mrs ms mx sir dame".split())
#: Short forms of given names, with the names they stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "andy": "andrew", "barb": "barbara", "basti": "sebastian", "bea": "beatrice", "becky": "rebecca", "bel": "isabel", "bella": "isabel",
    "ben": "benjamin", "bess": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine",
    "charlie": "charles", "chris": "christopher", "cilla": "priscilla", "dan": "daniel", "dave": "david", "dick": "richard", "dima": "dmitri", "dolly": "dorothy", "dora": "theodora",
    "ed": "edward", "eddie": "edward", "ella": "eleanor", "fran": "francesca", "frank": "francis", "fred": "frederick", "gabi": "gabriela", "gabby": "gabriela", "greg": "gregory", "hal": "henry",
    "hank": "henry", "harry": "henry", "inge": "ingrid", "jack": "john", "jake": "jacob", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph",
    "joey": "joseph", "josh": "joshua", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "christopher", "kolya": "nikolai", "larry": "lawrence", "lena": "magdalena",
    "leo": "leonora", "lera": "waleria", "liz": "elizabeth", "lizzie": "elizabeth", "lori": "laura", "lou": "louis", "magda": "magdalena", "maggie": "margaret", "meg": "margaret", "mike": "michael",
    "molly": "mary", "nate": "nathaniel", "ned": "edward", "nell": "eleanor", "nick": "nicholas", "nora": "leonora", "pam": "pamela", "pat": "patrick", "peggy": "margaret", "pete": "peter",
    "phil": "philip", "pip": "philippa", "polly": "mary", "rick": "richard", "rob": "robert", "ron": "ronald", "sally": "sarah", "sam": "samuel", "sandy": "alexander", "sasha": "alexander",
    "steve": "stephen", "sue": "susan", "ted": "edward", "teddy": "edward", "thea": "theodora", "tim": "timothy", "toby": "tobias", "tom": "thomas", "tony": "anthony", "uli": "ulrich", "val": "valerie",
    "vanya": "ivan", "vic": "victor", "vicky": "victoria", "walt": "walter", "will": "william", "xana": "oksana",
}
_SPECIAL = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "’": "'"})
_INITIALS = re.compile(r"^(?:\w\.?){1,3}$")


def plain(s: str) -> str:
    """Without diacritics, in lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.translate(_SPECIAL)) if not unicodedata.combining(c)).lower()


def joined(words: Iterable[str]) -> str:
    return re.sub(r"[\W\d_]+", "", plain("".join(words)))


def _is_initials(t: str, mixed: bool) -> bool:
    """AB, A., A.B.; in a name written in capitals throughout only one or two letters."""
    core = t.replace(".", "")
    if not core.isalpha() or not core.isupper() or not _INITIALS.match(t):
        return False
    return len(core) == 1 or len(core) <= 3 and (mixed or len(core) <= 2)


def readings(name: str) -> list[tuple[str, str, str]]:
    """(family, given, initials) as a person's name can be read, the likelier way first; none where nothing is left of it."""
    raw = [t for t in re.split(r"\s+", name.strip()) if t]
    while raw and plain(raw[0]).rstrip(".") in TITLES:
        raw = raw[1:]
    if not raw:
        return []
    if raw[0].endswith(",") or any(t.endswith(",") for t in raw[:-1]):
        at = next(i for i, t in enumerate(raw) if t.endswith(","))
        family, rest = raw[: at + 1], raw[at + 1 :]
        return _one(family, rest)
    mixed = any(c.islower() for t in raw for c in t)
    tail = len(raw)
    while tail > 1 and _is_initials(raw[tail - 1], mixed):
        tail -= 1
    if tail < len(raw):
        return _one(raw[:tail], raw[tail:])
    head = 0
    while head < len(raw) - 1 and _is_initials(raw[head], mixed):
        head += 1
    if head:
        return _one(raw[head:], raw[:head])
    if len(raw) == 1:
        return _one(raw, [])
    for i in range(1, len(raw) - 1):
        if _is_initials(raw[i], mixed):
            return _one(raw[i + 1 :], raw[: i + 1])
    low = [plain(t) for t in raw]
    if low[0] in PARTICLES or low[0].split("-")[0] in PARTICLES and "-" in low[0]:
        return _one(raw[:-1], raw[-1:])
    if raw[0].endswith("."):
        return _one(raw[1:], raw[:1])
    if low[1] in PARTICLES or low[1].split("-")[0] in PARTICLES and "-" in low[1]:
        return _one(raw[1:], raw[:1])
    return _one(raw[1:], raw[:1]) + _one(raw[:-1], raw[-1:])


def _one(family: list[str], rest: list[str]) -> list[tuple[str, str, str]]:
    key = joined(family)
    if not key:
        return []
    letters, given = "", ""
    for t in rest:
        core = re.sub(r"[\W\d_]+", "", t)
        if not core:
            continue
        if len(core) <= 3 and core.isupper():
            letters += plain(core)
        else:
            given = given or plain(core)
            letters += plain(core)[:1]
    return [(key, given, letters)]


def parsed_people(names: DataFrame) -> DataFrame:
    """names(name) -> (name, turn, turns, family, given, initials)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, i, len(r), *x) for n in b.column(0).to_pylist() for r in [readings(n)] for i, x in enumerate(r)]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["name", "turn", "turns", "family", "given", "initials"])

    return names.mapInArrow(run, "name string, turn int, turns int, family string, given string, initials string")


def edit_near(a: str, b: str) -> Column:
    """At most one letter wrong, missing, too many, or two neighbours swapped."""
    d = F.expr(f"levenshtein({a}, {b}, 2)")
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    return (d == 0) | (d == 1) | ((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def segments(key: str) -> list[tuple[int, int, str]]:
    """(length of the key, number, text) of the two segments an index holds of a key."""
    half = len(key) // 2
    return [(len(key), 0, key[:half]), (len(key), 1, key[half:])]


def probes(key: str) -> set[tuple[int, int, str]]:
    """The segments of all keys that one slip makes of this one: one edit leaves one of two segments whole, shifted by one place
    at most, and so does a swap, but for one across the middle, which is undone first."""
    out = set()
    half = len(key) // 2
    turned = key[: half - 1] + key[half] + key[half - 1] + key[half + 1 :] if 0 < half < len(key) else key
    for size in range(max(2, len(key) - 1), len(key) + 2):
        cut = size // 2
        for part, start, n in ((0, 0, cut), (1, cut, size - cut)):
            out |= {(size, part, key[at : at + n]) for at in range(max(0, start - 1), min(len(key) - n, start + 1) + 1)}
    return out | set(segments(turned))


def segment_join(doubtful: DataFrame, known: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, known): keys of `doubtful` beside keys of `known` of the same group that one slip of the pen makes of each other.

    The inverted index holds two segments of each known key under its length, so that postings of long keys stay short; keys of
    fewer than three characters aren't compared, as any two of them are a slip apart. Long postings are split by the join.
    """
    schema = "g string, k string, size int, part int, seg string"
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def keyed(of):  # noqa: ANN001, ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(g, k, *x) for g, k in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in sorted(of(k))]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["g", "k", "size", "part", "seg"])

        return run

    both = lambda df: df.select(F.col(group).alias("g"), F.col(key).alias("k")).where(F.length("k") >= 3).distinct()
    left = both(doubtful).mapInArrow(keyed(probes), schema)
    right = both(known).mapInArrow(keyed(segments), schema).withColumnRenamed("k", "known")
    met = left.join(right, ["g", "size", "part", "seg"]).where(F.col("k") != F.col("known")).where(edit_near("k", "known")).select("g", "k", "known").distinct()
    return met.select(F.col("g").alias(group), F.col("k").alias(key), "known")


def followed(moved: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, target), one target a key, with a target that moves on itself replaced by the one at the end of its way, so that
    all that steps link meet there; of a circle that is its least key."""
    moved = cut_lineage(moved.select(group, key, "target"))
    if moved.join(moved.select(group, F.col(key).alias("target")), [group, "target"], "left_semi").isEmpty():
        return moved
    node = lambda c: F.to_json(F.array(F.col(c), F.col(group)))
    met = cut_lineage(components(moved.select(node(key).alias("a"), node("target").alias("b"))))
    last = moved.join(moved.select(group, F.col(key).alias("target")), [group, "target"], "left_anti").select(node("target").alias("id"), F.col("target").alias("end")).distinct()
    ends = met.join(last, "id").groupBy("component").agg(F.min("end").alias("end"))
    least = F.from_json("component", "array<string>")[0]
    return moved.select(group, key, node(key).alias("id")).join(met, "id").join(ends, "component", "left").select(group, key, F.coalesce("end", least).alias("target"))


def people_classes(names: DataFrame, told: DataFrame) -> DataFrame:
    """names(name, n), told(name, family, given): what payloads say of the parts of some names -> (name, class)."""
    raw = cut_lineage(parsed_people(names.select("name")).join(names, "name"))
    sure = raw.where("turns = 1")
    said = told.where("family <> '' AND given <> ''").select("name", "family", "given", F.substring("given", 1, 1).alias("initial"))
    of_family = sure.select("family").unionByName(said.select("family")).groupBy("family").agg(F.count("*").alias("f"))
    of_given = sure.where("length(given) > 1").select("given").unionByName(said.select("given")).groupBy("given").agg(F.count("*").alias("g"))
    open_ = raw.where("turns > 1").join(of_family, "family", "left").join(of_given, "given", "left")
    score = F.log1p(F.coalesce("f", F.lit(0))) + F.log1p(F.coalesce("g", F.lit(0))) - F.col("turn") * 0.3
    best = open_.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc(score), "turn"))).where("r = 1")
    cols = ["name", "n", "family", "given", "initials"]
    read = cut_lineage(sure.select(cols).unionByName(best.select(cols)))

    keys = read.select("family", F.substring("initials", 1, 1).alias("initial"), "n").unionByName(said.select("family", "initial", F.lit(0).cast("bigint").alias("n")))
    keys = keys.where("initial <> ''").groupBy("family", "initial").agg(F.sum("n").alias("n"))
    attested = said.select("family", "initial").distinct()
    keys = keys.join(attested.withColumn("att", F.lit(1)), ["family", "initial"], "left").join(attested.select("family").distinct().withColumn("real", F.lit(1)), "family", "left")
    keys = cut_lineage(keys.select("family", "initial", "n", F.coalesce("att", F.lit(0)).alias("att"), F.coalesce("real", F.lit(0)).alias("real")))

    # a short given name stands for the initial under which the family knows somebody
    nick = F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in (kv[0], kv[1][0])])
    own = F.substring("initials", 1, 1)
    other = F.when(F.length("given") > 1, nick[F.col("given")])
    asked = read.withColumns({"own": own, "other": F.when(other != own, other)})
    known = keys.where("n > 0 OR att = 1").select("family", F.col("initial").alias("other"), F.lit(True).alias("there")).distinct()
    asked = asked.join(known, ["family", "other"], "left")
    placed = asked.select("name", "n", "family", F.when(F.col("there"), F.col("other")).otherwise(F.col("own")).alias("initial"), F.substring("initials", 2, 1).alias("middle")).where("initial <> ''")

    # family names that payloads never tell and that are one slip from a better known one of the same initial
    doubt = keys.where("real = 0")
    near = segment_join(doubt, keys, "initial", "family")
    weigh = near.join(keys.select("initial", "family", F.col("n").alias("pn")), ["initial", "family"]).join(
        keys.select("initial", F.col("family").alias("known"), F.col("n").alias("tn"), F.col("att").alias("ta")), ["initial", "known"]
    )
    better = weigh.where("ta = 1 OR tn >= 2 * pn").withColumn("r", F.row_number().over(Window.partitionBy("initial", "family").orderBy(F.desc("ta"), F.desc("tn"), "known"))).where("r = 1")
    direct = said.join(read.select("name", F.col("family").alias("seen")), "name").where(F.col("seen") != F.col("family")).select(F.col("seen").alias("family"), "initial", F.col("family").alias("target")).groupBy("family", "initial").agg(F.min("target").alias("target"))
    moved = followed(better.select("family", "initial", F.col("known").alias("target")).join(direct.select("family", "initial"), ["family", "initial"], "left_anti").unionByName(direct), "initial", "family")
    settled = placed.join(moved, ["family", "initial"], "left").select("name", F.coalesce("target", "family").alias("family"), "initial", "middle")
    split = settled.groupBy("family", "initial").agg(F.count_distinct(F.nullif("middle", F.lit(""))).alias("middles"))
    full = settled.join(split, ["family", "initial"])
    return full.select("name", F.concat_ws("|", "family", "initial", F.when(F.col("middles") > 1, F.col("middle"))).alias("class"))


#: What institutions are called, with other spellings and languages.
HEADS = {
    "university": ("university", "univ", "u", "universidad", "universite", "universita", "universitat", "uni"),
    "hospital": ("hospital", "hosp", "hospitals", "krankenhaus", "hopital", "ospedale"),
    "institute": ("institute", "inst", "instituto", "institut", "istituto"),
    "college": ("college", "coll"), "academy": ("academy", "acad", "academia"), "centre": ("centre", "center", "ctr", "centro"), "laboratory": ("laboratories",), "agency": ("agency",), "clinic": ("clinic", "clin"),
}
_HEAD = {w: k for k, words in HEADS.items() for w in words}
_SMALL = frozenset("of the for de del la le les des du and in at on an a und der die das e y et".split())
#: Words in fewer names than this share of all (and in fewer than three) are taken for places: that bounds the words institutions
#: are told by to the words of a name over this share, whatever the number of names, and treats all sizes alike.
LEXICON_SHARE = 1e-4
#: Words one worker keeps the reading of.
_KEPT = 200_000


def slip(a: str, b: str) -> bool:
    """One letter wrong, missing, too many, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


class Gazetteer:
    """Words seen as whole parts of addresses (places) and words seen only within names (what institutions are called)."""

    def __init__(self, common: dict[str, int], countries: frozenset[str]) -> None:
        self.common, self.countries = common, countries
        self._by_first: dict[str, list[str]] = {}
        for w in sorted(common, key=lambda w: (-common[w], w)):
            if len(w) > 3:
                self._by_first.setdefault(w[0], []).append(w)
        self._known: dict[str, str | None] = {}

    def word(self, w: str) -> str | None:
        """The common word that w is, abbreviates or misspells; None for a place."""
        if w not in self._known:
            if len(self._known) > _KEPT:
                self._known.clear()
            self._known[w] = self._find(w)
        return self._known[w]

    def _find(self, w: str) -> str | None:
        if w in _HEAD:
            return _HEAD[w]
        full = [c for c in self._by_first.get(w[:1], ()) if len(c) > len(w) and self._short(w, c)]
        if w in self.common and not full:
            kinds = [h for h in _HEAD if len(h) > 4 and self.common.get(h, 0) >= 2 * self.common[w] and slip(w, h)]
            if kinds:
                return _HEAD[max(kinds, key=lambda h: (self.common[h], h))]
            slips = [c for c in self._by_first.get(w[0], ()) if len(w) > 4 and self.common[c] >= 8 * self.common[w] and slip(w, c)]
            return _HEAD.get(slips[0], slips[0]) if slips else _HEAD.get(w, w)
        if full:
            return _HEAD.get(full[0], full[0])
        if len(w) >= 5:
            for c in [*self._by_first.get(w[0], ()), *(x for f, ws in self._by_first.items() if f != w[0] for x in ws)]:
                if slip(w, c):
                    return _HEAD.get(c, c)
            for h, k in _HEAD.items():
                if len(h) > 4 and slip(w, h):
                    return k
        return None

    @staticmethod
    def _short(w: str, c: str) -> bool:
        """w is the start of c, or its letters in order without vowels."""
        if len(w) < 3 or len(w) > 7 or len(c) < len(w) + 2:
            return False
        if c.startswith(w):
            return True
        return not re.search("[aeiou]", w[1:]) and re.sub("[aeiou]", "", c) == w


def institution(name: str, g: Gazetteer) -> tuple[str, str, str] | None:
    """(what, town in the name, town in the address) of an institution; departments before it and the country are left out."""
    parts = [p for p in (re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", plain(s)) for s in re.split(r"[,;()\[\]]", name)) if p]
    at = None
    for i, p in enumerate(parts):
        kinds = [g.word(w) for w in p if w not in _SMALL]
        if any(k in HEADS for k in kinds):
            at = i
            break
    if at is None:
        return None
    what, towns = [], []
    for w in parts[at]:
        if w in _SMALL:
            continue
        k = g.word(w)
        if k is None:
            towns.append(w)
        else:
            what.append(k)
    after = [" ".join(p) for p in parts[at + 1 :]]
    if after and after[-1] in g.countries and (len(after) > 1 or towns):  # what is all that tells the place stays
        after = after[:-1]
    return "|".join(sorted(set(what))), " ".join(towns), after[0] if after else ""


def gazetteer(names: DataFrame) -> Gazetteer:
    """Common words and countries, from all names.

    A common word stands beside three or more different parts of addresses or within three different parts that nothing follows;
    one that is somewhere a whole part needs the former, as a town only ever stands before its own name and country.

    A country is what ends addresses after three or more towns (parts without any word for an institution), after a town in at
    least a fifth of its occurrences as an end, and stands before such an end in less than a tenth of all its occurrences.
    """

    def beside(split: list[list[str]], i: int, w: str) -> str:
        """The town or else the country after part i; where none follows the part itself, marked."""
        for at in (-2, -1):
            if i < len(split) + at and w not in split[at] and (at == -1 or not any(x in _HEAD for x in split[at])):
                return " ".join(split[at])
        return "=" + " ".join(split[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                split = [p for p in (re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", plain(s)) for s in re.split(r"[,;()\[\]]", name)) if p]
                parts = [" ".join(p) for p in split]
                if len(parts) > 1:
                    town = "" if any(w in _HEAD for w in split[-2]) else parts[-2]
                    rows.append(("last", parts[-1], town))
                    rows += [("part", p, "") for p in parts]
                    rows += [("inner", p, "") for p in parts[:-1]]
                rows += [("word", w, beside(split, i, w)) for i, p in enumerate(split) for w in set(p) if w not in _SMALL]
                rows.append(("all", "", ""))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "w", "beside"])

    seen = names.select("name").mapInArrow(run, "kind string, w string, beside string")
    each = seen.groupBy("kind", "w", "beside").agg(F.count("*").alias("n"))
    counted = cut_lineage(each.groupBy("kind", "w").agg(F.sum("n").alias("n"), F.count_if(F.col("beside") != "").alias("d"), F.count_if((F.col("beside") != "") & ~F.startswith("beside", F.lit("="))).alias("told"), F.sum(F.when(F.col("beside") != "", F.col("n")).otherwise(0)).alias("towns")))
    total = counted.where("kind = 'all'").agg(F.sum("n")).first()[0] or 0
    of = lambda kind, name: counted.where(F.col("kind") == kind).select("w", F.col("n").alias(name))
    words = counted.where("kind = 'word'").join(of("part", "alone"), "w", "left").where("n >= 3 AND coalesce(alone, 0) * 4 < n AND d >= 3 AND (alone IS NULL OR told >= 3)").where(F.col("n") >= LEXICON_SHARE * total)
    last = counted.where("kind = 'last'").join(of("inner", "inner"), "w", "left").where("d >= 3 AND towns * 5 >= n AND coalesce(inner, 0) * 9 < n").where(F.col("n") >= LEXICON_SHARE * total)
    return Gazetteer({r.w: r.n for r in words.select("w", "n").collect()}, frozenset(r.w for r in last.select("w").collect()))


def organisation_classes(names: DataFrame) -> DataFrame:
    """names(name, n) -> (name, class).

    Names without any place are told by their words, unless these tell no more than the kind of institution.
    """
    g = gazetteer(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(name, n, *x) for name, n in zip(*(c.to_pylist() for c in b.columns), strict=True) if (x := institution(name, g))]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["name", "n", "what", "town", "address"])

    read = cut_lineage(names.select("name", F.col("n").cast("bigint")).mapInArrow(run, "name string, n bigint, what string, town string, address string"))
    spots = read.select(F.explode(F.array_distinct(F.array("town", "address"))).alias("t"), (F.col("town") == F.col("address")).cast("bigint").alias("both")).where("t <> ''")
    spots = cut_lineage(spots.groupBy("t").agg(F.count("*").alias("c"), F.sum("both").alias("both")))
    of = lambda side: spots.select(F.col("t").alias(side), F.col("c").alias(f"c_{side}"), F.col("both").alias(f"b_{side}"))
    x = read.join(of("town"), "town", "left").join(of("address"), "address", "left")
    pick = (
        F.when(F.col("town") == "", F.col("address")).when(F.col("address") == "", F.col("town"))
        .when(F.coalesce("c_address", F.lit(0)) >= F.coalesce("c_town", F.lit(0)), F.col("address")).otherwise(F.col("town"))
    )
    kinds = F.array(*map(F.lit, HEADS))
    placed = cut_lineage(x.select("name", "n", "what", pick.alias("place")).where((F.col("place") != "") | (F.size(F.array_except(F.split("what", r"\|"), kinds)) > 0)))
    keys = placed.groupBy("what", "place").agg(F.sum("n").alias("n")).join(spots.select(F.col("t").alias("place"), "c", "both"), "place", "left").fillna(0, ["c", "both"])
    keys = cut_lineage(keys)
    near = segment_join(keys.where("both = 0"), keys, "what", "place")
    weigh = near.join(keys.select("what", "place", F.col("c").alias("pc")), ["what", "place"]).join(keys.select("what", F.col("place").alias("known"), F.col("c").alias("tc"), F.col("both").alias("tb")), ["what", "known"])
    better = weigh.where("tb > 0 OR tc >= 2 * pc").withColumn("r", F.row_number().over(Window.partitionBy("what", "place").orderBy(F.desc(F.col("tb") > 0), F.desc("tc"), "known"))).where("r = 1")
    moved = followed(better.select("what", "place", F.col("known").alias("target")), "what", "place")
    return placed.join(moved, ["what", "place"], "left").select("name", F.concat_ws("|", "what", F.coalesce("target", "place")).alias("class"))


def spellings(articles: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """People's and organisations' spellings with how often they occur, and what payloads tell of people's name parts."""
    authors = child_tables(articles, "article_id", "payload", ("author",)).where("full_name IS NOT NULL").groupBy("full_name", "last_name", "first_name").agg(F.count("*").alias("n"))
    authors = cut_lineage(authors)
    items = cut_lineage(notice_values(notices.select("notice_id", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("reason"), "author", "institution")).groupBy("field_name", "item").agg(F.count("*").alias("n")))
    listed = articles.where("author_string IS NOT NULL").select(F.explode(F.split(F.regexp_replace("author_string", r"\.$", ""), ", ")).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    people = listed.unionByName(authors.select(F.col("full_name").alias("name"), "n")).unionByName(items.where("field_name = 'author'").select(F.col("item").alias("name"), "n"))
    people = cut_lineage(people.where("trim(name) <> ''").groupBy("name").agg(F.sum("n").alias("n")))
    orgs = items.where("field_name = 'institution'").select(F.col("item").alias("name"), "n")
    return people, orgs, authors.where("last_name IS NOT NULL AND first_name IS NOT NULL").select(F.col("full_name").alias("name"), "last_name", "first_name")


def _told(authors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name, last, first = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([joined([x]) for x in last]), pa.array([joined([x]) for x in first])], ["name", "family", "given"])

    return cut_lineage(authors.distinct().mapInArrow(run, "name string, family string, given string"))


def variant_names(articles: DataFrame, notices: DataFrame) -> DataFrame:
    """(kind, name_a, name_b), name_a first by code point: two spellings of one person or organisation.

    Only classes of spellings decide; a spelling that can't be read (no family name or initial, no institution) is linked to
    none. Nulls and repeated rows don't matter; empty tables give no rows.
    """
    people, orgs, authors = spellings(articles, notices)
    classes = people_classes(people, _told(authors)).withColumn("kind", F.lit("person")).unionByName(organisation_classes(orgs).withColumn("kind", F.lit("organisation")))
    classes = cut_lineage(classes.distinct())
    other = classes.select("kind", "class", F.col("name").alias("name_b"))
    return classes.select("kind", "class", F.col("name").alias("name_a")).join(other, ["kind", "class"]).where("name_a < name_b").select("kind", "name_a", "name_b").distinct()


def name_classes(articles: DataFrame, notices: DataFrame) -> DataFrame:
    """(kind, name, class, spellings): every spelling that can be read, with its class and the class's size."""
    people, orgs, authors = spellings(articles, notices)
    classes = people_classes(people, _told(authors)).withColumn("kind", F.lit("person")).unionByName(organisation_classes(orgs).withColumn("kind", F.lit("organisation")))
    classes = cut_lineage(classes.distinct())
    return classes.join(classes.groupBy("kind", "class").agg(F.count("*").alias("spellings")), ["kind", "class"]).select("kind", "name", "class", "spellings")
