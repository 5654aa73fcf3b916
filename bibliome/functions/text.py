"""Titles, names, abstracts and queries as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibliome.functions.folding import unmarked

#: Entities that occur in bibliographic titles, with what they stand for.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}
#: Fixed value: editorial notes that publishers put before a title.
STATUS_PREFIX = r"(?i)^(?:\s*(?:retracted(?:\s+article)?|withdrawn|expression\s+of\s+concern|erratum|corrigendum)\s*[:.\-]\s*)+"
#: Fixed value: scripts in which one character says about as much as a short word.
DENSE = r"[\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF\uF900-\uFAFF]"
#: Shortest abstract that is worth embedding, what parts it from the title, and the length of a preview.
LEAST_ABSTRACT, SEPARATOR, PREVIEW = 40, "[SEP]", 320


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def display_text(c: Column) -> Column:
    """Entities and tags out, wording kept; null where nothing is left."""
    return F.nullif(squeeze(F.regexp_replace(unescape(c), r"<[^>]+>", " ")), F.lit(""))


def strip_status(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, STATUS_PREFIX, ""))


def fold_title(c: Column) -> Column:
    """The key two renderings of one title share: no tags, commands, notes, marks, case or punctuation; never null."""
    t = F.regexp_replace(F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), r"<[^>]+>", " "), r"\\[a-zA-Z]+\s*", " ")
    return squeeze(F.regexp_replace(F.lower(unmarked(strip_status(t))), r"[^\p{L}\p{N}]+", " "))


def blocking_weight(folded: Column) -> Column:
    """Length of a key in letters; a character of a dense script counts as three."""
    return F.length(folded) + 2 * F.regexp_count(folded, F.lit(DENSE))


def surname(name: Column) -> Column:
    """What stands before a comma, else the last word, folded; null where there is none."""
    shown = display_text(name)
    part = F.when(shown.contains(","), F.split(shown, ",")[0]).otherwise(F.element_at(F.split(shown, " "), -1))
    return F.nullif(fold_title(part), F.lit(""))


def first_surname(listed: Column) -> Column:
    """The folded family name of the first of 'Family AB, Family C.': what stands before the initials, all of it; a name without
    initials is read as surname() does."""
    first = F.trim(F.split(listed, ", ")[0])
    before = F.regexp_extract(first, r"^(.*?)(?:\s+\p{Lu}{1,3}(?:-\p{Lu})?)+[.\s]*$", 1)
    return F.when(F.length(before) > 0, F.nullif(fold_title(before), F.lit(""))).otherwise(surname(first))


def surnames(names: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(names, surname)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays read as sets; an empty or missing one makes it 0."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def trigrams(folded: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(folded, " "), lambda w: F.length(w) > 0)
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def clean_query(c: Column) -> Column:
    """Control characters become blanks, blanks are squeezed."""
    return squeeze(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "))


def preview(c: Column) -> Column:
    s = F.nullif(squeeze(c), F.lit(""))
    return F.when(F.length(s) <= PREVIEW, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, PREVIEW)), F.lit("…")))


def usable_abstract(c: Column) -> Column:
    shown = display_text(c)
    return F.when(F.length(shown) >= LEAST_ABSTRACT, shown)


def embedding_input(title: Column, abstract: Column) -> Column:
    head = F.coalesce(display_text(strip_status(F.coalesce(title, F.lit("")))), F.lit(""))
    body = usable_abstract(abstract)
    return F.when(body.isNotNull(), F.concat(head, F.lit(SEPARATOR), body)).otherwise(head)


def inverted_text(index: Column) -> Column:
    """map<word, positions> -> text, words in the order of their positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x.w), " "), F.lit(""))
