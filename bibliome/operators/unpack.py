"""Several values packed in one cell: one row per value, with its place.

Each cell is split on quote characters: odd pieces are literals, even pieces are cut at the delimiters, and array folds put the
values together again. Everything stays inside Catalyst expressions; only cells whose commas could be either delimiter or text
(a few per cent) take a look at the values seen elsewhere in the same column.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibliome.session import cut_lineage

#: What parts values wherever it stands outside quotes.
DELIMITERS = r"[;；|\t\r\n•]|(?<=\s|^)//|//(?=\s|$)"
#: White space of any kind, the no-break ones and the byte order mark included.
_WS = r"[\s\p{Z}\x{FEFF}\x{200B}]"
#: Noncharacters stand for: a value's end, an opening and a closing quote, a lone quote, and escaped characters.
_END, _OPEN, _CLOSE, _LONE = "\uFDD0", "\uFDD1", "\uFDD2", "\uFDD3"
_ESCAPED = {";": "\uFDD4", "|": "\uFDD5", ",": "\uFDD6", '"': "\uFDD7", "；": "\uFDD8", "\\": "\uFDD9"}
#: Cells without any of these are one value as they stand.
_SPECIAL = r"""["\\;；|\t\r\n•,/&()\[\]\x{FDD0}-\x{FDEF}]|\sand\s"""
#: How a comma outside quotes is read where no other delimiter occurs in the cell.
QUOTED, KNOWN, NAMES = "quoted", "known", "names"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}+|{_WS}+$", "")


def _hide_escapes(c: Column) -> Column:
    for char, mark in reversed(_ESCAPED.items()):
        c = F.replace(c, F.lit("\\" + char), F.lit(mark))
    return c


def _show(c: Column) -> Column:
    """Quotes inside a literal were doubled; what was hidden comes back."""
    c = F.replace(c, F.lit(_CLOSE + _OPEN), F.lit('"'))
    c = F.translate(c, _OPEN + _CLOSE + _LONE, '"""')
    return F.translate(c, "".join(_ESCAPED.values()), "".join(_ESCAPED))


def _pieces(c: Column) -> Column:
    """The cell split on its quote characters; a last quote without partner is text."""
    odd = F.pmod(F.length(F.regexp_replace(c, '[^"]', "")), F.lit(2)) == 1
    return F.split(F.when(odd, F.regexp_replace(c, '"([^"]*)$', _LONE + "$1")).otherwise(c), '"')


def _cut(pieces: Column, pattern: str) -> Column:
    """Even pieces cut by the pattern, odd ones kept between quote marks, folded to an array of raw values."""
    marked = F.transform(
        pieces,
        lambda p, i: F.when(F.pmod(i, F.lit(2)) == 0, F.regexp_replace(p, pattern, _END)).otherwise(F.concat(F.lit(_OPEN), p, F.lit(_CLOSE))),
    )
    return F.split(F.array_join(marked, ""), _END)


def _values(raw: Column) -> Column:
    """Trimmed values without number, quotes and escapes; empty ones are gone before places are counted."""
    full = F.filter(F.transform(raw, _trim), lambda v: F.length(F.translate(v, _OPEN + _CLOSE, "")) > 0)
    numbered = F.transform(
        full,
        lambda v, i: F.when(
            F.regexp_extract(v, r"^\((\d{1,4})\)", 1) == (i + 1).cast("string"), _trim(F.regexp_replace(v, r"^\(\d+\)", ""))
        ).otherwise(v),
    )
    quoted = f"^{_OPEN}(.*){_CLOSE}$"
    shown = F.transform(numbered, lambda v: _trim(_show(F.when(v.rlike(f"(?s){quoted}") & ~_has_gap(v), F.regexp_replace(v, f"(?s){quoted}", "$1")).otherwise(v))))
    return F.filter(shown, lambda v: F.length(v) > 0)


def _has_gap(v: Column) -> Column:
    """Text between two literals: the value isn't one quoted whole."""
    return v.rlike(f"(?s){_CLOSE}[^{_OPEN}]+{_OPEN}")


def packed_values(cells: DataFrame, *, policy: Mapping[str, str]) -> DataFrame:
    """cells(row_id, field_name, cell) -> (row_id, field_name, pos, item).

    policy says per field_name how commas are read when nothing else parts the cell: 'quoted' (only where a whole value is
    quoted), 'names' (people: every part must be a full name; 'A, B and C' and '&' count too) or 'known' (the cell as a whole
    isn't a value of this column, and each of its parts is one). JSON arrays of strings are read as such. A null, blank or
    delimiter-only cell gives no row; repeated rows give repeated values; text of any length is kept.
    """
    field = F.col("field_name")
    of = lambda kind: field.isin([f for f, p in policy.items() if p == kind])
    base = cells.withColumn("all", _trim(F.col("cell"))).where(F.length("all") > 0)
    base = base.withColumn("t", F.when(F.col("all").rlike(_SPECIAL), F.col("all")))  # null costs nothing in what follows
    base = base.withColumn("json", F.when(F.col("t").rlike(r'(?s)^\[\s*".*"\s*\]$'), F.from_json("t", "array<string>")))
    base = base.withColumn("pieces", _pieces(_hide_escapes(F.col("t"))))
    outside = F.array_join(F.filter("pieces", lambda p, i: F.pmod(i, F.lit(2)) == 0), _LONE)
    base = base.withColumn("outside", outside)
    base = base.withColumn("primary", F.col("outside").rlike(DELIMITERS))
    comma = ~F.col("primary") & F.col("json").isNull() & F.col("outside").contains(",")
    joint = ~F.col("primary") & F.col("json").isNull() & of(NAMES) & F.col("outside").rlike(r"\s(and|&)\s")
    marked = F.transform("pieces", lambda p, i: F.when(F.pmod(i, F.lit(2)) == 0, p).otherwise(F.concat(F.lit(_OPEN), p, F.lit(_CLOSE))))
    whole = _values(F.array(F.array_join(marked, "")))
    by_comma = _cut(F.col("pieces"), ",")
    some_quoted = (F.size(by_comma) > 1) & F.exists(by_comma, lambda v: v.rlike(f"^\\s*{_OPEN}[^,]*{_CLOSE}\\s*$") | v.rlike(f"(?s)^\\s*{_OPEN}.*{_CLOSE}\\s*$"))
    full_name = lambda v: (F.size(F.split(_trim(_show(v)), r"\s+")) > 1) & ~_trim(_show(v)).rlike(r"\s\p{Lu}\.?$")
    all_names = of(NAMES) & F.forall(by_comma, lambda v: (F.length(_trim(v)) == 0) | full_name(v))
    base = base.withColumn(
        "way",
        F.when(F.col("t").isNull(), "plain")
        .when(F.col("json").isNotNull(), "json")
        .when(F.col("primary"), "primary")
        .when(joint, "joint")
        .when(comma & (some_quoted | all_names), "comma")
        .when(comma & of(KNOWN), "ask")
        .otherwise("one"),
    )
    keep = ["row_id", "field_name"]
    items = (
        F.when(F.col("way") == "plain", F.array("all"))
        .when(F.col("way") == "json", F.filter(F.transform("json", _trim), lambda v: F.length(v) > 0))
        .when(F.col("way") == "primary", _values(_cut(F.col("pieces"), DELIMITERS)))
        .when(F.col("way") == "joint", _values(_cut(F.col("pieces"), r"\s*,\s*(?:and|&)\s+|\s*,\s*|\s+(?:and|&)\s+")))
        .when(F.col("way").isin("comma", "ask"), _values(by_comma))
        .otherwise(whole)
    )
    # every cell is taken apart once; what follows reads the result, as the values, as those known, and as cases to decide
    read = cut_lineage(base.select(*keep, "way", "t", items.alias("items"), F.when(F.col("way") == "ask", whole).alias("whole")))
    sure = read.where("way <> 'ask'").select(*keep, "items")
    asked = read.where("way = 'ask'").select(*keep, "t", F.col("items").alias("parts"), "whole")
    known = sure.where(of(KNOWN)).select("field_name", F.explode("items").alias("v")).distinct()
    cases = asked.select("field_name", "t", "parts", "whole").dropDuplicates(["field_name", "t"])
    verdict = (
        cases.select("field_name", "t", F.size("parts").alias("n"), F.posexplode(F.concat("whole", F.array_distinct("parts"))).alias("i", "v"))
        .join(known.withColumn("seen", F.lit(True)), ["field_name", "v"], "left")
        .groupBy("field_name", "t")
        .agg(F.bool_or((F.col("i") == 0) & F.col("seen").isNotNull()).alias("whole_known"), F.bool_and((F.col("i") == 0) | F.col("seen").isNotNull()).alias("parts_known"))
        .select("field_name", "t", (~F.col("whole_known") & F.col("parts_known")).alias("split"))
    )
    settled = asked.join(verdict, ["field_name", "t"]).select(*keep, F.when(F.col("split"), F.col("parts")).otherwise(F.col("whole")).alias("items"))
    return sure.unionByName(settled).select(*keep, F.posexplode("items").alias("p", "item")).select(*keep, (F.col("p") + 1).alias("pos"), "item")


def unpack_columns(df: DataFrame, id_col: str, policy: Mapping[str, str]) -> DataFrame:
    """packed_values over several columns of one table, which is read once."""
    cells = df.select(
        F.col(id_col).alias("row_id"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in policy])).alias("x"),
    ).select("row_id", "x.*")
    return packed_values(cells, policy=policy)


#: How the four packed columns of a retraction notice are read.
NOTICE_POLICY = {"subject": KNOWN, "reason": KNOWN, "author": NAMES, "institution": QUOTED}


def notice_values(notices: DataFrame) -> DataFrame:
    """retraction_notice -> (notice_id, field_name, pos, item)."""
    return unpack_columns(notices, "notice_id", NOTICE_POLICY).withColumnRenamed("row_id", "notice_id")
