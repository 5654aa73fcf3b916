"""Records of the same publication in two sources that share no dependable key.

Records of both sources are sorted by several composite keys; pairs within a sliding window that letter counts and years don't rule
out are compared once, by weighted similarities of title, authors, year and the partial doi. Repeated records of one source are
put into classes, and classes are matched one to one so that the total confidence is greatest.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions.folding import unmarked
from bibliome.operators.components import components
from bibliome.session import cut_lineage

WINDOW = 8
#: Rows of a sorted list that one window function takes, besides the overlap.
_BLOCK = 4000
#: None: groups of classes of any size are assigned exactly, each by one task. A number, which no query sets, has groups of more
#: pairs assigned pair by pair, to at least half the greatest total.
LARGE: int | None = None
#: Least similarity of titles.
_TITLE = 0.84
#: Names of Greek letters, which one source writes out, keeps or loses.
_GREEK = "alpha|beta|gamma|delta|epsilon|zeta|eta|theta|kappa|lambda|sigma|omega"
#: What makes a title that of another publication beside the original.
_COMPANION_HEAD = r"^(?:correction|corrigendum|erratum|addendum|retraction|reply|response|comment|comments|commentary|author response|letter)\b.{0,24}?\b(?:to|on|of|for)\b"
_COMPANION_WORD = r"\b(?:correction|corrigendum|erratum|addendum|reply|response|follow ?up|part|supplement|supplementary|protocol|revisited|years on|companion|update|second report)\b"


def folded_title(c: Column) -> Column:
    """Lower case words without tags, marks, Greek letters, articles, labels in front and British spellings."""
    t = F.regexp_replace(c, r"<[^<>]{1,40}>", "")
    t = F.replace(F.replace(F.replace(t, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    t = F.regexp_replace(F.lower(unmarked(t)), r"&", " and ")
    t = F.regexp_replace(t, r"^(?:[^\p{L}\p{N}]*article\s*:\s*)+", "")
    t = F.regexp_replace(t, r"[^a-z0-9\p{IsHan}\p{IsCyrillic}]+", " ")
    t = F.regexp_replace(t, rf"(?<= |^)(?:{_GREEK}|a|an|the)(?= |$)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"isation|ization", "ization"), r"is(?=e\b|ed\b|es\b|ing\b)", "iz")
    t = F.regexp_replace(F.regexp_replace(t, r"our(?=\b|s\b|al\b)", "or"), r"ogue\b", "og")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"([a-z])\1", "$1"), r" +", " "))


def _author_words(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(unmarked(c)), r"[^a-z]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin("van", "der", "von", "del", "den")))


def _doi(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(c, r"(10\.\d{3,9}/\S+)", 1), r"[.,;]+$", "")), F.lit(""))


def records(articles: DataFrame, works: DataFrame) -> DataFrame:
    """Both sources in one shape: kind ('a' or 'w'), id, title (folded), main (title before its subtitle, folded), words, people,
    authors, year, doi, and of the title whether it begins as a companion's, how many companion words and which numbers it has."""
    year = lambda c: F.expr(f"try_cast(regexp_extract(CAST({c} AS string), '(\\\\d{{4}})', 1) AS int)")
    a = articles.select(F.lit("a").alias("kind"), F.col("article_id").cast("bigint").alias("id"), F.col("title").alias("raw"), F.col("author_string").alias("people"), year("pub_year").alias("year"), "doi")
    w = works.select(F.lit("w").alias("kind"), F.col("work_id").cast("bigint").alias("id"), F.col("title").alias("raw"), F.col("authors").alias("people"), year("publication_year").alias("year"), "doi")
    both = a.unionByName(w)
    names = F.regexp_replace(F.coalesce("people", F.lit("")), r"(?i)[,;]?\s*\bet al\.?\s*$", "")
    read = both.select(
        "kind", "id", folded_title(F.coalesce("raw", F.lit(""))).alias("title"),
        folded_title(F.regexp_extract(F.coalesce("raw", F.lit("")), r"^(.{12,}?)(?:: | [–—-] |\. (?=\p{Lu})).{6,}$", 1)).alias("main"),
        _author_words(names).alias("words"),
        F.size(F.filter(F.split(names, r"[;,]"), lambda x: F.length(F.trim(x)) > 2)).alias("authors"),
        "year", _doi(F.col("doi")).alias("doi"),
    )
    return cut_lineage(read).withColumns({
        "head": F.col("title").rlike(_COMPANION_HEAD), "marks": F.regexp_count("title", F.lit(_COMPANION_WORD)),
        "numbers": F.array_join(F.array_sort(F.regexp_extract_all("title", F.lit(r"(\d+|\b[iv]{1,3}\b)"), F.lit(1))), " "),
    })


def signatures(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per title, how often each of 32 classes of characters occurs (255 at most), and 256 bits for its pairs of characters.

    An edit changes the counts by two in sum and the bits in four places at most, so both bound the edits between titles from below.
    """
    sizes = np.array([len(t) for t in titles], np.int64)
    point = np.frombuffer("".join(titles).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(titles)), sizes)
    counts = np.minimum(np.bincount(row * 32 + (point & 31), minlength=len(titles) * 32), 255).reshape(-1, 32).astype(np.uint8)
    pair = ((point[:-1] * 0x9E3779B1 ^ point[1:] * 0x85EBCA6B) >> 8) & 255
    bits = np.zeros((len(titles), 256), bool)
    inside = row[:-1] == row[1:]
    bits[row[:-1][inside], pair[inside]] = True
    return counts, np.packbits(bits, axis=1)


_SAID = ["title", "main", "words", "authors", "year", "doi", "head", "marks", "numbers"]


def distinct_records(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that say the same as one, named by the least id, and (kind, id, member): copies never fill a window."""
    sign = r.select("*", F.xxhash64(*_SAID[:6]).alias("h1"), F.xxhash64(F.lit(1), *_SAID[:6]).alias("h2"))
    one = cut_lineage(sign.groupBy("kind", "h1", "h2").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in _SAID]))
    return one.select("kind", "id", *_SAID), sign.select("kind", "h1", "h2", F.col("id").alias("member")).join(one.select("kind", "h1", "h2", "id"), ["kind", "h1", "h2"]).select("kind", "id", "member")


def sort_keys(r: DataFrame) -> DataFrame:
    """(kind, id, key_no, key, year, main, sign): a row per sort key of each record: title, title from its end, rarest word of the
    title with author, author with year, doi. The author is the one of the rarest name; every word counts, however frequent.
    main is the length of the main title, sign the title's signatures and length."""
    each = F.explode(F.concat(
        F.transform(F.array_distinct(F.filter(F.split("title", " "), lambda w: F.length(w) > 3)), lambda w: F.struct(F.lit("t").alias("of"), w.alias("w"))),
        F.transform("words", lambda w: F.struct(F.lit("p").alias("of"), w.alias("w"))),
    ))
    word = r.select("kind", "id", each.alias("x")).select("kind", "id", "x.of", "x.w")
    listed = word.join(word.groupBy("of", "w").agg(F.count("*").alias("n")), ["of", "w"]).groupBy("kind", "id").agg(F.collect_list(F.struct("of", "n", "w")).alias("l"))
    rarest = lambda of: F.array_min(F.filter("l", lambda x: x.of == of)).w
    x = r.join(listed.select("kind", "id", rarest("t").alias("rare"), F.array_max(F.transform(F.filter("l", lambda x: x.of == "t"), lambda x: x.w)).alias("last"), rarest("p").alias("who")), ["kind", "id"], "left")
    tail = F.concat_ws("|", F.coalesce("who", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("")))
    keys = [
        F.when(F.length("title") > 0, F.concat_ws("|", F.translate("title", " ", ""), tail)),
        F.when(F.length("title") > 0, F.concat_ws("|", F.reverse(F.translate("title", " ", "")), tail)),
        F.concat_ws("|", "rare", "last", tail),
        F.when(F.col("who").isNotNull(), F.concat_ws("|", "who", F.coalesce("rare", F.lit("")), F.substring("title", 1, 12))),
        F.col("doi"),
    ]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, bits = signatures(b.column(4).to_pylist())
            packed = pa.array([c.tobytes() + w.tobytes() for c, w in zip(counts, bits, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.compute.utf8_length(b.column(4)), packed, b.column(5)], ["kind", "id", "year", "main", "long", "sign", "keys"])

    signed = x.select("kind", "id", "year", F.length("main").alias("main"), "title", F.array(*keys).alias("keys")).mapInArrow(sign, "kind string, id bigint, year int, main int, long int, sign binary, keys array<string>")
    return signed.select("kind", "id", "year", "main", "long", "sign", F.posexplode("keys").alias("key_no", "key")).where("key IS NOT NULL AND key <> ''")


def _met(t: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of one block that meet and that nothing rules out, in rank order."""
    year = t["year"].fill_null(0).to_numpy().astype(np.int32)
    main, long, key, own = t["main"].to_numpy(), t["long"].to_numpy(), t["key_no"].to_numpy(), t["own"].to_numpy()
    sign = np.frombuffer(b"".join(t["sign"].to_pylist()), np.uint8).reshape(len(year), 64)
    counts, bits = sign[:, :32].astype(np.int16), np.ascontiguousarray(sign[:, 32:]).view(np.uint64)
    xs, ys = [], []
    for k in range(1, min(window, len(year))):
        x = np.flatnonzero((key[:-k] == key[k:]) & own[:-k] & ((np.abs(year[:-k] - year[k:]) <= 2) | (year[:-k] == 0) | (year[k:] == 0)))
        y = x + k
        edits = (1 - _TITLE) * np.maximum(long[x], long[y]) + 1e-6
        near = np.abs(counts[x] - counts[y]).sum(1) <= 2 * edits
        near &= np.bitwise_count(bits[x] ^ bits[y]).sum(1) <= 4 * edits
        near |= ((main[y] >= 10) & (np.abs(long[x] - main[y]) <= 2)) | ((main[x] >= 10) & (np.abs(long[y] - main[x]) <= 2))
        xs.append(x[near])
        ys.append(y[near])
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64),) * 2


def neighbours(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(kx, x, ky, y): records at most window - 1 places apart in the order of one of their keys, each pair once.

    Left out is only what can't match: years too far apart, and titles whose signatures differ by more than the edits allowed
    could make up for, unless one is as long as the main title of the other.
    """
    cols = ["kind", "id", "year", "main", "long", "sign", "key_no"]
    parts = max(2, keyed.sparkSession.sparkContext.defaultParallelism)
    ordered = keyed.repartitionByRange(parts, "key_no", "key", "kind", "id").sortWithinPartitions("key_no", "key", "kind", "id")
    fixed = cut_lineage(ordered.select(*cols, F.monotonically_increasing_id().alias("m")))
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(fixed.groupBy(part.alias("p")).count().collect())  # one number per partition
    starts, total = [], 0
    for p, n in sizes:
        starts += [F.lit(p), F.lit(total)]
        total += n
    if not sizes:
        return fixed.select(F.col("kind").alias("kx"), F.col("id").alias("x"), F.col("kind").alias("ky"), F.col("id").alias("y"))
    ranked = fixed.withColumn("rank", F.create_map(*starts)[part] + place).drop("m")
    block = F.floor(F.col("rank") / _BLOCK)
    twice = F.when((F.col("rank") % _BLOCK < window - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    spread = ranked.withColumn("block", F.explode(twice)).withColumn("own", F.floor(F.col("rank") / _BLOCK) == F.col("block"))

    def slide(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        x, y = _met(t, window)
        kind, ids = t["kind"].to_numpy(zero_copy_only=False), t["id"].to_numpy()
        turned = (kind[x] > kind[y]) | ((kind[x] == kind[y]) & (ids[x] > ids[y]))
        x, y = np.where(turned, y, x), np.where(turned, x, y)
        return pa.table([pa.array(kind[x], pa.string()), pa.array(ids[x]), pa.array(kind[y], pa.string()), pa.array(ids[y])], ["kx", "x", "ky", "y"])

    return spread.groupBy("block").applyInArrow(slide, "kx string, x bigint, ky string, y bigint").distinct()


def compared(pairs: DataFrame, r: DataFrame) -> DataFrame:
    """(kx, x, ky, y, confidence) of pairs that tell of one publication.

    confidence weighs title (0.6), authors (0.25), year (0.1) and doi (0.05); a field one side lacks has no weight. Titles that
    differ in their numbers, or of which one goes on beyond the other (a part, reply, correction or follow-up), are of different
    publications, unless one source only left the subtitle out.
    """
    side = lambda s: r.select(F.col("kind").alias(f"k{s}"), F.col("id").alias(s), F.struct(*_SAID).alias(f"r{s}"))
    f = pairs.join(side("x"), ["kx", "x"]).join(side("y"), ["ky", "y"])
    f = f.where("abs(length(rx.title) - length(ry.title)) <= 90")
    less = F.length("rx.title") <= F.length("ry.title")
    f = f.withColumns({"s": F.when(less, F.col("rx.title")).otherwise(F.col("ry.title")), "l": F.when(less, F.col("ry.title")).otherwise(F.col("rx.title")), "g": F.when(less, F.col("ry.main")).otherwise(F.col("rx.main")), "lm": F.when(less, F.col("ry.marks")).otherwise(F.col("rx.marks"))})
    subtitle = "(length(g) >= 10 AND length(s) < length(l) - 4 AND lm = 0 AND levenshtein(s, g, 2) >= 0)"
    grows = "(length(l) - length(s) >= 6 AND (levenshtein(s, substring(l, 1, length(s)), 3) >= 0 OR levenshtein(s, right(l, length(s)), 3) >= 0))"
    marks = "(rx.marks <> ry.marks AND length(l) - length(s) >= 3)"  # else a slip of the pen within the word
    t = F.expr(f"CASE WHEN {subtitle} THEN 0.9D WHEN rx.head <> ry.head OR {marks} OR rx.numbers <> ry.numbers OR {grows} THEN NULL ELSE 1 - nullif(levenshtein(s, l, CAST(length(l) * 0.2 AS int) + 1), -1) / greatest(length(l), 1) END")
    near = F.expr("size(rx.words) - size(filter(rx.words, a -> NOT exists(ry.words, b -> a = b OR (length(a) > 4 AND levenshtein(a, b, 2) >= 0)))) - 0.2 * size(filter(rx.words, a -> NOT array_contains(ry.words, a) AND exists(ry.words, b -> length(a) > 4 AND levenshtein(a, b, 2) >= 0)))")
    # given names and family names count alike, so what is shared is measured by the shorter list of words
    least = F.least(F.size("rx.words"), F.size("ry.words"))
    people = F.when(least > 0, F.least(F.lit(1.0), near / least))
    year = F.when(F.col("rx.year").isNotNull() & F.col("ry.year").isNotNull(), 1 - 0.5 * F.abs(F.col("rx.year") - F.col("ry.year")))
    doi = F.when(F.col("rx.doi").isNotNull() & F.col("ry.doi").isNotNull(), F.when(F.col("rx.doi") == F.col("ry.doi"), 1.0).otherwise(0.0))
    f = f.withColumn("t", t).withColumn("brief", F.length("s") < 24)
    f = f.withColumn("judged", F.when(F.col("t") >= _TITLE, F.struct("t", people.alias("p"), year.alias("yr"), doi.alias("d"), "brief")))
    return f.select("kx", "x", "ky", "y", "judged")


def confident(judged: DataFrame) -> DataFrame:
    """(kx, x, ky, y, confidence, sure) of judged pairs that are likely enough: a short title says little, so authors or doi must
    agree; sure ones can be repeated records of one source."""
    f = judged.where("judged IS NOT NULL").select("kx", "x", "ky", "y", "judged.*")
    weight = 0.6 + 0.25 * F.col("p").isNotNull().cast("int") + 0.1 * F.col("yr").isNotNull().cast("int") + 0.05 * F.coalesce((F.col("d") == 1).cast("int"), F.lit(0))
    total = 0.6 * F.col("t") + 0.25 * F.coalesce("p", F.lit(0.0)) + 0.1 * F.coalesce("yr", F.lit(0.0)) + 0.05 * F.coalesce("d", F.lit(0.0))
    ok = (F.coalesce("p", F.lit(1.0)) >= F.when(F.col("brief"), 0.5).otherwise(0.3)) & (~F.col("brief") | F.col("p").isNotNull() | (F.coalesce("d", F.lit(0.0)) == 1))
    return f.where(ok).select("kx", "x", "ky", "y", F.round(total / weight, 4).alias("confidence"), ((total / weight >= 0.8) & (F.coalesce("p", F.lit(1.0)) >= 0.6)).alias("sure"))


def assigned(edges: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The one-to-one pairs of greatest total confidence, by augmenting paths of least cost; of equal totals the first found with
    ends in order, free ones before taken ones: else many equal confidences would have every search go through all pairs."""
    left, right = sorted({a for a, _, _ in edges}), sorted({w for _, w, _ in edges})
    at = {w: j for j, w in enumerate(right)}
    out: dict[str, list[tuple[int, int]]] = {a: [] for a in left}
    for a, w, c in sorted(edges):
        out[a].append((at[w], -round(c * 10_000)))
    near = [out[a] for a in left]
    n, m = len(left), len(right)
    # every left end may also stay alone, at no cost: a right end of its own, numbered from m
    pot_l, pot_r = [min([0, *(c for _, c in e)]) for e in near], [0] * (m + n)
    of_r, of_l = [-1] * (m + n), [-1] * n
    for root in range(n):
        dist, back, done, heap = {}, {}, set(), []

        def reach(i: int, base: int) -> None:
            for j, c in (*near[i], (m + i, 0)):
                d = base + c - pot_l[i] - pot_r[j]  # noqa: B023
                if j not in done and d < dist.get(j, 1 << 60):  # noqa: B023
                    dist[j], back[j] = d, i  # noqa: B023
                    heappush(heap, (d, of_r[j] >= 0, j))  # noqa: B023

        reach(root, 0)
        while True:
            d, _, j = heappop(heap)
            if j in done:
                continue
            done.add(j)
            if of_r[j] < 0:
                break
            reach(of_r[j], d)
        pot_l[root] += d
        for k in done:
            if k != j:
                pot_l[of_r[k]] += d - dist[k]
            pot_r[k] -= d - dist[k]
        while True:
            i = back[j]
            of_r[j], of_l[i], j = i, j, of_l[i]
            if i == root:
                break
    best = {(left[i], right[j]): 0.0 for i, j in enumerate(of_l) if j < m}
    for a, w, c in edges:
        if (a, w) in best:
            best[a, w] = max(c, best[a, w])
    return [(a, w, c) for (a, w), c in best.items()]


def one_to_one(cross: DataFrame) -> DataFrame:
    """cross(a, w, confidence), each pair once -> the pairs of greatest total confidence in which no end occurs twice.

    Pairs that share no end with others are chosen as they are. The rest falls into components, each solved exactly in one task,
    however many pairs it has. Only where LARGE is set is a component of more pairs instead solved by taking, again and again, the
    pairs that are each end's best, which has at least half the greatest total.
    """
    lone = cross.withColumns({"na": F.count("*").over(Window.partitionBy("a")), "nw": F.count("*").over(Window.partitionBy("w"))})
    lone = cut_lineage(lone)
    tied = lone.where("na > 1 OR nw > 1").select("a", "w", "confidence")
    done = lone.where("na = 1 AND nw = 1").select("a", "w", "confidence")
    group = components(tied, "a", "w").withColumnRenamed("id", "a")
    grouped = tied.join(group, "a").select("component", "a", "w", "confidence")

    def solve(t: pa.Table) -> pa.Table:
        rows = assigned(list(zip(t["a"].to_pylist(), t["w"].to_pylist(), t["confidence"].to_pylist(), strict=True)))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.table([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["a", "w", "confidence"])

    exact = lambda df: df.groupBy("component").applyInArrow(solve, "a string, w string, confidence double")
    if LARGE is None:
        return done.unionByName(exact(grouped))
    sized = cut_lineage(grouped.withColumn("n", F.count("*").over(Window.partitionBy("component"))))
    done = done.unionByName(exact(sized.where(F.col("n") <= LARGE).drop("n")))
    open_ = sized.where(F.col("n") > LARGE).select("a", "w", "confidence")
    while not open_.isEmpty():  # the most confident pair left is always each side's best, so every round wins some
        best = open_.withColumns({"ra": F.row_number().over(Window.partitionBy("a").orderBy(F.desc("confidence"), "w")), "rw": F.row_number().over(Window.partitionBy("w").orderBy(F.desc("confidence"), "a"))})
        won = cut_lineage(best.where("ra = 1 AND rw = 1").select("a", "w", "confidence"))
        done = done.unionByName(won)
        open_ = cut_lineage(open_.join(won.select("a"), "a", "left_anti").join(won.select("w"), "w", "left_anti"))
    return done


def matched(articles: DataFrame, works: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """(article_id, work_id, confidence): rows of the two tables that tell of the same publication.

    Repeated rows of a table form a class and all get the match of their class; rows without a title can match only by nothing,
    so they don't. Ties go to the smaller ids. Empty tables give no rows.
    """
    r, copies = distinct_records(records(articles, works))
    judged = cut_lineage(compared(neighbours(sort_keys(r), window), r))  # before the nulls are left out, else titles are compared twice
    node = lambda kind, i: F.concat(kind, F.lpad(F.col(i).cast("string"), 20, "0"))
    found = confident(judged).select(node(F.col("kx"), "x").alias("x"), node(F.col("ky"), "y").alias("y"), "kx", "ky", "confidence", "sure")
    classes = cut_lineage(components(found.where("kx = ky AND sure"), "x", "y"))
    of = lambda side: classes.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    cross = found.where("kx <> ky").join(of("x"), "x", "left").join(of("y"), "y", "left").select(F.coalesce("cx", "x").alias("a"), F.coalesce("cy", "y").alias("w"), "confidence")
    done = one_to_one(cross.groupBy("a", "w").agg(F.max("confidence").alias("confidence")))
    member = classes.select(F.col("component").alias("class"), F.col("id").alias("node"))
    each = copies.select(node(F.col("kind"), "id").alias("node"), "member")
    rows = lambda side: done.select(F.col(side).alias("class"), "a", "w", "confidence").join(member, "class", "left").select(F.coalesce("node", "class").alias("node"), "a", "w", "confidence").join(each, "node")
    left = rows("a").select("a", "w", "confidence", F.col("member").alias("article_id"))
    return left.join(rows("w").select("a", "w", F.col("member").alias("work_id")), ["a", "w"]).select("article_id", "work_id", "confidence")
