import datetime as dt
import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from bibliome.functions import dates, ids, scores, taxonomy, text, vectors
from bibliome.functions.embedding import HashedWords, build_encoder, embedded


def one(spark, column, *values):
    """The column over a one-row frame with columns a, b, ..."""
    names = [chr(97 + i) for i in range(len(values))]
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<double>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Ünder the <i>Sea</i>: a study", "under the sea a study"), ("RETRACTED: Erratum - Gödel &amp; Bach", "godel bach"), ("\\alpha decay  of  Ra", "decay of ra"), ("深度学习的方法", "深度学习的方法"),
        ("ALL CAPS_with_underscores", "all caps with underscores"), ("", ""), (None, ""), ("naïve résumé", "naive resume"), ("Straße – œuvre Łódź", "strasse oeuvre lodz"), ("Effekte von α-Strahlung", "effekte von α strahlung"),
    ],
)
def test_fold_title(spark, raw, want):
    assert one(spark, text.fold_title(F.col("a")), raw) == want


@pytest.mark.parametrize(("name", "want"), [("Céline Loot", "loot"), ("Loot, C.", "loot"), ("", None), (None, None), ("van der Waals", "waals")])
def test_surname(spark, name, want):
    assert one(spark, text.surname(F.col("a")), name) == want


def test_text_rules(spark):
    assert one(spark, text.blocking_weight(F.col("a")), "ab 深度") == 3 + 6
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), ["x", "y"], ["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), [], ["y"]) == 0
    assert one(spark, text.trigrams(F.col("a")), "cat") == ["  c", " ca", "cat", "at "]
    assert one(spark, text.clean_query(F.col("a")), " a\x00b\n c ") == "a b c"
    assert one(spark, text.preview(F.col("a")), "x" * 400) == "x" * 320 + "…"
    assert one(spark, text.preview(F.col("a")), "  ") is None
    assert one(spark, text.embedding_input(F.col("a"), F.col("b")), "<b>T</b>", "short") == "T"
    assert one(spark, text.embedding_input(F.col("a"), F.col("b")), None, "y" * 40) == "[SEP]" + "y" * 40
    m = spark.sql("SELECT map('b', array(1, 3), 'a', array(0, 2)) AS m").select(text.inverted_text(F.col("m")).alias("x")).first().x
    assert m == "a b a b"


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [
        ("doi", "https://doi.org/10.1234/AbC.", "10.1234/abc"), ("doi", "none", None), ("doi", None, None), ("pmid", "https://x/00123/", "123"), ("pmid", "0", None), ("pmcid", "pmc 55", "PMC55"), ("pmcid", "x", None),
        ("arxiv", "arXiv:2401.12345v3", "2401.12345"), ("arxiv", "10.48550/arXiv.1706.03762", "1706.03762"), ("arxiv", "math.GT/0309136v1", "math.gt/0309136"), ("arxiv", "no", None),
        ("openalex", "https://openalex.org/w123456", "W123456"), ("openalex", "x1", None), ("mag", "m 99", "99"),
    ],
)
def test_ids(spark, kind, raw, want):
    assert one(spark, ids.NORMALISERS[kind](F.col("a")), raw) == want
    assert one(spark, ids.normalised(F.lit(kind), F.col("a")), raw) == want


def test_id_rules(spark):
    assert one(spark, ids.arxiv_of_url(F.col("a")), "https://ArXiv.org/abs/2401.12345") == "2401.12345"
    assert one(spark, ids.arxiv_of_url(F.col("a")), "https://x.org/abs/2401.12345") is None
    assert one(spark, ids.is_preprint_doi(F.col("a")), "10.1101/x") and not one(spark, ids.is_preprint_doi(F.col("a")), None)
    assert one(spark, ids.conflicting(F.col("a"), F.col("b")), "x", "y") and not one(spark, ids.conflicting(F.col("a"), F.col("b")), "x", None)


@pytest.mark.parametrize(("raw", "want"), [("8/13/2020 0:00", dt.date(2020, 8, 13)), ("1/2/2021", dt.date(2021, 1, 2)), ("2025-02-17", dt.date(2025, 2, 17)), ("soon", None), (None, None)])
def test_notice_date(spark, raw, want):
    assert one(spark, dates.notice_date(F.col("a")), raw) == want


def test_dates(spark):
    day = F.lit("2025-01-01").cast("date")
    assert one(spark, dates.iso_date(F.col("a")), "2024-02-30") is None
    assert one(spark, dates.believed(F.col("a").cast("date"), day), "2026-01-02") is None
    assert one(spark, dates.feed_date(F.col("a").cast("date"), day), None) is None
    assert one(spark, dates.earliest(F.col("a").cast("date"), F.col("b").cast("date")), None, "2024-01-01") == dt.date(2024, 1, 1)


def test_taxonomy(spark):
    x = spark.sql("SELECT array(named_struct('scheme','arxiv','value','stat.ML'), named_struct('scheme','arxiv','value','q-bio.XX'), named_struct('scheme','biorxiv','value','Zoology'), named_struct('scheme','openalex','value','Medicine'), named_struct('scheme','mesh','value','Humans')) AS t")
    assert x.select(taxonomy.fields_of(F.col("t")).alias("f")).first().f == ["agricultural-and-biological-sciences", "computer-science", "medicine"]
    assert [r.value for r in x.select(taxonomy.unmapped(F.col("t")).alias("u")).first().u] == ["Humans"]
    assert len(taxonomy.SLUGS) == 26 and taxonomy.known_fields(["medicine", "medicine"]) == ["medicine"]
    with pytest.raises(ValueError):
        taxonomy.known_fields(["alchemy"])


def test_vectors_and_scores(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), [1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), [0.0], [1.0]) is None
    assert one(spark, vectors.unit(F.col("a")), [0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, scores.rescaled(F.lit(0.735))) == pytest.approx(0.5)
    assert one(spark, scores.saturated(F.lit(100.0))) == pytest.approx(3.0)
    assert one(spark, scores.decayed(F.lit(1.0), F.lit(10.0), "short")) == 0.5
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [0.0, 2.0])], "id bigint, v array<double>")
    assert {r.id: r.sims for r in vectors.similarities(df, "id", "v", [[2.0, 0.0], [0.0, 1.0]]).collect()} == {1: [1.0, 0.0], 5: [0.0, 1.0]}
    assert vectors.similarities(df.limit(0), "id", "v", [[1.0]]).count() == 0


def test_hashed_words(spark):
    e = build_encoder("hashed-words", dimension=32)
    v = e.encode(["deep sea fish", "deep sea fish", ""])
    assert (v[0] == v[1]).all() and abs(float((v[0] ** 2).sum()) - 1) < 1e-6 and not v[2].any()
    with pytest.raises(ValueError):
        build_encoder("none")
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id bigint, t string")
    out = {r.id: r for r in embedded(df, "id", "t", HashedWords(16)).collect()}
    assert len(out[1].vector) == 16 and not any(out[2].vector) and out[1].model_key == "hashed-words-16"


def test_every_title_and_author_is_folded(spark, rows, tmp_path):
    from bibliome import queries

    titles = [(1, "Étude des protéines β–amyloïdes"), (2, "海洋堆積物の研究"), (3, "A plain title."), (4, None), (5, "Straße — Łódź"), (6, "")]
    spark.createDataFrame(titles, "work_id bigint, title string").write.parquet(str(tmp_path / "openalex_work.parquet"))
    want = [(1, "etude des proteines β amyloides"), (2, "海洋堆積物の研究"), (3, "a plain title"), (4, ""), (5, "strasse lodz"), (6, "")]
    assert rows(queries.QUERIES["text_fold_title"](spark, str(tmp_path))) == want
    lists = [(1, "Jean Dupré, Ana Kepo-Gepo, Jan van der Berg"), (2, "Ann Lee"), (3, None)]
    spark.createDataFrame(lists, "article_id bigint, author_string string").write.parquet(str(tmp_path / "epmc_article.parquet"))
    want = [(1, "Ana Kepo-Gepo", "kepo gepo"), (1, "Jan van der Berg", "berg"), (1, "Jean Dupré", "dupre"), (2, "Ann Lee", "lee")]
    assert rows(queries.QUERIES["text_surname"](spark, str(tmp_path))) == want


def test_long_texts_are_weighed_and_cleaned_whole(spark, rows, tmp_path):
    from bibliome import queries

    data = [(1, "ab " * 1500 + "海洋", 4502), (2, "x\ty", 3), (3, None, 0)]
    spark.createDataFrame(data, "doc_id bigint, text string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(queries.QUERIES["text_blocking_weight"](spark, str(tmp_path))) == [(1, 4506), (2, 3)]
    cleaned = {r.doc_id: r.cleaned for r in queries.QUERIES["text_query_cleanup"](spark, str(tmp_path)).collect()}
    assert cleaned == {1: "ab " * 1500 + "海洋", 2: "x y", 3: None}
