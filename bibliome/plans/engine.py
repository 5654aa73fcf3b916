"""The engine as one object: search, browse, recommend and evaluate over a directory of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bibliome.functions.embedding import Encoder, HashedWords, embedded
from bibliome.operators import filters, fusion, recommend
from bibliome.operators.lexical import evaluate, evaluate_many, parse, postings
from bibliome.operators.semantic import search_stated, semantic_search
from bibliome.plans import feed as feeds
from bibliome.session import table

#: Methods with what their scores are measured in.
UNITS = {"lexical": "cover density, 0 to 1", "semantic": "cosine, -1 to 1", "hybrid": "sum of reciprocal ranks"}
METHODS = tuple(UNITS)
#: Files of a stored index, by hash of term.
BUCKETS = 64


@dataclass(frozen=True)
class Result:
    """hits(rank, id, score, and the texts' display columns) with what was asked and how it was answered."""

    query: str
    method: str
    mode: str
    unit: str
    hits: DataFrame


@dataclass
class Engine:
    """Texts (id, title, body, and whatever else is shown or filtered by) are searched by words, by vectors, or both; papers are
    browsed and recommended by their facts. The inverted index and the vectors are made once: in the folder `store` if one is
    named (read from there ever after, by the terms of each query only), else kept by the session.

    `columns` names the texts' columns for filters, as SearchFilters does; `records` (id, source_key) serves filters by source.
    """

    spark: SparkSession
    texts: DataFrame
    facts: DataFrame
    encoder: Encoder = field(default_factory=HashedWords)
    store: str | None = None
    columns: Mapping[str, str] = field(default_factory=dict)
    records: DataFrame | None = None

    @staticmethod
    def over(spark: SparkSession, d: str, **options: object) -> Engine:
        texts = table(spark, d, "epmc_preprint").select(F.col("preprint_id").alias("id"), "title", F.col("abstract_text").alias("body"), "doi", F.col("author_string").alias("authors"), F.col("first_publication_date").alias("published"), "category", F.col("src").alias("source"))
        return Engine(spark, texts, table(spark, d, "paper_facts"), columns={"date": "published"}, **options)

    @cached_property
    def index(self) -> DataFrame:
        made = postings(self.texts, "id", {"title": "A", "body": "C"}).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        if self.store is None:
            return made.persist()
        path = f"{self.store}/postings"
        if not _written(self.spark, path):
            made.repartition("bucket").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.parquet(path)

    @cached_property
    def vectors(self) -> DataFrame:
        both = self.texts.select("id", F.concat_ws(" ", "title", "body").alias("text"))
        made = embedded(both, "id", "text", self.encoder)
        if self.store is None:
            return made.persist()
        path = f"{self.store}/vectors-{self.encoder.model_key}"
        if not _written(self.spark, path):
            made.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _of(self, terms: Sequence[str]) -> DataFrame:
        """The index, only the files that hold these terms being read."""
        b = [r.b for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()] if terms else []
        return self.index.where(F.col("bucket").isin(b)) if b else self.index

    def allowed(self, f: filters.SearchFilters | None) -> DataFrame | None:
        """Ids that pass the filters; None where nothing is filtered."""
        if f is None:
            return None
        return filters.filtered(self.texts, f, dict(self.columns), self.records, on="id").select("id")

    def lexical(self, query: str, limit: int, f: filters.SearchFilters | None = None) -> tuple[DataFrame, str]:
        """(id, score) and the mode; texts with equal scores come newest first where a date is known, then by id."""
        asked, mode, only = parse(query), "strict", self.allowed(f)
        found = self._found(asked, only)
        loose = asked.relaxed()
        if loose and found.isEmpty():
            found, mode = self._found(loose, only), "relaxed"
        if "date" in self.columns:
            found = found.join(self.texts.select("id", F.col(self.columns["date"]).alias("_day")), "id")
            found = found.orderBy(F.desc("score"), F.desc_nulls_last("_day"), "id").limit(limit)
            return found.select("id", "score", "_day"), mode
        return found.orderBy(F.desc("score"), "id").limit(limit).select("id", "score"), mode

    def _found(self, query: object, only: DataFrame | None) -> DataFrame:
        negated = any(a.negated for c in query.clauses for a in c)
        found = evaluate(self.index if negated else self._of(query.terms), query)
        return found if only is None else found.join(only, "id", "left_semi")

    def semantic(self, query: str, limit: int, f: filters.SearchFilters | None = None) -> DataFrame:
        only = self.allowed(f)
        vectors = self.vectors if only is None else self.vectors.join(only, "id", "left_semi")
        return semantic_search(vectors, "id", "vector", self.encoder.encode([query])[0].tolist(), limit).select("id", "score")

    def answer(self, query: str, *, method: str = "hybrid", limit: int = 20, how: str = "rrf", f: filters.SearchFilters | None = None) -> Result:
        """The best texts by one method or by both fused, under the filters, with their display columns."""
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}; known are {METHODS}")
        query = " ".join("".join(c if c.isprintable() else " " for c in query).split())
        depth = fusion.pool_depth(limit) if method == "hybrid" else limit
        mode, parts = "exact", []
        if method in ("lexical", "hybrid"):
            found, mode = self.lexical(query, depth, f)
            parts.append(found.withColumn("method", F.lit("lexical")))
        if method in ("semantic", "hybrid"):
            parts.append(self.semantic(query, depth, f).withColumn("method", F.lit("semantic")))
        lists = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        order = [F.desc("score"), *([F.desc_nulls_last("_day")] if "_day" in lists.columns else []), F.asc("id")]
        lists = lists.withColumns({"query": F.lit(query), "rank": F.row_number().over(Window.partitionBy("method").orderBy(*order))})
        if method == "hybrid":
            top = fusion.fuse(lists, limit, how=how).select("id", "rank", F.col("total").alias("score"), "components")
        else:
            top = lists.select("id", "rank", "score")
        shown = self.texts.select(*[c for c in self.texts.columns if c != "body"])
        return Result(query, method, mode, UNITS[method] if how == "rrf" or method != "hybrid" else "sum of scaled scores", filters.hydrate(top, shown, "id"))

    def search(self, query: str, *, method: str = "hybrid", limit: int = 20, how: str = "rrf", f: filters.SearchFilters | None = None) -> DataFrame:
        return self.answer(query, method=method, limit=limit, how=how, f=f).hits

    def search_all(self, query: str, *, limit: int = 20, f: filters.SearchFilters | None = None) -> DataFrame:
        """(method, id, rank, score): every method's list for one query, for pooling."""
        one = lambda m: self.search(query, method=m, limit=limit, f=f).select(F.lit(m).alias("method"), "id", "rank", "score")
        return one("lexical").unionByName(one("semantic")).unionByName(one("hybrid"))

    def run_all(self, queries: Mapping[str, str], *, limit: int = 20) -> DataFrame:
        """(query, method, id, rank, score): many queries by every method, each index being read once for all of them."""
        depth = fusion.pool_depth(limit)
        lex = evaluate_many(self.index, {k: parse(q) for k, q in queries.items()}, depth).select("query", F.lit("lexical").alias("method"), "id", "rank", "score")
        names = list(queries)
        asked = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(self.encoder.encode([queries[n] for n in names]))], "q bigint, v array<float>")
        near = search_stated(self.vectors.select("id", F.col("vector").alias("v")), asked.select(F.col("q").alias("id"), "v"), "id", "v", depth)
        sem = near.select(F.get(F.array(*map(F.lit, names)), F.col("query").cast("int")).alias("query"), F.lit("semantic").alias("method"), "id", "rank", "score")
        both = lex.unionByName(sem)
        mixed = fusion.fuse(both, limit).select("query", F.lit("hybrid").alias("method"), "id", "rank", F.col("total").alias("score"))
        return both.where(F.col("rank") <= limit).unionByName(mixed)

    def papers(self, f: filters.SearchFilters | None = None, *, limit: int = 20, offset: int = 0) -> DataFrame:
        columns = {"date": "feed_date", "preprint": "is_preprint", "reviewed": "is_peer_reviewed", "fields": "field_slugs", "retraction": "retraction_status"}
        return filters.newest_first(filters.filtered(self.facts, f or filters.SearchFilters(), columns, self.records), "feed_date", "facts_id", limit=limit, offset=offset)

    def paper(self, facts_id: int) -> DataFrame:
        return self.facts.where(F.col("facts_id") == facts_id).limit(1)

    def field_counts(self) -> DataFrame:
        return filters.field_counts(self.facts, "field_slugs")

    def feed(self, profile: recommend.Profile, today: Column, **options: object) -> feeds.Feed:
        """A reader's feed from all candidate sources, with reasons and diagnostics; see plans/feed.py."""
        return feeds.build_feed(self.facts, profile, today, **options)


def _written(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def interests_of(facts: DataFrame, keys: Sequence[int]) -> list[tuple[int, tuple[float, ...]]]:
    """The vectors of a handful of papers, for a profile made of papers."""
    rows = facts.where(F.col("facts_id").isin(list(keys))).select("facts_id", "vector").collect()
    return sorted((r.facts_id, tuple(float(x) for x in r.vector)) for r in rows if r.vector)
