"""The search functions by their short names, with the implementation and parameters that the session's settings name."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions import settings
from vectide.operators import analogy as analogies
from vectide.operators import codebooks, grouping, ivfadc, ivpq, knn, pq
from vectide.operators.insertion import Indexes, insert_batch
from vectide.sources import vectors as source

#: What a saved model holds: tables, inverted lists by cell, and what is known of their cells.
TABLES = ("vectors", "original", "coarse", "codebook", "residual_codebook", "multi", "codes")
LISTS = ("residual_codes", "multi_codes")
COUNTS = ("residual_counts", "word_statistics")


@dataclass
class Model:
    """A vocabulary with its indexes. Codebooks come seeded unless trained ones are given."""

    spark: SparkSession
    vectors: DataFrame
    original: DataFrame
    coarse: DataFrame
    dims: int
    m: int = 8
    k: int = 16
    k_multi: int = 8
    books: dict[str, DataFrame] | None = None

    def _book(self, name: str, vectors: DataFrame, m: int, k: int) -> DataFrame:
        return (self.books or {}).get(name) or codebooks.seeded_codebook(vectors, m, k, self.dims)

    @cached_property
    def codebook(self) -> DataFrame:
        return self._book("codebook", self.vectors, self.m, self.k)

    @cached_property
    def residual_codebook(self) -> DataFrame:
        return self._book("residual_codebook", codebooks.assign(self.vectors, self.coarse), self.m, self.k)

    @cached_property
    def multi(self) -> DataFrame:
        return self._book("multi", self.vectors, 2, self.k_multi)

    @cached_property
    def codes(self) -> DataFrame:
        return codebooks.encode(self.vectors, self.codebook, ("id", "word"))

    @cached_property
    def residual_codes(self) -> DataFrame:
        return ivfadc.build(self.vectors, self.coarse, self.residual_codebook)

    @cached_property
    def multi_codes(self) -> DataFrame:
        return ivpq.build(self.vectors, self.multi, self.codebook, self.k_multi)

    @cached_property
    def residual_counts(self) -> DataFrame:
        return ivfadc.cell_counts(self.residual_codes)

    @cached_property
    def word_statistics(self) -> DataFrame:
        return ivpq.create_statistics(self.vectors.select("word"), self.multi_codes, self.k_multi**2)

    def save(self, path: str) -> Model:
        """Write vectors, codebooks, indexes, and the counts and statistics of their cells below a path, inverted lists by cell, and return the model that reads them."""
        for name in TABLES:
            source.save_table(getattr(self, name), f"{path}/{name}")
        for name in LISTS:
            source.save_index(getattr(self, name), f"{path}/{name}")
        stored = self.load(path, TABLES + LISTS)
        for name in COUNTS:
            source.save_table(getattr(stored, name), f"{path}/{name}")
        return self.load(path)

    def load(self, path: str, names: tuple[str, ...] = ()) -> Model:
        """The model with the tables that save has written."""
        names = names or TABLES + LISTS + COUNTS
        own = {f: source.load(self.spark, f"{path}/{f}") for f in ("vectors", "original", "coarse")}
        out = replace(self, **own)
        for name in names:
            if name not in own:
                out.__dict__[name] = source.load(self.spark, f"{path}/{name}")
        return out

    def insert(self, terms: DataFrame, path: str) -> Model:
        """Write a new snapshot with a batch of terms below another path: rows appended, codebooks moved, counts and statistics anew. The old one stays as it is until its readers have gone."""
        got = insert_batch(self.indexes, terms)
        grown = replace(self, vectors=self.vectors.unionByName(got.vectors), original=self.original.unionByName(got.original))
        for name in ("codes", "residual_codes", "multi_codes"):
            old, new = getattr(self, name), getattr(got, name)
            grown.__dict__[name] = old.unionByName(new.select(*[F.col(f.name).cast(f.dataType) for f in old.schema]))
        grown.__dict__.update(codebook=got.codebook, residual_codebook=got.residual_codebook, multi=self.multi)
        return grown.save(path)

    @property
    def indexes(self) -> Indexes:
        return Indexes(self.vectors, self.codebook, self.coarse, self.residual_codebook, self.multi, self.m, self.k_multi, self.dims, self.original)

    # queries as rows (qid, vector)

    def words(self, words: DataFrame) -> DataFrame:
        return knn.within(self.vectors, words.select("word")).select(F.col("id").alias("qid"), F.col("word").alias("query"), "vector")

    def one(self, query) -> DataFrame:
        if isinstance(query, str):
            return self.vectors.where(F.col("word") == query).select(F.col("id").alias("qid"), F.col("word").alias("query"), "vector")
        return self.spark.range(1).select(F.col("id").alias("qid"), F.lit("").alias("query"), knn.literal(query).alias("vector"))

    # pairs qid, id, word, similarity by each implementation

    def pairs(self, how: str, queries: DataFrame, n: int, targets: DataFrame | None = None, pvf: int | None = None) -> DataFrame:
        get = lambda name: settings.get(self.spark, name)
        pvf = pvf or get("pvf")
        size = (self.m, self.k, self.dims)
        if how == "exact":
            return knn.knn_pairs(queries, knn.within(self.vectors, targets) if targets is not None else self.vectors, n)
        if how in ("pq", "pq_verified"):
            times = pvf if how == "pq_verified" else 1
            found = pq.pq_batch(self.codes, self.codebook, queries, n * times, *size, targets)
        elif how in ("ivfadc", "ivfadc_verified", "ivfadc_batch"):
            times, w = pvf if how == "ivfadc_verified" else 1, 1 if how == "ivfadc_batch" else get("w")
            index = knn.within(self.residual_codes, targets) if targets is not None else self.residual_codes
            found = ivfadc.ivfadc_search(index, self.coarse, self.residual_codebook, queries, n * times, *size, w, None if targets is not None else self.residual_counts)
        elif how == "ivpq":
            among = targets if targets is not None else self.vectors.select("id")
            return ivpq.ivpq_join(self.vectors, self.multi_codes, self.multi, self.codebook, self.statistics(), queries, among, n, *size[:2], self.k_multi, self.dims, get("alpha"), pvf, get("method"), get("confidence"), get("use_targetlist"))
        else:
            raise ValueError(f"no implementation {how}")
        if times > 1:
            return pq.verified(found, self.vectors, queries, n)
        return found.select("qid", "id", "word", pq.as_similarity())

    def statistics(self) -> DataFrame:
        """Of the table that the settings name, if it is there; else of the vocabulary itself."""
        name = settings.get(self.spark, "statistics_table")
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        return self.word_statistics

    # the functions

    def knn(self, query, n: int, how: str | None = None, pvf: int | None = None) -> DataFrame:
        how = how or settings.get(self.spark, "knn")
        if how == "exact":
            return knn.knn(self.vectors, query, n)
        return self.pairs(how, self.one(query), n, None, pvf).select("word", "similarity")

    def knn_in(self, query, n: int, targets: DataFrame, how: str | None = None) -> DataFrame:
        """Among a set of words or ids."""
        how = how or settings.get(self.spark, "knn_in")
        if how == "exact":
            return knn.knn_in(self.vectors, query, n, targets)
        return self.pairs(how, self.one(query), n, targets).select("word", "similarity")

    def knn_join(self, queries: DataFrame, n: int, targets: DataFrame | None, how: str | None = None) -> DataFrame:
        """query, target, similarity for query words (word)."""
        how = how or settings.get(self.spark, "knn_join")
        if how == "exact":
            return knn.knn_join(self.vectors, queries, n, targets)
        known = self.words(queries)
        near = self.pairs(how, known, n, targets).join(known.select("qid", "query"), "qid")
        return near.select("query", F.col("word").alias("target"), "similarity")

    def knn_batch(self, queries: DataFrame, n: int, how: str | None = None) -> DataFrame:
        how = how or settings.get(self.spark, "knn_batch")
        return self.knn_join(queries, n, None, "ivfadc_batch" if how == "ivfadc" else how)

    def analogy(self, a: str, b: str, c: str, how: str | None = None, targets: DataFrame | None = None) -> DataFrame:
        """word. Besides exact scores, pq, ivfadc and ivpq ask an index for candidates and score those exactly."""
        how = how or settings.get(self.spark, "analogy" if targets is None else "analogy_in")
        if how in analogies.SCORES:
            return analogies.analogy(self.original if how == "pair_direction" else self.vectors, a, b, c, how, targets)
        query = analogies.offset(self.vectors, a, b, c, unit=True)
        n = 4 if how == "ivpq" else settings.get(self.spark, "pvf") + 3
        return analogies.analogy_from(self.vectors, self.pairs(how, query, n, targets), a, b, c)

    def groups(self, tokens: DataFrame, names: DataFrame, how: str | None = None) -> DataFrame:
        how = how or settings.get(self.spark, "groups")
        if how == "exact":
            return grouping.groups(self.vectors, tokens, names)
        return grouping.groups_pq(self.vectors, self.codes, self.codebook, tokens, names, self.m, self.k, self.dims)

    def cluster(self, tokens: DataFrame, k: int, how: str | None = None, seeds: list[int] | None = None, rounds: int = 10) -> DataFrame:
        how = how or settings.get(self.spark, "cluster")
        nearest = None
        if how != "exact":

            if how not in ("pq", "ivpq"):
                raise ValueError(f"no implementation {how}")
            held = knn.within(self.codes, tokens)

            def nearest(own: DataFrame, centroids: DataFrame) -> DataFrame:
                # every token is assigned, so the cells of a multi-index have nothing to leave out
                return pq.pq_nearest(held, self.codebook, centroids, self.m, self.k, self.dims).select("id", "qid")

        return grouping.cluster(self.vectors, tokens, k, self.dims, seeds, rounds, nearest)
