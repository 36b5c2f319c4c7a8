"""What users ask a corpus: similar pages, filters, text search, analysis of a series, details of one page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.operators import filters, search
from foliolake.operators.hooks import hashed_words


class Corpus:
    """Pages (page_id, series, volume, issue, source, std_id, ..., vector column) and, if given, texts (page_id or series, text).

    Every method returns a DataFrame and computes nothing by itself."""

    def __init__(self, pages: DataFrame, texts: DataFrame | None = None, *, vector: str = "page_embeddings", encoder: Callable[[str | None], list[float]] = hashed_words) -> None:
        self.pages, self.texts, self.vector, self.encoder = pages, texts, vector, encoder

    def find(self, part: str) -> DataFrame:
        """Pages whose standard id holds ``part``."""
        return filters.id_search(self.pages, part, ident="std_id").select("page_id", "std_id").orderBy("page_id")

    def similar(self, page_id: int, k: int = 10, **where: object) -> DataFrame:
        """The k pages most like one page, among those that fit ``where``."""
        q = self.pages.filter(F.col("page_id") == page_id)
        return search.top_k(filters.by_metadata(self.pages, where), q, k, ident="page_id", vector=self.vector)

    def similar_to(self, vector: list[float], k: int = 10, **where: object) -> DataFrame:
        q = self.pages.sparkSession.createDataFrame([(vector,)], f"{self.vector} array<double>")
        return search.top_k(filters.by_metadata(self.pages, where), q, k, ident="page_id", vector=self.vector)

    def covers(self, page_id: int, k: int = 10) -> DataFrame:
        """As :meth:`similar`, among first pages only."""
        q = self.pages.filter(F.col("page_id") == page_id)
        return search.top_k(self.pages.filter("page_num = 1"), q, k, ident="page_id", vector=self.vector)

    def filter(self, **where: object) -> DataFrame:
        return filters.by_metadata(self.pages, where).drop(self.vector)

    def text(self, query: str, k: int = 20) -> DataFrame:
        if self.texts is None:
            raise ValueError("this corpus has no texts")
        return filters.keyword_search(self.texts, query, k, order=["doc_id"])

    def meaning(self, query: str, encoded: DataFrame, k: int = 10) -> DataFrame:
        """The k texts nearest to the query under the corpus's encoder. ``encoded``: doc_id, embedding."""
        q = encoded.sparkSession.createDataFrame([(self.encoder(query),)], "embedding array<double>")
        return search.top_k(encoded, q, k, ident="doc_id")

    def analyze(self, series: str) -> DataFrame:
        """Pages of a series in all, by volume, by issue, by source: one scan."""
        own = self.pages.filter(F.col("series") == series)
        kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in (("all", F.lit("")), ("volume", F.col("volume")), ("issue", F.col("issue")), ("source", F.col("source")))])
        return own.select("page_id", F.explode(kinds).alias("k")).groupBy("k.kind", "k.value").agg(F.countDistinct("page_id").alias("pages"))

    def details(self, page_id: int, *, vectors: bool = False) -> DataFrame:
        own = self.pages.filter(F.col("page_id") == page_id)
        return own if vectors else own.drop(self.vector)
