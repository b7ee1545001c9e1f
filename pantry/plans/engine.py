"""One catalog with its four requests, budgets and renderings."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from pantry.operators import compare, lookup, render, search, vocabulary
from pantry.operators.admission import Limiter
from pantry.operators.resilience import BASE_DELAY_S, classified, with_retries, within
from pantry.plans.errors import CatalogError, failure
from pantry.plans.requests import CompareRequest, LookupRequest, SearchRequest, VocabularyRequest
from pantry.plans.schema import CatalogSpec
from pantry.sources import products as P
from pantry.sources.config import Settings
from pantry.sources.config import settings as from_environment
from pantry.sources.seed import seed

RENDER = {lookup.LookupResult: render.lookup, search.SearchResult: render.search, compare.CompareResult: render.compare, vocabulary.VocabularyResult: render.vocabulary}


class Catalog:
    """products: raw products; quarantine: records that could not be read; full: the full vocabulary (a table, or a function that reads it).

    Every request runs under the settings' deadline; failures that may pass are tried again with growing pauses.
    """

    def __init__(self, products: DataFrame, quarantine: DataFrame | None = None, full=None, index: DataFrame | None = None, spec: CatalogSpec = CatalogSpec(), settings: Settings | None = None, limiter: Limiter | None = None, sleep=time.sleep):
        self.products, self.quarantine, self.full, self.index, self.spec, self.sleep = products, quarantine, full, index, spec, sleep
        self.settings = s = settings or from_environment()
        self.limiter = limiter or Limiter({"product": s.product, "search": s.search, "vocabulary": s.vocabulary})
        self.seed = seed(products.sparkSession)

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, settings: Settings | None = None, **more) -> "Catalog":
        """From JSON lines, or from Parquet sorted by key (``write_parquet``), where a look-up reads the row groups of its key only. Without a path the settings name it."""
        settings = settings or from_environment()
        path = path or settings.catalog
        if not path:
            raise CatalogError("invalid_input", "no catalog is named: give a path or set PANTRY_CATALOG")
        products, quarantine = P.read_json(spark, path) if P.is_json(path) else (P.read_parquet(spark, path), None)
        return cls(products, quarantine, settings=settings, **more)

    def _run(self, kind: str, call):
        spark = self.products.sparkSession
        return with_retries(lambda: within(spark, lambda: classified(call), self.settings.deadline_s), BASE_DELAY_S[kind], sleep=self.sleep)

    def get_product(self, barcode: str, fields: tuple[str, ...] = ()) -> lookup.LookupResult:
        request = LookupRequest(barcode, tuple(fields))
        self.limiter.acquire("product")
        return self._run("product", lambda: lookup.get_product(self.products, request, self.spec))

    def search_products(self, **request) -> search.SearchResult:
        asked = SearchRequest(**request)
        asked.check()
        self.limiter.acquire("search")
        return self._run("search", lambda: search.search(self.products, asked, self.spec, self.index))

    def compare_products(self, barcodes: list[str]) -> compare.CompareResult:
        """Each key takes a slot; a key without one failed."""
        request, refused, keys = CompareRequest(tuple(barcodes)), [], []
        for b in request.barcodes:
            try:
                self.limiter.acquire("product")
                keys.append(b)
            except CatalogError as e:
                refused.append(failure(b, e))
        if not keys:
            return compare.CompareResult([], 0, [], refused)
        try:
            result = self._run("product", lambda: compare.compare(self.products, _some(keys), self.quarantine, self.spec))
        except CatalogError as e:  # the one read behind all keys failed
            result = compare.CompareResult([], 0, [], [failure(b, e) for b in keys])
        if refused:
            result.failed = (result.failed or []) + refused
        return result

    def browse_vocabulary(self, facet: str, search: str | None = None, limit: int = 20) -> vocabulary.VocabularyResult:
        request = VocabularyRequest(facet, search, limit)

        def read() -> DataFrame | None:
            self.limiter.acquire("vocabulary")
            if self.full is None and self.settings.vocabularies:
                return P.read_vocabulary(self.products.sparkSession, self.settings.vocabularies, facet)
            return self.full() if callable(self.full) else self.full

        def guarded() -> DataFrame | None:
            try:
                return with_retries(lambda: classified(read), BASE_DELAY_S["vocabulary"], sleep=self.sleep)
            except CatalogError as e:
                raise RuntimeError(e.message) from e

        return self._run("vocabulary", lambda: vocabulary.browse(self.seed, request, guarded))


def _some(keys: list[str]) -> CompareRequest:
    """A batch of those keys that had a slot; may be a single one."""
    request = object.__new__(CompareRequest)
    object.__setattr__(request, "barcodes", tuple(keys))
    return request


def to_text(result) -> str:
    return RENDER[type(result)](result)


def to_dict(result) -> dict:
    """The structured form, without absent members."""
    return lookup.present(asdict(result))
