"""The cleaned mart: raw tables run through the cleaning jobs.

* ``Mart(spark, sf_dir)`` wires the driver tables -> conformed raw tables ->
  cleaning jobs. Everything stays lazy; each property is one DataFrame built
  once per ``Mart``.
* ``Mart.from_raw(spark, tables)`` does the same for raw tables a user read
  (e.g. the nine CSV files through ``sources.io.read_raw_dir``).
* ``Mart.shared(spark, sf_dir)`` is the loaded mart: the cleaned tables
  written once per session and input to the shared folder, each when it is
  first read, then read by every check and question.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ordermart.operators import clean
from ordermart.session import discard, file_state, shared_dir
from ordermart.sources import io
from ordermart.sources.conformed import Conformed
from ordermart.sources.driver import DriverTables, table_path

# Driver tables the mapping reads (their fingerprint keys the loaded mart).
MAPPED_SOURCES = ("nation", "customer", "supplier", "part", "orders", "lineitem")

TABLES = (
    "orders", "order_items", "order_payments", "order_reviews", "customers", "sellers", "products", "category_translation", "geolocation",
)


class RawTables:
    """User-supplied raw tables with the same attributes as ``Conformed``."""

    def __init__(self, tables: dict[str, DataFrame]):
        for name, df in tables.items():
            setattr(self, name, df)


class Mart:
    def __init__(self, spark: SparkSession, sf_dir: str, raw=None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.raw = raw if raw is not None else Conformed(DriverTables(spark, sf_dir))

    @classmethod
    def from_raw(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> "Mart":
        """Run the pipeline on the nine raw tables (e.g. from ``read_raw_dir``)."""
        return cls(spark, "", raw=RawTables(tables))

    @cached_property
    def orders(self) -> DataFrame:
        return clean.clean_orders(self.raw.orders)

    @cached_property
    def order_items(self) -> DataFrame:
        return clean.clean_order_items(self.raw.order_items)

    @cached_property
    def order_payments(self) -> DataFrame:
        return clean.clean_order_payments(self.raw.order_payments)

    @cached_property
    def order_reviews(self) -> DataFrame:
        return clean.clean_order_reviews(self.raw.order_reviews)

    @cached_property
    def customers(self) -> DataFrame:
        return clean.clean_customers(self.raw.customers)

    @cached_property
    def sellers(self) -> DataFrame:
        return clean.clean_sellers(self.raw.sellers)

    @cached_property
    def products(self) -> DataFrame:
        return clean.clean_products(self.raw.products)

    @cached_property
    def category_translation(self) -> DataFrame:
        return clean.clean_category_translation(self.raw.category_translation)

    @cached_property
    def geolocation(self) -> DataFrame:
        return clean.clean_geolocation(self.raw.geolocation)

    def tables(self) -> dict[str, DataFrame]:
        """The nine cleaned tables by their reference names."""
        return {
            "orders": self.orders,
            "order_items": self.order_items,
            "order_payments": self.order_payments,
            "order_reviews": self.order_reviews,
            "customers": self.customers,
            "sellers": self.sellers,
            "products": self.products,
            "category_translation": self.category_translation,
            "geolocation": self.geolocation,
        }

    # ---------------------------------------------------------- loading
    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str) -> "Mart":
        """The cleaned mart written once per session and input, then reused.

        This is the reference's own flow: clean once, load, then run every
        check and question against the loaded tables. The nine cleaned tables
        (plus raw orders, whose mapping needs a lineitem aggregation) are
        written under the shared checkpoint folder, each when a query first
        reads it, so that none pays for tables it doesn't read; later queries
        scan those Parquet files instead of re-deriving them from the raw
        tables. The key includes the input files' sizes and times, so changed
        inputs reload.
        """
        key = (spark.sparkContext.applicationId, _fingerprint(spark, sf_dir))
        with _LOAD_LOCK:
            loaded = _LOADED.get(key)
            if loaded is None:
                loaded = LoadedMart(cls(spark, sf_dir))
                _LOADED[key] = loaded
        return loaded


_LOADED: dict[tuple[str, str], "LoadedMart"] = {}
_LOAD_LOCK = threading.Lock()
_RAW_LOCK = threading.Lock()


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Changes with the mapped tables' sizes and times, on any storage."""
    state = [(name, file_state(spark, table_path(sf_dir, name))) for name in MAPPED_SOURCES]
    return hashlib.sha1(repr((sf_dir, state)).encode()).hexdigest()[:16]


class LoadedRaw:
    """The raw tables a loaded mart was built from; raw orders, and what
    ``load_raw`` wrote, are read from their copies."""

    def __init__(self, source, orders: Callable[[], DataFrame]):
        self._source, self._orders = source, orders

    @cached_property
    def orders(self) -> DataFrame:
        return self._orders()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._source, name)


class LoadedMart(Mart):
    """A ``Mart`` whose cleaned tables are Parquet copies in the shared folder,
    written when they are first read (``build``: all at once)."""

    _raw_loaded = False

    def __init__(self, source: Mart):
        # Raw tables with attributes of its own.
        super().__init__(source.spark, source.sf_dir, raw=LoadedRaw(source.raw, self._raw_orders))
        self.source, self.paths = source, {}
        self.root = shared_dir(self.spark, f"mart-{uuid.uuid4().hex}")
        self._lock = threading.RLock()

    @classmethod
    def build(cls, source: Mart) -> "LoadedMart":
        mart = cls(source)
        mart.tables()
        return mart

    def _written(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        paths = io.load_tables(tables, self.root)
        self.paths |= paths
        # A known schema skips the footer-inference job on read.
        return {name: io.read_table(self.spark, path, schema=tables[name].schema) for name, path in paths.items()}

    def _raw_orders(self) -> DataFrame:
        """Cleaned orders are derived from this copy, so the lineitem
        aggregation of the mapping runs once."""
        with self._lock:
            if "raw_orders" not in self.__dict__:
                self.__dict__["raw_orders"] = self._written({"raw_orders": self.source.raw.orders})["raw_orders"]
            return self.__dict__["raw_orders"]

    def _cleaned(self, name: str) -> DataFrame:
        if name != "orders":
            return getattr(self.source, name)
        # Rows sorted by status inside each file: row-group min/max stats then
        # let the pushed ``order_status = 'delivered'`` filter skip the rest.
        return clean.clean_orders(self.raw.orders).sortWithinPartitions("order_status", "order_purchase_timestamp")

    def _load(self, *names: str) -> None:
        """Write those of the tables that aren't yet; independent, so together."""
        with self._lock:
            self._loaded |= self._written({n: self._cleaned(n) for n in names if n not in self._loaded})

    @cached_property
    def _loaded(self) -> dict[str, DataFrame]:
        return {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._loaded:
            self._load(name)
        return self._loaded[name]

    orders = property(lambda self: self._table("orders"))
    order_items = property(lambda self: self._table("order_items"))
    order_payments = property(lambda self: self._table("order_payments"))
    order_reviews = property(lambda self: self._table("order_reviews"))
    customers = property(lambda self: self._table("customers"))
    sellers = property(lambda self: self._table("sellers"))
    products = property(lambda self: self._table("products"))
    category_translation = property(lambda self: self._table("category_translation"))
    geolocation = property(lambda self: self._table("geolocation"))

    def tables(self) -> dict[str, DataFrame]:
        self._load(*TABLES)
        return super().tables()

    def load_raw(self) -> "LoadedMart":
        """Write the raw tables too, once: reports over them then scan files
        instead of deriving (or parsing) each raw table for every pass."""
        with _RAW_LOCK:
            if not self._raw_loaded:
                names = [n for n in TABLES if n != "orders"]  # raw orders have a copy of their own
                raw = {f"raw_{n}": getattr(self.raw, n) for n in names}
                paths = io.load_tables(raw, self.root)
                for n in names:
                    self.raw.__dict__[n] = io.read_table(self.spark, paths[f"raw_{n}"], schema=raw[f"raw_{n}"].schema)
                self._raw_loaded = True
        return self

    def unload(self) -> None:
        """Remove the copies; the mart can't be read after that."""
        discard(self.spark, self.root)
