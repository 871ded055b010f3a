"""The four-table holder every operator takes.

``star_tables`` derives all lazily from the star-schema test data; ``load_tables`` reads them from a stored layout
(``sales`` and ``target`` partitioned by ``Year`` and load, summaries, rollup and dimensions beside them) as written by
:func:`salescope.sources.ingest.write_tables` and :func:`salescope.sources.ingest.append_load`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from salescope.functions import dates
from salescope.session import dropped, folder, kept
from salescope.sources import fixtures, marts, names, rollups
from salescope.sources.schema import SALES, TARGET, validate

TABLE_NAMES = ("sales", "target", "sales_summary", "target_summary")


class Tables:
    """The two facts, and what is derived from them or stored beside them; each is made when it is first asked for."""

    def __init__(self, sales: DataFrame, target: DataFrame, root: str | None = None):
        self.sales, self.target, self.root = sales, target, root

    @classmethod
    def from_facts(cls, sales: DataFrame, target: DataFrame) -> "Tables":
        return cls(validate(sales, SALES, "sales"), validate(target, TARGET, "target"))

    def _derived(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return make() if self.root is None else self.sales.sparkSession.read.parquet(f"{self.root}/{name}")

    @cached_property
    def sales_summary(self) -> DataFrame:
        return self._derived("sales_summary", lambda: marts.sales_summary(self.sales))

    @cached_property
    def target_summary(self) -> DataFrame:
        return self._derived("target_summary", lambda: marts.target_summary(self.target))

    @cached_property
    def item_days(self) -> DataFrame:
        """Sales by item, customer, channel and day."""
        return self._derived("item_days", lambda: rollups.item_days(self.sales))

    def days_of(self, as_of, months: int) -> DataFrame:
        """``item_days`` of the last ``months``, for queries that read them several times. Where the rollup is not stored,
        it is made and written once for all these readers, which would each join the star and add up its lines otherwise:
        first the lines, then their sums, so that the shuffle files of both do not lie on disk at a time."""
        cutoff = dates.months_ago(as_of, months)
        if self.root is not None:
            return dates.since(self.item_days, cutoff)
        spark, at = self.sales.sparkSession, folder(self.sales.sparkSession)
        days = kept(rollups.item_days(kept(dates.since(self.sales, cutoff).select(*rollups.LINE_COLUMNS), at)))
        dropped(spark, at)
        return days

    @cached_property
    def items(self) -> DataFrame:
        """Items ever sold, by year."""
        return self._derived("items", lambda: rollups.items(self.sales))

    @cached_property
    def accounts(self) -> DataFrame:
        """Customers and the brands they bought, by year."""
        return self._derived("accounts", lambda: rollups.accounts(self.sales))

    @cached_property
    def brand_names(self) -> DataFrame:
        """Index of brand names."""
        return self._derived("brand_names", lambda: names.brand_names(self.sales))

    @cached_property
    def item_grams(self) -> DataFrame:
        """Index of item descriptions."""
        return self._derived("item_grams", lambda: names.item_grams(self.items))

    @property
    def stored_grams(self) -> DataFrame | None:
        """The index of item descriptions where one is stored; without one a lookup makes it from the items it reads."""
        return None if self.root is None else self.item_grams

    def register(self, spark: SparkSession) -> "Tables":
        """Expose the four tables as temp views for the SQL surface."""
        for name in TABLE_NAMES:
            view = getattr(self, name)
            (view.drop("Year") if name == "target_summary" else view).createOrReplaceTempView(name)
        return self


def star_tables(spark: SparkSession, sf_dir: str) -> Tables:
    base = fixtures.star_base(spark, sf_dir)
    return Tables.from_facts(fixtures.sales_from_star(base), fixtures.target_from_star(base))


def load_tables(spark: SparkSession, root: str) -> Tables:
    root = root.rstrip("/")
    sales = validate(spark.read.parquet(f"{root}/sales").drop("load"), SALES, "sales")
    target = validate(spark.read.parquet(f"{root}/target").drop("load"), TARGET, "target")
    return Tables(sales, target, root)
