"""Leads and what their pages hold, kept as tables laid out alike, so that repeated runs join them without a shuffle.

The leads and the findings are bucketed by ``fetch``, the homepage, and ``salt``. Findings have one row per homepage asked for: the
address and description of the homepage, and the contacts of its site, which are joined to it when pages are
written. So a lead needs one join, on just the columns of the buckets; a site with many homepages, such as a platform, is
many keys and spreads by itself. Rows cross the network when they are written, once.

A homepage that many leads share cannot be one bucket. Hot homepages are counted when the leads are written and kept as a third
table, a few rows per bucket at most; their leads are dealt to all salts by number and their one row of findings lies at
every salt. Leads without website are dealt by number as well.

Defined cases: a lead without website, or whose pages were not crawled, keeps what it had, as in :func:`enrich.enriched`. Leads may
repeat. Pages written later replace the findings and use the layout of the leads; leads written anew need their pages
written anew. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from leadweave.fixed_values import CONTACT_PATHS, DESCRIPTION_LENGTH
from leadweave.functions.url import site_base
from leadweave.operators import enrich
from leadweave.operators.skew import hot_keys, skew_join
from leadweave.session import fan_out, settle, shared_path

_LAYOUT = ["fetch", "salt"]
_PARTS = ("leads", "findings", "hot")


@dataclass(frozen=True)
class SiteStore:
    """Tables ``{name}_leads``, ``{name}_findings`` and ``{name}_hot`` of the catalog, with their files in *folder*.

    *buckets* is the parallelism of every later join: two to three times the cores, and enough that a bucket of leads fits a task.
    """

    spark: SparkSession
    name: str
    buckets: int
    folder: str

    @classmethod
    def create(cls, spark: SparkSession, name: str, buckets: int | None = None, folder: str | None = None) -> SiteStore:
        """A store in *folder*, by default a fresh one in the shared folder."""
        return cls(spark, name, buckets or fan_out(spark), folder or shared_path(spark, name))

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def drop(self) -> None:
        """Forget the tables; their files stay in the folder."""
        for part in _PARTS:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    def write_leads(self, leads: DataFrame) -> None:
        """Lay out *leads*, which are read three times: settle them if they are costly."""
        keyed = enrich.with_urls(leads).drop("base")
        self._save(hot_keys(keyed, "fetch").coalesce(1), "hot")
        salt = F.when(F.col("hot") | F.col("fetch").isNull(), F.pmod(F.xxhash64("lead_id"), F.lit(self.buckets)).cast("int"))
        self._keep(self._with_hot(keyed).withColumn("salt", salt.otherwise(0)), "leads")

    def write_crawl(
        self, crawl: DataFrame, paths: Sequence[str] = CONTACT_PATHS, length: int = DESCRIPTION_LENGTH, strict: bool = False
    ) -> None:
        """Read the pages that the kept leads use, in one scan of *crawl*, and keep what they hold."""
        asking = self.table("leads").select("lead_id", "website")
        homes, contacts = enrich.asked_features(asking, crawl, paths, length, strict)
        self.write_pages(homes, contacts, paths)

    def write_pages(self, homes: DataFrame, contacts: DataFrame, paths: Sequence[str] = CONTACT_PATHS) -> None:
        """Keep features of homepages and of contact-like pages, each unique by URL."""
        home = homes.select(
            F.col("url").alias("fetch"), F.col("email").alias("home_email"), F.col("description").alias("home_description")
        )
        asked = self.table("leads").where("fetch is not null").select("fetch").distinct()
        known = settle(asked.join(home, "fetch", "left").withColumn("base", site_base(F.col("fetch"))))
        # A platform has many homepages, and all of them get its contacts.
        found = skew_join(known, settle(enrich.site_contacts(contacts, paths)), "base", "fetch").drop("base")
        every = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(self.buckets - 1))).otherwise(F.array(F.lit(0)))
        self._keep(self._with_hot(found).withColumn("salt", F.explode(every)), "findings")

    def lead_pages(self) -> DataFrame:
        """Leads with the address and description of their homepage and the contacts of their site, as
        :func:`enrich.lead_pages` gives them, without a shuffle."""
        return self.table("leads").join(self.table("findings"), _LAYOUT, "left").drop(*_LAYOUT)

    def enriched(self) -> DataFrame:
        """As :func:`enrich.enriched`, from the kept tables."""
        return enrich.with_findings(self.lead_pages())

    def _with_hot(self, df: DataFrame) -> DataFrame:
        """Add ``hot``; the list has a few rows per bucket at most, see :func:`skew.hot_keys`."""
        marked = F.broadcast(self.table("hot").withColumn("hot", F.lit(True)))
        return df.join(marked, "fetch", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))

    def _keep(self, df: DataFrame, part: str) -> None:
        """Write *df* in buckets of one file each."""
        self._save(df.drop("hot").repartition(self.buckets, *_LAYOUT), part, _LAYOUT)

    def _save(self, df: DataFrame, part: str, layout: Sequence[str] = ()) -> None:
        writer = df.write.format("parquet").mode("overwrite").option("path", f"{self.folder}/{part}")
        if layout:
            writer = writer.bucketBy(self.buckets, *layout).sortBy(*layout)
        writer.saveAsTable(f"{self.name}_{part}")
