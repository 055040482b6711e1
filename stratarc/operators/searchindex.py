"""Search over a stored order of URLs.

``build_index`` writes the distinct URLs once, range-partitioned and sorted by (level, uri), a folder for each part, with
a summary of each part's last URL and number of rows; and postings of three-letter grams, sorted by gram.

* A *keyset page* starts at the part in which the cursor lies; parts before it are never opened, so that its cost does
  not depend on how deep it is.  Parts are read a few at a time (1, 4, 16, ...) until the page is full.
* An *offset page* reads parts from the first on until all rows before the page and the page itself are found.
* A *capped count* stops when the parts read so far hold as many rows as the cap.
* A *text* of three letters or more can be looked up by its grams: only postings of these are read (their table is
  sorted, so parquet skips the rest), URLs that have all of them are compared with the text.

Only the summary of the parts comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stratarc.operators.search import COUNTED, LAST_PAGE, PAGE, level, matches

GRAM = 3


def build_index(captures: DataFrame, at: str) -> None:
    """Writes the index of the captures' URLs to a shared folder."""
    spark = captures.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    uris = captures.where("uri IS NOT NULL").select("uri").distinct().withColumn("level", level(F.col("uri")))
    placed = uris.repartitionByRange(n, "level", "uri").sortWithinPartitions("level", "uri").withColumn("part", F.spark_partition_id())
    placed.write.partitionBy("part").parquet(f"{at}/uris")
    stored = spark.read.parquet(f"{at}/uris")
    stored.groupBy("part").agg(F.max(F.struct("level", "uri")).alias("last"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{at}/parts")
    low = F.lower("uri")
    starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    grams = stored.select("level", "uri", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))))).alias("gram"))
    grams.repartitionByRange(n, "gram", "level", "uri").sortWithinPartitions("gram", "level", "uri").write.parquet(f"{at}/grams")


@dataclass
class SearchIndex:
    uris: DataFrame
    grams: DataFrame
    parts: list[Row]

    def _enough(self, wanted: int, found: Column, first: int = 0) -> DataFrame:
        """The rows that are found in as many parts, from ``first`` on, as hold the number wanted (all parts, if they do not)."""
        size = 1
        while True:
            some = self.parts[first : first + size]
            rows = self.uris.where(F.col("part").between(some[0].part, some[-1].part) if some else F.lit(False)).where(found)
            if first + size >= len(self.parts) or rows.limit(wanted).count() >= wanted:
                return rows.select("level", "uri")
            size *= 4

    def offset_page(self, query: str, page: float) -> DataFrame:
        before = (min(max(int(page), 1), LAST_PAGE) - 1) * PAGE
        return self._enough(before + PAGE, matches(F.col("uri"), query)).orderBy("level", "uri").offset(before).limit(PAGE)

    def keyset_page(self, query: str, after_level: int | None, after_uri: str | None) -> DataFrame:
        """Rows after a cursor; half a cursor is none."""
        found, first = matches(F.col("uri"), query), 0
        if after_level is not None and after_uri:
            cursor = (after_level, after_uri.encode())
            first = next((k for k, p in enumerate(self.parts) if (p.last.level, p.last.uri.encode()) > cursor), len(self.parts))
            found = found & ((F.col("level") > after_level) | ((F.col("level") == after_level) & (F.col("uri") > after_uri)))
        return self._enough(PAGE, found, first).orderBy("level", "uri").limit(PAGE)

    def exact_count(self, query: str) -> DataFrame:
        return self.uris.where(matches(F.col("uri"), query)).agg(F.count("*").alias("total"))

    def capped_count(self, query: str, cap: int = COUNTED) -> DataFrame:
        """Counting stops at the cap; without a text the parts' own counts say whether it is reached."""
        if not query and sum(p.n for p in self.parts) >= cap:
            n = self.uris.sparkSession.range(1).select(F.lit(cap).cast("long").alias("total"))
        else:
            n = self._enough(cap, matches(F.col("uri"), query)).limit(cap).agg(F.count("*").alias("total"))
        return n.select("total", (F.col("total") >= cap).alias("capped"), F.when(F.col("total") >= cap, "10,000+").otherwise(F.col("total").cast("string")).alias("label"))

    def found(self, query: str) -> DataFrame:
        """All URLs with a text, by its grams; shorter texts have none, and all URLs are read."""
        low = query.lower()
        wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not wanted:
            return self.uris.where(matches(F.col("uri"), query)).select("level", "uri")
        some = self.grams.where(F.col("gram").isin(wanted)).groupBy("level", "uri").agg(F.count("*").alias("n"))
        return some.where((F.col("n") == len(wanted)) & matches(F.col("uri"), query)).select("level", "uri")


def open_index(spark: SparkSession, at: str) -> SearchIndex:
    """The summary has a row for each part; only that is collected."""
    parts = spark.read.schema("part int, last struct<level:int,uri:string>, n long").parquet(f"{at}/parts").orderBy("part").collect()
    return SearchIndex(spark.read.schema("uri string, level int, part int").parquet(f"{at}/uris"), spark.read.schema("level int, uri string, gram string").parquet(f"{at}/grams"), parts)
