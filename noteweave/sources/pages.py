"""The latest pages as a versioned table, bucketed by url, for lookups that come again and again."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places of a page in the table, beside its url; ``taken`` tells copies apart.
COLUMNS = {"content_type": "string", "error": "string", "taken": "bigint"}


@dataclass(frozen=True)
class PreparedPages:
    """A folder of versions.  A version is complete before the list of versions names it, and is never changed after."""

    path: str

    def versions(self, spark: SparkSession) -> list[dict]:
        """Name, buckets and columns of the versions, oldest first; none before the first is written."""
        if not _exists(spark, f"{self.path}/versions"):
            return []
        lines = spark.read.text(f"{self.path}/versions").collect()  # one short line a version
        return sorted((json.loads(r["value"]) for r in lines), key=lambda v: v["number"])

    def table(self, spark: SparkSession, number: int | None = None) -> DataFrame:
        """``url, content_type, error, taken`` and the body of the current version, or of an earlier one."""
        found = [v for v in self.versions(spark) if number is None or v["number"] == number]
        if not found:
            raise ValueError(f"no prepared pages in {self.path}")
        version = found[-1]
        # The table of the session is a name for the files: any session that reads the folder knows its buckets.
        name = f"pages_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}_{version['number']}"
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({version['schema']}) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {version['buckets']} BUCKETS "
                f"LOCATION '{self.path}/{version['name']}'"
            )
        return spark.table(name)


def prepare_pages(spark: SparkSession, path: str, pages: DataFrame, order: str = "page_id", buckets: int = 200) -> PreparedPages:
    """Merge a snapshot into the prepared pages below ``path`` as a new version; the first call makes the table.

    Of the copies of a url the one with the largest ``order`` (a number) stays, be it in the table or in the snapshot; of equal ones the snapshot's.  The
    snapshot's copies are chosen on narrow columns and only the chosen bodies move; the table's own side is read bucket by bucket and does not.
    """
    from noteweave.operators.lookup import as_scan, bodies_of, latest_copies  # the lookup reads prepared pages too

    prepared = PreparedPages(path)
    known = prepared.versions(spark)
    buckets = known[-1]["buckets"] if known else buckets
    pages = as_scan(pages)
    body = "html" if "html" in pages.columns else "body"
    copies = latest_copies(None, pages, order, keep={"taken": F.col(order).cast("bigint")})
    new = bodies_of(copies.select("url", "_file", "_row", *COLUMNS), pages, body).select("url", *COLUMNS, body)
    number = known[-1]["number"] + 1 if known else 1
    if known:
        old = prepared.table(spark)
        if body not in old.columns:
            raise ValueError(f"the prepared pages hold {old.columns[-1]}, the snapshot {body}")
        ours, theirs = old.select("url", F.struct(*COLUMNS, body).alias("_old")), new.select("url", F.struct(*COLUMNS, body).alias("_new"))
        both = ours.join(theirs.hint("shuffle_hash"), "url", "full")
        newer = F.col("_old").isNull() | (F.col("_new").isNotNull() & (F.coalesce("_new.taken", F.lit(-1)) >= F.coalesce("_old.taken", F.lit(-1))))
        new = both.select("url", F.when(newer, F.col("_new")).otherwise(F.col("_old")).alias("_page")).select("url", "_page.*")
    name = f"v{number}-{uuid.uuid4().hex[:8]}"
    target = f"pages_{uuid.uuid4().hex}"
    (
        new.repartition(buckets, "url")
        .write.bucketBy(buckets, "url")
        .sortBy("url")
        .option("path", f"{path}/{name}")
        .saveAsTable(target)
    )
    schema = ", ".join(f"{c} {kind}" for c, kind in new.dtypes)
    spark.sql(f"DROP TABLE {target}")  # the name only: its files have a place of their own
    line = json.dumps({"number": number, "name": name, "buckets": buckets, "schema": schema})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/versions")
    return prepared


def _exists(spark: SparkSession, folder: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(folder)
        return True
    except AnalysisException:
        return False
