"""Bookmark tables: CSV exports, and the table derived from a page snapshot."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from noteweave.operators.order import MAX_BROADCAST_SPLITS, number_rows, number_tagged, tag_splits
from noteweave.schemas import BOOKMARK_CSV
from noteweave.session import shared_dir

CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt_record",
    "enforceSchema": "true",
}


def csv_reader(reader: "DataStreamReader | object", multi_line: bool = False):
    """Reader set up for bookmark exports.

    ``multi_line`` allows line breaks inside quoted fields, at the price that a
    file is read by one task; give such exports as many files.
    """
    return reader.schema(BOOKMARK_CSV).options(**CSV_OPTIONS, multiLine=str(multi_line).lower())


def read_bookmarks(spark: SparkSession, path: str, multi_line: bool = False, work_dir: str | None = None) -> DataFrame:
    """Bookmark CSV with a dense ``row_idx`` in file order.

    Rows with too few or too many fields keep what was parsed; the raw line is
    in ``_corrupt_record``.  ``multi_line`` allows line breaks inside quoted fields; files are read in splits either way.
    """
    if not multi_line:
        return number_rows(csv_reader(spark.read).csv(path), "row_idx", work_dir)
    base = work_dir or shared_dir(spark, "csv-records")
    records, unpaired = quoted_records(spark, path, base)
    options = {name: value for name, value in CSV_OPTIONS.items() if name not in ("header", "enforceSchema")}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BOOKMARK_CSV)
    rows = records.select(F.from_csv("record", F.lit(schema), options).alias("row"), *SPLIT).select("row.*", *SPLIT)
    if unpaired:
        rows = rows.union(tag_splits(csv_reader(spark.read, multi_line=True).csv(unpaired)))
    return number_tagged(rows, "row_idx", f"{base}/numbers")


SPLIT = ("_file", "_start", "_seq")
# Pieces of records: whole ones, the first piece of one that goes on in the next split, and what goes on.
RECORD, TAIL, HEAD = 0, 1, 2
NO_NUMBER = 1 << 62  # of a head, which is not the first piece of its record


def quoted_records(spark: SparkSession, path: str, work_dir: str) -> tuple[DataFrame, list[str]]:
    """``record, _file, _start, _seq``: the records of quoted CSV files behind their headers, numbered in the split they begin in.

    A line begins a record when an even number of quotes stands before it in its file.  The quotes of each split are counted and added up
    over the splits of its file, so a split knows whether it begins inside a field.  A record that goes on into later splits is put
    together from its pieces.  This holds where quotes stand around whole fields and are doubled inside of them.  Files with an odd number of
    quotes break the rule; they are left out and named, for a reader that takes them whole.  Line breaks of two characters become one.
    """
    lines = tag_splits(spark.read.option("lineSep", "\n").text(path))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("_file", "_start").agg(F.sum(quotes).alias("_quotes"))
    file = Window.partitionBy("_file")
    before = F.coalesce(F.sum("_quotes").over(file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = counted.select("_file", "_start", (before % 2 == 1).alias("_inside"), (F.sum("_quotes").over(file) % 2 == 1).alias("_unpaired"))
    splits.write.mode("overwrite").parquet(f"{work_dir}/quotes")
    splits = spark.read.parquet(f"{work_dir}/quotes")
    unpaired = [unquote(r["_file"]) for r in splits.where("_unpaired").select("_file").distinct().collect()]
    splits, keys = splits.where("NOT _unpaired").select("_file", "_start", "_inside"), ["_file", "_start"]
    if splits.count() <= MAX_BROADCAST_SPLITS:
        known = lines.join(F.broadcast(splits), keys)
    else:
        known = lines.join(splits, keys).repartition(*keys).sortWithinPartitions(*keys, "_seq")
    pieces = known.select(*keys, "_inside", "value").mapInArrow(cut_records, "record string, _file string, _start bigint, _seq bigint, kind int")
    # Stored, as records are counted before they are read.
    pieces.write.mode("overwrite").parquet(f"{work_dir}/pieces")
    pieces = spark.read.parquet(f"{work_dir}/pieces")
    # At most two loose pieces a split.  In the order of a file, the head of a split comes before its tail and ends what a tail before began.
    place = F.struct("_start", (-F.col("kind")).alias("kind"), "record")
    loose = pieces.where(F.col("kind") != RECORD).withColumn("_place", place)
    begun = F.count_if(F.col("kind") == TAIL).over(file.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    joined = loose.withColumn("_chain", begun).groupBy("_file", "_chain").agg(
        F.array_join(F.array_sort(F.collect_list("_place"))["record"], "\n").alias("record"), F.min("_start").alias("_start"), F.min("_seq").alias("_seq")
    )
    return pieces.where(F.col("kind") == RECORD).select("record", *SPLIT).union(joined.select("record", *SPLIT)).where("_seq >= 0"), unpaired


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, start, inside, value) of whole splits, in order, to pieces of records.

    The header of a file has number -1, lines without a character are no records.
    """
    split, inside, open_, number = None, False, [], 0

    def rows(found: list[tuple[str, int, int]]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int32()))]
        file, start = pa.array([split[0]] * len(found), pa.string()), pa.array([split[1]] * len(found), pa.int64())
        return pa.RecordBatch.from_arrays([columns[0], file, start, *columns[1:]], names=["record", *SPLIT, "kind"])

    def rest() -> list[tuple[str, int, int]]:
        """What is open at the end of a split: a head if nothing has ended yet inside of it, else a tail."""
        return [("\n".join(open_), number if not inside else NO_NUMBER, HEAD if inside else TAIL)] if open_ else []

    for batch in batches:
        counts = pc.count_substring(batch.column(3), '"').to_numpy(zero_copy_only=False)
        values, starts, files = batch.column(3).to_pylist(), batch.column(1).to_numpy(), batch.column(0).to_pylist()
        found: list[tuple[str, int, int]] = []
        for n, value in enumerate(values):
            if split != (files[n], starts[n]):
                if split is not None and (found or open_):
                    yield rows(found + rest())
                split, inside, open_, found = (files[n], int(starts[n])), batch.column(2)[n].as_py(), [], []
                number, odd = (-1 if split[1] == 0 else 0), inside
            open_.append(value.removesuffix("\r"))
            odd ^= bool(counts[n] & 1)
            if odd:
                continue
            record = "\n".join(open_)
            open_ = []
            if inside:  # what the split before began ends here
                found.append((record, NO_NUMBER, HEAD))
                inside = False
            elif record.strip(" "):
                found.append((record, number, RECORD))
                number += 1
        if found:
            yield rows(found)
    if open_:
        yield rows(rest())


def bookmarks_from_pages(pages: DataFrame) -> DataFrame:
    """Bookmarks of a page table, with the irregular rows a real export has."""
    index = F.col("page_id")
    bare = F.regexp_replace("url", r"[?#][\s\S]*$", "")
    endings = F.array(*[F.lit(e) for e in ("pdf", "jpg", "mp4", "mp3", "docx", "zip", "dmg", "exe")])
    ending = F.element_at(endings, (index % 8 + 1).cast("int"))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return pages.select(
        index.alias("row_idx"),
        F.when(index % 10 == 0, F.lit(""))
        .otherwise(F.regexp_extract("html", r"<title>([^<]*)</title>", 1))
        .alias("title"),
        F.when(index % 7 == 3, F.concat(bare, F.lit("."), ending)).otherwise(F.col("url")).alias("url"),
        (index + 1507018057).cast("string").alias("time_added"),
        F.when(index % 5 == 0, F.lit(""))
        .when(index % 5 == 1, F.concat(F.lit("web, ,"), host))
        .otherwise(F.lit("web,web, html"))
        .alias("tags"),
        F.when(index % 2 == 0, F.lit("unread")).otherwise(F.lit("read")).alias("status"),
    )
