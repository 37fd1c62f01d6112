"""Row order as data: dense numbering, running totals, slices, batches, parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions import fixed
from noteweave.session import shared_dir

BLOCK = 65_536
# Index values of one block of a renumbering, and values (8 bytes each) that may be broadcast.
INDEX_BLOCK = 1024
MAX_BROADCAST_INDEX = 2_000_000
# Scan splits whose offsets may be broadcast (about 100 bytes each).
MAX_BROADCAST_SPLITS = 200_000
# Splits (one narrow row each) that are put in order by one task.
FEW_SPLITS = 10_000


def number_rows(scan: DataFrame, name: str = "row_idx", work_dir: str | None = None) -> DataFrame:
    """Dense 0-based position of every row of a file scan, in file order.

    Rows keep their order inside a split, so a position is the row's offset in
    its split plus the rows of all earlier splits.  Only the split totals, one
    row per split, are ordered; the data is neither sorted nor shuffled.
    The totals are written to the shared folder once, which also gives the size
    that decides between a broadcast and an ordinary join.
    """
    return number_tagged(tag_splits(scan), name, work_dir)


def tag_splits(scan: DataFrame) -> DataFrame:
    """Adds ``_file, _start, _seq``: the split of a row of a file scan, and its place there (rising)."""
    return scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )


def number_tagged(tagged: DataFrame, name: str = "row_idx", work_dir: str | None = None) -> DataFrame:
    """``number_rows`` of rows that know their split; ``_seq`` is without gaps in each."""
    spark = tagged.sparkSession
    totals = tagged.groupBy("_file", "_start").agg(F.count("*").alias("_rows"), F.min("_seq").alias("_first"))
    path = work_dir or shared_dir(spark, "splits")
    totals.write.mode("overwrite").parquet(path)
    totals = spark.read.parquet(path)
    splits = totals.count()
    offsets = _split_offsets(totals, splits, f"{path}-ranges")
    if splits <= MAX_BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    position = F.col("_offset") + F.col("_seq") - F.col("_first")
    return (
        tagged.join(offsets, ["_file", "_start"])
        .withColumn(name, position.cast("bigint"))
        .drop("_file", "_start", "_seq", "_first", "_offset")
    )


def _split_offsets(totals: DataFrame, splits: int, work_dir: str) -> DataFrame:
    """``_file, _start, _first, _offset``: the rows of all earlier splits, in order of part number, file and position.

    Many splits are dealt into ranges of that order first; each range is added up by itself, and the totals of the ranges are one small array.
    """
    spark = totals.sparkSession
    part_number = F.regexp_extract("_file", r"_part(\d+)\.enex", 1).try_cast("bigint")
    order = ["_part", "_file", "_start"]
    named = totals.withColumn("_part", part_number)
    if splits <= FEW_SPLITS:
        earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return named.select("_file", "_start", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    named.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.mode("overwrite").parquet(work_dir)
    ranged = spark.read.parquet(work_dir)
    sums = ranged.groupBy("_range").agg(F.sum("_rows").alias("n")).agg(F.collect_list(F.struct("_range", "n"))).scalar()
    earlier = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.select("*", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_inside"), sums.alias("_sums"))
    before = F.aggregate(F.filter("_sums", lambda r: r["_range"] < F.col("_range")), F.lit(0).cast("bigint"), lambda total, r: total + r["n"])
    return inside.select("_file", "_start", "_first", (before + F.col("_inside")).alias("_offset"))


def running_totals(table: DataFrame, index: str, **sums: Column) -> DataFrame:
    """Inclusive running sums in the order of a unique integer ``index``.

    Three levels: a window inside blocks of 65,536 index values, one over block
    totals inside super-blocks, and one over super-block totals.  The last is the
    only global order and holds one row per 2**32 index values.
    """
    blocked = table.withColumn("_block", F.expr(f"`{index}` div {BLOCK}"))
    in_block = Window.partitionBy("_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    in_super = Window.partitionBy("_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    of_supers = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    names = list(sums)

    rows = blocked.select("*", *[F.sum(c).over(in_block).alias(f"_run_{n}") for n, c in sums.items()])
    totals = (
        blocked.groupBy("_block")
        .agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
        .withColumn("_super", F.expr(f"_block div {BLOCK}"))
    )
    supers = totals.groupBy("_super").agg(*[F.sum(f"_sum_{n}").alias(f"_all_{n}") for n in names])
    supers = supers.select("_super", *[F.sum(f"_all_{n}").over(of_supers).alias(f"_base_{n}") for n in names])
    offsets = totals.select("*", *[F.sum(f"_sum_{n}").over(in_super).alias(f"_part_{n}") for n in names])

    def zero(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0))

    offsets = offsets.join(supers, "_super").select(
        "_block", *[(zero(f"_part_{n}") + zero(f"_base_{n}")).alias(f"_off_{n}") for n in names]
    )
    return rows.join(offsets, "_block").select(
        *table.columns, *[(F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in names]
    )


def index_blocks(table: DataFrame, index: str, *flags: str) -> DataFrame:
    """``_block, _at, _before`` (and ``_before_<flag>``): the index values of each block, sorted, and what stands in earlier blocks.

    ``index`` is unique, so a block is an array of at most INDEX_BLOCK entries (structs of ``at`` and the boolean ``flags``).  Rows are grouped, not
    windowed: only one row per block is ordered, within super-blocks, and the totals of the super-blocks are one small array.
    """
    entry = F.struct(F.col(index).alias("at"), *(F.col(f) for f in flags))
    blocks = table.groupBy(F.expr(f"cast(floor(`{index}` / {INDEX_BLOCK}) AS bigint)").alias("_block")).agg(F.array_sort(F.collect_list(entry)).alias("_at"))
    counts = {"": F.size("_at"), **{f"_{f}": F.expr(f"size(filter(_at, e -> e.`{f}`))") for f in flags}}
    sized = blocks.select("*", F.expr(f"cast(floor(_block / {BLOCK}) AS bigint)").alias("_super"), *(c.cast("bigint").alias(f"_n{n}") for n, c in counts.items()))
    per_row = {n: F.lit(1) if not n else F.coalesce(F.col(n[1:]).cast("int"), F.lit(0)) for n in counts}
    key = F.expr(f"cast(floor(floor(`{index}` / {INDEX_BLOCK}) / {BLOCK}) AS bigint)").alias("_super")
    supers = table.groupBy(key).agg(*(F.sum(c).alias(f"_n{n}") for n, c in per_row.items()))
    every = supers.agg(F.collect_list(F.struct("_super", *(f"_n{n}" for n in counts)))).scalar()
    inside = Window.partitionBy("_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.select("*", *(F.coalesce(F.sum(f"_n{n}").over(inside), F.lit(0)).alias(f"_in{n}") for n in counts), every.alias("_every"))

    def before(n: str) -> Column:
        earlier = F.filter("_every", lambda s: s["_super"] < F.col("_super"))
        return F.aggregate(earlier, F.lit(0).cast("bigint"), lambda total, s: total + s[f"_n{n}"]) + F.col(f"_in{n}")

    return summed.select("_block", "_at", *(before(n).alias(f"_before{n}") for n in counts))


def renumber(table: DataFrame, order: str = "row_idx", name: str = "note_idx", work_dir: str | None = None) -> DataFrame:
    """Close the gaps of a unique index: dense 0-based ``name`` in the order of ``order``.

    The order is found on the narrow index, by blocks (a stored table), and a row looks its block up: the other columns are neither windowed nor
    sorted, and with a block table of checked size not moved either.
    """
    spark = table.sparkSession
    path = work_dir or shared_dir(spark, "index")
    blocks = index_blocks(table.select(order), order)
    blocks.select("_block", "_at.at", "_before").write.mode("overwrite").parquet(path)
    blocks = spark.read.parquet(path)
    size = blocks.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    blocks = F.broadcast(blocks) if size <= MAX_BROADCAST_INDEX else blocks.hint("shuffle_hash")
    placed = table.withColumn("_block", F.expr(f"cast(floor(`{order}` / {INDEX_BLOCK}) AS bigint)")).join(blocks, "_block")
    dense = F.col("_before") + F.array_position("at", F.col(order)) - 1
    return placed.withColumn(name, dense.cast("bigint")).drop("_block", "at", "_before")


def first_rows(table: DataFrame, limit: int | None = None, index: str = "row_idx") -> DataFrame:
    """The first ``limit`` rows of the table in row order; all rows without a limit."""
    return table if limit is None else table.where(F.col(index) < limit)


def slice_rows(table: DataFrame, start: int, stop: int, index: str = "row_idx") -> DataFrame:
    return table.where((F.col(index) >= start) & (F.col(index) < stop))


def batch_number(batch_size: int = fixed.DEFAULT_BATCH_SIZE, index: str = "row_idx") -> Column:
    return F.expr(f"`{index}` div {_positive(batch_size)}")


def part_number(notes_per_part: int = fixed.DEFAULT_NOTES_PER_PART, index: str = "note_idx") -> Column:
    """1-based part of a dense index."""
    return F.expr(f"`{index}` div {_positive(notes_per_part)} + 1")


def part_name(base: str, part: Column) -> Column:
    return F.format_string(fixed.PART_NAME, F.lit(base), part)


def _positive(size: int) -> int:
    if int(size) <= 0:
        raise ValueError("size must be a positive number")
    return int(size)
