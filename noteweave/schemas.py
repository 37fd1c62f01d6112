"""Row shapes of the tables the jobs read and write."""

from pyspark.sql import types as T

BOOKMARK_CSV = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("time_added", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("row_idx", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("processed_at", T.TimestampType()),
    ]
)

# One <note> element as the XML reader sees it; column names are element names.
ENEX_NOTE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("updated", T.StringType()),
        T.StructField("tag", T.ArrayType(T.StringType())),
        T.StructField(
            "note-attributes",
            T.StructType(
                [
                    T.StructField("author", T.StringType()),
                    T.StructField("source", T.StringType()),
                    T.StructField("source-url", T.StringType()),
                ]
            ),
        ),
    ]
)
