"""Document fingerprints by threshold-scaled sketches, in DataFrame operations only.

A sketch retains every hash of a word shingle that falls below a fixed fraction of the hash space.  So the
sketch of a union is the union of sketches, and shares of common hashes estimate resemblance as
well as containment, however unequal the documents are.  A text whose shingles all fall above keeps its smallest one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: One of 2**BITS hashes is retained.
BITS = 2
#: Rows of one bucket of the document order, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 500, 20_000
#: Step of the coarse level of the bucket search.
STRIDE = 128


def with_sketch(df: DataFrame, text: str, out: str, *, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Adds ``out``, the sorted retained 64-bit hashes of the whole text; empty without words.

    Words are runs without white space.  A text of fewer words than a shingle has one shingle, the whole sequence.
    """
    w, s = f"{out}_words", f"{out}_shingles"
    parts = ", ".join(f"get({w}, i + {n})" for n in range(words))
    hashed = df.withColumn(w, F.expr(f"transform(filter(split({text}, '\\\\s+'), x -> x <> ''), x -> xxhash64(x))"))
    hashed = hashed.withColumn(
        s, F.expr(f"CASE WHEN size({w}) > 0 THEN transform(sequence(0, greatest(size({w}) - {words}, 0)), i -> xxhash64({parts})) ELSE array() END")
    )
    below = (1 << (64 - bits)) - 1
    hashed = hashed.withColumn(f"{out}_low", F.expr(f"array_sort(array_distinct(filter({s}, h -> h >= 0 AND h <= {below})))"))
    kept = F.expr(f"CASE WHEN size({out}_low) > 0 OR size({s}) = 0 THEN {out}_low ELSE array(array_min({s})) END")
    return hashed.withColumn(out, kept).drop(w, s, f"{out}_low")


def resemblance(a: Column, b: Column) -> Column:
    """Share of the hashes of either that both have; 1 for two empty sketches."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Share of the hashes of ``a`` that ``b`` has; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def merged(sketches: Column) -> Column:
    """Aggregate: the sketch of the union of texts, shingles across their borders aside."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketches))))


def fingerprint_text(sketch: Column) -> Column:
    """Sixteen hex digits per hash, rising."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(df: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row behind, ascending by (key, tie), nulls last; the first follows the last.

    Bucket bounds are keys of the table, found from quantiles, so every bucket holds its bound, and the row behind a
    bucket's last is the one at the next bound: a copy of it closes the bucket.  Rows move once.
    """
    spark = df.sparkSession
    rows, nulls = df.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    buckets = max(1, min(MOST_BUCKETS, max(rows // BUCKET_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    fractions = F.array(*(F.lit(n / buckets) for n in range(buckets)))
    found = df.agg(F.percentile_approx(key, fractions, 10 * max(buckets, 1000)), F.min(key)).first()
    bounds = sorted({*(found[0] or []), *([found[1]] if found[1] is not None else [])})
    literal = lambda values: F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<long>")
    at = F.col(key)
    coarse = F.size(F.filter(literal(bounds[::STRIDE]), lambda b: b <= at))
    fine = F.size(F.filter(F.slice(literal(bounds), F.greatest((coarse - 1) * STRIDE + 1, F.lit(1)), STRIDE), lambda b: b <= at))
    last = len(bounds)  # the bucket of null keys, behind all others
    total = last + (1 if nulls else 0)
    own = F.when(at.isNull(), last).otherwise(F.greatest((coarse - 1) * STRIDE + fine - 1, F.lit(0))) if bounds else F.lit(last)
    marked = df.withColumn("bucket", own.cast("int"))
    opens = at.isNull() if not bounds else at.isNull() | F.array_contains(literal(bounds[:1]), at) | reduce(
        lambda a, b: a | b, [at.isin(bounds[n : n + 1000]) for n in range(0, len(bounds), 1000)]
    )
    copy = F.struct(F.pmod(F.col("bucket") + total - 1, F.lit(max(total, 1))).cast("int").alias("bucket"), F.lit(True).alias("copy"))
    real = F.struct(F.col("bucket"), F.lit(False).alias("copy"))
    dealt = marked.withColumn("place", F.explode(F.when(opens, F.array(real, copy)).otherwise(F.array(real)))).drop("bucket")
    order = Window.partitionBy("place.bucket").orderBy("place.copy", F.col(key).asc_nulls_last(), tie)
    following = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return dealt.withColumns(following).where(~F.col("place.copy")).drop("place")


def fingerprints_with_edits(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Sketches of every text, of its edited text and of the next document's, with their likeness.

    The edited text ends in the beginning of the next document (ascending doc, nulls last, then text) instead of
    its last quarter of code points.  A null text counts as empty; repeated rows follow one another; a single row follows itself.  An
    empty table gives no rows.  Other columns are not read.
    """
    base = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    followed = with_next(with_sketch(base, "text", "sketch", words=words, bits=bits), "doc", "text", ["text", "sketch"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    edits = followed.select("doc", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return with_sketch(edits, "edited", "edited_sketch", words=words, bits=bits).withColumnRenamed("doc", doc)
