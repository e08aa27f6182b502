"""As-of join: each row of one side with the nearest row of its key at or before (or after) its time on the other.

Both sides stand in one table, dealt by key and bucket of time, so that a key with very many rows is many groups. Within a
bucket the last row of the other side is carried along in order of time; the last row of each bucket is carried on to the
buckets after it, of which a key has no more than BUCKETS. Buckets hold about as many rows each: they are cut by a histogram
of all times of FINE bins, the only thing that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a bucket holds about, buckets at most, and bins of the histogram of times.
BUCKET_ROWS, BUCKETS, FINE = 1 << 20, 4096, 1 << 16
#: Whether the other side's time lies before, and whether equal times match.
OPS = {">=": (True, True), ">": (True, False), "<=": (False, True), "<": (False, False)}


def _number(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c) if isinstance(kind, T.DateType) else c


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[str], op: str = ">=", how: str = "inner", bucket_rows: int = BUCKET_ROWS, suffix: str = "_right") -> DataFrame:
    """Rows of left with the columns of their match in right: of the rows with equal `by` and `left_time op right_time` the one
    nearest in time; of several at that time the one whose columns are the largest, as a struct in their order.

    how: inner, or left to keep rows without a match. Columns of right but `by` follow, with the suffix where their name is
    taken. Null keys and null times match nothing; repeated rows of left stay; empty sides are no special case.
    """
    before, equal = OPS[op]
    sign = 1 if before else -1
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c not in by}
    rows = right.select(*by, F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("_r"), (sign * _number(F.col(right_time), right.schema[right_time].dataType)).alias("_t"))
    real = [F.col(c).isNotNull() for c in [*by, "_t"]]
    for c in real:
        rows = rows.filter(c)
    own = left.select(*by, F.struct(*left.columns).alias("_l"), (sign * _number(F.col(left_time), left.schema[left_time].dataType)).alias("_t"))
    wide = own.schema["_t"].dataType if own.schema["_t"].dataType == rows.schema["_t"].dataType else T.DoubleType()
    own, rows = own.withColumn("_t", F.col("_t").cast(wide)), rows.withColumn("_t", F.col("_t").cast(wide))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    # at one time rows of the other side come first if equal times match, else last
    both = own.select(*by, "_t", F.lit(1 if equal else 0).alias("_s"), "_l", none(rows, "_r")).unionByName(rows.select(*by, "_t", F.lit(0 if equal else 1).alias("_s"), none(own, "_l"), "_r"))
    both = _bucketed(both, bucket_rows)
    key = [*by, "_b"]
    order = Window.partitionBy(*key).orderBy("_t", "_s", F.col("_r").asc_nulls_first())
    carried = both.withColumn("_m", F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_l").isNotNull())
    lasts = both.filter(F.col("_r").isNotNull()).groupBy(*key).agg(F.max(F.struct("_t", "_r")).alias("_x"))
    # a row for each key and bucket: what the buckets before it leave
    past = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.select(*key).distinct().join(lasts, key, "left").withColumn("_p", F.last("_x", ignorenulls=True).over(past)).select(*key, F.col("_p._r").alias("_p"))
    # null keys are groups of their own on the left and have no rows to carry
    found = carried.join(starts.filter("_p IS NOT NULL"), key, "left").select("_l", F.coalesce("_m", "_p").alias("_m"))
    if how == "inner":
        found = found.filter("_m IS NOT NULL")
    return found.select("_l.*", *[F.col("_m")[n].alias(n) for n in names.values()])


def _bucketed(both: DataFrame, bucket_rows: int) -> DataFrame:
    """The rows with _b, the number of their bucket of time; null times fall in bucket 0."""
    x = F.col("_t").cast("double")
    low, high = both.agg(F.min(x), F.max(x)).first()
    if low is None or low == high:
        return both.withColumn("_b", F.lit(0))
    bin_ = F.when(x.isNotNull(), F.least(F.lit(FINE - 1), F.floor((x - low) / ((high - low) / FINE)))).cast("int")
    counts = both.groupBy(bin_.alias("_f")).agg(F.count("*").alias("n")).filter("_f IS NOT NULL")
    total = F.sum("n").over(Window.partitionBy())  # FINE rows at most
    upto = F.sum("n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1))
    size = F.greatest(F.lit(bucket_rows), F.ceil(total / BUCKETS))
    buckets = counts.select("_f", F.floor(F.coalesce(upto, F.lit(0)) / size).cast("int").alias("_b"))
    return both.withColumn("_f", bin_).join(F.broadcast(buckets), "_f", "left").drop("_f").withColumn("_b", F.coalesce("_b", F.lit(0)))
