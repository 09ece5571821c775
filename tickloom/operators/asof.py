"""As-of lookup: for each row, the nearest record of the same code before or after it.

Both sides are tagged and united, shuffled once by (code, calendar bucket) and scanned in time order. The few
records that reach into a bucket from its neighbours are added as carried records, one per (code, bucket), so a
code with very many rows is spread over its buckets and the work stays linear in both inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.operators.series import CODE, DT, bucket_of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: list[str],
    *,
    key: str = CODE,
    left_on: str = DT,
    right_on: str = DT,
    direction: str = "backward",
    allow_exact: bool = True,
    unit: str = "year",
    alike: bool = False,
) -> DataFrame:
    """Add ``values`` of the record with the largest ``right_on <= left_on`` (``forward``: smallest ``>=``).

    Rows without a record get NULLs. Records of one code and time are resolved by the greatest values; ``alike`` says that
    they all have the same, so that they need not be brought together first. Both directions scan with a frame that only
    grows, forward from the end of time: a frame that reaches to the end would be read again for each row.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    back = direction == "backward"

    # a single value is reduced bare: structs would be reduced by sorting all records
    bare = len(values) == 1
    records = right.where(F.col(right_on).isNotNull()).select(
        key,
        bucket_of(right_on, unit).alias("_bucket"),
        F.col(right_on).cast(left.schema[left_on].dataType).alias("_at"),
        (F.col(values[0]) if bare else F.struct(*values)).alias("_value"),
    )
    if not alike:
        records = records.groupBy(key, "_bucket", "_at").agg(F.max("_value").alias("_value"))
    rec = F.struct(F.col("_value").alias(values[0])) if bare else F.col("_value")
    rows = left.withColumns({"_bucket": bucket_of(left_on, unit), "_at": F.col(left_on)})

    # nearest record of an earlier (later) bucket, for every bucket that holds rows
    pick = F.max_by if back else F.min_by
    edges = records.groupBy(key, "_bucket").agg(pick("_value", "_at").alias("_value")).select(key, "_bucket", rec.alias("_edge"))
    buckets = rows.select(key, "_bucket").distinct().withColumn("_used", F.lit(True))
    united = edges.withColumn("_used", F.lit(False)).unionByName(buckets, allowMissingColumns=True)
    along = F.col("_bucket").asc_nulls_first() if back else F.col("_bucket").desc_nulls_first()
    passed = Window.partitionBy(key).orderBy(along).rangeBetween(Window.unboundedPreceding, -1)
    carried = united.withColumn("_rec", F.last("_edge", ignorenulls=True).over(passed)).where("_used")
    carried = carried.where(F.col("_rec").isNotNull()).select(key, "_bucket", "_rec")

    # equal times: a record must be seen before the row it serves, or after it when exact hits do not count
    record_rank = (0 if back else 2) if allow_exact else (2 if back else 0)
    tagged = (
        rows.withColumn("_rank", F.lit(1))
        .unionByName(records.select(key, "_bucket", "_at", rec.alias("_rec"), F.lit(record_rank).alias("_rank")), allowMissingColumns=True)
        .unionByName(carried.withColumn("_rank", F.lit(-1 if back else 3)), allowMissingColumns=True)
    )
    # carried records have no time: they are seen before all rows of the bucket
    seen = [F.col("_at").asc_nulls_first(), F.col("_rank").asc()] if back else [F.col("_at").desc_nulls_first(), F.col("_rank").desc()]
    scan = Window.partitionBy(key, "_bucket").orderBy(*seen).rowsBetween(Window.unboundedPreceding, -1)
    matched = tagged.withColumn("_found", F.last("_rec", ignorenulls=True).over(scan)).where(F.col("_rank") == 1)
    return matched.select(*left.columns, *[F.col("_found")[v].alias(v) for v in values])
