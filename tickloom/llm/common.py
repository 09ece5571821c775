"""Helpers the text operators share: reading, storing between steps, hot keys, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_dir

#: ASCII white space, as every contract of this package spells it: space and 0x09 to 0x0D.
WHITE = "\\x20\\x09-\\x0D"
WORD = f"[^{WHITE}]+"
WHITE_BYTES = b" \t\n\x0b\x0c\r"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark's setting to delete an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A key is hot from this share of all rows; so there are at most 1 / HOT_SHARE hot keys, whatever the data.
HOT_SHARE = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and later steps scan the result.

    The shuffle files of the write go with it, so steps do not pile theirs up; the session's setting stays as it was.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def carrying(*read: str):
    """For stages that keep rows of ``docs`` whole and read only the columns ``read``: the others go through as one struct,
    so no helper column of the stage can clash with them, whatever their names. The stage returns the columns it got."""
    def wrap(stage):
        @functools.wraps(stage)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            rest = [c for c in docs.columns if c not in read]
            if not rest:
                return stage(docs, *args, **kwargs)
            packed = docs.select(*[c for c in docs.columns if c in read], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_carried"))
            out = stage(packed, *args, **kwargs)
            return out.select(*[F.col("_carried").getField(c).alias(c) if c in rest else F.col(f"`{c}`") for c in docs.columns])

        return run

    return wrap


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def row_key(text: Column) -> Column:
    """Digest that, with the id, tells rows apart whose ids repeat or are null."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Join each row with the one row of its group, where a group may hold a third of all rows.

    ``groups`` has one row per ``key`` with its number of rows in ``size``; store it first, it is read three times.
    Groups above ``HOT_SHARE`` of all rows number at most 1 / HOT_SHARE, a bound that holds for any data, so their
    table is broadcast and their rows are dealt by a salt; the others are small and meet in an ordinary shuffle join.
    Rows without a group are dropped. Every row is read and shuffled once, at every size.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) > max(1, int(total * HOT_SHARE))
    got = [c for c in groups.columns if c != key]
    hot = groups.where(is_hot).select(key, F.struct(*got).alias("_hot"))
    # always 0, but no constant: as one, it would leave the join's keys, and hot rows would meet in one task again
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    cold = groups.where(~is_hot).select(key, zero.alias("_salt"), F.struct(*got).alias("_cold"))
    salted = rows.join(F.broadcast(hot), key, "left") \
        .withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(9973)).cast("int")))
    met = salted.join(cold.hint("merge"), [key, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_cold")).where("_got IS NOT NULL")
    return met.select(*rows.columns, *(F.col(f"_got.{c}").alias(c) for c in got))


def release() -> None:
    """Give freed memory back: Python workers outlive their task, and the next stage's stand beside them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library keeps it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: int | str, limit: int = 1 << 20):
    """Arrow batches cut where the texts of ``column`` exceed ``limit`` bytes, so a task's memory follows that, not the
    number of rows a batch happens to hold. A single longer text is a batch of its own."""
    for batch in batches:
        at = batch.schema.get_field_index(column) if isinstance(column, str) else column
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


#: ASCII letters in lower case and all bytes of other characters; every other byte parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_lists(text: bytes, piece: int = 1 << 20):
    """The terms of a text, runs of ASCII letters and other characters with A-Z in lower case: a list for each ``piece``
    bytes or, where a piece would end inside a term, a few more."""
    at = 0
    while at < len(text):
        end = at + piece
        while end < len(text) and TERM_BYTES[text[end]] != 32:
            end += 1
        yield text[at:end].translate(TERM_BYTES).split()
        at = end


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [start, start + len)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b): (node, component), component = smallest node.

    Alternating large-star and small-star steps; each writes its edges to the shared folder, so an executor's loss
    costs one step, and the number of steps grows with the logarithm of the component size. A node with very many
    neighbours is aggregated by its partial minima before the shuffle and attached through ``attach``.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("size")) \
            .withColumn("least", F.least("a", "least"))
        least = stored(least, tag)
        out = attach(both, least, "a", "size")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("least").alias("b")) \
                .unionByName(least.select("a", F.col("least").alias("b")))
        return out.where("a <> b").distinct()

    now = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    while not _is_forest(now):
        now = stored(star(stored(star(now, True), tag), False), tag)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _is_forest(pairs: DataFrame) -> bool:
    """Whether each node points to one root, that is, to a node that points nowhere."""
    a, n = pairs.select("a"), F.count("*")
    roles = a.withColumn("root", F.lit(False)).unionByName(pairs.select(F.col("b").alias("a"), F.lit(True).alias("root")).distinct())
    return roles.groupBy("a").agg(n.alias("n")).where("n > 1").isEmpty()
