"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share a token budget by weight; a source takes its words at most ``epochs`` times, and what it cannot take is
shared again by weight. A schedule of equal slots walks the golden-ratio points through the cumulated targets, so
every stretch of the mix holds each source in its share. Slots are ranked per source, and the rank names the block
of that source's shuffled word stream which the slot takes. The last block of a source ends at its target.

Nulls: a null source is a source of its own (last in order); a null text has no words. Documents without words take
part with nothing taken. Repeated rows are separate documents. Shuffling is by a hash of the id, so reruns agree.
Running positions are summed in hash buckets of a source and over the buckets, so a source that holds a third of the
rows is dealt over as many tasks as it has buckets; only the list of sources itself, one row each, is ordered whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import attach, carrying, n_words, row_key, stored

#: x_n = frac(n * GOLDEN / 2^31): an odd multiplier near the golden section visits every point once in 2^31 slots.
GOLDEN, UNIT = 1327217885, 1 << 31
#: Unit interval cells in which slots look their source up.
CELLS = 4096
BLOCK = 1024
#: Documents of a source summed in one task.
PER_BUCKET = 5000
SLOTS_PER_CHUNK = 5000


def targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """Per source: n (documents), source_size, weight, target; input one row per source with n and source_size.

    Sources in code point order, null last, weigh ``weights``, repeating. With T = share * all words, the target is
    min(epochs * size, weight * level) at the one level where targets sum to T; as sources are capped in the order of
    cap / weight, the level follows from running sums.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    t = sizes.withColumn("weight", F.element_at(cycle, ((place - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(epochs))
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"total": F.sum("source_size").over(every) * float(share), "weights": F.sum("weight").over(every),
                       "caps_ahead": F.coalesce(F.sum("cap").over(ahead), F.lit(0.0)), "weights_ahead": F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))})
    left, of = F.col("total") - F.col("caps_ahead"), F.col("weights") - F.col("weights_ahead")
    # in this order, sources are capped up to the first whose share of what is left stays within its cap
    t = t.withColumn("open", F.col("weight") * left / of <= F.col("cap"))
    level = F.first(F.when(F.col("open"), F.struct(left.alias("left"), of.alias("of"))), True).over(
        Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("level", level).select(
        "source", "n", "source_size", "weight",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("weight") * F.col("level.left") / F.col("level.of")).alias("target"))


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of the id's MD5: the same order in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: int = 2, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Return (pieces, documents) for ``docs`` with doc_id, text and source.

    pieces: slot, source, doc_id, start (of the document in its source's stream), size, epoch, from_word, to_word; in
    slot order they are the mix. documents: every row's doc_id, source, start, size, source_size, target and quota
    (whole words its source gives).
    """
    more = [c for c in ("_row",) if c in docs.columns]
    slim = stored(docs.select("doc_id", "source", *more, n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("key")), "sizes")
    per = stored(targets(slim.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, share, epochs)
                 .withColumn("quota", F.floor("target").cast("long"))
                 .withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")), "targets")
    rows = attach(slim.withColumn("sid", F.xxhash64(F.col("source").isNull(), "source")).drop("source"), per.drop("weight"), "sid", "n") \
        .withColumn("bucket", F.floor(F.col("key") / F.ceil(F.lit(float(1 << 60)) / F.ceil(F.col("n") / F.lit(PER_BUCKET)))).cast("long"))
    buckets = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(rows.join(buckets, ["sid", "bucket"]).select(
        "doc_id", "source", *more, "sid", "size", "source_size", "target", "quota",
        (F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start")), "placed")

    # the unrolled stream of a source repeats its documents once an epoch; block b covers words b * block and on
    turns = placed.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")) \
        .withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).where("at < quota") \
        .withColumn("stop", F.least(F.col("at") + F.col("size"), "quota"))
    cut = turns.select("sid", "source", "doc_id", "start", "size", "epoch", "at", "stop", F.explode(F.sequence(
        F.floor(F.col("at") / block), F.floor((F.col("stop") - 1) / block))).alias("rank"))
    pieces = cut.join(schedule(per, block), ["sid", "rank"]).select(
        "slot", "source", "doc_id", "start", "size", "epoch",
        (F.greatest(F.col("at"), F.col("rank") * block) - F.col("at")).alias("from_word"),
        (F.least(F.col("stop"), (F.col("rank") + 1) * block) - F.col("at")).alias("to_word"))
    return pieces, placed.drop("sid")


def schedule(per: DataFrame, block: int) -> DataFrame:
    """(sid, rank, slot): the slot that takes block ``rank`` of a source; from per-source rows sid, target, quota."""
    spark = per.sparkSession
    per = per.withColumn("blocks", F.ceil(F.col("quota") / F.lit(block)).cast("long")).where("blocks > 0")
    n = per.agg(F.sum("blocks")).first()[0] or 0
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = per.withColumn("cum", F.sum("blocks").over(order)).withColumn("all", F.sum("blocks").over(every)) \
        .select("sid", "blocks", F.floor((F.col("cum") - F.col("blocks")) / F.col("all") * UNIT).alias("lo"), F.floor(F.col("cum") / F.col("all") * UNIT).alias("hi"))
    cells = edges.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / (UNIT // CELLS)), F.floor((F.col("hi") - 1) / (UNIT // CELLS)))).alias("cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), ((F.col("id") % UNIT) * GOLDEN % UNIT).alias("x")) \
        .withColumn("cell", F.floor(F.col("x") / (UNIT // CELLS)))
    owned = points.join(cells, "cell").where("x >= lo AND x < hi").select("slot", "sid", F.floor(F.col("slot") / SLOTS_PER_CHUNK).alias("chunk"))
    counts = owned.groupBy("sid", "chunk").agg(F.count("*").alias("k"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    ranked = owned.join(counts, ["sid", "chunk"]).select("sid", "slot", (F.col("base") + F.row_number().over(
        Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).alias("rank"))
    # discrepancy leaves a source a few slots short; those blocks follow at the end
    given = owned.groupBy("sid").agg(F.count("*").alias("given"))
    short = edges.join(given, "sid", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < blocks") \
        .select("sid", F.explode(F.sequence("given", F.col("blocks") - 1)).alias("rank"))
    tail = short.select("sid", "rank", (F.lit(n) + F.row_number().over(Window.orderBy("rank", "sid")) - 1).alias("slot"))
    return ranked.select("sid", "rank", "slot").unionByName(tail)


def taken(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` as doc_id, size, source_size, target, taken."""
    return _taken(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, **options) -> DataFrame:
    pieces, placed = mix(docs, **options)
    got = pieces.groupBy("source", "start", "doc_id", "size").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken")) \
        .withColumnsRenamed({"source": "s", "start": "p", "doc_id": "d", "size": "z"})
    hit = F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")) & (F.col("size") > 0)
    return placed.join(got, hit, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


@carrying("doc_id", "text", "source")
def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as often as the mix takes them, whole: a row is repeated taken / size times, rounded half up.

    Only the one document of a source at which its target ends can be rounded. Documents without words stay once. Rows
    that share an id are told apart by source and text; of rows that repeat all three, each has its own count.
    """
    cols = docs.columns
    marked = docs.withColumn("_row", row_key(F.col("text")))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    got = _taken(marked, **options).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("_row").alias("_key")) \
        .agg(F.sort_array(F.collect_list(times)).alias("_each"))
    got = stored(got, "times")

    def of(keys: DataFrame) -> DataFrame:
        return marked.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_from")) & (F.col("_row") == F.col("_key")))

    out = of(got.where("size(_each) = 1")).withColumn("_times", F.col("_each")[0])
    several = got.where("size(_each) > 1")
    if not several.isEmpty():
        nth = F.row_number().over(Window.partitionBy("_id", "_from", "_key").orderBy(*cols))
        out = out.unionByName(of(several).withColumn("_nth", nth).withColumn("_times", F.col("_each")[F.col("_nth") - 1]).drop("_nth"))
    return out.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).select(*cols)
