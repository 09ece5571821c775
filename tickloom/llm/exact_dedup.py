"""Exact duplicates by composable polynomial fingerprints.

A text is normalised (white space deleted) and read as a number in base 256, chunk by chunk, modulo a 128-bit prime:
the fingerprint of AB is fp(A) * 256^|B| + fp(B), so chunks of a huge text are hashed apart and combined. Texts
with equal fingerprints are then compared with one of their group, chunk by chunk; should two differ, they part.

Nulls count as empty texts, and all empty texts are equal. Of equal texts the row with most code points stays, then
the smallest id (a null id first), then any one of rows that agree in both. Only ids, fingerprints and lengths are
shuffled for all rows; texts move once, and only those whose fingerprint repeats.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WHITE_BYTES, attach, carrying, slices, stored

#: Largest prime below 2^128.
PRIME = 2**128 - 159
CHUNK = 1 << 16
#: Texts compared with one copy of their group's pivot.
PER_PIVOT = 64


def combine(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(fingerprint, length) of the concatenation of two byte strings, from theirs."""
    return (left[0] * pow(256, right[1], PRIME) + right[0]) % PRIME, left[1] + right[1]


def chunk_print(chunk: bytes) -> tuple[int, int]:
    return int.from_bytes(chunk, "big") % PRIME, len(chunk)


def fingerprint(data: bytes, chunk: int = CHUNK) -> tuple[int, int]:
    """(fingerprint, length) of ``data``; the same for every chunk size."""
    view, out = memoryview(data), (0, 0)
    for i in range(0, len(data), chunk):
        out = combine(out, chunk_print(view[i : i + chunk]))
    return out


def _norm(text: bytes | None) -> bytes:
    return (text or b"").translate(None, WHITE_BYTES)


def prints(docs: DataFrame, rest: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """Columns ``rest`` with n_chars, n_bytes, fp (fingerprint then length, 24 bytes) and text_sha256 of ``text``.

    With ``keep_text`` also the column text.
    """
    kept = [*rest, *(["text"] if keep_text else [])]
    df = docs.select(*rest, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))

    def run(batches):
        for b in slices(batches, "text"):
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            fps, shas, sizes = [], [], []
            for t in cols["text"].cast(pa.binary()):
                norm = _norm(t.as_py())
                h, n = fingerprint(norm)
                fps.append(h.to_bytes(16, "big") + n.to_bytes(8, "big"))
                shas.append(hashlib.sha256(norm).hexdigest())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays(
                [*(cols[c] for c in kept), cols["n_chars"], pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(shas)],
                names=[*kept, "n_chars", "n_bytes", "fp", "text_sha256"])

    schema = df.select(*kept, "n_chars", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("fp"), F.lit("").alias("text_sha256")).schema
    return df.mapInArrow(run, schema)


def _differing(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(fp, text_sha256) of texts that differ from their group's pivot although the fingerprints agree.

    ``repeated``: fp, pivot (struct n_chars, doc_id) and size of groups of two rows or more. Each group is dealt over
    size / PER_PIVOT parts; the pivot's text goes to each part once, ahead of the others, which stream past it.
    """
    texts = attach(prints(docs, keep_text=True), repeated, "fp", "size")
    parts = F.ceil(F.col("size") / F.lit(PER_PIVOT)).cast("int")
    is_pivot = (F.col("n_chars") == F.col("pivot.n_chars")) & F.col("doc_id").eqNullSafe(F.col("pivot.doc_id"))
    dealt = texts.select(
        "fp", "text", "text_sha256",
        F.explode(F.when(is_pivot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "n_chars").cast("long"), parts).cast("int")))).alias("part"),
        F.when(is_pivot, 0).otherwise(1).alias("after"))
    rows = dealt.repartition("fp", "part").sortWithinPartitions("fp", "part", "after").select("fp", "part", "text", "text_sha256")

    def run(batches):
        key, pivot = None, b""
        for b in slices(batches, 2):
            fps, sha = [], []
            for f, p, t, s in zip(*(b.column(i) for i in range(4))):
                f, p, t = f.as_py(), p.as_py(), _norm(t.cast(pa.binary()).as_py())
                if (f, p) != key:
                    key, pivot = (f, p), t
                elif not same(pivot, t):
                    fps.append(f)
                    sha.append(s.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(sha, pa.string())], names=["fp", "text_sha256"])

    return rows.mapInArrow(run, "fp binary, text_sha256 string").distinct()


def same(a: bytes, b: bytes, chunk: int = CHUNK) -> bool:
    """Chunkwise comparison that stops at the first difference."""
    if len(a) != len(b):
        return False
    x, y = memoryview(a), memoryview(b)
    return all(x[i : i + chunk] == y[i : i + chunk] for i in range(0, len(a), chunk))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, n_chars, text_sha256, keep_id, group_size, kept."""
    slim = stored(prints(docs), "prints")
    order = F.struct((-F.col("n_chars")).alias("less"), "doc_id")
    groups = slim.groupBy("fp").agg(F.count("*").alias("size"), F.min(order).alias("best"))
    repeated = stored(groups.where("size > 1").select("fp", "size", F.struct((-F.col("best.less")).alias("n_chars"), F.col("best.doc_id").alias("doc_id")).alias("pivot")), "repeated")
    differing = stored(_differing(docs, repeated), "differing")
    if differing.isEmpty():
        keyed = slim.withColumn("cls", F.col("fp"))
    else:  # fingerprints that met: the digest tells the texts of such a group apart
        keyed = slim.join(differing.select("fp").distinct().withColumn("met", F.lit(True)), "fp", "left") \
            .withColumn("cls", F.when(F.col("met"), F.concat("fp", F.col("text_sha256").cast("binary"))).otherwise(F.col("fp"))).drop("met")
    classes = stored(keyed.groupBy("cls").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
                     .select("cls", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars")), "classes")
    out = attach(keyed, classes, "cls", "group_size")
    chosen = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    # rows that repeat an id and its text: one of them stays
    one = F.row_number().over(Window.partitionBy("cls", "doc_id", "n_chars").orderBy("text_sha256"))
    picked = out.where(chosen).withColumn("kept", one == 1)
    return picked.unionByName(out.where(~chosen).withColumn("kept", F.lit(False))) \
        .select("doc_id", "fp", "n_chars", "text_sha256", "keep_id", "group_size", "kept")


@carrying("doc_id", "text", "source", "lang")
def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose equal stays elsewhere; all columns, one row of each group."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("n_chars").alias("_n"), F.col("text_sha256").alias("_sha"))
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]", "")
    marked = docs.withColumns({"_id2": F.col("doc_id"), "_n2": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "_sha2": F.sha2(norm.cast("binary"), 256)})
    hit = marked.join(kept, F.col("_id2").eqNullSafe(F.col("_id")) & (F.col("_n2") == F.col("_n")) & (F.col("_sha2") == F.col("_sha")), "left_semi")
    one = F.row_number().over(Window.partitionBy("_id2", "_n2", "_sha2").orderBy(F.coalesce("text", F.lit("")), *[c for c in ("source", "lang") if c in docs.columns]))
    return hit.withColumn("_one", one).where("_one = 1").select(*docs.columns)

