"""Source divergence audit: how far the word use of a language's sources lies apart, and which words set a source off.

Rows of a language's count matrix are its sources, columns its kept terms, cells the counts. The matrix is held as a
K²-tree: squares of ``SIDE`` rows by ``SIDE`` columns, each a tree whose nodes have K by K children and stop where
nothing but zeros lie below. Two bands of rows are walked jointly, the same columns of both at a time. Where both nodes
are zeros, every pair of their rows differs by the same amount per column, so the square is priced at its width; where a
walk reaches nonzero leaves, their cells are compared for all pairs of rows at once.

Spark deals (language, band, band, run of squares) to tasks. A task holds one square of each band, the rows' smoothed
frequency of an unseen term and the sums of ``SIDE`` times ``SIDE`` pairs, whatever the size of a language or a source.
Counting pre-aggregates in the task that reads a text, so a hot source or a frequent word is shuffled as a few sums.

Frequencies are whole billionths, and products that could pass 64 bits are decimals: sums come out alike however the rows
are dealt.

Odd rows: null texts, languages and sources count as empty strings. A text without terms still makes its group occur.
Languages that keep no term have pairs of value 0 and no terms. Rows that repeat, also with one id, count each time: a
row is a document. Equal values rank by the UTF-8 order of the item. Very long texts are read in pieces that end between
terms. Further columns are not read, so they may have any name. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import attach, slices, stored, term_lists

#: Children of a node per axis, columns and rows of a leaf, of a square; squares of a run that one task sums up.
K, LEAF, SIDE, RUN = 4, 16, 256, 64
#: Terms of a language that are numbered in one task, at most about so many.
NUMBERED = 4096
#: Distinct (group, term) sums a counting task holds before it passes them on.
HELD = 250_000


def _counts(batches):
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def passed_on():
        sizes = [len(seen) + 1 for seen, _ in held.values()]
        each = lambda names: pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        terms = [t for seen, _ in held.values() for t in (b"", *seen)]
        n = [x for seen, _ in held.values() for x in (0, *seen.values())]
        docs = [x for seen, docs in held.values() for x in (0, *map(docs.__getitem__, seen))]
        columns = [each([g[0] for g in held]), each([g[1] for g in held]), pa.array(terms, pa.binary()).cast(pa.string(), safe=False), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for part in slices(batches, 2):
        for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
            seen, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, here = len(seen), set()
            for terms in term_lists(text or b""):
                seen.update(terms)
                new = set(terms) - here
                docs.update(new)
                here |= new
            size += len(seen) - before
            if size >= HELD:
                yield passed_on()
                held, size = {}, 0
    if held:
        yield passed_on()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term and documents that hold it. Each group that occurs also has
    a row of the empty term, with zeros."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(blank("lang"), blank("source"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(df: DataFrame, key: str, order: list[str | Column], item: str, out: str) -> DataFrame:
    """Add ``out``: numbers from 0 without gaps per ``key``. Rows go to buckets by a digest of ``item``, are numbered in
    ``order`` within them, and start where the buckets before end; the buckets grow in number, not in size."""
    df = stored(df.withColumn("_bucket", F.pmod(F.xxhash64(item), F.lit(df.count() // NUMBERED + 1)).cast("int")), "number")
    ahead = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(key, "_bucket").agg(F.count("*").alias("_size")).select(key, "_bucket", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    return df.join(starts, [key, "_bucket"]).withColumn(out, F.col("_start") + place - 1).drop("_bucket", "_start")


def _frequency(n: Column | str) -> Column:
    """Smoothed frequency in billionths: n of total occurrences, of width different terms."""
    n = F.col(n) if isinstance(n, str) else n
    weighed = F.lit(10**9).cast("decimal(10,0)") * (n.cast("decimal(18,0)") + F.lit(2).cast("decimal(1,0)"))
    of = F.col("total").cast("decimal(18,0)") + F.col("width").cast("decimal(18,0)") * F.lit(2).cast("decimal(1,0)")
    return F.lit(1).cast("long") + F.call_function("div", weighed, of)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Matrix:
    """Kept terms and groups of all languages, as stored tables.

    ``groups`` has (lang, source, total, width, row, unseen), ``cells`` has (lang, source, row, col, term, n, p, q) for
    counts above 0; p and q are the frequencies in the group and in the language, ``unseen`` that of count 0.
    """

    def __init__(self, docs: DataFrame, least: int = 10):
        counted = stored(counts(docs), "counts")
        real = counted.where("term <> ''")
        terms = real.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"), F.count("*").alias("held"), F.min("source").alias("first"))
        # terms of few groups stand side by side, those of the same group together: zeros gather in squares
        terms = stored(numbered(terms.where(F.col("docs") >= least), "lang", [F.desc("held"), "first", "term"], "term", "col"), "terms")
        langs = terms.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("width"))
        cells = stored(real.select("lang", "source", "term", "n").join(terms.select("lang", "term", "in_lang", "col"), ["lang", "term"]), "cells")
        sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
        groups = counted.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left") \
            .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "cells", "width", "lang_total")))
        groups = numbered(groups, "lang", ["source"], "source", "row")
        self.groups = stored(groups.withColumn("unseen", F.when(F.col("width") > 0, _frequency(F.lit(0))).otherwise(1)), "groups")
        about = self.groups.select(F.struct("lang", "source").alias("group"), "cells", F.col("total").alias("g_total"), "lang_total", "width", "row")
        known = attach(cells.withColumn("group", F.struct("lang", "source")), about, "group", "cells")
        p = _frequency("n")
        self.cells = stored(known.withColumn("total", F.col("g_total")).withColumn("p", p).withColumn("total", F.col("lang_total"))
                            .withColumn("q", _frequency("in_lang")).select("lang", "source", "row", "col", "term", "n", "p", "q"), "matrix")


class Square:
    """A K²-tree of at most ``SIDE`` rows and columns: which nodes hold nonzero cells, and the cells' frequencies."""

    def __init__(self, unseen: np.ndarray, slots=(), cols=(), p=()):
        self.unseen = unseen
        self.p = np.repeat(unseen[:, None], SIDE, axis=1)
        self.p[slots, cols] = p
        at = np.zeros((SIDE, SIDE), bool)
        at[slots, cols] = True
        self.nodes, size = {}, LEAF
        at = at.reshape(SIDE // LEAF, LEAF, SIDE // LEAF, LEAF).any(axis=(1, 3))
        while True:
            self.nodes[size] = at
            if size >= SIDE:
                break
            size, n = size * K, len(at) // K
            at = at.reshape(n, K, n, K).any(axis=(1, 3))


def walk(a: Square, b: Square, width: int, sums: np.ndarray, both: bool, visit=None) -> None:
    """Add to ``sums`` [row of a, row of b] what the first ``width`` columns hold. ``both``: a and b are one band, so only
    nodes on and above the diagonal are walked. ``visit`` is told each (size, row, row, column, leaf or zero)."""
    unseen = np.square(a.unseen[:, None] - b.unseen[None, :]) // (a.unseen[:, None] + b.unseen[None, :])

    def joint(size: int, i: int, j: int, c: int) -> None:
        if c * size >= width or i * size >= len(a.unseen) or j * size >= len(b.unseen) or (both and i > j):
            return
        rows, others, cols = slice(i * size, (i + 1) * size), slice(j * size, (j + 1) * size), slice(c * size, min((c + 1) * size, width))
        zeros = not a.nodes[size][i, c] and not b.nodes[size][j, c]
        if zeros:
            sums[rows, others] += unseen[rows, others] * (cols.stop - cols.start)
        elif size == LEAF:
            p, q = a.p[rows, None, cols], b.p[None, others, cols]
            sums[rows, others] += (np.square(p - q) // (p + q)).sum(axis=2)
        else:
            for x in range(K):
                for y in range(K):
                    for z in range(K):
                        joint(size // K, i * K + x, j * K + y, c * K + z)
            return
        if visit is not None:
            visit(size, i, j, c, not zeros)

    joint(SIDE, 0, 0, 0)


def _walked(batches):
    """Rows come by (lang, i, j, run, square): first, as square -1, the rows of both bands with their unseen frequency,
    then the cells of one square after the other."""
    key = square = None
    state: dict = {}

    def close_square() -> None:
        if square is None or square < 0:
            return
        parts = [np.array([x[1:] for x in state["cells"] if x[0] == side], np.int64).reshape(-1, 3).T for side in (0, 1)]
        a = Square(state["unseen"][0], *parts[0])
        b = a if state["same"] else Square(state["unseen"][1], *parts[1])
        walk(a, b, min(SIDE, state["width"] - square * SIDE), state["sums"], state["same"])
        state["at"] = square + 1

    def zeros_until(end: int) -> None:
        """Squares that no row of either band has a cell in."""
        columns = max(0, min(end * SIDE, state["width"]) - state["at"] * SIDE)
        p, q = state["unseen"][0][:, None], state["unseen"][1][None, :]
        state["sums"] += np.square(p - q) // (p + q) * columns
        state["at"] = end

    def open_bands() -> None:
        sides = [sorted(x for x in state["rows"] if x[0] == side) for side in (0, 1)]
        if state["same"]:
            sides[1] = sides[0]
        state["names"] = [[x[3] for x in s] for s in sides]
        state["unseen"] = [np.array([x[2] for x in s], np.int64) for s in sides]
        state["sums"] = np.zeros((len(sides[0]), len(sides[1])), np.int64)

    def closed():
        if square == -1:
            open_bands()
        else:
            close_square()
        zeros_until((key[3] + 1) * RUN)
        a, b = state["names"]
        at = [(x, y) for x in range(len(a)) for y in range(x + 1 if state["same"] else 0, len(b))]
        one, other = [a[x] for x, _ in at], [b[y] for _, y in at]
        value = [int(state["sums"][x, y]) for x, y in at]
        columns = [pa.array([key[0]] * (2 * len(at)), pa.string()), pa.array(one + other, pa.string()), pa.array(other + one, pa.string()), pa.array(value * 2, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])

    for batch in batches:
        for lang, i, j, run, sq, side, slot, col, p, source, width in zip(*(c.to_pylist() for c in batch.columns)):
            if (lang, i, j, run) != key:
                if key is not None:
                    yield closed()
                key, square = (lang, i, j, run), -1
                state = {"rows": [], "cells": [], "same": i == j, "width": width, "at": run * RUN}
            if sq < 0:
                state["rows"].append((side, slot, p, source))
                continue
            if sq != square:
                if square < 0:
                    open_bands()
                else:
                    close_square()
                zeros_until(sq)
                state["cells"], square = [], sq
            state["cells"].append((side, slot, col, p))
    if key is not None:
        yield closed()


def pair_values(matrix: Matrix) -> DataFrame:
    """(lang, source, item, value) for each source and each other source of its language."""
    def to_pairs(rows: DataFrame) -> DataFrame:
        """A copy for each band that the row's band is walked with."""
        band = F.floor(F.col("row") / SIDE).cast("int")
        met = rows.withColumn("band", band).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
        return met.select("lang", F.least("band", "other").alias("i"), F.greatest("band", "other").alias("j"), "run", "square",
                          F.when(F.col("band") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("row") % SIDE).cast("int").alias("slot"),
                          "col", "p", "source", "width")

    groups = matrix.groups
    langs = stored(groups.groupBy("lang").agg((F.floor(F.max("row") / SIDE) + 1).cast("int").alias("bands"), F.sum("cells").alias("size"), F.max("width").alias("width")), "langs")
    last = F.floor(F.greatest(F.col("width") - 1, F.lit(0)) / (SIDE * RUN))
    heads = groups.drop("width").join(langs, "lang").withColumn("run", F.explode(F.sequence(F.lit(0), last))) \
        .withColumns({"square": F.lit(-1), "col": F.lit(-1), "p": F.col("unseen")})
    square = F.floor(F.col("col") / SIDE)
    cells = attach(matrix.cells.select("lang", "row", "col", "p"), langs, "lang", "size").withColumns(
        {"run": F.floor(square / RUN), "square": square.cast("int"), "col": (F.col("col") % SIDE).cast("int"), "source": F.lit(None).cast("string")})
    rows = to_pairs(heads).unionByName(to_pairs(cells))
    dealt = rows.repartition("lang", "i", "j", "run").sortWithinPartitions("lang", "i", "j", "run", "square")
    walked = dealt.mapInArrow(_walked, "lang string, source string, item string, value long")
    return walked.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(matrix: Matrix) -> DataFrame:
    """(lang, source, item, value) for each term that a source uses more often than its language does."""
    p, q = F.col("p"), F.col("q")
    return matrix.cells.where(p > q).select("lang", "source", F.col("term").alias("item"), _apart(p, q).alias("value"))


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` with every other source of the language, part ``term`` with
    the ``top`` terms that set the source off. Terms count if at least ``least`` documents of the language hold them."""
    matrix = Matrix(docs, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_values(matrix), "pair").unionByName(ranked(term_values(matrix), "term").where(F.col("rank") <= top))
