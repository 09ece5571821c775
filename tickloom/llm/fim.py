"""Fill-in-middle transformation: a text's units are cut into prefix, middle and suffix and written in another order.

Each Arrow batch goes through one ``pyarrow.compute`` pipeline, without a Python step per text or unit: texts are split
into list arrays of units, flattened with the index of their text, numbered within it, filtered by the role that their
number gives them, rebuilt into one list per text and role, and joined with the sentinels.

A unit is a line with its line feed; the last one may lack it. Where a text is cut is drawn from a digest of the salt
and the id, so reruns agree and no state is kept.

Odd rows: a null text counts as empty, a null id as an id without digits. Empty texts, texts that hold a sentinel and
texts that the rate leaves out stay plain. Rows that repeat are transformed alike, one row each. Only id and text are
read, so further columns may have any name. A text is one value; batches are cut by bytes, so a task holds a few copies
of the longest text or of ``LIMIT`` bytes, whichever is more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices

#: Bytes of text that one batch of the pipeline holds, unless a single text is longer.
LIMIT = 1 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Spec:
    """``rate`` percent of the texts are transformed, ``spm`` percent of these put the suffix first."""

    salt: str = "7"
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        for i, a in enumerate(self.sentinels):
            for j, b in enumerate(self.sentinels):
                if not a or (i != j and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                    raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart where they touch a text")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _mod(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def transformed(ids: pa.Array, text: pa.Array, draws: list[pa.Array], spec: Spec) -> pa.RecordBatch:
    """One batch: ``draws`` are four unsigned 32-bit numbers a row, as int64."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    split = pc.split_pattern(text, "\n")
    # units with the index of their text, their ordinal in it, and their line feed
    parent, piece = pc.list_parent_indices(split), pc.list_flatten(split)
    sizes = pc.list_value_length(split).cast(pa.int64())
    ends = pc.cumulative_sum(sizes)
    ordinal = pc.subtract(pa.array(np.arange(len(piece))), pc.take(pc.subtract(ends, sizes), parent))
    last = pc.equal(ordinal, pc.subtract(pc.take(sizes, parent), 1))
    feed = pc.if_else(last, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    unit = pc.binary_join_element_wise(piece, feed, pa.scalar("", pa.large_string()))
    real = pc.greater(pc.binary_length(unit), 0)  # what follows a text's last line feed is no unit if empty
    unit, parent, ordinal = unit.filter(real), parent.filter(real), ordinal.filter(real)
    empty = pc.equal(pc.binary_length(text), 0)
    n = pc.subtract(sizes, pc.or_(empty, pc.ends_with(text, "\n")).cast(pa.int64()))

    cuts = [_mod(d, pc.add(n, 1)) for d in draws[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    after_low = pc.greater_equal(ordinal, pc.take(low, parent))
    after_high = pc.greater_equal(ordinal, pc.take(high, parent))

    def joined(role: pa.Array, count: pa.Array) -> pa.Array:
        """The units of one role, as one list per text, joined; a text has ``count`` of them."""
        offsets = pa.array(np.concatenate([[0], np.cumsum(count.to_numpy())]), pa.int64())
        lists = pa.LargeListArray.from_arrays(offsets, unit.filter(role))
        return pc.binary_join(lists, pa.scalar("", pa.large_string()))

    prefix = joined(pc.invert(after_low), low)
    middle = joined(pc.and_(after_low, pc.invert(after_high)), pc.subtract(high, low))
    suffix = joined(after_high, pc.subtract(n, high))

    marked = pc.match_substring_regex(text, "|".join(map(re.escape, spec.sentinels)))
    plain = pc.or_(pc.or_(empty, marked), pc.greater_equal(_mod(draws[2], 100), spec.rate))
    spm = pc.less(_mod(draws[3], 100), spec.spm)
    p, s, m, nothing = (pa.scalar(x, pa.large_string()) for x in (*spec.sentinels, ""))
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    unless_plain = lambda a: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(a).cast(pa.int64()))
    output = pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text))
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()), n, form.cast(pa.string()), unless_plain(prefix), unless_plain(middle), output.cast(pa.string())],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output) per row of ``docs``; form is plain, psm or spm.

    psm is prefix, suffix, middle, each behind its sentinel; spm has the suffix first; plain is the text as it was."""
    digest = F.sha2(F.concat(F.lit(f"{spec.salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches):
        for part in slices(batches, 1, LIMIT):
            yield transformed(part.column(0), part.column(1), [part.column(2 + i) for i in range(4)], spec)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, spec: Spec = Spec()) -> Column:
    """The text an output was made from. A plain output is the text itself, whatever it holds."""
    parts = F.split(output, "|".join(re.escape(s) for s in spec.sentinels))
    part = lambda i: F.element_at(parts, i)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)
