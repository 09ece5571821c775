"""Fill-in-middle against a per-text version, and its way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import fim

SCHEMA = "doc_id long, text string, n long, form string, output string, h1 int"


def by_hand(doc_id, text, spec):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{spec.salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in spec.sentinels) or h3 % 100 >= spec.rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spec.spm:
        return len(units), "spm", len(pre), len(mid), spec.suffix + suf + spec.prefix + pre + spec.middle + mid
    return len(units), "psm", len(pre), len(mid), spec.prefix + pre + spec.suffix + suf + spec.middle + mid


def rows():
    rnd = random.Random(5)
    odd = ["", None, "\n", "\n\n", "a", "a\n", "\na", "x <P> y\nz", "<", "a<\n<S\nP>\n>", "é\r\n🤖 \x85\n\x00b\n", "one\n" * 50_000, "w" * 3_000_000]
    texts = odd + ["".join(rnd.choice("ab<>PSM\n\n") for _ in range(rnd.randrange(60))) for _ in range(400)]
    return [(i if i % 17 else None, t, -1, "f", "o", 3) for i, t in enumerate(texts)] + [(2, "again\nagain", 0, None, None, None)] * 3


@pytest.mark.parametrize("spec", [fim.Spec(), fim.Spec(salt="x", rate=60, spm=10, prefix="[(pre)]", suffix="{suf.}", middle="|mid+!")])
def test_rows_against_single_texts(spark, spec):
    given = rows()
    got = fim.transform(spark.createDataFrame(given, SCHEMA).repartition(5), spec)
    back = got.withColumn("text", fim.restored(F.col("output"), F.col("form"), spec)).collect()
    want = sorted(map(repr, ((r[0], *by_hand(r[0], r[1], spec), r[1] or "") for r in given)))
    assert sorted(repr(tuple(r)) for r in back) == want
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_empty_table_and_batch_borders(spark, monkeypatch):
    df = spark.createDataFrame(rows(), SCHEMA)
    assert fim.transform(df.limit(0)).count() == 0
    monkeypatch.setattr(fim, "LIMIT", 100)  # every text its own batch, or nearly
    assert fim.transform(df).select(F.sum("n")).first()[0] == sum(len(re.findall(r"[^\n]*\n|[^\n]+", r[1] or "")) for r in rows())


@pytest.mark.parametrize("bad", [dict(prefix=""), dict(prefix="<P", suffix="P>"), dict(prefix="aba"), dict(prefix="<S>")])
def test_sentinels_that_run_into_each_other(bad):
    with pytest.raises(ValueError):
        fim.Spec(**bad)
