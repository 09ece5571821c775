"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, chat, divergence, exact_dedup, fim, jaccard_join, mixing, neighbours, quality, secret_scan, toxicity, url_filter, wrapper
from tickloom.llm.common import table
from tickloom.llm.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]

#: White space, deleted or splitting words, as SQL patterns.
SQL_WORD = r"[^\x20\x09-\x0D]+"

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights,
        coalesce(sum(cap) OVER a, 0)::DOUBLE AS caps_ahead, coalesce(sum(weight) OVER a, 0)::DOUBLE AS weights_ahead
      FROM w WINDOW a AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT total - caps_ahead AS rest, weights - weights_ahead AS of FROM r WHERE weight * (total - caps_ahead) / (weights - weights_ahead) <= cap
      ORDER BY cap / weight, encode(source) NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l.rest IS NULL THEN cap ELSE least(cap, weight * l.rest / l.of) END AS target FROM r LEFT JOIN l ON TRUE),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS quota,
        (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""


@query("op1_mix_sources", MIX_SQL + """
SELECT doc_id, size, source_size, target,
  (greatest(0, least(start + size, quota) - start) + greatest(0, least(start + size + source_size, quota) - start - source_size))::BIGINT AS taken
FROM p""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, epochs=2)


@query("op7_exact_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def own_bpe(spark: SparkSession, path: str | None = None):
    """The byte-level vocabulary at ``path``, by default the installed 50k one, as a broadcast ``Bpe``."""
    import public_tokenizers

    return spark.sparkContext.broadcast(bpe.Bpe(bpe.read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN))


def digests(docs: DataFrame, own) -> DataFrame:
    done = bpe.round_trip(docs.select("doc_id", "text"), own)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), own_bpe(spark))


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), jaccard_join.Join(words=3, num=9, den=10))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    words = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", words), (-1, 1, "assistant", words)], "conv_id long, turn long, role string, text string")


#: Escaped control strings add one character each; a backslash run before the rest of a control string counts alike.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role || chr(10) || text || chr(10) AS said, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  length(role) + length(text) + 23
  + len(regexp_extract_all(text, '<\\*(\|(turn|text|end|endoftext|im_start|im_end)\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])'))
  + len(regexp_extract_all(role, '<\\*(\|(turn|text|end|endoftext|im_start|im_end)\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(INST\]|/INST\])')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op2_chat_format", CHAT_SQL)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        vocabulary = f.read()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe_conversation(spark))
    return chat.read_back(chat.format_conversations(rows, vocabulary)).drop("n_tokens", "n_loss_tokens")


#: (verdict, host, path) of the explicit URL rules.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, URL_RULES, url_filter.mine(pages, table(spark, sf_dir, "labels")))


@query("op10_cross_polytope")
def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op3_wrapper_induction")
def op3_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


@query("op13_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


@query("op12_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM (SELECT k, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 10),
l AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS in_lang, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total
  FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT f.*, 1 + 1000000000::HUGEINT * (f.n + 2) // (f.total + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (f.in_lang + 2) // (l.total + 2 * l.v) AS q FROM f JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM u
QUALIFY part = 'pair' OR rank <= 10""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=10, top=10)


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    place = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    every = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind")))),
                        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(kind) for kind in ("assign", "access", "hex")), F.sha2(line(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        line(every).alias("spans"), "n_values", "n_strong", F.size("added").cast("long").alias("n_guess"))
