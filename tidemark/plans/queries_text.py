"""Named queries: text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ngrams as ng
from ..operators import scoring
from . import views
from .fixture_sql import over
from .registry import query

TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]', 0)"


@query(
    "tokenize",
    f"""
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {TOKENS} AS t FROM documents)""",
)
def tokenize(spark, sf_dir):
    docs = views.texts(spark, sf_dir).select("doc_id", tx.tokenize("text").alias("t"))
    return docs.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.array_join("t", " ").alias("tokens"),
    )


@query(
    "token_counts",
    f"""
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY token""",
)
def token_counts(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    return (
        ng.explode_tokens(docs, "doc_id", "text")
        .groupBy("token", "doc_id")
        .agg(F.count("*").alias("c"))
        .groupBy("token")
        .agg(F.sum("c").alias("n"), F.count("*").alias("docs"))
    )


@query(
    "ngrams",
    f"""
SELECT doc_id, pos - 1 AS pos, array_to_string(t[pos:pos + 2], ' ') AS gram
FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS pos
      FROM (SELECT doc_id, {TOKENS} AS t FROM documents))""",
)
def ngrams(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    rows = ng.explode_ngrams(docs, "doc_id", "text", 3)
    return rows.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.array_join("gram", " ").alias("gram")
    )


@query(
    "split_sentences",
    r"""
SELECT doc_id, list_position(kept, s) IS NOT NULL AS kept, pos - 1 AS pos, s AS sentence
FROM (SELECT doc_id, kept, unnest(kept) AS s, unnest(range(1, len(kept) + 1)) AS pos
      FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'),
              lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '') AS kept
            FROM documents))""",
)
def split_sentences(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    rows = ng.explode_sentences(docs, "doc_id", "text")
    return rows.select(
        "doc_id", F.lit(True).alias("kept"), F.col("pos").cast("bigint").alias("pos"), "sentence"
    )


MCQ_SQL = r"""
SELECT item_id, task_type, reference, predicted,
  CASE WHEN coalesce(predicted = upper(trim(reference)), false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM (SELECT *, nullif(upper(regexp_extract(generation,
        '(?:^|[^\p{L}\p{N}_])([A-Da-d])(?:$|[^\p{L}\p{N}_])', 1)), '') AS predicted FROM mcq)"""


@query("mcq_regex_accuracy", over("mcq", MCQ_SQL))
def mcq_regex_accuracy(spark, sf_dir):
    return scoring.mcq_regex_accuracy(views.mcq(spark, sf_dir)).drop("generation")


@query(
    "mcq_regex_accuracy_by_task",
    over(
        "mcq",
        f"""
SELECT task_type, count(*) AS items, CAST(sum(score) AS BIGINT) AS hits, round(avg(score), 6) AS accuracy
FROM ({MCQ_SQL}) GROUP BY task_type""",
    ),
)
def mcq_regex_accuracy_by_task(spark, sf_dir):
    scored = scoring.mcq_regex_accuracy(views.mcq(spark, sf_dir))
    return scoring.mean_score(scored, ["task_type"]).withColumn("accuracy", F.round("accuracy", 6))


def _grams(column: str, n: str) -> str:
    tokens = TOKENS.replace("text", column)
    return f"""(SELECT list(array_to_string(t[i:i + {n} - 1], ' ')) FROM
      (SELECT t, unnest(range(1, len(t) - {n} + 2)) AS i FROM (SELECT {tokens} AS t)))"""


def _clipped_sql(orders: list[int]) -> str:
    n_list = ", ".join(str(n) for n in orders)
    return rf"""
WITH toks AS (
  SELECT pair_id, conv_id, {TOKENS.replace("text", "cand")} AS ct, {TOKENS.replace("text", "ref")} AS rt FROM pairs),
orders AS (SELECT unnest([{n_list}]) AS n),
cg AS (SELECT pair_id, conv_id, n, gram, count(*) AS c FROM (
  SELECT pair_id, conv_id, n, array_to_string(ct[i:i + n - 1], ' ') AS gram FROM (
    SELECT pair_id, conv_id, ct, n, unnest(range(1, len(ct) - n + 2)) AS i FROM toks, orders)) GROUP BY ALL),
rg AS (SELECT pair_id, conv_id, n, gram, count(*) AS r FROM (
  SELECT pair_id, conv_id, n, array_to_string(rt[i:i + n - 1], ' ') AS gram FROM (
    SELECT pair_id, conv_id, rt, n, unnest(range(1, len(rt) - n + 2)) AS i FROM toks, orders)) GROUP BY ALL),
counts AS (
  SELECT coalesce(cg.conv_id, rg.conv_id) AS conv_id, coalesce(cg.n, rg.n) AS n,
    coalesce(c, 0) AS c, coalesce(r, 0) AS r
  FROM cg FULL JOIN rg ON cg.pair_id = rg.pair_id AND cg.n = rg.n AND cg.gram = rg.gram)"""


@query(
    "corpus_ngram_overlap",
    over(
        "pairs",
        _clipped_sql([2])
        + """
SELECT CAST(sum(least(c, r)) AS BIGINT) AS matches, CAST(sum(r) AS BIGINT) AS ref_total,
  round(sum(least(c, r)) / sum(r), 6) AS overlap FROM counts""",
    ),
)
def corpus_ngram_overlap(spark, sf_dir):
    return ng.corpus_ngram_overlap(views.pairs(spark, sf_dir)).withColumn(
        "overlap", F.round("overlap", 6)
    )


@query(
    "corpus_ngram_overlap_by_system",
    over(
        "pairs",
        _clipped_sql([1])
        + """
SELECT conv_id % 5 AS system, CAST(sum(least(c, r)) AS BIGINT) AS matches, CAST(sum(r) AS BIGINT) AS ref_total,
  round(CASE WHEN sum(r) > 0 THEN sum(least(c, r)) / sum(r) ELSE 0 END, 6) AS overlap
FROM counts GROUP BY 1""",
    ),
)
def corpus_ngram_overlap_by_system(spark, sf_dir):
    rows = views.pairs(spark, sf_dir).withColumn("system", F.col("conv_id") % 5)
    return ng.corpus_ngram_overlap(rows, 1, by=["system"]).withColumn(
        "overlap", F.round("overlap", 6)
    )


_BLEU = """,
pooled AS (
  SELECT {by} AS system, n, sum(least(c, r)) AS m, sum(c) AS ct, sum(r) AS rt FROM counts GROUP BY 1, 2),
lens AS (SELECT system, max(CASE WHEN n = 1 THEN ct END) AS cl, max(CASE WHEN n = 1 THEN rt END) AS rl,
  sum(ln(CASE WHEN ct > 0 THEN m / ct ELSE 0 END + 1e-9)) + (4 - count(*)) * ln(1e-9) AS logs
  FROM pooled GROUP BY system)
SELECT {out} CAST(cl AS BIGINT) AS cand_len, CAST(rl AS BIGINT) AS ref_len,
  round(CASE WHEN cl > rl THEN 1 ELSE exp(1 - rl / greatest(cl, 1)) END * exp(logs / 4), 6) AS bleu
FROM lens"""


@query("corpus_bleu", over("pairs", _clipped_sql([1, 2, 3, 4]) + _BLEU.format(by="0", out="")))
def corpus_bleu(spark, sf_dir):
    return ng.corpus_bleu(views.pairs(spark, sf_dir)).withColumn("bleu", F.round("bleu", 6))


@query(
    "corpus_bleu_by_system",
    over("pairs", _clipped_sql([1, 2, 3, 4]) + _BLEU.format(by="conv_id % 5", out="system,")),
)
def corpus_bleu_by_system(spark, sf_dir):
    rows = views.pairs(spark, sf_dir).withColumn("system", F.col("conv_id") % 5)
    return ng.corpus_bleu(rows, by=["system"]).withColumn("bleu", F.round("bleu", 6))


@query(
    "ngram_diversity",
    f"""
SELECT doc_id, round(CASE WHEN len(g) > 0 THEN len(list_distinct(g)) / len(g) ELSE 0 END, 6) AS diversity
FROM (SELECT doc_id, list_transform(range(1, len(t)), lambda i: concat(t[i], ' ', t[i + 1])) AS g
      FROM (SELECT doc_id, {TOKENS} AS t FROM documents))""",
)
def ngram_diversity(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    return ng.ngram_diversity(docs, "doc_id", "text").withColumn(
        "diversity", F.round("diversity", 6)
    )


@query(
    "corpus_ngram_diversity",
    f"""
SELECT lang, count(DISTINCT gram) AS distinct_grams, count(gram) AS total_grams,
  round(count(DISTINCT gram) / count(gram), 6) AS diversity
FROM (SELECT lang, concat(t[i], ' ', t[i + 1]) AS gram
      FROM (SELECT lang, t, unnest(range(1, len(t))) AS i FROM (SELECT lang, {TOKENS} AS t FROM documents)))
GROUP BY lang""",
)
def corpus_ngram_diversity(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    return ng.corpus_ngram_diversity(docs, ["lang"], "text").withColumn(
        "diversity", F.round("diversity", 6)
    )
