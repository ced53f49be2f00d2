"""Named queries: embeddings and score columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, similarity
from . import views
from .fixture_sql import over
from .queries_text import TOKENS
from .registry import query

_COS = """list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))
  / (greatest(sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9)
   * greatest(sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9))"""


def _cos(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


@query(
    "embedding_similarity",
    over(
        "vec_pairs",
        f"""
SELECT label, count(*) AS pairs, round(avg({_cos("gen_vec", "ref_vec")}), 6) AS similarity
FROM vec_pairs GROUP BY label""",
    ),
)
def embedding_similarity(spark, sf_dir):
    return similarity.embedding_similarity(views.vec_pairs(spark, sf_dir), ["label"]).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query(
    "pair_similarity",
    over(
        "vec_pairs",
        f"""SELECT pair_id, round({_cos("gen_vec", "ref_vec")}, 6) AS similarity FROM vec_pairs""",
    ),
)
def pair_similarity(spark, sf_dir):
    rows = similarity.pair_similarity(views.vec_pairs(spark, sf_dir))
    return rows.select("pair_id", F.round("similarity", 6).alias("similarity"))


@query(
    "embedding_diversity",
    f"""
WITH firsts AS (SELECT label, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS fv, count(*) AS members
  FROM embeddings GROUP BY label)
SELECT f.label, f.members, round(CASE WHEN f.members < 2 THEN 0 ELSE
  1 - avg(CASE WHEN e.vec_id <> f.vec_id THEN {_cos("fv", "embedding")} END) END, 6) AS diversity
FROM firsts f JOIN embeddings e ON e.label = f.label GROUP BY f.label, f.members""",
)
def embedding_diversity(spark, sf_dir):
    vecs = views.table(spark, sf_dir, "embeddings")
    return similarity.embedding_diversity(vecs, "label", "embedding", "vec_id").withColumn(
        "diversity", F.round("diversity", 6)
    )


@query(
    "coherence",
    f"""
WITH adj AS (SELECT label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings)
SELECT label, count(*) AS members,
  round(coalesce(avg(CASE WHEN prev IS NOT NULL THEN {_cos("prev", "embedding")} END), 0), 6) AS coherence
FROM adj GROUP BY label""",
)
def coherence(spark, sf_dir):
    vecs = views.table(spark, sf_dir, "embeddings")
    return similarity.coherence(vecs, "label", "vec_id", "embedding").withColumn(
        "coherence", F.round("coherence", 6)
    )


_SCORE = """CASE WHEN coalesce(upper(predicted) = upper(trim(reference)), false)
  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score"""


@query(
    "logit_accuracy",
    over(
        "scores",
        f"""
SELECT item_id, reference, predicted, {_SCORE}
FROM (SELECT *, substr('ABCD', CAST(list_position(scores[1:4], list_max(scores[1:4])) AS INT), 1) AS predicted FROM scores)""",
    ),
)
def logit_accuracy(spark, sf_dir):
    letters = {"A": 0, "B": 1, "C": 2, "D": 3}
    return scoring.logit_accuracy(views.scores(spark, sf_dir), letters).drop("scores")


@query(
    "logit_accuracy_open",
    over(
        "scores vocab",
        f"""
SELECT item_id, reference, predicted, {_SCORE}
FROM (SELECT s.item_id, s.reference, trim(v.token) AS predicted FROM scores s
  LEFT JOIN vocab v ON v.token_id = list_position(s.scores, list_max(s.scores)) - 1)""",
    ),
)
def logit_accuracy_open(spark, sf_dir):
    rows = scoring.logit_accuracy(
        views.scores(spark, sf_dir), vocabulary=views.vocab(spark, sf_dir)
    )
    return rows.drop("scores")


@query(
    "perplexity",
    over(
        "token_lp",
        """
SELECT e.vec_id AS seq_id, coalesce(n, 0) AS scored,
  round(CASE WHEN n >= 1 THEN exp(-m) ELSE 'inf'::DOUBLE END, 6) AS perplexity
FROM embeddings e LEFT JOIN (SELECT seq_id, count(*) AS n, avg(logprob) AS m FROM token_lp GROUP BY seq_id) s
  ON s.seq_id = e.vec_id""",
    ),
)
def perplexity(spark, sf_dir):
    seqs = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"))
    return scoring.perplexity(views.token_lp(spark, sf_dir), seqs).withColumn(
        "perplexity", F.round("perplexity", 6)
    )


@query(
    "bigram_perplexity",
    f"""
WITH toks AS (SELECT doc_id, {TOKENS} AS t FROM documents),
words AS (SELECT w, count(*) AS wc FROM (SELECT unnest(t) AS w FROM toks) GROUP BY w),
bi AS (SELECT doc_id, t[i] AS w1, t[i + 1] AS w2 FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM toks)),
bc AS (SELECT w1, w2, count(*) AS c FROM bi GROUP BY w1, w2),
model AS (SELECT w1, w2, ln((c + 1) / (wc + (SELECT count(*) FROM words))) AS lp FROM bc JOIN words ON w = w1),
scored AS (SELECT doc_id, count(*) AS n, exp(-avg(lp)) AS ppl FROM bi JOIN model USING (w1, w2) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS scored, round(coalesce(ppl, 'inf'::DOUBLE), 4) AS bigram_ppl
FROM documents LEFT JOIN scored USING (doc_id)""",
)
def bigram_perplexity(spark, sf_dir):
    docs = views.texts(spark, sf_dir)
    return scoring.bigram_perplexity(docs, "doc_id", "text").withColumn(
        "bigram_ppl", F.round("bigram_ppl", 4)
    )


@query(
    "generation_config",
    over(
        "mcq",
        """
SELECT item_id, task_type, temperature, max_new_tokens, temperature > 0 AS do_sample FROM (
  SELECT item_id, task_type,
    coalesce(CASE WHEN item_id % 3 = 0 THEN 0.2 END,
      CASE task_type WHEN 'mcq' THEN 0.0 WHEN 'mt' THEN 0.0 WHEN 'ssg' THEN 0.7 ELSE 0.7 END)::DOUBLE AS temperature,
    CASE task_type WHEN 'mcq' THEN 4 WHEN 'mt' THEN 200 WHEN 'ssg' THEN 100 ELSE 100 END AS max_new_tokens
  FROM mcq)""",
    ),
)
def generation_config(spark, sf_dir):
    rows = views.mcq(spark, sf_dir).select("item_id", "task_type")
    return scoring.generation_config(
        rows, temperature=F.when(F.col("item_id") % 3 == 0, F.lit(0.2))
    )
