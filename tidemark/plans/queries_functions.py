"""Named queries: user functions and model inference."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import remote
from ..operators import inference, scoring, similarity
from . import views
from .fixture_sql import over
from .queries_text import TOKENS
from .registry import query


def _cents(frame):
    return frame.assign(cents=(frame["value"] * 100).round().astype("int64"))[["event_id", "cents"]]


@query("run_function", "SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events")
def run_function(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", "value")
    return remote.run(rows, _cents, "event_id bigint, cents bigint")


def _total(frame):
    return frame.assign(n=1).groupby("event_type", as_index=False).agg(n=("n", "sum"), top=("value", "max"))


def _merge_totals(parts):
    return parts.groupby("event_type", as_index=False).agg(n=("n", "sum"), top=("top", "max"))


@query(
    "run_function_by_key",
    "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type",
)
def run_function_by_key(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_type", "value")
    schema = "event_type string, n bigint, top double"
    return remote.run(rows, _total, schema, "event_type", _merge_totals)


@remote.on_table("event_id bigint, band string", limit=100.0)
def _band(frame, limit):
    band = (frame["value"] > limit).map({True: "high", False: "low"})
    return frame.assign(band=band)[["event_id", "band"]]


@query(
    "on_table",
    "SELECT event_id, CASE WHEN value > 250 THEN 'high' ELSE 'low' END AS band FROM events",
)
def on_table(spark, sf_dir):
    return _band(views.table(spark, sf_dir, "events").select("event_id", "value"), limit=250.0)


def _count_or_fail(frame):
    worst = float(frame["value"].max())
    if worst > 400:
        raise ValueError("value above 400")
    return {"n": len(frame)}


def _join_counts(parts):
    return {"n": sum(p["n"] for p in parts)}


@query(
    "capture_outcomes",
    """
SELECT user_id, CASE WHEN max(value) > 400 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN max(value) > 400 THEN 'ValueError: value above 400' END AS error,
  CASE WHEN max(value) <= 400 THEN concat('{"n": ', count(*), '}') END AS result
FROM events GROUP BY user_id""",
)
def capture_outcomes(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("user_id", "value")
    return remote.capture_outcomes(rows, _count_or_fail, "user_id", _join_counts).drop("traceback")


@query(
    "embed_column",
    f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents),
p AS (SELECT doc_id, CAST(concat('0x', substr(md5(token), 1, 8)) AS BIGINT) % 384 AS place FROM t),
c AS (SELECT doc_id, place, count(*) AS n FROM p GROUP BY doc_id, place)
SELECT doc_id, CAST(place AS INT) AS place,
  round(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS FLOAT)::DOUBLE, 5) AS weight FROM c""",
)
def embed_column(spark, sf_dir):
    docs = views.texts(spark, sf_dir).select("doc_id", "text")
    vectors = inference.embed_column(docs).select("doc_id", F.posexplode("embedding").alias("place", "x"))
    return vectors.filter("x <> 0").select(
        "doc_id", "place", F.round(F.col("x").cast("double"), 5).alias("weight")
    )


@query(
    "batch_generate",
    over(
        "mcq",
        """
SELECT item_id, task_type, CASE task_type WHEN 'mcq' THEN 'A' WHEN 'mt' THEN 'This is a stub translation.'
  WHEN 'ssg' THEN 'This is a stub story generation.' ELSE 'Stub response' END AS generation,
  'completed' AS status, NULL::VARCHAR AS error FROM mcq""",
    ),
)
def batch_generate(spark, sf_dir):
    prompts = views.mcq(spark, sf_dir).select("item_id", F.col("generation").alias("prompt"), "task_type")
    return inference.batch_generate(prompts).drop("prompt")


class ShortEcho:
    """A stand-in model: the first characters of the prompt, as many as tokens allowed."""

    def generate(self, prompts, temperatures, max_new_tokens):
        return [p[:n] for p, n in zip(prompts, max_new_tokens)]


@query(
    "batch_generate_with_model",
    over(
        "mcq",
        """
SELECT item_id, task_type, CASE WHEN task_type <> 'other' THEN trim(substr(generation,  1,
    CASE task_type WHEN 'mcq' THEN 4 WHEN 'mt' THEN 200 ELSE 100 END), chr(32) || chr(9) || chr(10) || chr(13)) END AS generation,
  CASE WHEN task_type = 'other' THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN task_type = 'other' THEN 'invalid task type' END AS error FROM mcq""",
    ),
)
def batch_generate_with_model(spark, sf_dir):
    prompts = views.mcq(spark, sf_dir).select("item_id", F.col("generation").alias("prompt"), "task_type")
    return inference.batch_generate(prompts, model_factory=ShortEcho).drop("prompt")


def letter_counts():
    """A stand-in model: the score of letter id i is how often that capital letter occurs."""
    import numpy as np

    def predict(prompts):
        return np.array([[p.count(chr(65 + i)) for i in range(26)] for p in prompts], dtype="float32")

    return predict


@query(
    "next_token_scores",
    over(
        "mcq",
        """
WITH s AS (SELECT item_id, reference, list_transform(['A', 'B', 'C', 'D'],
    lambda l: length(generation) - length(replace(generation, l, ''))) AS c FROM mcq)
SELECT item_id, reference, substr('ABCD', CAST(list_position(c, list_max(c)) AS INT), 1) AS predicted,
  CAST(c[1] AS DOUBLE) AS a_score,
  CASE WHEN substr('ABCD', CAST(list_position(c, list_max(c)) AS INT), 1) = reference THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM s""",
    ),
)
def next_token_scores(spark, sf_dir):
    prompts = views.mcq(spark, sf_dir).select(
        "item_id", F.col("generation").alias("prompt"), "reference"
    )
    scored = inference.next_token_scores(prompts, letter_counts)
    letters = {"A": 0, "B": 1, "C": 2, "D": 3}
    return scoring.logit_accuracy(scored, letters).select(
        "item_id",
        "reference",
        "predicted",
        F.get("scores", F.lit(0)).cast("double").alias("a_score"),
        "score",
    )


def length_logprobs():
    """A stand-in model: a blank-separated word is the less likely the longer it is."""

    def score(texts):
        return [[-0.25 * len(w) for w in t.split(" ")[1:]] for t in texts]

    return score


@query(
    "token_logprobs",
    over(
        "mcq",
        """
SELECT item_id AS seq_id, len(w) - 1 AS scored, round(CASE WHEN len(w) < 2 THEN 'inf'::DOUBLE
  ELSE exp(list_sum(list_transform(w[2:], lambda x: 0.25 * length(x))) / (len(w) - 1)) END, 4) AS perplexity
FROM (SELECT item_id, string_split(generation, ' ') AS w FROM mcq)""",
    ),
)
def token_logprobs(spark, sf_dir):
    texts = views.mcq(spark, sf_dir).select(
        F.col("item_id").alias("seq_id"), F.col("generation").alias("text")
    )
    scores = inference.token_logprobs(texts, length_logprobs)
    return scoring.perplexity(scores, texts).withColumn("perplexity", F.round("perplexity", 4))


_LETTER_VECTOR = """list_transform(range(65, 91), lambda c: length({text}) - length(replace({text}, chr(CAST(c AS INT)), '')))"""
_LETTER_COS = """list_sum(list_transform(range(1, 27), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))
  / (greatest(sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9)
   * greatest(sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9))"""
_by_letters = partial(inference.embed_column, model_factory=letter_counts)


@query(
    "text_similarity",
    over(
        "pairs",
        f"""
SELECT count(*) AS pairs, round(avg({_LETTER_COS.format(a="cv", b="rv")}), 6) AS similarity
FROM (SELECT {_LETTER_VECTOR.format(text="cand")} AS cv, {_LETTER_VECTOR.format(text="ref")} AS rv FROM pairs)""",
    ),
)
def text_similarity(spark, sf_dir):
    rows = similarity.text_similarity(views.pairs(spark, sf_dir), embed=_by_letters)
    return rows.withColumn("similarity", F.round("similarity", 6))


@query(
    "text_diversity",
    over(
        "mcq",
        f"""
WITH v AS (SELECT item_id, task_type, {_LETTER_VECTOR.format(text="generation")} AS vec FROM mcq),
f AS (SELECT task_type, min(item_id) AS item_id, arg_min(vec, item_id) AS fv, count(*) AS members FROM v GROUP BY task_type)
SELECT f.task_type, f.members, round(CASE WHEN f.members < 2 THEN 0 ELSE
  1 - avg(CASE WHEN v.item_id <> f.item_id THEN {_LETTER_COS.format(a="fv", b="vec")} END) END, 6) AS diversity
FROM f JOIN v ON v.task_type = f.task_type GROUP BY f.task_type, f.members""",
    ),
)
def text_diversity(spark, sf_dir):
    rows = views.mcq(spark, sf_dir)
    scored = similarity.text_diversity(rows, "task_type", "generation", "item_id", _by_letters)
    return scored.withColumn("diversity", F.round("diversity", 6))


@query(
    "text_coherence",
    rf"""
WITH s AS (SELECT doc_id, unnest(kept) AS s, unnest(range(1, len(kept) + 1)) AS pos FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'),
    lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS kept FROM documents)),
v AS (SELECT doc_id, pos, {_LETTER_VECTOR.format(text="s")} AS vec FROM s),
a AS (SELECT doc_id, vec, lag(vec) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM v),
c AS (SELECT doc_id, count(*) AS n, avg(CASE WHEN prev IS NOT NULL THEN {_LETTER_COS.format(a="prev", b="vec")} END) AS m
  FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS sentences, round(coalesce(m, 0), 6) AS coherence FROM documents LEFT JOIN c USING (doc_id)""",
)
def text_coherence(spark, sf_dir):
    docs = views.texts(spark, sf_dir).select("doc_id", "text")
    scored = similarity.text_coherence(docs, "doc_id", "text", _by_letters)
    return scored.withColumn("coherence", F.round("coherence", 6))
