"""The named queries of this package and, where SQL can say it, the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    decontamination,
    exact_dedup,
    lexical_search,
    line_dedup,
    mixing,
    neighbours,
    ngram_join,
    periodic_runs,
    secrets,
    substring_dedup,
    token_counts,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_line_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), l AS (
      SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
    ), k AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM l
    ), r AS (
      SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    ), m AS (
      SELECT doc_id, line, pos, r.key IS NOT NULL AND doc_id < keep AS lost
      FROM k LEFT JOIN r USING (key)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), ''))
             AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query(
    "op2_ngram_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x20\x09-\x0D]+') AS words
      FROM documents
    ), s AS (
      SELECT doc_id, CASE
               WHEN len(words) = 0 THEN []
               WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
               ELSE list_distinct([array_to_string(words[i:i + 2], ' ')
                                   FOR i IN range(1, len(words) - 1)]) END AS grams
      FROM w
    ), g AS (
      SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
    ), p AS (
      SELECT a.doc_id AS x, b.doc_id AS y
      FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
    ), r AS (
      SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x
    )
    SELECT s.doc_id, len(s.grams) AS n_shingles, least(s.doc_id, coalesce(min(r.y), s.doc_id))
             AS component_id
    FROM s LEFT JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, s.grams
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


@query(
    "op3_exact_dedup",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS chars,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
      FROM documents
    ), g AS (
      SELECT bare, count(*) AS group_size,
             first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
      FROM d GROUP BY bare
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256
    FROM d JOIN g USING (bare)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op4_substring_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document that shares passages: its spans, and what others keep of them."""
    spans = substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    size = F.col("stop") - F.col("start")
    return spans.groupBy("doc_id").agg(
        F.count("*").alias("n_spans"),
        F.sum(size).alias("repeated_bytes"),
        F.sum(F.when(F.col("first_doc") != F.col("doc_id"), size).otherwise(0)).alias(
            "dropped_bytes"
        ),
        F.min("first_doc").alias("first_doc"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("start", "stop"))),
                lambda s: F.concat_ws(":", s["start"], s["stop"]),
            ),
            ",",
        ).alias("spans"),
    )


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query(
    "op6_neighbours",
    """
    WITH v AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN embedding IF x <> 0]) > 0
    ), d AS (
      SELECT q.vec_id AS query_id, c.vec_id,
             sqrt(list_reduce([(q.e[i] - c.e[i]) * (q.e[i] - c.e[i])
                               FOR i IN range(1, len(q.e) + 1)], lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
    ), r AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER)
        AS rank
      FROM d
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


@query("op7_secrets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secrets.INFERRED)
    text = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(
        F.filter("spans", lambda s: s["kind"] == kind)
    ).cast("bigint")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


@query(
    "op8_mixing",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
      FROM documents
    ), t AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
    ), r AS (
      SELECT source, source_size, 3 * source_size AS cap,
             [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
      FROM t
    ), l AS (
      SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos,
             CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (
               ORDER BY cap / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
             / CAST(sum(weight) OVER (
               ORDER BY cap / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
      FROM r
    ), f AS (
      SELECT arg_min(level, pos) AS level FROM l WHERE NOT cap / weight < level
    ), g AS (
      SELECT source, source_size,
             CASE WHEN cap / weight < l.level THEN CAST(cap AS DOUBLE)
                  ELSE weight * f.level END AS target
      FROM l LEFT JOIN f ON TRUE
    ), p AS (
      SELECT doc_id, size, source_size, target,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)
                  AS BIGINT) / 4503599627370496 AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
    )
    SELECT doc_id, size, source_size, target,
           CAST(size * (floor(rate) + CAST(u < rate - floor(rate) AS INTEGER)) AS BIGINT) AS taken
    FROM p
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select(
        "doc_id",
        "mix.size",
        "mix.source_size",
        "mix.target",
        (F.col("mix.size") * F.col("mix.copies")).alias("taken"),
    )


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    ).drop("ids")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int")
    )


@query(
    "op11_decontamination",
    r"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM documents
    ), i AS (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM benchmark
    ), k AS (
      SELECT DISTINCT item_id, least(10, len(words)) AS size,
             unnest([array_to_string(words[p:p + 9], ' ')
                     FOR p IN range(1, greatest(1, len(words) - 9) + 1)]) AS win
      FROM i WHERE len(words) > 0
    ), z AS (
      SELECT DISTINCT size FROM k
    ), g AS (
      SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS p,
             unnest([array_to_string(words[p:p + size - 1], ' ')
                     FOR p IN range(1, len(words) - size + 2)]) AS win
      FROM w, z WHERE len(words) >= size
    ), o AS (
      SELECT DISTINCT doc_id, p, g.size, item_id FROM g JOIN k USING (size, win)
    ), h AS (
      SELECT doc_id, count(DISTINCT q) AS n_hit
      FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM o) GROUP BY doc_id
    ), m AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id
    )
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           n_hit IS NOT NULL AS contaminated
    FROM w LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    n_hit = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"]
    )
    return checked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query(
    "op12_lexical_search",
    r"""
    WITH t AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM documents
    ), p AS (
      SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
    ), d AS (
      SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
    ), a AS (
      SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d
    ), f AS (
      SELECT term, count(*) AS df FROM p GROUP BY term
    ), q AS (
      SELECT item_id, term, count(*) AS r
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY item_id, term
    ), s AS (
      SELECT item_id, doc_id, CAST(sum(
               r * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
               * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // len)))
             ) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id), a
      GROUP BY item_id, doc_id
    ), k AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)
        AS INTEGER) AS rank
      FROM s WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of each tenth document by checksum, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    cut = docs.select(
        "doc_id",
        "text",
        h.alias("h"),
        g.alias("g"),
        F.when(h % 10 == 0, F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).alias("words"),
    )
    n = F.size("words")
    a = F.col("g") % n
    placed = cut.withColumns({"a": a, "p": 1 + F.floor((n - a) / (3 + F.col("g") % 8))})
    source = lambda i: F.when(i < F.col("a"), i).otherwise(
        F.col("a") + (i - F.col("a")) % F.col("p")
    )
    changed = F.transform("words", lambda _, i: F.get("words", source(i).cast("int")))
    return placed.select(
        "doc_id",
        F.when((F.col("h") % 10 == 0) & (n > 0), F.array_join(changed, " "))
        .otherwise(F.col("text"))
        .alias("text"),
    )


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias(
            "runs_sha256"
        ),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
