import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, sketch


def test_cells_are_summed_over_tasks(spark):
    def run(batches):
        counts = sketch.Counts()
        for batch in batches:
            keys, times = np.unique(batch.column(0).to_numpy(), return_counts=True)
            counts.add(keys, times)
        for segment, packed in counts.segments():
            yield pa.record_batch(
                {"segment": pa.array([segment], pa.int32()), "counts": pa.array([packed], pa.binary())}
            )

    rows = spark.range(300_000, numPartitions=4).select(
        F.xxhash64(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))).alias("key")
    )
    found = sketch.merged(rows.mapInArrow(run, sketch.SEGMENTS))
    assert [int(row.sum()) for row in found] == [300_000] * sketch.ROWS

    keys, times = np.unique(rows.toPandas()["key"].to_numpy(), return_counts=True)
    guess = sketch.estimates(found, keys)
    assert (guess >= times).all()
    assert guess[times > 1].tolist() == [100_000]
    assert (guess == times).mean() > 0.9


def test_an_empty_table_counts_nothing(spark):
    found = sketch.merged(spark.createDataFrame([], sketch.SEGMENTS))
    assert found.shape == (sketch.ROWS, sketch.CELLS) and not found.any()


def test_rare_ngrams_come_first():
    members = np.sort(
        np.array([xxhash.xxh3_64_intdigest(str(i)) for i in range(50)], np.uint64).view(np.int64)
    )
    counts = sketch.Counts()
    counts.add(members, np.arange(50, 0, -1))
    assert ngram_join.rare_first(members, counts.rows).tolist() == members[::-1].tolist()


def test_a_passage_spread_over_tasks_stays_out_of_lists(spark):
    """Each task sees the passage once; the documents are otherwise different."""
    passage = " ".join(f"shared{i}" for i in range(30))
    docs = spark.range(40, numPartitions=40).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(
            " ",
            F.lit(passage),
            *[F.concat(F.lit(f"w{i}x"), F.col("id")) for i in range(60)],
        )
        .cast("binary")
        .alias("text"),
    )
    nodes = ngram_join._prepare(docs, 5, 80, 100)
    lists = nodes.select(F.explode("scan").alias("token")).groupBy("token").count()
    assert nodes.filter("scan IS NOT NULL").count() == 40
    assert lists.filter("count > 1").count() == 0
