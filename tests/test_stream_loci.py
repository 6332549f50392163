"""Loci over a stream against the batch operator, with a restart between batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helicase.operators.hits import cluster_hits, locus_stats
from helicase.streaming.loci import stream_loci

SCHEMA = "hit_id long, seq_id string, start long, end long, n long, identity double, p double, z double, stamp timestamp"
DAY = datetime(2024, 1, 1)


def hits():
    r = random.Random(8)
    rows = []
    for seq in "abc":
        at = 0
        for i in range(60):
            at += r.randrange(0, 60)
            rows.append((len(rows), seq, at, at + r.randrange(5, 60), r.randrange(2, 6), float(r.randrange(50, 99)), r.choice([0.3, 0.6, 0.9]), -float(r.randrange(5)), DAY + timedelta(minutes=i)))
    return rows


@pytest.mark.parametrize("compat", [False, True])
def test_stream_and_batch_agree(spark, tmp_path, compat):
    rows = hits()
    frame = spark.createDataFrame(rows, SCHEMA)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        loci = stream_loci(stream, late="1 minute", hold_ms=60_000, compat=compat)
        loci.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    for k in range(3):  # the query ends and starts again between the parts
        part = [x for x in rows if k * 20 <= (x[8] - DAY).seconds // 60 < k * 20 + 20]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
        run()
    for k in (3, 4):  # later hits elsewhere move the watermark on
        spark.createDataFrame([(999, "later", 1, 2, 2, 50.0, 0.9, 0.0, DAY + timedelta(days=k))], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
        run()
    got = spark.read.parquet(str(tmp_path / "out")).where("seq_id <> 'later'")
    names = ["seq_id", "start", "end", "windows", "max_n", "max_identity", "max_p", "min_z"]
    want = locus_stats(cluster_hits(frame, compat=compat)).select(*names)
    assert sorted(map(str, got.select(*names).collect())) == sorted(map(str, want.collect()))
    assert got.groupBy("seq_id").agg(F.count("*").alias("n")).where("n > 3").count() == 3
