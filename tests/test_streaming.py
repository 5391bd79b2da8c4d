"""The row-local harmonisation gives the same rows on a stream as in batch."""

import tempfile
import uuid

from pyspark.sql import functions as F

from reefline.sources import bindings as B
from reefline.sources.tables import RATES_SCHEMA
from reefline.streaming import harmonise_rows, start_harmonise_stream
from tests.conftest import SF_SMALL


def test_stream_equals_batch(spark):
    rates = B.study_rates(spark, SF_SMALL)
    rates = rates.withColumn("row_ordinal", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rates = rates.select(*[F.col(f.name).cast(f.dataType) for f in RATES_SCHEMA.fields])
    src = tempfile.mkdtemp(prefix="reefline-stream-src-")
    rates.repartition(3).write.mode("overwrite").parquet(src)
    name = "h_" + uuid.uuid4().hex[:8]
    out = tempfile.mkdtemp(prefix="reefline-stream-out-")
    q = start_harmonise_stream(spark, src, sink=out, query_name=name,
                               checkpoint=tempfile.mkdtemp(prefix="reefline-stream-ckpt-"))
    q.awaitTermination(300)
    batch = harmonise_rows(spark.read.schema(RATES_SCHEMA).parquet(src))
    streamed = spark.read.schema(batch.schema).parquet(out).select(*batch.columns)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
