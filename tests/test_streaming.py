"""Fitted steps applied to a stream (projection + stream–static join)."""

import os

from tabloom.operators import clean as C
from tabloom.operators import encode as R
from tabloom.streaming.score import score_stream


def test_score_stream(spark, tmp_path):
    rows = [(i, float(i % 7) if i % 5 else None, ["A", "B", "?"][i % 3], f"v{i % 30}") for i in range(60)]
    schema = "k bigint, x double, c string, h string"
    batch = spark.createDataFrame(rows, schema)
    cm = C.fit_clean(batch, None, winsorize=False)
    enc = R.fit_encoder(cm.transform(batch).drop("k"))
    src = os.path.join(str(tmp_path), "in")
    batch.write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    out = score_stream(stream, clean=cm, encoder=enc, keep=["k"])
    q = out.writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM scored")
    assert got.count() == 60
    assert set(got.columns) == {"k", *enc.feature_names}
    static = enc.transform(cm.transform(batch, deduplicate=False), keep=["k"])
    assert got.exceptAll(static).count() == 0
