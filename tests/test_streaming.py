"""The streaming scoring plan produces the same rows as the batch plan."""

import os
import tempfile

from pyspark.sql import functions as F

from tidewatch.operators import lookups
from tidewatch.plans import baseline, scoring
from tidewatch.sources import fixture
from tidewatch.streaming import reports as streaming


def test_stream_equals_batch(spark, sf_dir):
    model_df = baseline.fixture_model_frame(spark, sf_dir)
    base = baseline.build_baseline(model_df, fixture.terrain(spark, sf_dir))
    exposure = scoring.Exposure(fixture.district_regions(spark, sf_dir), fixture.region_divisors(spark, sf_dir),
                                fixture.risk_profiles(spark, sf_dir),
                                lookups.region_population(fixture.impact_reports(spark, sf_dir)))
    batch_in = fixture.field_reports(spark, sf_dir).drop("score")
    work = tempfile.mkdtemp(prefix="tidewatch-stream-")
    src = os.path.join(work, "in")
    batch_in.write.parquet(src)
    stream = streaming.read_reports(spark, src, max_files=1)
    q = streaming.start(streaming.score_stream(stream, base, exposure), os.path.join(work, "out"),
                        os.path.join(work, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(work, "out"))
    want = scoring.score_reports(batch_in, base, exposure)
    cols = ["report_id", "ok", "risk_level_en", "population_risk_estimate"]
    assert got.count() == want.count()
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert got.where(F.col("ok")).count() > 0
