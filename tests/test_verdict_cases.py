"""Null texts and timestamps, skewed days, scale-free validity, shared folders."""

import pytest
from pyspark.sql import functions as F

from vigilspark import session
from vigilspark.operators import events as EV
from vigilspark.operators import outbound as OB
from vigilspark.operators.validate import validate_requests
from vigilspark.sources import fixtures as FX

from .conftest import SF_ORACLE, SF_SMALL


def test_null_text_is_clean(spark):
    r = OB.outbound_scan(spark.createDataFrame([(1, None)], "id long, text string"), "text").first()
    assert r.passed and r.threat_type == "clean" and r.final_text is None and not r.excessive_length


def test_retention_keeps_rows_without_timestamp(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-03-01 00:00:00"), (3, None)], "id long, t string").select("id", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    kept, _ = EV.retention_split(e, "2024-03-02 00:00:00", 30)
    assert sorted(r.id for r in kept.collect()) == [2, 3]
    r = EV.retention_report(e, "2024-03-02 00:00:00", 30).first()
    assert (r.kept, r.deleted) == (2, 1)


def test_valid_share_does_not_depend_on_scale(spark):
    share = [validate_requests(FX.prompts(spark, d)).agg(F.avg(F.col("valid").cast("int"))).first()[0] for d in (SF_SMALL, SF_ORACLE)]
    assert min(share) > 0.7 and abs(share[0] - share[1]) < 0.15


def test_a_large_day_is_split_over_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        e = spark.range(200_000).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("prompt"))
        EV.append_events(e, str(tmp_path / "log"))
        assert len(list((tmp_path / "log").rglob("*.parquet"))) > 1
        assert spark.read.parquet(str(tmp_path / "log")).count() == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_shared_folder_is_required_off_a_local_master():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_text_scans_do_not_shuffle(spark):
    from vigilspark.plans.registry import queries
    for name in ("redact_documents", "outbound_scan", "inbound_scan"):
        plan = queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobin" not in plan
