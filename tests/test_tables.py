"""Tables as folders of files, and numbers rounded as SQL rounds them."""

from sievework.plans import registry
from sievework.streaming.leases import drain, table_stream

SF = "/root/testdata/sf0.001"


def test_a_folder_is_streamed_as_a_file_is(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(5).write.parquet(f"{tmp_path}/other.parquet")
    got = drain(spark, table_stream(spark, f"{tmp_path}/documents.parquet").select("doc_id"), "folder")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    ingested = lambda sf: sorted(map(str, registry.QUERIES["stm_ingested"](spark, sf).collect()))
    assert ingested(str(tmp_path)) == ingested(SF) and ingested(SF)


def test_options_round_as_sql(spark, tmp_path):
    """0.145 as a binary number lies below the half; 0.285, 0.575 and 0.565 too, and 0.125 and 0.375 are halves."""
    values = [14.5, 28.5, 57.5, 56.5, 12.5, 37.5, 0.0, 89.99]
    spark.createDataFrame([(6 * k + 3, v) for k, v in enumerate(values)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.min_sim for r in registry.QUERIES["js_options"](spark, str(tmp_path)).collect()}
    assert [got[6 * k + 3] for k in range(8)] == [0.14, 0.28, 0.57, 0.56, 0.13, 0.38, None, 0.9]
