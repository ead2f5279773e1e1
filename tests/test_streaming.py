from linkmill.operators.records import normalize_records
from linkmill.sources.files import RECORDS
from linkmill.streaming.incremental import link_stream


def test_stream_links_like_a_batch(spark, tmp_path):
    reference = normalize_records(spark.createDataFrame([("S1-1", "Blue Lake Foods", "12 Main Street", "US"), ("S1-2", "Red Fox Tools", "9 Oak Road", "US")], RECORDS))
    new = [("S2-5", "Blue Lake Foods Inc", "12 Main St", "US"), ("S3-6", "Red Fox Tools", "9 Oak Rd", "US"), ("S3-7", "Nothing Alike", "1 Elm", "US")]
    spark.createDataFrame(new, RECORDS).write.json(str(tmp_path / "in"))
    found = []
    stream = spark.readStream.schema(RECORDS).json(str(tmp_path / "in"))
    link_stream(reference, stream, lambda df, _: found.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    assert {(r.s1_id, r.cand_id) for r in found} == {("S1-1", "S2-5"), ("S1-2", "S3-6")}
