from featlens.operators import clean
from featlens.streaming import apply_fitted
from tests.conftest import SF001


def test_fitted_transforms_apply_to_a_stream(spark, tmp_path):
    static = spark.read.parquet(f"{SF001}/customer.parquet")
    onehot = clean.fit_onehot(static, ["c_mktsegment"])
    stream = (spark.readStream.schema(static.schema).option("pathGlobFilter", "customer.parquet")
              .parquet(SF001))
    q = (apply_fitted(stream, onehot).writeStream.format("memory").queryName("oh_stream")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM oh_stream")
    assert out.count() == static.count()
    assert "c_mktsegment_BUILDING" in out.columns and "c_mktsegment" not in out.columns
