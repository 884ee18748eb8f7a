from pyspark.sql import functions as F

from verbatrix.operators import trails
from verbatrix.streaming import refresh


def test_only_changed_files_are_parsed_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "rel_path string, content string"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = refresh.refresh_units(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    feed([("a.md", "# A\none fact"), ("b.md", "# B\ntwo facts")])
    feed([("a.md", "# A\nnew fact"), ("b.md", "# B\ntwo facts")])
    assert sorted(u.text for u in refresh.current_units(spark, out).collect()) == ["new fact", "two facts"]
    assert spark.read.parquet(f"{out}/hashes").count() == 3


def test_notebook_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [("t", 1, "2024-01-01 00:00:00", "create", "g"), ("t", 2, "2024-01-01 00:01:00", "add", "d#a"), ("t", 2, "2024-01-01 00:01:00", "add", "d#a")]
    spark.createDataFrame(rows, "trail_id string, seq bigint, at string, action string, value string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(src)
    refresh.trail_states(spark.readStream.schema(trails.EVENT).parquet(src), str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema(trails.EVENT).parquet(str(tmp_path / "log"))
    assert log.count() == 2 and trails.fold(log).first().visited_refs == ["d#a"]
