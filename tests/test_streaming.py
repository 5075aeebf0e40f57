import json

from reelsleuth.streaming.manifests import stage_counts, watch_jobs


def test_jobs_are_counted_as_they_arrive(spark, tmp_path):
    def arrive(name, text):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)

    arrive("a", json.dumps({"id": "a", "stage": "ripped"}))
    arrive("b", "{broken")
    query = stage_counts(watch_jobs(spark, str(tmp_path))).writeStream.format("memory").queryName("stages").outputMode("complete").start()
    query.processAllAvailable()
    arrive("c", json.dumps({"id": "c", "stage": "ripped"}))
    query.processAllAvailable()
    query.stop()
    assert [(r["stage"], r["jobs"]) for r in spark.sql("SELECT * FROM stages").collect()] == [("ripped", 2)]
