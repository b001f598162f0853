"""Streams against their batch twins."""

import json

from pyspark.sql import functions as F

from reelmill.sources import files
from reelmill.streaming import jobs


def write_logs(folder, n, first=0):
    folder.mkdir(exist_ok=True)
    for i in range(first, first + n):
        row = {"job_id": f"j{i}", "timestamp": f"2026-0{1 + i % 3}-0{1 + i % 9}T10:00:00", "video": "v", "profile": "p", "stages": {"ocr": {"sec": 1.5 * i, "status": "ok"}, "parse": {"sec": 0.5, "status": "ok"}}, "errors": [], "total_sec": 2.0}
        (folder / f"{i}.json").write_text(json.dumps(row) + "\n")


def test_stage_statistics_and_quota(spark, tmp_path):
    write_logs(tmp_path / "logs", 6)
    stream = jobs.stage_statistics(jobs.read_job_stream(spark, str(tmp_path / "logs")))
    q = stream.writeStream.format("memory").queryName("stage_stats").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = files.read_job_log(spark, str(tmp_path / "logs")).groupBy("stage").agg(F.count("*").alias("n"), F.sum("sec").alias("total_sec"), F.max("sec").alias("max_sec"))
    assert sorted(map(tuple, spark.table("stage_stats").collect())) == sorted(map(tuple, batch.collect()))
    q = jobs.monthly_quota(jobs.read_job_stream(spark, str(tmp_path / "logs"))).writeStream.format("memory").queryName("quota").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("quota").count() >= 3


def test_watch_sees_each_file_once(spark, tmp_path):
    media = tmp_path / "media"
    (media / "sub").mkdir(parents=True)
    for n in ("a.mp4", "sub/b.MKV", "c.txt"):
        (media / n).write_bytes(b"x" * 10)
    run = lambda: jobs.watch_folder(spark, str(media), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    run()
    (media / "d.mov").write_bytes(b"y")
    run()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a.mp4", "b.MKV", "d.mov"]
    assert [r["path"].rsplit("/", 1)[1] for r in files.scan_media(spark, str(media)).collect()] == ["a.mp4", "d.mov", "b.MKV"]


def test_ledger_skips_completed(spark, tmp_path):
    source, ledger = tmp_path / "runs", str(tmp_path / "ledger")
    schema = "path STRING, returncode INT, finished_at TIMESTAMP"

    def put(rows, n):
        spark.createDataFrame(rows, "path string, returncode int").withColumn("finished_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(str(source))
        jobs.resume_ledger(spark.readStream.schema(schema).parquet(str(source)), ledger, str(tmp_path / "ck")).awaitTermination(120)
        assert spark.read.parquet(ledger).count() == n

    put([("a", 0), ("b", 1), ("b", 1)], 2)
    put([("a", 0), ("b", 0), ("c", 0)], 4)
    put([("b", 0), ("c", 1)], 4)


def test_states_and_transcript(spark, tmp_path):
    source = tmp_path / "events"
    spark.sql("SELECT 'a' job_id, 'running' status, timestamp'2026-01-01' ts UNION ALL SELECT 'a', 'failed', timestamp'2026-01-02' UNION ALL SELECT 'b', 'running', timestamp'2026-01-02'").write.parquet(str(source))
    jobs.queue_states(spark.readStream.schema(jobs.STATUS).parquet(str(source)), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r["job_id"]: r["status"] for r in jobs.latest_states(spark, str(tmp_path / "t")).collect()} == {"a": "pending", "b": "running"}
    talk = tmp_path / "talk"
    talk.mkdir()
    (talk / "1.json").write_text('{"video_id": 1, "seg_no": 0, "start_sec": 1.5, "end_sec": 2, "text": " hi "}\n{"video_id": 1, "seg_no": 1, "start_sec": 2, "end_sec": 3, "text": " "}\n')
    jobs.live_transcript(spark, str(talk), str(tmp_path / "lines"), str(tmp_path / "ck2")).awaitTermination(120)
    assert [r["line"] for r in spark.read.parquet(str(tmp_path / "lines")).collect()] == ["[1.500 - 2.000] UNK: hi"]


def test_sidecars_and_profile_log(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<R><ASSET><MEDIAID>1</MEDIAID><REPOSITORY>r</REPOSITORY><TITLE> </TITLE><NAME>Film A</NAME></ASSET><ASSET><MEDIAID>2</MEDIAID><TITLE>B</TITLE></ASSET></R>")
    assert sorted(map(tuple, files.read_sidecars(spark, str(tmp_path / "a.xml")).collect())) == [("1", "r", "Film A"), ("2", None, "B")]
    (tmp_path / "p.jsonl").write_text('{"type": "stage", "job_id": "j", "t": 1.0}\nnot json\n{"type": "sample", "job_id": "k"}\n')
    assert files.read_profile_log(spark, str(tmp_path / "p.jsonl"), "j").count() == 1
