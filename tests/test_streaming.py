"""Streams driven to completion over small folders."""

from archspark.streaming.incremental import extract_changes, newest, requests_per_window


def test_changed_files_are_extracted_once(spark, tmp_path):
    schema = "path string, language string, content string, seen_at int"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a.py", "python", "import old\n", 1), ("a.py", "python", "import new\nimport os\n", 2), ("b.cc", "cpp", "int f() { return g(); }\n", 1)], schema).write.parquet(source)
    got = {}

    def sink(nodes, batch_id):
        for r in nodes.where("kind = 3").collect():
            got.setdefault(r.path, []).append(r.name)

    for _ in range(2):  # the second run finds nothing new
        extract_changes(spark.readStream.schema(schema).parquet(source), sink, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert got == {"a.py": ["new", "os"]}
    assert newest(spark.read.parquet(source)).count() == 2


def test_requests_per_window(spark, tmp_path):
    source = str(tmp_path / "log")
    rows = [("2025-01-01 10:10:00", "m", None), ("2025-01-01 10:50:00", "m", "timeout"), ("2025-01-01 11:10:00", "n", None)]
    spark.createDataFrame(rows, "logged_at string, model string, error string").write.parquet(source)
    counted = requests_per_window(spark.readStream.schema("logged_at string, model string, error string").parquet(source))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.window_start)[11:16], r.model, r.requests, r.failures) for r in spark.table("windows").collect()} == {("10:00", "m", 2, 1), ("11:00", "n", 1, 0)}
