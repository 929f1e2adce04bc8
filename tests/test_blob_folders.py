"""The file sink and its reader over many files: what the driver holds is folders, not files."""

from pyspark.sql import functions as F

from folio.sources import blobs


def test_driver_lists_folders_and_tasks_list_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "FOLDER_FILES", 10, raising=False)
    path = str(tmp_path / "out")
    rows = spark.range(95).coalesce(1).select(F.concat(F.when(F.col("id") % 5 == 0, "deep/").otherwise(""), F.lit("f"), "id", F.lit(".ttf")).alias("name"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("content"))
    blobs.write_blobs(rows, path)
    found = blobs.read_blobs(spark, path, "*.ttf")
    # Spark's file index would list every file on the driver.
    assert not found.inputFiles()
    got = {r.name: (r.length, len(r.content)) for r in found.collect()}
    assert got == {("deep/" if i % 5 == 0 else "") + f"f{i}.ttf": (i, i) for i in range(1, 95)}
    assert blobs.read_blobs(spark, path, "*.otf").count() == 0


def test_nothing_was_written(spark, tmp_path):
    blobs.write_blobs(spark.createDataFrame([], "name string, content binary"), str(tmp_path / "none"))
    assert blobs.read_blobs(spark, str(tmp_path / "none")).collect() == []
