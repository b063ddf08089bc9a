"""Work on few bytes that takes long is dealt to all tasks."""

from rippleline.plans import extraction


def test_source_files_are_dealt_to_all_tasks(spark, sf):
    files = extraction.code_files(spark, sf)
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    per_task = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(1 for n in per_task if n) > 1
