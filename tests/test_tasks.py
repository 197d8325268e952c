import pytest

from lectern.streaming.tasks import TaskFailed, catalogue, total


def test_tasks_run_in_chunks_and_fail_loudly(spark):
    expected = spark.range(10).selectExpr("id AS doc_id", "concat('h', id) AS file_hash", "id = 3 AS redacted", "concat('p', id) AS storage_path")
    stored = spark.range(10).selectExpr("id AS doc_id", "concat('h', id) AS content_hash", "concat('p', id) AS path")
    tasks = catalogue("2024-01-10", chunk=4)
    assert len(tasks["verify"].plan({"expected": expected})) == 3
    assert tasks["verify"]({"expected": expected, "stored": stored}) == {"redacted": 1, "sound": 9}
    with pytest.raises(TaskFailed) as failed:
        tasks["verify"]({"expected": expected, "stored": stored.where("doc_id <> 5")})
    assert failed.value.result == {"missing": 1, "redacted": 1, "sound": 8}
    assert tasks["verify"]({"expected": expected.limit(0), "stored": stored}) == {}
    entries = spark.createDataFrame([("i", "d", "end", "2024-01-01", "x", "confirmed"), ("j", "d", "end", "2024-02-01", "x", "confirmed"), ("k", "d", "start", "2024-02-01", "x", "confirmed")], "instance_id string, document_id string, role string, value string, raw string, status string")
    assert tasks["calendar"]({"entries": entries}) == {"due": 1, "overdue": 1}
    instances = spark.range(9).selectExpr("id AS seq", "concat('i', id) AS instance_id")
    mentions = spark.createDataFrame([("i1", False), ("i2", True)], "instance_id string, unlinked boolean")
    assert tasks["propose"]({"instances": instances, "mentions": mentions}) == {"unlinked": 8}
    assert total([{"a": 1}, {"a": 2, "b": 1}]) == {"a": 3, "b": 1}
