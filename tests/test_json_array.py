"""The splittable array reader against json.loads: every byte range, awkward texts, broken files."""

import json
import random

import pytest

from tidemill.sources import files, json_array


def read(spark, path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        objects, files = json_array.array_objects(spark, str(path))
        values = [r["value"] for r in objects.orderBy("file", "begin", "at").collect()]
        return values, {r["file"].rpartition("/")[2]: r["whole"] for r in files.collect()}, objects
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def awkward(n):
    r = random.Random(7)
    pieces = ["}", "{", "[", "]", '"', "\\", "\\\\", "},{", '"}', "\n", ",", "é", "中", "😀", " ", ":", "\\u007d"]
    return [{"id": i, "title": "".join(r.choice(pieces) for _ in range(r.randint(0, 12))), "nested": {"a": [{}, [], {"b": "}"}]}, "list": [[1], {"x": None}], "text": "x" * r.choice([0, 3, 60, 400])} for i in range(n)]


@pytest.mark.parametrize("form, size", [({"indent": 2, "ensure_ascii": False}, 150), ({"separators": (",", ":")}, 97), ({}, 1 << 20)])
def test_equal_to_loads_for_all_ranges(spark, tmp_path, form, size):
    rows = awkward(14)
    (tmp_path / "a.json").write_text(" \n" + json.dumps(rows, **form) + "\n")
    values, whole, objects = read(spark, tmp_path / "a.json", size)
    assert [json.loads(v) for v in values] == rows and whole == {"a.json": True}


#: Text, whether it is an array of objects, and of those that are how many it has.
CASES = [
    ("[]", True, 0), (" [ {} ] ", True, 1), ("{}", False, 0), ('{"a": [{}]}', False, None), ("[1]", False, None), ('["}"]', False, None), ("[{}", False, None), ("[{}, {]", False, None),
    ('[{"a": "x]', False, None), ("[{}{}]", False, None), ("[{},]", False, None), ("[{}] []", False, None), ("[[{}]]", False, None), ('[{"a" 1}]', False, None), ("[{}, null]", False, None), ("x[{}]", False, None), ("[{}]x", False, None), ("null", False, None),
    ('[{"a": 2}, {"a": 3}]', True, 2), (b'[{"a": "\xff"}]', False, None), ("[{}]}", False, None),
]


def test_files_count_only_as_a_whole(spark, tmp_path):
    for i, (text, _, _) in enumerate(CASES):
        (tmp_path / f"{i:02}.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        objects, files = json_array.array_objects(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {r["file"].rpartition("/")[2]: r["whole"] for r in files.collect()}
    assert found == {f"{i:02}.json": whole for i, (_, whole, _) in enumerate(CASES)}
    counts = {r["file"].rpartition("/")[2]: r["count"] for r in objects.groupBy("file").count().collect()}
    assert all(n is None or counts.get(f"{i:02}.json", 0) == n for i, (_, _, n) in enumerate(CASES))


def test_objects_of_one_file_do_not_meet_in_one_task(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": i, "title": f"t{i}"} for i in range(50)]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = files.array_records(spark, str(tmp_path / "a.json"))
        assert rows.count() == 50
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    semi = next(line for line in plan.splitlines() if "LeftSemi" in line)
    assert "broadcast" in semi
