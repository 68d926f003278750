import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner.model import FINDINGS
from gleaner.operators import catalogue, reports
from gleaner.sources import files

FOUND = [
    ("a.x", "info", "b.py", 3, 'say("ü")', "m", "", 1), ("a.x", "error", "z.py", 1, "x\n,y", "m", "s", 2), ("b.y", "error", "a.py", 9, None, "m", None, 3),
    ("b.y", "odd", "a.py", 9, "", None, "s", 4), ("a.x", "error", "z.py", 1, "x\n,y", "m", "s", 2),
]


def report(spark, tmp_path, rows):
    folder = str(tmp_path / "report")
    total = reports.write_report(spark.createDataFrame(rows, FINDINGS).repartition(3), folder, "src", 7, "2024-01-01T00:00:00Z", 12)
    whole = "".join(open(f"{folder}/{n}", encoding="utf-8").read() for n in sorted(os.listdir(folder)) if n[0] not in "._")
    return json.loads(whole), total, reports.read_report(spark, folder)


def test_files_of_a_report_are_one_document_in_the_order_of_findings(spark, tmp_path):
    document, total, back = report(spark, tmp_path, FOUND)
    assert [(x["severity"], x["file"]) for x in document["findings"]] == [("error", "a.py"), ("error", "z.py"), ("error", "z.py"), ("info", "b.py"), ("odd", "a.py")]
    assert document["summary"] == total == {"total": 5, "errors": 3, "warnings": 0, "info": 1, "files_scanned": 7, "duration_ms": 12}
    assert document["path"] == "src" and "suggestion" not in document["findings"][0]
    rows = back.orderBy("place").collect()
    assert [(x.place, x.code) for x in rows] == [(1, None), (2, "x\n,y"), (3, "x\n,y"), (4, 'say("ü")'), (5, "")]


def test_a_report_without_findings(spark, tmp_path):
    document, total, back = report(spark, tmp_path, [])
    assert document["findings"] == [] and total["total"] == 0 and back.count() == 0


def test_a_broken_line_of_a_report_fails(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text('{"rule": "a"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        reports.read_report(spark, str(tmp_path)).collect()


def test_rules_of_files(spark):
    rules = spark.createDataFrame([("b", [".py", ".js"]), ("a", ["*"]), ("c", [".py"])], "id string, file_types array<string>")
    paths = [("x/a.py", 1), ("a.js", 2), ("Makefile", 3), (None, 4), ("x/a.py", 5)]
    got = catalogue.applicable(spark.createDataFrame(paths, "path string, rules_before int"), rules).collect()
    assert sorted((r.rules_before, tuple(r.rules), r.language) for r in got) == [(1, ("a", "b", "c"), "python"), (2, ("a", "b"), "jsts"), (3, ("a",), None), (4, ("a",), None), (5, ("a", "b", "c"), "python")]


def test_a_tree_is_written_once_a_path(spark, tmp_path):
    rows = [("a/b.py", "2"), ("a/b.py", "1"), ("c.py", None), (None, "x"), ("a/./d/../e.py", "ü\r\n")]
    assert files.write_tree(spark.createDataFrame(rows, "path string, content string"), str(tmp_path / "t")) == 3
    assert {r.path[len(str(tmp_path)) + 3 :]: r.content for r in files.read_tree(spark, str(tmp_path / "t")).collect()} == {"a/b.py": "1", "c.py": "", "a/e.py": "ü\r\n"}
    assert files.write_tree(spark.createDataFrame([], "path string, content string"), str(tmp_path / "none")) == 0


@pytest.mark.parametrize("path", ["../a.py", "/a.py", "b/../../a.py"])
def test_no_file_is_written_outside_of_a_tree(spark, tmp_path, path):
    with pytest.raises(Exception, match="outside"):
        files.write_tree(spark.createDataFrame([(path, "x")], "path string, content string"), str(tmp_path / "t"))
    assert not (tmp_path / "a.py").exists()


@pytest.mark.parametrize("most", [1, 4, 100_000])
def test_tasks_list_what_the_walk_lists(spark, tmp_path, most):
    root = tmp_path / "tree"
    for k in range(40):
        at = root / "/".join(f"d{k % n}" for n in range(1, k % 6 + 1)) / ("vendor" if k % 11 == 5 else ".hid" if k % 13 == 5 else "e")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f{k}{('.py', '.min.js', '.txt', '.go')[k % 4]}").write_text("x" * k)
    (root / "e.py").symlink_to(root / "nothing")
    (root / "loop").symlink_to(root)
    (root / "empty").mkdir()
    got = files.walked(spark, str(root), "d1", "f9*", most)
    want = files.list_tree(spark, str(root), "d1", "f9*")
    assert sorted(got.select("path", "ext", "size").collect()) == sorted(want.select("path", "ext", "size").collect())
    assert got.where("mtime_ns is null").count() == 0 and want.count() > 5


def test_listing_of_one_file_or_of_a_folder_that_is_left_out(spark, tmp_path):
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "a.py").write_text("1")
    assert files.walked(spark, str(tmp_path / "vendor")).count() == 0
    assert files.walked(spark, str(tmp_path / "vendor" / "a.py")).select(F.col("size")).collect()[0][0] == 1
