"""Taking out what hangs together, putting it back, switching bases, settling decisions."""

from __future__ import annotations

import pytest

from folioscope.operators import decisions, trash
from folioscope.sources import files


def small(spark):
    tables = {
        "file": spark.createDataFrame([("f1",), ("f2",)], "sha string"),
        "page": spark.createDataFrame([(1, "f1", None), (2, "f1", 1), (3, "f2", 4), (4, "f2", 3), (5, None, 3)], "page bigint, sha string, after bigint"),
        "note": spark.createDataFrame([(10, 1), (11, 3), (12, None)], "note bigint, page bigint"),
    }
    keys = {"file": "sha", "page": "page", "note": "note"}
    links = [trash.Link("file", "sha", "page", "sha"), trash.Link("page", "page", "page", "after"), trash.Link("page", "page", "note", "page")]
    return tables, keys, links


def test_all_that_hangs_from_a_file_goes_and_comes_back(spark, rows):
    tables, keys, links = small(spark)
    found = trash.hanging(tables, keys, links, {"file": tables["file"].where("sha = 'f2'")})
    # Pages 3 and 4 hang from each other and page 5 from 3 without a file.
    assert {t: [r[0] for r in rows(df)] for t, df in found.items()} == {"file": ["f2"], "page": [3, 4, 5], "note": [11]}
    rest, taken, digests = trash.take_out(tables, keys, found)
    assert rows(rest["note"]) == [(10, 1), (12, None)] and rows(rest["page"], "page") == [(1,), (2,)]
    back = trash.put_back(rest, keys, taken, digests)
    assert all(rows(back[t]) == rows(tables[t]) for t in tables)
    with pytest.raises(ValueError):
        trash.put_back(tables, keys, taken, digests)
    with pytest.raises(ValueError):
        trash.put_back(rest, keys, taken | {"note": taken["note"].withColumn("page", taken["note"].note)}, digests)
    assert all(df.count() == 0 for df in trash.hanging(tables, keys, links, {}).values())


def test_bases_are_switched_and_the_old_one_stays(spark, tmp_path, rows):
    for name, n in (("a", 1), ("b", 2)):
        files.snapshot({"t": spark.createDataFrame([(n,)], "x int")}, str(tmp_path / name))
    pointer = str(tmp_path / "pointer")
    assert files.current_base(spark, pointer) is None and files.switch_base(spark, str(tmp_path / "a"), pointer) is None
    assert files.switch_base(spark, str(tmp_path / "b"), pointer) == str(tmp_path / "a")
    assert rows(files.restore(spark, files.current_base(spark, pointer))["t"]) == [(2,)] and rows(files.restore(spark, str(tmp_path / "a"))["t"]) == [(1,)]
    with pytest.raises(Exception):  # noqa: B017
        files.switch_base(spark, str(tmp_path / "none"), pointer)
    assert files.current_base(spark, pointer) == str(tmp_path / "b")


def test_people_settle_what_found_no_field(spark, rows):
    outcomes = spark.createDataFrame([(1, 7, "applied"), (2, None, "not_found"), (3, 8, "ambiguous"), (4, None, "not_found")], "decision_id int, field_id int, outcome string")
    choices = spark.createDataFrame([(1, "discard", None, 1), (2, "discard", None, 1), (2, "reassign", 9, 2), (3, "discard", None, 1)], "decision_id int, choice string, field_id int, choice_id int")
    assert rows(decisions.settle(outcomes, choices)) == [(1, 7, "applied"), (2, 9, "reassigned"), (3, None, "discarded"), (4, None, "pending")]
