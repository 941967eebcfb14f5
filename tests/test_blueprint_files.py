from pathlib import Path


def test_blueprint_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries
    from itemloom.plans import tables

    monkeypatch.setattr(tables, "work_path", lambda spark, name: f"{tmp_path}/{name}")
    rows = queries()["blueprint_scan"](spark, "/root/testdata/sf0.01")
    files = [p.name for p in Path(tmp_path, "blueprints/blueprints").glob("part-*.json")]
    assert len(files) * 3 == rows.count() == 300
    assert len({name.split("-")[1] for name in files}) > 4
