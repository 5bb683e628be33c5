"""Stores in the session's catalog."""

import os

import pytest

from logweir.sources.catalogue import Catalogue, safe_name


@pytest.fixture
def folder(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS kind").write.parquet(str(tmp_path / "first" / "events.parquet"))
    spark.range(0).selectExpr("id", "'x' AS note").write.parquet(str(tmp_path / "first" / "none.parquet"))
    spark.range(5).selectExpr("id AS `a b`").write.orc(str(tmp_path / "first" / "it's 1.orc"))
    (tmp_path / "first" / "readme.txt").write_text("passed over")
    spark.range(3).write.parquet(str(tmp_path / "other" / "events.parquet"))
    return tmp_path


@pytest.fixture
def catalogue(spark, folder):
    made = Catalogue(spark, str(folder / "first"), prefix="t_")
    yield made
    made.close()
    assert not spark.sql("SHOW NAMESPACES LIKE 't_*'").collect()
    assert os.path.isdir(folder / "first" / "events.parquet")


def test_names():
    assert [safe_name(n) for n in ("/a/My-Logs.parquet", "...", "x.y.orc", "Ünï", "/a/b/")] == ["mylogs", "store", "xy", "n", "b"]


def test_tables_from_metadata(spark, catalogue):
    rows = {r.table_name: r for r in catalogue.tables().collect()}
    assert {n: (r.format, r.n_columns, r.n_rows) for n, r in rows.items()} == {"events": ("parquet", 2, 1000), "none": ("parquet", 2, 0), "its1": ("orc", 1, 5)}
    assert all(r.n_bytes > 0 for r in rows.values())
    spark.sparkContext.setJobGroup("listing", "")
    catalogue.tables(), catalogue.stores()
    jobs = list(spark.sparkContext.statusTracker().getJobIdsForGroup("listing"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == []  # no file is read
    assert catalogue.table("events").where("kind = 0").count() == 143


def test_refresh(spark, folder, catalogue):
    spark.range(50).selectExpr("id", "id AS kind").write.mode("append").parquet(str(folder / "first" / "events.parquet"))
    old = {r.table_name: r.n_rows for r in catalogue.tables().collect()}
    catalogue.refresh()
    assert (old["events"], {r.table_name: r.n_rows for r in catalogue.tables().collect()}["events"]) == (1000, 1050)
    assert catalogue.table("events").count() == 1050


def test_stores(folder, catalogue):
    other, again = catalogue.add(str(folder / "other")), catalogue.add(str(folder / "other"))
    assert (other, again) == ("other", "other_2")
    assert [(r.store, r.is_default, r.deletable, r.n_tables) for r in catalogue.stores().collect()] == [("default", True, False, 3), ("other", False, True, 1), ("other_2", False, True, 1)]
    assert catalogue.table("events", other).count() == 3 and catalogue.table("events").count() == 1000
    assert catalogue.resolve().store == catalogue.resolve(" ").store == "default"
    catalogue.remove(other)
    with pytest.raises(ValueError, match="no store other"):
        catalogue.resolve(other)
    assert catalogue.resolve(again).location == str(folder / "other")
    os.rename(folder / "other", folder / "moved")
    with pytest.raises(FileNotFoundError):
        catalogue.tables(again)
    with pytest.raises(ValueError, match="default"):
        catalogue.remove("default")
    with pytest.raises(ValueError, match="no table nope"):
        catalogue.table("nope")


def test_refused(spark, folder, catalogue):
    os.mkdir(folder / "bad")
    spark.range(3).write.parquet(str(folder / "bad" / "a.parquet"))
    (folder / "bad" / "b.parquet").write_bytes(b"no footer at all")
    with pytest.raises(ValueError, match="readable"):
        catalogue.add(str(folder / "bad"))
    with pytest.raises(FileNotFoundError):
        catalogue.add(str(folder / "nowhere"))
    os.mkdir(folder / "empty")
    assert catalogue.tables(catalogue.add(str(folder / "empty"))).count() == 0
    assert [r.store for r in catalogue.stores().collect()] == ["default", "empty"]


def test_search(spark, folder, catalogue):
    rows = [("a Valve", 1, None), (None, 2, "VALVE"), ("valve valve", 3, "valv"), ("", 4, "v%lve"), ("x" * 100_000 + "valve", 5, "")]
    spark.createDataFrame(rows, "text string, value int, `column.name` string").repartition(3).write.parquet(str(folder / "texts" / "t.parquet"))
    spark.createDataFrame(rows[:1] * 2, "text string, value int, note string").write.parquet(str(folder / "texts" / "same.parquet"))
    spark.range(3).write.parquet(str(folder / "texts" / "numbers.parquet"))
    store = catalogue.add(str(folder / "texts"))
    brute = [("t", c, v) for r in rows for c, v in (("text", r[0]), ("column.name", r[2])) if v and "valve" in v.lower()] + [("same", "text", "a Valve")] * 2
    assert sorted(tuple(r) for r in catalogue.search("vALve", store).collect()) == sorted(brute)
    assert [r.value for r in catalogue.search("v%l", store).collect()] == ["v%lve"]  # % is a plain character
    assert catalogue.search("nowhere", store).count() == 0
    with pytest.raises(ValueError):
        catalogue.search("", store)
