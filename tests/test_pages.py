"""Pages from ranges against slices of a sorted list."""

import random
import shutil

import pytest

from logweir.operators.pages import Pages

rng = random.Random(5)
ROWS = [(rng.choice([None, "a", "b", "c", "hot", "hot", "hot"]), i, i * 7) for i in range(500)]


@pytest.mark.parametrize("descending", [False, True])
def test_pages_and_cursors(spark, tmp_path, descending):
    rows = ROWS[:]
    rng.shuffle(rows)
    pages = Pages.write(spark.createDataFrame(rows, "kind string, id long, last long"), f"file://{tmp_path}/p", ["kind", "id"], 9, descending)
    want = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or "", r[1]), reverse=descending)
    assert pages.total() == 500
    for number in (0, 1, 7, 12, 13):
        got = [tuple(r) for r in pages.page(number, 40).collect()]
        assert got == want[number * 40 : number * 40 + 40]
    for k in (0, 39, 250, 480, 499):
        assert [tuple(r) for r in pages.after(want[k][:2], 33).collect()] == want[k + 1 : k + 34]
    between = [r for r in want if (r[0] or "") > "bb"] if not descending else [r for r in want if r[0] is None or r[0] < "bb"]
    assert [tuple(r) for r in pages.after(["bb", 0], 10).collect()] == between[:10]


def test_a_page_reads_its_range_only(spark, tmp_path):
    pages = Pages.write(spark.range(10_000).toDF("id"), f"file://{tmp_path}/p", ["id"], 20)
    far = pages.page(999, 10)
    assert [r.id for r in far.collect()] == list(range(9990, 10_000))
    folders = sorted((tmp_path / "p" / "rows").glob("page_range=*"), key=lambda d: int(d.name.split("=")[1]))
    assert len(folders) == 20
    for other in folders[:-1]:
        shutil.rmtree(other)
    assert [r.id for r in pages.page(999, 10).collect()] == list(range(9990, 10_000))
    assert [r.id for r in pages.after([9994], 3).collect()] == [9995, 9996, 9997]


def test_empty_and_odd(spark, tmp_path):
    none = Pages.write(spark.createDataFrame([], "id long"), f"file://{tmp_path}/p", ["id"], 4)
    assert none.total() == 0 and none.page(0, 5).count() == 0 and none.after([3], 5).count() == 0
    with pytest.raises(ValueError):
        Pages.write(spark.createDataFrame([], "id long, Page_Range int"), f"file://{tmp_path}/q", ["id"], 4)
    with pytest.raises(ValueError):
        none.page(-1, 5)
    with pytest.raises(ValueError):
        none.after([3, 4], 5)
