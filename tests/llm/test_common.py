from pathlib import Path

from plumbline.llm import common


def test_stored_leaves_little_to_the_driver(spark, monkeypatch):
    """One folder of data files alone, and the driver's freed memory goes back after each table."""
    trims, trim = [], common.trim_driver
    monkeypatch.setattr(common, "trim_driver", lambda s: trims.append(trim(s)))
    back = common.stored(spark.range(10), "ten")
    assert back.count() == 10 and len(trims) == 1
    files = [Path(f.removeprefix("file://")) for f in back.inputFiles()]
    assert files[0].parent.parent == Path(common.shared_dir(spark).removeprefix("file://"))
    assert {p.name for p in files[0].parent.iterdir() if not p.name.startswith(".")} == {p.name for p in files}


def test_a_driver_that_cannot_trim_goes_on(spark, monkeypatch):
    common.trim_driver(spark)

    class Broken:
        def __getattr__(self, name):
            raise common.Py4JError("no such class")

    monkeypatch.setattr(type(spark.sparkContext), "_jvm", Broken())
    common.trim_driver(spark)
