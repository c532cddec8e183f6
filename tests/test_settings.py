"""Presets, sessions, swatches, plates."""

from pyspark.sql import functions as F

from dotgrain.functions import params
from dotgrain.operators import records
from dotgrain.plans import render
from dotgrain.sources import codecs, images, settings


def test_presets_and_session(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    none = settings.load_presets(spark, a)
    assert none.count() == 0 and settings.load_session(spark, a) is None
    two = settings.put_preset(settings.put_preset(none, "x", {"density": 20}), "y", {})
    settings.save_presets(two, a)
    settings.save_presets(settings.put_preset(settings.load_presets(spark, a), "x", {"density": 30}), b)
    got = {r.name: params.sanitized(__import__("json").loads(r.params))["density"] for r in settings.load_presets(spark, b).collect()}
    assert got == {"x": 30, "y": 90}
    (tmp_path / "a" / "bad.json").write_text("{not json\n")
    assert settings.load_presets(spark, a).count() == 2
    settings.save_session(spark, f"{a}s", {"density": 1e9, "what": 1}, {"height": 3})
    got = settings.load_session(spark, f"{a}s")
    assert got["params"]["density"] == 400 and got["ui"] == {"height": 3} and got["version"] == params.VERSION


def test_swatches():
    assert params.with_locked(["#1", "#2", "#3"], ["#A", "#B"], [1, 2]) == ["#1", "#B", "#3"]
    assert params.padded(["#1"], 3) == ["#1"] * 3 and params.padded([], 2) == ["#808080"] * 2 and params.padded(["#1", "#2"], 1) == ["#1"]
    assert params.same({"density": 90, "nothing": 1}, {}) and not params.same({"density": 91}, {})


def test_deep_trees_are_whole(spark):
    n = 60
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit(0).alias("ord"), F.lit("group").alias("kind"), F.lit("g").alias("name"))
    assert records.tree(chain).agg(F.max("depth")).first()[0] == n - 1


def test_exported_plates(spark):
    px = images.flats(spark, 40, 30)
    got = render.export_plates(px, {"palette": ["#161616", "#EC3E32", "#F5EBD8"], "spread": 0, "density": 10, "screenMode": "perInk"}, "a/b").collect()
    assert sorted(r.file for r in got) == ["ab plate 1 161616.png", "ab plate 2 EC3E32.png"]
    for r in got:
        p = codecs.decode_png(bytes(r.png))
        assert p.shape[:2] == (30, 40) and (p[..., 0] == p[..., 1]).all() and p[..., 0].min() < 255
