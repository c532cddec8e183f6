"""Whole renderings."""

import pytest
from pyspark.sql import functions as F

from dotgrain.plans import presets, render
from dotgrain.sources import images


def density(df):
    return df.agg(F.avg(765 - F.col("r") - F.col("g") - F.col("b"))).first()[0] / 765


def test_black_and_white(spark):
    bw = {"palette": ["#000000", "#FFFFFF"], "spread": 0, "density": 12, "background": "#FFFFFF", "radius": 150}
    white = render.render(images.solid(spark, 48, 36, (255, 255, 255, 255)), bw)
    assert white.count() == 48 * 36 and density(white) < 0.01
    assert density(render.render(images.solid(spark, 48, 36), bw)) > 0.95
    grey = [density(render.render(images.solid(spark, 48, 36, (v, v, v, 255)), {**bw, "radius": 112})) for v in (64, 128, 192)]
    assert grey[0] > grey[1] > grey[2]
    small, large = (density(render.render(images.solid(spark, 48, 36, (128, 128, 128, 255)), bw, out)) for out in ((48, 36), (96, 72)))
    assert abs(small - large) < 0.02


@pytest.mark.parametrize("name", ["offset-cmyk", "zone-poster", "rgb-pop"])
def test_presets_render(spark, name):
    px = images.flats(spark, 40, 30)
    out = render.render(px, {**presets.find(name), "density": 10, "ditherResolution": 40})
    assert out.count() == 1200 and out.where("r is null or r < 0 or r > 255").count() == 0


def test_plates_recompose(spark):
    px = images.flats(spark, 40, 30)
    p = {"palette": ["#161616", "#EC3E32", "#F5EBD8"], "spread": 0, "density": 10}
    masks = render.plates(px, p)
    assert masks.groupBy("x", "y").agg(F.sum("v").alias("s")).where("abs(s - 255) > 4").count() == 0
    value = lambda k: F.sum(F.col("v") * F.conv(F.substring("hex", k, 2), 16, 10).cast("int") / 255)
    again = masks.groupBy("x", "y").agg(value(2).alias("r2"), value(4).alias("g2"), value(6).alias("b2"))
    off = render.render(px, p).join(again, ["x", "y"]).where("abs(r - r2) > 4 or abs(g - g2) > 4 or abs(b - b2) > 4")
    assert off.count() == 0


def test_svg_and_batch(spark):
    px = images.gradient(spark, 40, 30)
    doc = render.render_svg(px, {"density": 10}).first()
    assert doc.svg.count("<circle") == doc.shapes and not doc.busy
    with pytest.raises(ValueError, match="vector"):
        render.render_svg(px, {"mode": "dither"})
    got = render.batch({"a": px, "bad": px.drop("r"), "b": px}, {"density": 8})
    assert [e is None for _, _, e in got] == [True, False, True] and got[2][1].count() == 1200
    assert len(presets.BUILTIN) == 13 and presets.find("Comic")["contrast"] == 1.45


def test_screens_per_ink(spark):
    px = images.flats(spark, 40, 30)
    p = {"palette": ["#161616", "#EC3E32", "#2A6FDB", "#F5EBD8"], "spread": 0, "density": 10, "screenMode": "perInk", "angle": 20}
    masks = render.plates(px, p)
    paper = masks.where("hex = '#F5EBD8'")
    assert paper.count() == 1200 and paper.where("v <> 255").count() == 0
    assert masks.where("v < 0 or v > 255 or blend <> 'multiply'").count() == 0 and 2 <= masks.select("plate").distinct().count() <= 4
    doc = render.render_svg(px, p).first()
    assert doc.svg.startswith("<?xml") and 'fill="#F5EBD8"/>' in doc.svg and doc.svg.count("<circle") == doc.shapes
    assert doc.svg.index('id="screen-0-') < doc.svg.index('id="screen-1-') and 'data-angle="65"' in doc.svg
    plain, slipped = (render.render(px, {**p, **more}) for more in ({}, {"misregistration": 80}))
    assert plain.count() == 1200 and plain.exceptAll(slipped).count() > 0
    noise = render.render(px, {**p, "screenType": "fm", "jitterSize": 50, "edgeAware": True, "hue": 40})
    assert noise.count() == 1200 and noise.where("r is null or r < 0 or r > 255").count() == 0


def test_screens_read_their_own_noise(spark):
    from dotgrain.functions.matrices import blue_noise
    from dotgrain.operators import cells, raster

    grid = cells.Grid.make(40, 40, 10, 0)
    cov = images.blank(spark, 10, 10).select(F.lit("a").alias("image_id"), F.col("x").alias("col"), F.col("y").alias("row"), F.lit(0.4).alias("cov"))
    for rank in (0, 2):
        got = {(r.row, r.col) for r in raster.ink_dots(cov, grid, rank, fm=True).collect()}
        assert got == {(y, x) for y in range(10) for x in range(10) if blue_noise()[(y + rank * 97) % 64, x % 64] < 0.4}
