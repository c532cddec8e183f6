"""Properties of the operators: bounds that hold for any right implementation."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotgrain.functions import color, geometry, matrices, params, tone
from dotgrain.functions.kernels import KERNELS
from dotgrain.operators import blur, cells, dither, palette, raster, records, separation
from dotgrain.sources import codecs, images

CMYK = [(26, 23, 27), (0, 158, 224), (230, 0, 126), (255, 237, 0)]
WHITE = (255, 255, 255)
BW = [(0, 0, 0), WHITE]


@pytest.mark.parametrize("name", list(matrices.ORDERED))
def test_matrices_are_even(name):
    m = matrices.ORDERED[name]()
    assert m.min() > 0 and m.max() < 1 and abs(m.mean() - 0.5) < 0.02
    if name.startswith(("bayer", "cluster", "blue")):
        assert len(np.unique(m)) == m.size


@pytest.mark.parametrize("name", list(KERNELS))
def test_diffusion_keeps_tone(name):
    for level in (32, 96, 160, 224):
        idx = dither.diffuse(np.full((40, 40, 3), float(level)), BW, name)
        assert abs(idx.mean() - level / 255) <= (0.13 if name == "atkinson" else 0.03)


@pytest.mark.parametrize("name", ["bayer2", "bayer4", "bayer8", "cluster45", "bluenoise"])
def test_ordered_keeps_tone(spark, name):
    px = images.gradient(spark, 256, 32)
    rows = dither.ordered(px, BW, name).groupBy(F.floor(F.col("x") / 32).alias("band")).agg(F.avg("idx").alias("v")).collect()
    m = matrices.ORDERED[name]()
    for r in rows:
        assert abs(r["v"] - (r["band"] * 32 + 15.5) / 255) <= 1 / (2 * len(np.unique(m))) + 0.02


def test_unknown_dither_is_floyd_steinberg(spark):
    px = images.gradient(spark, 24, 8)
    assert dither.dither(px, BW, "nothing").exceptAll(dither.dither(px, BW, "floydsteinberg")).count() == 0


@pytest.mark.parametrize(("method", "most"), [("kmeans", 0.02), ("popularity", 0.02), ("mediancut", 0.15)])
def test_quantisers_find_flat_colours(spark, method, most):
    px = images.flats(spark, 100, 40)
    found = [tuple(r) for r in palette.extract(px, 100, 40, 5, method).orderBy("idx").select("r", "g", "b").collect()]
    for c in images.FLATS:
        assert min(math.dist(palette.lab(c), palette.lab(f)) for f in found) < most
    assert found == sorted(found, key=palette.luma709)


def test_palette_padding_and_ink():
    assert len(palette.pad([(0, 0, 0)], 5)) == 5
    assert palette.pad(BW, 2) == BW
    assert palette.ink_palette([*CMYK, (250, 250, 250)], WHITE) == CMYK
    assert palette.ink_palette(CMYK, WHITE) == CMYK


def test_unmix_resolves_inks():
    cov = separation.unmix(np.array(CMYK, float), CMYK, WHITE)
    for i, row in enumerate(cov):
        assert row[i] > 0.9 and all(v < 0.1 for k, v in enumerate(row) if k != i)
    assert np.allclose(separation.unmix(np.array([WHITE], float), CMYK, WHITE), 0)
    assert geometry.screen_angles(4) == [45, 15, 75, 0]


def test_unmix_is_never_worse_than_nothing():
    r = np.random.default_rng(1)
    rgb = r.integers(0, 256, (50, 3)).astype(float)
    a, b = separation.basis(CMYK, WHITE), separation.density(rgb)
    cost = lambda x: 0.5 * ((x @ a.T - b) ** 2).sum(1) + 0
    assert (cost(separation.unmix(rgb, CMYK, WHITE)) <= cost(np.zeros((50, 4))) + 1e-9).all()


def test_masks_sum_to_full(spark):
    px = images.flats(spark, 60, 40)
    grid = cells.Grid.make(60, 40, 12, 20)
    d = raster.dots(cells.aggregate(px, grid), grid, tone.tone_lut(), radius=140).withColumn("idx", (F.col("ord") % 3).cast("int"))
    s = raster.stamp(d, "circle", grid.cell, 60, 40, ("image_id", "ord", "idx"))
    m = raster.exclusive_masks(s, 4, 3).groupBy("x", "y").agg(F.sum("v").alias("v"))
    assert m.where(F.abs(F.col("v") - 255) > 3).count() == 0


@pytest.mark.parametrize("shape", list(geometry.SHAPES))
def test_shapes_cover_their_area(spark, shape):
    one = spark.createDataFrame([("i", 0, 30.2, 29.7, 8.0, 0.3)], "image_id string, ord long, cx double, cy double, radius double, rot double")
    got = raster.stamp(one, shape, 20.0, 60, 60).agg(F.sum("a")).first()[0]
    want = one.select(geometry.area(shape, F.col("radius"))).first()[0]
    assert abs(got - want) < 0.06 * want
    far = one.select(geometry.extent(shape, F.col("radius"), 20.0)).first()[0]
    assert raster.stamp(one, shape, 20.0, 60, 60).where((F.hypot(F.col("x") + 0.5 - 30.2, F.col("y") + 0.5 - 29.7) > far + 1.5)).count() == 0


def test_tiny_dots_keep_their_area(spark):
    one = spark.createDataFrame([("i", 0, 10.3, 11.8, 0.3, 0.0)], "image_id string, ord long, cx double, cy double, radius double, rot double")
    assert abs(raster.stamp(one, "circle", 4.0, 60, 60).agg(F.sum("a")).first()[0] - math.pi * 0.09) < 1e-9


def test_blur_leaves_flat_fields_and_alpha(spark):
    px = images.solid(spark, 20, 16, (10, 200, 77, 90))
    for out in (blur.gaussian(px, 20, 16, 3), blur.unsharp(px, 20, 16, 80, 2), blur.denoise(px, 20, 16, 60), blur.preprocess(px, 20, 16, 50, 10, 50)):
        assert out.exceptAll(px.select(*out.columns)).count() == 0
    assert blur.gaussian(px, 20, 16, 0.01) is px


def test_blur_against_numpy(spark):
    px = images.gradient(spark, 30, 5)
    got = {(r.x, r.y): r.r for r in blur.box(px, "x", 30, 4).collect()}
    line = np.array([math.floor(x * 255 / 29 + 0.5) for x in range(30)], float)
    padded = np.pad(line, 4, mode="edge")
    for x in range(30):
        assert abs(got[x, 2] - padded[x : x + 9].mean()) < 1e-9


def test_grid_covers_and_scales():
    for angle in (0, 15, 45, 75):
        g = cells.Grid.make(640, 480, 90, angle)
        assert g.cols * g.cell >= 640 * abs(g.cos) + 480 * abs(g.sin) - 1e-6
        assert (s := g.scaled(1280, 960)).cols == g.cols and abs(s.cell - 2 * g.cell) < 1e-9


def test_transparent_pixels_have_no_cells(spark):
    px = images.with_alpha(spark, 40, 20)
    grid = cells.Grid.make(40, 20, 10)
    assert cells.aggregate(px, grid).agg(F.max("col")).first()[0] < grid.cols / 2
    assert cells.aggregate(px.limit(0), grid).count() == 0


def test_curves():
    assert tone.normalise_curve([[2, -1], [0.5, 0.5], [0.5, 0.9], ["x", "y"], None]) == [(0.5, 0.5), (1.0, 0.0)]
    for points in ([(0, 0), (0.3, 0.1), (0.7, 0.9), (1, 1)], [(0, 0), (0.5, 0.5), (0.51, 0.95), (1, 1)], [(0, 1), (1, 0)]):
        values = [tone.eval_curve(points, i / 500) for i in range(501)]
        steps = [b - a for a, b in zip(values, values[1:], strict=False)]
        assert all(s >= -1e-12 for s in steps) or all(s <= 1e-12 for s in steps)
        assert all(0 <= v <= 1 for v in values)
    assert tone.is_identity_lut(tone.tone_lut()) and not tone.is_identity_lut(tone.tone_lut(gamma=2))


def test_params():
    got = params.sanitized({"density": 1e9, "radius": -50, "shape": "hexagon", "palette": ["#fff", "zzz"], "other": 1})
    assert (got["density"], got["radius"], got["shape"], got["palette"]) == (400, 0, "circle", ("#FFFFFF",))
    assert "other" not in got and len(params.PARAMS) == 52 and len(matrices.ALGORITHMS) == 24
    assert params.sanitized({"blackPoint": 200, "whitePoint": 100})["whitePoint"] == 201
    base = {**params.DEFAULTS, "scaleMode": "dpi", "dpi": 150}
    assert params.resolution(base, 3000, 300) == 400 and params.resolution({**base, "dpi": 20}, 3000, 300) == 200
    assert params.resolution({**base, "mode": "dither", "dpi": 100}, 2000, 200) == 1000


def test_png():
    r = np.random.default_rng(2)
    for h, w in ((1, 1), (3, 2), (5, 17), (30, 40)):
        for alpha in (False, True):
            p = r.integers(0, 256, (h, w, 4)).astype(np.uint8)
            if not alpha:
                p[..., 3] = 255
            assert (codecs.decode_png(codecs.encode_png(p)) == p).all()
    assert zlib.adler32(b"abc") == 0x024D0127


def test_swatches(spark, tmp_path):
    colours = [(22, 22, 22), (245, 235, 216), (236, 62, 50)]
    many = [(i % 256, i // 2, 7) for i in range(300)]
    assert codecs.decode_act(codecs.encode_act(colours)) == colours and len(codecs.decode_act(codecs.encode_act(many))) == 256
    assert codecs.decode_ase(codecs.encode_ase(colours)) == colours and len(codecs.decode_ase(codecs.encode_ase(many))) == 300
    with pytest.raises(ValueError):
        codecs.decode_act(b"short")
    (tmp_path / "a.act").write_bytes(codecs.encode_act(colours))
    (tmp_path / "b.ase").write_bytes(codecs.encode_ase(colours))
    assert codecs.palette_files(spark, str(tmp_path)).count() == 6


def test_embedded_records(spark):
    texts = [(codecs.build_xmp({"renderId": "HT-0011AABB", "version": 2}),), ("<x/>",), ('hts:payload="%%%"',), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(codecs.parse_xmp(F.col("t"), "renderId string, version int")).collect()]
    assert got[0].renderId == "HT-0011AABB" and got[0].version == 2
    assert all(g is None or g.renderId is None for g in got[1:])
    one = spark.createDataFrame([("a", "b")], "x string, y string").select(records.render_id(F.col("x"), F.col("y")).alias("i"))
    assert one.select(records.parse_render_id(F.concat(F.lit("layer "), F.col("i"), F.lit("!"))) == F.col("i")).first()[0]


def test_colour_round_trips(spark):
    r = random.Random(3)
    df = spark.createDataFrame([tuple(r.randrange(256) for _ in range(3)) for _ in range(300)], "r int, g int, b int")
    rgb = tuple(map(F.col, "rgb"))
    for back in (color.oklab_to_rgb(color.rgb_to_oklab(rgb)), color.from_hex(color.to_hex(rgb)), color.hsl_to_rgb(color.rgb_to_hsl(rgb))):
        assert df.where(sum((F.abs(a - b) for a, b in zip(rgb, back, strict=True)), F.lit(0)) > 2).count() == 0
    assert color.adjust(df) is df
    bad = spark.createDataFrame([("#12345",), ("xyz",), ("#ABC",)], "h string").select(color.normalize_hex(F.col("h"))).collect()
    assert [b[0] for b in bad] == [None, None, "#AABBCC"]


def test_widen_rejects(spark):
    with pytest.raises(Exception, match="1, 3 or 4"):
        images.widen(images.solid(spark, 2, 2), F.lit(2)).collect()


def test_white_noise_values():
    from dotgrain.functions import matrices

    m = matrices.white_noise()
    assert m.shape == (32, 32) and 0 <= m.min() and m.max() <= 1 and abs(m.mean() - 0.5) < 0.03
    # n steps of a congruential sequence in closed form: s * a^n + c * (a^n - 1) / (a - 1)
    a, c, k = 1664525, 1013904223, 1 << 32
    for n in (1, 2, 33, 1024):
        power = pow(a, n, k * (a - 1))
        s = (0x9E3779B9 * power + c * ((power - 1) // (a - 1))) % k
        assert abs(m.reshape(-1)[n - 1] - (s >> 8) / 0xFFFFFF) < 1e-7
