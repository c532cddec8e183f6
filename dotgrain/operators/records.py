"""Render records, layers, batches, presets and parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import params

KEPT = 400
LEVELS = 1000


def render_id(*parts: Column) -> Column:
    """HT- and eight hex digits, from what is rendered: the same input gets the same id."""
    return F.concat(F.lit("HT-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8)))


def parse_render_id(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"HT-[0-9A-F]{8}", 0), F.lit(""))


def upsert(records: DataFrame, kept: int = KEPT) -> DataFrame:
    """The last record of each render_id (by updated_at, then seq), and of these the newest."""
    last = records.groupBy("render_id").agg(F.max_by(F.struct(*records.columns), F.struct("updated_at", "seq")).alias("r")).select("r.*")
    return last.orderBy(F.desc("updated_at"), "render_id").limit(kept)


def load(ids: DataFrame, embedded: DataFrame, sidecar: DataFrame) -> DataFrame:
    """render_id, payload, origin: what is embedded in any layer, the first in order, comes before the sidecar."""
    first = embedded.groupBy("render_id").agg(F.min_by("payload", "ord").alias("e"))
    out = ids.join(first, "render_id", "left").join(sidecar.select("render_id", F.col("payload").alias("s")), "render_id", "left")
    origin = F.when(F.col("e").isNotNull(), "embedded").when(F.col("s").isNotNull(), "sidecar")
    return out.select("render_id", F.coalesce("e", "s").alias("payload"), origin.alias("origin"))


def tree(layers: DataFrame) -> DataFrame:
    """layers (id, parent_id, ord, kind, name) with depth, path (zero-filled orders, so it sorts in pre-order) and
    inside: whether an ancestor is an output group. A recursive query, without a limit of rows; a tree of over LEVELS
    levels is an error."""
    spark: SparkSession = layers.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(LEVELS))
    view = f"layers_{uuid.uuid4().hex}"
    layers.createOrReplaceTempView(view)
    walked = spark.sql(f"""WITH RECURSIVE walk AS (
      SELECT id, parent_id, kind, name, 0 AS depth, lpad(CAST(ord AS STRING), 8, '0') AS path, false AS inside FROM {view} WHERE parent_id IS NULL
      UNION ALL
      SELECT c.id, c.parent_id, c.kind, c.name, w.depth + 1, concat(w.path, '/', lpad(CAST(c.ord AS STRING), 8, '0')), w.inside OR (w.kind = 'group' AND w.name LIKE 'HT-%')
      FROM {view} c JOIN walk w ON c.parent_id = w.id) SELECT * FROM walk""")
    spark.catalog.dropTempView(view)
    return walked


def bounds(layers: DataFrame, width: int, height: int) -> DataFrame:
    """layers with left, top, right, bottom: widened to whole pixels and cut to the canvas; the whole canvas for a layer
    without bounds, or with none of its area on the canvas."""
    edge = {
        "left": F.greatest(F.lit(0), F.floor("left")), "top": F.greatest(F.lit(0), F.floor("top")),
        "right": F.least(F.lit(width), F.ceil("right")), "bottom": F.least(F.lit(height), F.ceil("bottom")),
    }
    known = F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("right").isNotNull() & F.col("bottom").isNotNull()
    some = known & (edge["right"] - edge["left"] >= 1) & (edge["bottom"] - edge["top"] >= 1)
    whole = {"left": 0, "top": 0, "right": width, "bottom": height}
    return layers.withColumns({k: F.when(some, v).otherwise(whole[k]).cast("long") for k, v in edge.items()})


def preview(targets: DataFrame) -> DataFrame:
    """count and names (in their order) of what a batch would touch; one row, also for none."""
    named = F.transform(F.array_sort(F.collect_list(F.struct("path", "name"))), lambda s: s["name"])
    return targets.agg(F.count(F.lit(1)).alias("count"), named.alias("names"))


def leaves(walked: DataFrame) -> DataFrame:
    return walked.where("kind <> 'group' and not inside")


OWN_KINDS = ("fill", "gradient", "pattern", "adjustment")


def batch_targets(walked: DataFrame) -> DataFrame:
    """Layers that a batch works on: pixels, not the engine's own output, not below an output group."""
    return walked.where(~F.col("kind").isin("group", *OWN_KINDS) & ~F.col("inside") & ~F.col("name").startswith("HT-"))


def presets(builtin: DataFrame, own: DataFrame) -> DataFrame:
    """All of both; a preset of the user's that has a built-in one's name takes its place."""
    return builtin.join(own, "name", "left_anti").unionByName(own)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_name(name: Column) -> Column:
    """A file's name: none of the characters that file systems refuse, 60 at most, never empty."""
    clean = F.substring(F.trim(F.regexp_replace(name, r'[\\/:*?"<>|]', "")), 1, 60)
    return F.when(clean == "", "untitled").otherwise(clean)


def sanitize(raw: DataFrame) -> DataFrame:
    """Columns of raw settings (strings) that are known parameters, coerced, clamped and completed; others stay."""
    out = {}
    for p in params.PARAMS:
        if p.key not in raw.columns:
            continue
        given = F.col(p.key)
        if p.kind == "number":
            value = F.expr(f"try_cast({p.key} AS double)")
            value = F.when(F.isnan(value), None).otherwise(value)
            out[p.key] = F.coalesce(F.greatest(F.lit(float(p.low)), F.least(F.lit(float(p.high)), value)), F.lit(float(p.default)))
        elif p.kind == "enum":
            out[p.key] = F.when(given.isin(*p.choices), given).otherwise(p.default)
        elif p.kind == "bool":
            out[p.key] = F.coalesce(F.expr(f"try_cast({p.key} AS boolean)"), F.lit(p.default))
    df = raw.withColumns(out)
    repaired = {}
    if {"blackPoint", "whitePoint"} <= out.keys():
        repaired["whitePoint"] = F.when(F.col("whitePoint") <= F.col("blackPoint"), F.least(F.lit(255.0), F.col("blackPoint") + 1)).otherwise(F.col("whitePoint"))
    if {"shadowSplit", "highlightSplit"} <= out.keys():
        repaired["highlightSplit"] = F.when(F.col("highlightSplit") <= F.col("shadowSplit"), F.least(F.lit(0.95), F.col("shadowSplit") + 0.05)).otherwise(F.col("highlightSplit"))
    if "colorCount" in out:
        repaired["colorCount"] = F.floor(F.col("colorCount") + 0.5).cast("double")
    return df.withColumns(repaired) if repaired else df


