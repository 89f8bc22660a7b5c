"""Problems 2 and 3: crops that must not part, and strips of neighbouring sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import assign_splits, hash_to_min, hook_and_shortcut, star, union_all
from .fields import image_number, site_codes

#: Image heights that a session can have, in pixels.
SESSION_PX = (1400, 2400)


def crop_ties(spots: DataFrame, design: DataFrame) -> DataFrame:
    """Edges between crops that share a source image (by number) or a scope and session height.

    Every crop is tied to the smallest crop of its key, so a key held by a third of all crops costs one edge for each of them.
    Texts without an image number, null scopes and heights outside SESSION_PX tie nothing.
    """
    images = design.select("crop", image_number(F.col("groups")).alias("k")).unionByName(
        spots.select(F.col("spot").alias("crop"), image_number(F.col("legacy_id")).alias("k")))
    scope = F.trim("scope")
    sessions = spots.where(F.col("session_px").between(*SESSION_PX) & (scope != "")).select(F.col("spot").alias("crop"), scope.alias("scope"), "session_px")
    return union_all(
        star(images.where("k IS NOT NULL AND crop IS NOT NULL").distinct(), "k", "crop"),
        star(sessions.where("crop IS NOT NULL").distinct(), ["scope", "session_px"], "crop"),
    )


def tied_crops(spots: DataFrame, design: DataFrame) -> DataFrame:
    """(crop, group_id) for each crop that is tied to another one; group_id is the smallest crop of the group."""
    return hook_and_shortcut(crop_ties(spots, design)).select(F.col("id").alias("crop"), "group_id")


def crop_splits(spots: DataFrame, design: DataFrame, shares: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """(crop, group_id, split) for every crop of design; crops tied to none are groups of their own."""
    crops = design.where("crop IS NOT NULL").select(F.col("crop").alias("id")).distinct()
    tied = tied_crops(spots, design).withColumnRenamed("crop", "id")
    members = crops.join(tied, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
    return assign_splits(members, shares).withColumnRenamed("id", "crop")


def site_links(strips: DataFrame, analysis: DataFrame) -> DataFrame:
    """Edges between sites: named neighbours (any delivery of a row counts) and following chain numbers of one image.

    Sites that share a chain number are each tied to the smallest site of the next and of the previous number, which links
    the same sites as all pairs would.
    """
    named = union_all(
        strips.select("site", F.explode(site_codes(F.col("left_neighbour"))).alias("other")),
        strips.select("site", F.explode(site_codes(F.col("right_neighbour"))).alias("other")),
        analysis.select("site", F.explode(site_codes(F.col("right_neighbour"))).alias("other")),
    ).distinct()
    sites = strips.select("site").union(analysis.select("site")).where("site IS NOT NULL").distinct()
    named = named.join(sites.withColumnRenamed("site", "other"), "other", "left_semi").select(F.col("site").alias("src"), F.col("other").alias("dst"))
    chain = analysis.where("source_image IS NOT NULL AND chain_order IS NOT NULL AND site IS NOT NULL").select("site", "source_image", F.col("chain_order").cast("bigint").alias("o")).distinct()
    first = chain.groupBy("source_image", "o").agg(F.min("site").alias("dst"))
    beside = first.select("source_image", F.explode(F.array(F.col("o") - 1, F.col("o") + 1)).alias("o"), "dst")
    return named.unionByName(chain.join(beside, ["source_image", "o"]).select(F.col("site").alias("src"), "dst"))


def strips_of_sites(strips: DataFrame, analysis: DataFrame) -> DataFrame:
    """(site, group_id) for each site that is linked to another one, directly or through others."""
    return hash_to_min(site_links(strips, analysis)).select(F.col("id").alias("site"), "group_id")
