"""Themes of a knowledge base: which communities are offered, with which members, and how a run's themes are listed.

Nodes are rows of ``user_id, kb_id, community_id, canonical_id, canonical_text, mention_count``;
nodes without a community take no part. Where a knowledge base has no communities, it has no
rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import modularity, structure
from .model import KB

#: The share of the communities that are offered, and the most of them; members of each that a prompt names.
TOP_SHARE, TOP_MOST, PROMPT_MEMBERS = 0.05, 5, 30
COMMUNITY = [*KB, "community_id"]


def community_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.where("community_id is not null").groupBy(*COMMUNITY).agg(F.count("*").alias("size"))


def top_communities(nodes: DataFrame) -> DataFrame:
    """``user_id, kb_id, community_id, size`` of the largest twentieth of the communities, one to five; ties go to the smaller id."""
    w = Window.partitionBy(*KB)
    s = community_sizes(nodes).withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("size"), "community_id")))
    most = F.least(F.lit(TOP_MOST), F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(TOP_SHARE))))
    return s.where(F.col("r") <= most).drop("n", "r")


def prompt_members(nodes: DataFrame, offered: DataFrame, most: int = PROMPT_MEMBERS) -> DataFrame:
    """``user_id, kb_id, community_id, members``: the most mentioned members of each offered community, ``most`` at most; ties go to the smaller id.

    Members are ranked before they are collected, so that a list never holds more than that.
    """
    w = Window.partitionBy(*COMMUNITY).orderBy(F.desc("mention_count"), "canonical_id")
    n = nodes.join(offered.select(*COMMUNITY), COMMUNITY, "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return n.groupBy(*COMMUNITY).agg(F.sort_array(F.collect_list(F.struct("r", "canonical_text")))["canonical_text"].alias("members"))


def saved_themes(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The themes of a run (``user_id, kb_id, community_id, label``) with ``entity_count`` and ``place``, largest community first, then by id.

    Sizes are those of the nodes now; a theme whose community is gone counts none.
    """
    t = parsed.join(community_sizes(nodes), COMMUNITY, "left").withColumn("entity_count", F.coalesce("size", F.lit(0).cast("long"))).drop("size")
    return t.withColumn("place", F.row_number().over(Window.partitionBy(*KB).orderBy(F.desc("entity_count"), "community_id")))


def described(nodes: DataFrame, g: DataFrame) -> DataFrame:
    """``user_id, kb_id, nodes, communities, modularity, structure`` of each knowledge base; nodes without a community count as nodes."""
    n = nodes.groupBy(*KB).agg(F.count("*").alias("nodes"), F.countDistinct("community_id").alias("communities"))
    j = n.join(modularity(nodes.where("community_id is not null"), g), KB, "left").na.fill(0.0, ["modularity"])
    return j.withColumn("structure", structure(F.col("nodes"), F.col("communities"), F.col("modularity")))
