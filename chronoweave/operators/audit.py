"""What people and models look at: review sheets, rendered packs, leakage-safe splits, extraction reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.ontology import TYPE_IDS
from chronoweave.operators.canonical import jaccard_pairs, whole_groups_to_test
from chronoweave.operators.graph import connected_components
from chronoweave.operators.sampling import simple_sample


def review_sheet(members: DataFrame, real: list[str], noise: list[str], n: int = 40, seed: int = 42) -> DataFrame:
    """theme, role: a seeded sample of themes with all controls; a theme with a known noise member is control_noise, else
    with a known real one control_real."""
    themes = members.select("theme").distinct()
    roles = members.groupBy("theme").agg(
        F.max(F.col("name").isin(*noise)).alias("is_noise"), F.max(F.col("name").isin(*real)).alias("is_real")
    )
    role = F.when(F.col("is_noise"), "control_noise").when(F.col("is_real"), "control_real")
    named = roles.select("theme", role.alias("role"))
    sample = simple_sample(themes, "theme", n, seed).withColumn("sampled", F.lit(True))
    return named.join(sample, "theme", "left").where("role is not null or sampled").select(
        "theme", F.coalesce("role", F.lit("sample")).alias("role")
    )


def rendered(packs: DataFrame) -> DataFrame:
    """theme, prompt: a pack (theme, birth_month, members, headlines) as a text for a judge."""
    members = F.array_join(F.transform("members", lambda m: F.format_string("%s (%.1f)", m["name"], m["excess"])), ", ")
    heads = F.array_join(
        F.transform("headlines", lambda h: F.concat(F.lit("- "), h["date"], F.lit(" ["), F.array_join(h["members_hit"], "; "), F.lit("] "), F.coalesce(h["title"], F.lit("")))),
        "\n",
    )
    text = F.concat(F.lit("Born "), "birth_month", F.lit("\nMembers: "), members, F.lit("\nHeadlines:\n"), heads)
    return packs.select("theme", text.alias("prompt"))


def storyline_groups(packs: DataFrame, least: float = 0.3) -> DataFrame:
    """id, group: packs (id, member) that share members, by connected overlaps."""
    links = jaccard_pairs(packs, least).select("a", "b")
    return connected_components(packs.select(F.col("id").alias("node")), links).select(
        F.col("node").alias("id"), F.col("component").alias("group")
    )


def distillation_split(packs: DataFrame, births: DataFrame, first_test) -> DataFrame:
    """id, group, is_test: by birth date, then whole groups to test. packs: id, member; births: id, birth."""
    dated = storyline_groups(packs).join(births, "id").withColumn("is_test", F.coalesce(F.col("birth") >= first_test, F.lit(False)))
    return whole_groups_to_test(dated).select("id", "group", "is_test")


def missing_types(triplets: DataFrame) -> DataFrame:
    """Types of the vocabulary that no valid triplet has."""
    spark = triplets.sparkSession
    every = spark.createDataFrame([(t,) for t in TYPE_IDS], "type string")
    seen = triplets.where("valid").select(F.explode(F.array("h_type", "o_type")).alias("type")).distinct()
    return every.join(seen, "type", "left_anti")


def extraction_report(triplets: DataFrame, stats: DataFrame) -> DataFrame:
    """articles, success, malformed, mean_triplets, type_density (share of GPE ends) of an extraction run."""
    ends = triplets.where("valid").select(F.explode(F.array("h_type", "o_type")).alias("type"))
    density = ends.agg(F.avg((F.col("type") == "GPE").cast("double")).alias("type_density"))
    base = stats.agg(
        F.count(F.lit(1)).alias("articles"),
        F.avg((F.col("n_valid") > 0).cast("double")).alias("success"),
        F.avg(F.col("malformed").cast("double")).alias("malformed"),
        F.avg("n_valid").alias("mean_triplets"),
    )
    return base.crossJoin(density)  # one row each
