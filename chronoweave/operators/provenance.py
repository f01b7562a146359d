"""From themes back to articles: window joins of mentions, cohesion, best pairs, packs.

themes: theme, birth. members: theme, name, excess. mentions: article, ts, head, tail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BEFORE_DAYS, AFTER_DAYS = 28, 7
TOP_MEMBERS, TOP_ARTICLES, TOP_PAIRS = 12, 10, 8


def top_members(members: DataFrame, n: int = TOP_MEMBERS) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("excess"), "name"))
    return members.withColumn("place", place).where(F.col("place") <= n)


def member_hits(mentions: DataFrame, themes: DataFrame, members: DataFrame, before: int = BEFORE_DAYS, after: int = AFTER_DAYS) -> DataFrame:
    """theme, article, name, day, lo: members named, at either end, by articles of [birth - before, birth + after].

    An equi-join on the name with the interval as a residual; each (theme, article, name) once.
    """
    windows = top_members(members).join(themes, "theme").select(
        "theme", "name", F.date_sub("birth", before).alias("lo"), F.date_add("birth", after).alias("hi")
    )
    named = mentions.select("article", F.col("ts").cast("date").alias("day"), F.explode(F.array("head", "tail")).alias("name"))
    named = named.join(windows.select("name").distinct(), "name", "left_semi").distinct()
    return named.join(windows, "name").where(F.col("day").between(F.col("lo"), F.col("hi"))).select(
        "theme", "article", "name", "day", "lo"
    )


def articles_by_theme(hits: DataFrame) -> DataFrame:
    """theme, article, day, lo, n_members."""
    return hits.groupBy("theme", "article", "day", "lo").agg(F.count(F.lit(1)).alias("n_members"))


def top_articles(hits: DataFrame, n: int = TOP_ARTICLES) -> DataFrame:
    """The best articles of each theme: most members, then closest to the window's start, then the article."""
    order = [F.desc("n_members"), F.abs(F.datediff("day", "lo")), F.col("article")]
    place = F.row_number().over(Window.partitionBy("theme").orderBy(*order))
    return articles_by_theme(hits).withColumn("place", place).where(F.col("place") <= n)


def binding(hits: DataFrame) -> DataFrame:
    """Hits of articles that name two members or more of a theme, with their number."""
    joint = articles_by_theme(hits).where("n_members >= 2").select("theme", "article", "n_members")
    return hits.join(joint, ["theme", "article"])


def joint_pairs(hits: DataFrame) -> DataFrame:
    """theme, a, b, joint, best: pairs of members that articles name together, and the article that names most members
    (the smallest of ties). An article names few members of a theme, TOP_MEMBERS at most, so pairs are bounded."""
    rows = binding(hits)
    left = rows.select("theme", "article", F.col("name").alias("a"), "n_members")
    right = rows.select("theme", "article", F.col("name").alias("b"))
    best = F.max_by("article", F.struct("n_members", -F.col("article")))
    return left.join(right, ["theme", "article"]).where("a < b").groupBy("theme", "a", "b").agg(
        F.count(F.lit(1)).alias("joint"), best.alias("best")
    )


def top_pairs(hits: DataFrame, n: int = TOP_PAIRS) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("theme").orderBy(F.desc("joint"), "a", "b"))
    return joint_pairs(hits).withColumn("place", place).where(F.col("place") <= n)


def cohesion(hits: DataFrame, themes: DataFrame, members: DataFrame) -> DataFrame:
    """theme, n_binding, multi3_share, pair_coverage, mean_members of every theme with members."""
    sizes = top_members(members).join(themes, "theme", "left_semi").groupBy("theme").agg(F.count(F.lit(1)).alias("size"))
    joint = articles_by_theme(hits).where("n_members >= 2").groupBy("theme").agg(
        F.count(F.lit(1)).alias("n_binding"),
        F.avg((F.col("n_members") >= 3).cast("double")).alias("multi3_share"),
        F.avg("n_members").alias("mean_members"),
    )
    pairs = joint_pairs(hits).groupBy("theme").agg(F.count(F.lit(1)).alias("pairs"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(joint, "theme", "left").join(pairs, "theme", "left").select(
        "theme",
        F.coalesce("n_binding", F.lit(0)).alias("n_binding"),
        F.coalesce("multi3_share", F.lit(0.0)).alias("multi3_share"),
        F.when(possible > 0, F.coalesce("pairs", F.lit(0)) / possible).otherwise(0.0).alias("pair_coverage"),
        F.coalesce("mean_members", F.lit(0.0)).alias("mean_members"),
    )


def packs(hits: DataFrame, themes: DataFrame, members: DataFrame, titles: DataFrame) -> DataFrame:
    """theme, pack: JSON of a theme's top members and, for its top articles, day, members and title (article, title).

    Titles are joined last, for winning articles only.
    """
    best = top_articles(hits)
    named = hits.join(best.select("theme", "article", "place"), ["theme", "article"]).groupBy(
        "theme", "article", "place", "day"
    ).agg(F.sort_array(F.collect_set("name")).alias("members_hit"))
    full = named.join(titles, "article", "left")
    headline = F.struct("place", F.col("day").cast("string").alias("date"), "members_hit", F.substring("title", 1, 200).alias("title"))
    heads = full.groupBy("theme").agg(F.array_sort(F.collect_list(headline)).alias("headlines"))
    own = top_members(members)
    total = members.groupBy("theme").agg(F.count(F.lit(1)).alias("n_members_total"))
    lists = own.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("place", "name", "excess"))).alias("members"))
    rows = themes.join(lists, "theme").join(total, "theme").join(heads, "theme", "left")
    pack = F.to_json(
        F.struct(
            "theme",
            F.date_format("birth", "yyyy-MM").alias("birth_month"),
            "n_members_total",
            F.transform("members", lambda m: F.struct(m["name"].alias("name"), m["excess"].alias("excess"))).alias("members"),
            F.transform(
                F.coalesce("headlines", F.array().cast("array<struct<place:int,date:string,members_hit:array<string>,title:string>>")),
                lambda h: F.struct(h["date"].alias("date"), h["members_hit"].alias("members_hit"), h["title"].alias("title")),
            ).alias("headlines"),
        )
    )
    return rows.select("theme", pack.alias("pack"))


def debut_share(members: DataFrame, themes: DataFrame, first_weeks: DataFrame, weeks: int = 13) -> DataFrame:
    """theme, debut_share: share of top members first seen within ``weeks`` weeks up to the birth week.

    themes: theme, birth_week. first_weeks: ent, first.
    """
    rows = top_members(members).join(themes, "theme").join(first_weeks.withColumnRenamed("ent", "name"), "name", "left")
    young = (F.col("birth_week") - F.col("first")).between(0, weeks)
    return rows.groupBy("theme").agg(F.avg(F.coalesce(young, F.lit(False)).cast("double")).alias("debut_share"))


def nearest_bucket(events: DataFrame, times: DataFrame) -> DataFrame:
    """events with the time id whose bucket start is nearest to ``event``; the earlier of ties. times is a calendar."""
    gap = F.abs(F.datediff("event", "bucket"))
    joined = events.crossJoin(F.broadcast(times))  # the calendar: a row a week
    return joined.groupBy(*events.columns).agg(F.min(F.struct(gap.alias("g"), F.col("time").alias("t"))).alias("m")).select(
        *events.columns, F.col("m.t").alias("time")
    )


def find_entities(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """wanted (name) with ``ent``: an exact name, else one that contains it in any case; the most active (total), then
    the smallest. ``wanted`` is a short list and is broadcast."""
    exact = F.col("ent") == F.col("name")
    joined = entities.join(F.broadcast(wanted), exact | F.lower("ent").contains(F.lower("name")))
    best = F.min_by("ent", F.struct((~exact).alias("e"), (-F.col("total")).alias("t"), F.col("ent").alias("n")))
    return joined.groupBy("name").agg(best.alias("ent"))
