"""Skill look-up by fragment and by spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradpath.functions.sizing import broadcast_if_small, shuffle_tasks
from gradpath.functions.text import strip
from gradpath.session import cut_lineage

PAGE = 50  # Fixed value: length of the suggestion list.
#: Characters of the longest runs that names are indexed by.
GRAM = 3


def runs_of(text: Column, width: Column | int) -> Column:
    """All runs of ``width`` characters of a text that has as many."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - width + 1), lambda i: F.substring(text, i, width))


def grams(low: Column) -> Column:
    """The distinct runs of up to ``GRAM`` characters of a text, the empty one included."""
    held = [F.when(F.length(low) >= n, runs_of(low, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, GRAM + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *held))


def postings(catalogue: DataFrame) -> DataFrame:
    """(gram, skill, low): the index of the catalogue's names, one row for each distinct run
    of up to three characters in the lower-cased name; linear in the length of the names."""
    names = catalogue.select("skill").filter(F.col("skill").isNotNull()).distinct()
    return names.withColumn("low", F.lower("skill")).select(F.explode(grams(F.col("low"))).alias("gram"), "skill", "low")


def skill_search(queries: DataFrame, chosen: DataFrame, catalogue: DataFrame, page: int = PAGE) -> DataFrame:
    """(query_id, rank, skill): the first ``page`` skills, by name, that contain the query's
    text in any case and are not chosen yet. A null text finds nothing, an empty one all.

    ``queries(query_id, id, text)``, ``chosen(id, skill)``, ``catalogue(skill)``. A distinct
    text is looked up once, by its rarest run of three characters (all of it, if it has no
    more), and the names found are verified. A list that is to lose up to m entries its
    person has chosen is made m longer beforehand, so the page is always exact. Lists of
    common texts, the empty one among them, are cut in parts that are dealt over all tasks
    before the parts are merged.
    """
    index = cut_lineage(postings(catalogue))
    many = chosen.groupBy("id").agg(F.countDistinct("skill").alias("extra"))
    asked = queries.select("query_id", "id", F.lower("text").alias("text")).filter(F.col("text").isNotNull())
    asked = asked.join(many, "id", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))
    wanted = asked.groupBy("text").agg((F.max("extra") + page).alias("most"))

    width = F.least(F.length("text"), F.lit(GRAM))
    asked_grams = wanted.select("text", "most", F.explode(F.array_distinct(runs_of(F.col("text"), width))).alias("gram"))
    sizes = index.groupBy("gram").agg(F.count("*").alias("held"))
    # a run that no name has counts as the rarest, so its text finds nothing
    rarest = asked_grams.join(sizes, "gram", "left").groupBy("text", "most").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram")).alias("best"))
    matches = (
        rarest.select("text", "most", F.col("best.gram").alias("gram"))
        .join(index, "gram").filter(F.contains("low", "text")).select("text", "most", "skill")
    )
    part = F.pmod(F.xxhash64("skill"), F.lit(shuffle_tasks(matches)))
    found = _first(_first(matches.withColumn("part", part), "text", "part"), "text")
    # a query looks at as many names as its own person may have chosen away
    seen = asked.join(found.drop("most"), "text").filter(F.col("place") <= page + F.col("extra"))
    open_rows = seen.join(chosen.select("id", "skill").distinct(), ["id", "skill"], "left_anti")
    return (
        open_rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("skill")))
        .filter(F.col("rank") <= page)
        .select("query_id", "rank", "skill")
    )


def _first(rows: DataFrame, *group: str) -> DataFrame:
    """The first ``most`` skills of each group, with their place."""
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy("skill")))
    return placed.filter(F.col("place") <= F.col("most")).select("text", "most", "skill", "place")


def canonical_skills(typed: DataFrame, chosen: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(entry_id, id, skill): typed entries in the spelling of the catalogue.

    An entry equal to a chosen skill as typed is dropped, and so is an unknown one; of
    several spellings the first by name is taken. ``typed(entry_id, id, typed)``.
    """
    spelling = catalogue.groupBy(F.lower("skill").alias("low")).agg(F.min("skill").alias("skill"))
    entries = typed.select("entry_id", "id", strip(F.col("typed")).alias("plain")).filter(F.col("plain") != "")
    fresh = entries.join(chosen.select("id", F.col("skill").alias("plain")).distinct(), ["id", "plain"], "left_anti")
    return fresh.join(broadcast_if_small(spelling), F.lower("plain") == F.col("low")).select("entry_id", "id", "skill")
