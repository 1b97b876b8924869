"""What-if scenarios and sensitivity sweeps.

All scenarios of a profile are built, scored, filtered, numbered and ranked inside its
row, so the whole step is a narrow map: nothing is shuffled however many profiles there
are. Long form comes from ``inline`` at the end.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from gradpath.functions import bands
from gradpath.functions.numeric import half_up, percent_of
from gradpath.operators.scoring import Scorer, own_features
from gradpath.schema import FEATURES

# The stream that is suggested, and the limits of the suggestions.
CS = "Computer Science"
CGPA_LIMIT, CGPA_MAX, INTERNSHIP_LIMIT = 9.0, 10.0, 3

# Title, description, icon and factor of each scenario, in order of emission.
TEXTS = {
    "career": ("Career Path Suggestion", "Learning these skills can help you transition towards your desired role.", "🧠", "Skills"),
    "cgpa": ("+1.0 CGPA", "What if you improved your CGPA?", "📚", "CGPA"),
    "internship": ("Extra Internship", "What if you did one more internship?", "💼", "Internships"),
    "backlogs": ("Clear Backlogs", "What if you had no history of backlogs?", "✅", "HistoryOfBacklogs"),
    "stream": ("Switch to CS", "What if you switched your stream to Computer Science?", "💻", "Stream"),
    "hostel": ("Stay in Hostel", "What if you stayed in a hostel?", "🏢", "Hostel"),
}


def percent(p: Column) -> Column:
    """Probability in percent; rounded so that comparisons do not hang on the last bit."""
    return F.round(p * 100, 6)


def _raised() -> dict[str, Column]:
    return {
        "CGPA": F.least(F.col("CGPA") + 1.0, F.lit(CGPA_MAX)),
        "Internships": F.col("Internships") + 1,
        "HistoryOfBacklogs": F.lit(0),
    }


def _in_stream(code: int | None) -> dict[str, Column]:
    """Gender and stream as a changed profile would be encoded: with a known gender the new
    stream counts and so does the gender, else both codes stay 0."""
    known = F.col("GenderCode").isNotNull() & F.lit(code is not None)
    return {
        "Gender": F.when(known, F.col("GenderCode")).otherwise(0),
        "Stream": F.when(known, F.lit(code)).otherwise(0),
    }


def _allowed() -> dict[str, Column]:
    return {
        "CGPA": F.col("CGPA") < CGPA_LIMIT,
        "Internships": F.col("Internships") < INTERNSHIP_LIMIT,
        "HistoryOfBacklogs": F.col("HistoryOfBacklogs") == 1,
    }


def whatif(df: DataFrame, scorer: Scorer, cs_code: int | None, career_skills: str | None = None) -> DataFrame:
    """Add ``scenarios`` (ranked), ``best``, and the original and combined results.

    ``df`` holds encoded profiles with ``StreamName``. ``cs_code`` is the code of the
    suggested stream, None if the dictionary does not know it. ``career_skills`` names an
    array column with the skills on the way to the desired role; where it has entries,
    they make up the first scenario.
    """
    raised, allowed = _raised(), _allowed()
    base = own_features()
    variants = {
        "_p0": base,
        "_cgpa": {**base, "CGPA": raised["CGPA"]},
        "_internship": {**base, "Internships": raised["Internships"]},
        "_backlogs": {**base, "HistoryOfBacklogs": raised["HistoryOfBacklogs"]},
        "_stream": {**base, **_in_stream(cs_code)},
        "_hostel": {**base, "Hostel": F.lit(1)},
        "_all": {**base, **{f: F.when(allowed[f], raised[f]).otherwise(F.col(f)) for f in raised}},
    }
    scored = scorer.score_many(df, variants)
    scored = scored.withColumns({name: percent(F.col(name)) for name in variants})
    original = F.col("_p0")

    def scenario(kind: str, when: Column, modified: Column, old: Column, new: Column, summary: Column) -> Column:
        title, description, icon, factor = TEXTS[kind]
        delta = F.round(modified - original, 6)
        return F.when(
            when,
            F.struct(
                F.lit(title).alias("title"),
                F.lit(description).alias("description"),
                summary.alias("change_summary"),
                original.alias("original_risk"),
                modified.alias("modified_risk"),
                delta.alias("risk_delta"),
                F.round(percent_of(delta, original, delta * 100), 6).alias("risk_reduction_percent"),
                F.lit(icon).alias("icon"),
                F.lit(factor).alias("factor_changed"),
                old.alias("original_value"),
                new.alias("suggested_value"),
            ),
        )

    text = lambda c: c.cast("string")
    arrow = lambda head, a, b: F.concat(F.lit(head), a, F.lit(" → "), b)
    items = []
    if career_skills is not None:
        learn = F.array_join(career_skills, ", ")
        items.append(scenario("career", F.size(F.coalesce(career_skills, F.array().cast("array<string>"))) > 0, original,
                              F.lit("Current Skills"), learn, F.concat(F.lit("Learn: "), learn)))
    cgpa, cgpa_new = text(F.col("CGPA")), text(raised["CGPA"])
    items.append(scenario("cgpa", allowed["CGPA"], F.col("_cgpa"), cgpa, cgpa_new, arrow("CGPA: ", cgpa, cgpa_new)))
    count, count_new = text(F.col("Internships")), text(raised["Internships"])
    items.append(scenario("internship", allowed["Internships"], F.col("_internship"), count, count_new,
                          arrow("Internships: ", count, count_new)))
    items.append(scenario("backlogs", allowed["HistoryOfBacklogs"], F.col("_backlogs"), F.lit("Yes"), F.lit("No"),
                          F.lit("Backlogs: Yes → No")))
    if cs_code is not None:
        better = (F.col("StreamName") != CS) & (F.col("_stream") > original)
        items.append(scenario("stream", better, F.col("_stream"), F.col("StreamName"), F.lit(CS),
                              arrow("Stream: ", F.col("StreamName"), F.lit(CS))))
    items.append(scenario("hostel", (F.col("Hostel") == 0) & (F.col("_hostel") > original), F.col("_hostel"),
                          F.lit("No"), F.lit("Yes"), F.lit("Hostel: No → Yes")))

    emitted = F.array_compact(F.array(*items))
    numbered = F.transform(emitted, lambda s, i: s.withField("scenario_id", i + 1))
    # largest gain first, the number decides ties
    keyed = F.transform(numbered, lambda s: F.struct((-s["risk_delta"]).alias("neg"), s["scenario_id"].alias("n"), s.alias("s")))
    ranked = F.transform(F.array_sort(keyed), lambda k: k["s"])
    return (
        scored.withColumns(
            {
                "scenarios": ranked,
                "original_risk": original,
                "original_risk_level": bands.risk_level(original / 100),
                "combined_risk": F.col("_all"),
                "combined_risk_level": bands.risk_level(F.col("_all") / 100),
            }
        )
        .withColumn("best", F.try_element_at("scenarios", F.lit(1)))
        .drop(*variants)
    )


def scenario_rows(df: DataFrame) -> DataFrame:
    """(id, rank, scenario fields, combined_risk), one row per scenario.

    The outer form of the generator is used throughout for arrays made in the row: for the
    plain one the optimizer adds a size filter below, which works the array out twice.
    """
    rows = df.select("id", F.posexplode_outer("scenarios").alias("place", "s"), "combined_risk").filter(F.col("place").isNotNull())
    return rows.select("id", (F.col("place") + 1).alias("rank"), "s.*", "combined_risk")


def scenario_display(df: DataFrame) -> DataFrame:
    """(id, scenario_id, improves, delta_abs, percent_abs, bar_width) per scenario."""
    size = F.abs("risk_reduction_percent")
    return scenario_rows(df).select(
        "id", "scenario_id", (F.col("risk_delta") > 0).alias("improves"),
        half_up(F.abs("risk_delta"), 1).alias("delta_abs"), half_up(size, 1).alias("percent_abs"),
        F.least(size, F.lit(100.0)).alias("bar_width"),
    )


def combined_summary(df: DataFrame) -> DataFrame:
    """Change from the original to the combined case; shown only with several scenarios.

    ``delta`` is combined minus original; ``ui_delta`` has the web form's opposite sign.
    """
    delta = F.round(F.col("combined_risk") - F.col("original_risk"), 6)
    back = F.round(F.col("original_risk") - F.col("combined_risk"), 6)
    return df.select(
        "id", F.size("scenarios").alias("scenario_count"), (F.size("scenarios") > 1).alias("shown"),
        delta.alias("delta"), back.alias("ui_delta"),
        F.round(percent_of(back, F.col("original_risk"), F.lit(0.0)), 6).alias("ui_percent"),
        "original_risk_level", "combined_risk_level",
    )


def sweep(df: DataFrame, scorer: Scorer, grid: dict[str, Iterable[float]]) -> DataFrame:
    """Add ``sweep``: an array of (field, value, percent), the profile re-scored with each
    value of each field in turn, and ``base_percent``. The grid is a short literal list."""
    base = own_features()
    variants, points = {"_base": base}, []
    for name, values in grid.items():
        for i, v in enumerate(values):
            key = f"_{name}_{i}"
            variants[key] = {**base, name: F.lit(v)}
            points.append((name, float(v), key))
    scored = scorer.score_many(df, variants)
    array = F.array(
        *[F.struct(F.lit(n).alias("field"), F.lit(v).alias("value"), percent(F.col(k)).alias("percent")) for n, v, k in points]
    )
    return scored.withColumns({"base_percent": percent(F.col("_base")), "sweep": array}).drop(*variants)


def sweep_grid(df: DataFrame, scorer: Scorer, grid: DataFrame) -> DataFrame:
    """(id, field, value, used, percent, delta, sense): profiles re-scored at the points of a table.

    ``grid(id, field, value, low, high)`` has any number of points for each profile, with the
    bounds of their own; ``used`` is the value within them, a missing one counting as ``low``.
    A point is a row beside its profile, scored with the unchanged profile in one call, so
    a profile with very many points needs no list. Points of unknown fields or profiles
    come back without a score.
    """
    value = F.coalesce(F.nullif(F.col("value").cast("double"), F.lit(0.0)), F.col("low").cast("double"))
    points = grid.select(F.col("id").alias("_id"), F.col("field").alias("_field"), F.col("value").cast("double").alias("_value"),
                         F.greatest(F.least(value, F.col("high").cast("double")), F.col("low").cast("double")).alias("_used"))
    known = F.col("_field").isin(FEATURES) & F.col("id").isNotNull()
    rows = points.join(df, F.col("_id") == F.col("id"), "left")
    base = own_features()
    changed = {f: F.when(F.col("_field") == f, F.col("_used")).otherwise(c) for f, c in base.items()}
    scored = scorer.score_many(rows, {"_base": base, "_point": changed})
    delta = half_up(percent(F.col("_point")) - percent(F.col("_base")), 1) + F.lit(0.0)
    done = scored.select(F.col("_id").alias("id"), F.col("_field").alias("field"), F.col("_value").alias("value"), F.col("_used").alias("used"),
                         F.when(known, percent(F.col("_point"))).alias("percent"), F.when(known, delta).alias("delta"))
    return done.withColumn("sense", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").when(F.col("delta") == 0, "same"))


def sweep_joint(df: DataFrame, scorer: Scorer, cases: list[dict[str, float]]) -> DataFrame:
    """(id, case, percent, delta): the profile re-scored with several fields changed at once.

    Each case names the fields it overrides; ``delta`` is the change in one decimal.
    """
    base = own_features()
    variants = {"_base": base} | {f"_case_{i}": {**base, **{f: F.lit(v) for f, v in case.items()}} for i, case in enumerate(cases)}
    scored = scorer.score_many(df, variants)
    rows = F.array(*[F.struct(F.lit(i).alias("case"), percent(F.col(f"_case_{i}")).alias("percent")) for i in range(len(cases))])
    delta = half_up(F.col("percent") - percent(F.col("_base")), 1) + F.lit(0.0)
    return scored.select("id", "_base", F.inline_outer(rows)).select("id", "case", "percent", delta.alias("delta"))


def sweep_rows(df: DataFrame) -> DataFrame:
    return df.select("id", F.inline_outer("sweep"))


def sweep_plateaus(df: DataFrame, digits: int = 2) -> DataFrame:
    """(id, field, value, percent, plateau): ``plateau`` where the percentage, at the
    ``digits`` shown, equals that of the value before in the grid."""
    shown = F.transform(
        "sweep",
        lambda s: F.struct(s["field"].alias("field"), s["value"].alias("value"), F.round(s["percent"], digits).alias("percent")),
    )
    marked = F.transform(
        F.col("_shown"),
        lambda s, i: F.struct(
            s["field"].alias("field"), s["value"].alias("value"), s["percent"].alias("percent"),
            F.coalesce(
                (F.try_element_at("_shown", F.when(i > 0, i))["percent"] == s["percent"])
                & (F.try_element_at("_shown", F.when(i > 0, i))["field"] == s["field"]),
                F.lit(False),
            ).alias("plateau"),
        ),
    )
    return df.select("id", shown.alias("_shown")).select("id", F.inline_outer(marked))


def sweep_delta(df: DataFrame) -> DataFrame:
    """(id, field, value, delta, sense): change to the unchanged profile in one decimal."""
    delta = half_up(F.col("percent") - F.col("base_percent"), 1) + F.lit(0.0)
    return (
        df.select("id", "base_percent", F.inline_outer("sweep"))
        .select("id", "field", "value", delta.alias("delta"))
        .withColumn("sense", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("same"))
    )
