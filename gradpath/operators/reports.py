"""Report texts, advice cards, conversation context and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradpath.functions.numeric import fixed
from gradpath.functions.text import blank_to_null, client_ip, india_time, yes_no

# Advice cards (icon, title, text).
BASE_CARD = ("📚", "Continuous Learning", "Keep building projects to stand out to recruiters.")
BAND_CARDS = {
    "HIGH": [
        ("🛠️", "Skill Development", "Focus heavily on matching industry required skills."),
        ("📈", "Improve Academics", "Work on your CGPA and try to secure internships."),
    ],
    "MEDIUM": [("🤝", "Networking", "Connect with alumni and professionals in your target field.")],
    "LOW": [("🚀", "Prepare for Interviews", "You are in a great position. Start practicing mock interviews!")],
}
ROLE_CARD = ("🎯", "Career Path")
GAP_CARD = ("🛠️", "Skill Gaps")
GAP_TEXT = "Focus on mastering: "
EMPHASIS = (
    'Based on your specific skill profile, your ideal career path is <strong style="color:#ffd700; font-size:1.15em; text-decoration:underline;">',
    "</strong>.",
)
HISTORY_RUNS = 5  # Fixed value: runs of a conversation that are kept as context.
TURN_BLOCK = 1000  # turns per block when counting runs of one conversation


def _card(icon: str, title: str, text: Column) -> Column:
    return F.struct(F.lit(icon).alias("icon"), F.lit(title).alias("title"), text.alias("text"))


def advice_cards(level: Column, role: Column, missing: Column) -> Column:
    """Array of (icon, title, text): the band's cards, the role, the base card, the gap."""
    def band(which: str) -> Column:
        return F.array(*[_card(i, t, F.lit(x)) for i, t, x in BAND_CARDS[which]])

    first = F.when(level == "HIGH", band("HIGH")).when(level == "MEDIUM", band("MEDIUM")).otherwise(band("LOW"))
    emphasis = F.concat(F.lit(EMPHASIS[0]), role, F.lit(EMPHASIS[1]))
    rest = F.array_compact(
        F.array(
            F.when(blank_to_null(role).isNotNull(), _card(*ROLE_CARD, emphasis)),
            _card(BASE_CARD[0], BASE_CARD[1], F.lit(BASE_CARD[2])),
            F.when(F.size(missing) > 0, _card(*GAP_CARD, F.concat(F.lit(GAP_TEXT), F.array_join(missing, ", ")))),
        )
    )
    return F.concat(first, rest)


def advice_rows(df: DataFrame) -> DataFrame:
    """(id, place, icon, title, text) from (id, risk_level, recommended, missing)."""
    cards = advice_cards(F.col("risk_level"), F.col("recommended"), F.coalesce("missing", F.array().cast("array<string>")))
    return df.select("id", F.posexplode(cards).alias("place", "c")).select("id", "place", "c.*")


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def assessment_report(df: DataFrame) -> Column:
    """The assessment of a profile as one text.

    Wants Age, GenderName, StreamName, Internships, CGPA, flags, ``skills``, ``desired_role``,
    ``probability_percentage``, ``risk_level``, ``confidence``, ``recommended``, ``factors``,
    ``scenarios``, ``combined_risk`` and ``combined_risk_level``; missing values get defaults.
    """
    c = F.col
    profile = F.array(
        F.concat(F.lit("Gender: "), _or(c("GenderName"), "N/A")),
        F.concat(F.lit("Age: "), _or(c("Age"), "N/A"), F.lit(" years")),
        F.concat(F.lit("Stream: "), _or(c("StreamName"), "N/A")),
        F.concat(F.lit("Internships: "), _or(c("Internships"), "N/A")),
        F.concat(F.lit("CGPA: "), _or(c("CGPA"), "N/A")),
        F.concat(F.lit("Hostel: "), yes_no(c("Hostel"), numeric=True)),
        F.concat(F.lit("History of Backlogs: "), yes_no(c("HistoryOfBacklogs"), numeric=True)),
        F.concat(F.lit("Skills: "), F.array_join(F.coalesce("skills", F.array().cast("array<string>")), ", ")),
        F.concat(F.lit("Desired Role: "), _or(c("desired_role"), "Not Specified")),
    )
    chance = F.array(
        F.concat(F.lit("Placement Chance: "), _or(c("probability_percentage"), "?"), F.lit("%")),
        F.concat(F.lit("Risk Level: "), _or(c("risk_level"), "?")),
        F.concat(F.lit("Confidence: "), _or(c("confidence"), "?")),
        F.concat(F.lit("Recommended Role: "), _or(c("recommended"), "N/A")),
    )
    factors = F.transform("factors", lambda f: F.concat(f["feature"], F.lit(" | "), f["direction"], F.lit(" | "), f["interpretation"]))
    signed_delta = lambda d: F.concat(F.when(d >= 0, "+").otherwise(""), fixed(d, 1))
    scenarios = F.transform(
        "scenarios",
        lambda s: F.concat(
            s["title"], F.lit(": "), s["original_risk"].cast("string"), F.lit("% -> "), s["modified_risk"].cast("string"),
            F.lit("% (delta: "), signed_delta(s["risk_delta"]), F.lit("%) | "), s["description"],
        ),
    )
    combined = F.when(
        c("combined_risk").isNotNull(),
        F.concat(F.lit("\n  BEST COMBINED OUTCOME (all changes): "), c("combined_risk").cast("string"), F.lit("% ("), _or(c("combined_risk_level"), "?"), F.lit(")")),
    ).otherwise("")
    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("  - "), x)), "\n")
    or_line = lambda a, line: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, bullets(a)).otherwise(line)
    return F.concat(
        F.lit("=== STUDENT CAREER ASSESSMENT DATA ===\n\nSTUDENT PROFILE:\n"), bullets(profile),
        F.lit("\n\nPLACEMENT CHANCE PREDICTION:\n"), bullets(chance),
        F.lit("\n\nTOP CONTRIBUTING FACTORS (SHAP):\n"), or_line(factors, "  (None available)"),
        F.lit("\n\nWHAT-IF SCENARIOS:\n"), or_line(scenarios, "  (None generated)"), combined,
        F.lit("\n\n======================================"),
    )


def with_runs(messages: DataFrame) -> DataFrame:
    """Add ``run``: the number of user messages up to and including each message.

    A run is a user message with the replies to it; what precedes the first is run 0.
    Turns are counted by blocks of one conversation and the blocks' totals are summed up
    before, so that one huge conversation is spread over many tasks.
    """
    from pyspark.sql import Window as W

    blocks = messages.withColumn("_block", F.floor(F.col("turn") / TURN_BLOCK))
    is_user = F.count_if(F.col("role") == "user")
    totals = blocks.groupBy("conv_id", "_block").agg(is_user.alias("_users"))
    before = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "_block", F.coalesce(F.sum("_users").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy("conv_id", "_block").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    counted = blocks.withColumn("_within", F.count_if(F.col("role") == "user").over(inside))
    return counted.join(offsets, ["conv_id", "_block"]).withColumn("run", F.col("_before") + F.col("_within")).drop("_block", "_before", "_within")


def chat_history(messages: DataFrame, runs: int = HISTORY_RUNS) -> DataFrame:
    """(conv_id, turn, run, history): before each message the messages of the last ``runs``
    runs, as an array of (turn, role, text) in order.

    Runs are gathered once and met by an equality join on (conversation, run), so a long
    conversation is neither gathered as a whole nor held by one task. A message without a
    conversation or without a turn has no place in one: it comes back without a run and
    without history, counts in nobody's run and is nobody's context.
    """
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    numbered = with_runs(messages.filter(placed))
    # the last run of a conversation is nobody's context and is not gathered
    last = numbered.groupBy("conv_id").agg(F.max("run").alias("_last"))
    earlier = numbered.join(last, "conv_id").filter(F.col("run") < F.col("_last"))
    bundles = earlier.groupBy("conv_id", "run").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("said"))
    # context is the same for all messages of a run, so it is put together once per run
    reach = bundles.select("conv_id", F.explode(F.sequence(F.col("run") + 1, F.col("run") + runs)).alias("run"), "said")
    context = reach.groupBy("conv_id", "run").agg(F.array_sort(F.flatten(F.collect_list("said"))).alias("history"))
    none = F.array().cast(context.schema["history"].dataType)
    met = numbered.select("conv_id", "turn", "run").join(context, ["conv_id", "run"], "left")
    loose = messages.filter(~placed).select("conv_id", "turn", F.lit(None).cast("bigint").alias("run"), none.alias("history"))
    return met.select("conv_id", "turn", "run", F.coalesce("history", none).alias("history")).unionByName(loose)


def arrival_lines(requests: DataFrame) -> DataFrame:
    """(event_id, line): what is logged when a request arrives."""
    ip = client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("peer"))
    line = F.concat(F.lit("[IP: "), ip, F.lit("] "), F.col("method"), F.lit(" "), F.col("path"))
    return requests.select("event_id", line.alias("line"))


def log_lines(requests: DataFrame) -> DataFrame:
    """(event_id, seen_at, ip, line) for a request log."""
    ip = client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("peer"))
    line = F.concat(F.lit("[IP: "), F.col("ip"), F.lit("] "), F.col("method"), F.lit(" "), F.col("path"), F.lit(" → "), F.col("status").cast("string"))
    return requests.withColumns({"seen_at": india_time(F.col("ts")), "ip": ip}).select("event_id", "seen_at", "ip", line.alias("line"))


def log_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("path", "status").agg(F.count("*").alias("n"))
