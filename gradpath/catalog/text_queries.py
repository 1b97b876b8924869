"""Queries on reports, advice, conversations and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradpath.catalog import fragments as fr
from gradpath.catalog.registry import catalogue_graph, engine, query
from gradpath.catalog.score_queries import _BASE, _DIRECTION, _IMPACTS, _PREDICT, _SHOWN, _TEXT
from gradpath.functions.text import chat_html, client_ip, failed_reply, india_time
from gradpath.operators import attribution as at
from gradpath.operators import reports as re_
from gradpath.operators.scoring import ExpressionScorer
from gradpath.plans import answers
from gradpath.sources.views import load, with_views

def _cards_sql() -> str:
    """Every card a profile can have, from the same constants."""
    card = lambda kind, icon, title, text, when: f"select id, {kind} kind, '{icon}' icon, '{title}' title, {text} as text from predicted where {when}"
    rows = [card(k, icon, title, f"'{text}'", f"risk_level = '{level}'") for level, cards in re_.BAND_CARDS.items() for k, (icon, title, text) in enumerate(cards)]
    rows += [
        card(2, *re_.ROLE_CARD, f"'{re_.EMPHASIS[0]}' || recommended_job || '{re_.EMPHASIS[1]}'", "recommended_job is not null"),
        card(3, *re_.BASE_CARD[:2], f"'{re_.BASE_CARD[2]}'", "true"),
        card(4, *re_.GAP_CARD, f"'{re_.GAP_TEXT}' || missing_skills", "missing_skills <> ''"),
    ]
    return f"select id, cast(row_number() over (partition by id order by kind) - 1 as int) place, icon, title, text from ({' union all '.join(rows)}) x"


@query("advice_cards", with_views(_cards_sql(), *_PREDICT))
def advice_cards(spark, d):
    ready = engine(spark, d, catalogue_graph(spark, d))
    done = answers.predict(ready, load(spark, d, "profiles"), load(spark, d, "skills"), load(spark, d, "desired"))
    return re_.advice_rows(done.withColumnsRenamed({"recommended_job": "recommended", "missing_skills": "missing"}))


_LF = "chr(10)"
_REPORT = f"""select e.id, '=== STUDENT CAREER ASSESSMENT DATA ===' || {_LF} || {_LF} || 'STUDENT PROFILE:' || {_LF}
|| '  - Gender: ' || e.GenderName || {_LF} || '  - Age: ' || e.Age || ' years' || {_LF} || '  - Stream: ' || e.StreamName || {_LF}
|| '  - Internships: ' || e.Internships || {_LF} || '  - CGPA: ' || e.CGPA || {_LF}
|| '  - Hostel: ' || case when e.Hostel = 1 then 'Yes' else 'No' end || {_LF}
|| '  - History of Backlogs: ' || case when e.HistoryOfBacklogs = 1 then 'Yes' else 'No' end || {_LF}
|| '  - Skills: ' || coalesce((select string_agg(k.skill, ', ' order by k.pos) from {{skills}} k where k.id = e.id), '') || {_LF}
|| '  - Desired Role: ' || coalesce(nullif(w.desired_role, ''), 'Not Specified') || {_LF} || {_LF} || 'PLACEMENT CHANCE PREDICTION:' || {_LF}
|| '  - Placement Chance: ' || p.probability_percentage || '%' || {_LF} || '  - Risk Level: ' || p.risk_level || {_LF} || '  - Confidence: ' || p.confidence || {_LF}
|| '  - Recommended Role: ' || coalesce(p.recommended_job, 'N/A') || {_LF} || {_LF} || 'TOP CONTRIBUTING FACTORS (SHAP):' || {_LF}
|| (select string_agg('  - ' || {_SHOWN} || ' | ' || {_DIRECTION} || ' | ' || {_TEXT}, {_LF} order by r.rank) from ranked r where r.id = e.id and r.rank <= 5)
|| {_LF} || {_LF} || 'WHAT-IF SCENARIOS:' || {_LF}
|| coalesce((select string_agg('  - ' || s.title || ': ' || s.original_risk || '% -> ' || s.modified_risk || '% (delta: '
     || case when s.risk_delta >= 0 then '+' else '' end || {fr.fixed('s.risk_delta', 1)} || '%) | ' || s.description, {_LF} order by s.rank) from scenarios s where s.id = e.id), '  (None generated)')
|| {_LF} || '  BEST COMBINED OUTCOME (all changes): ' || b.comb || '% (' || {fr.level('b.comb / 100')} || ')' || {_LF} || {_LF} || '======================================' report
from encoded e join predicted p on p.id = e.id join base b on b.id = e.id left join {{desired}} w on w.id = e.id"""


@query("assessment_report", with_views(_REPORT, *_PREDICT, *_IMPACTS[1:], *fr.scenarios()[1:]))
def assessment_report(spark, d):
    """The full assessment text of every profile."""
    profiles, skills, desired = (load(spark, d, v) for v in ("profiles", "skills", "desired"))
    ready = engine(spark, d, catalogue_graph(spark, d))
    attribution = at.LinearAttribution.fit(ExpressionScorer(), ready.encode(profiles))
    table = answers.assess(ready, profiles, skills, desired, attribution)
    return table.select("id", re_.assessment_report(table).alias("report"))


def _history_sql(source: str) -> str:
    return with_views(
        """select r.conv_id, r.turn, cast(r.run as bigint) run, count(h.turn) messages, coalesce(string_agg(h.role || ': ' || h.text, chr(10) order by h.turn), '') history
        from runs r left join runs h on h.conv_id = r.conv_id and h.run between r.run - 5 and r.run - 1 group by r.place, r.conv_id, r.turn, r.run""",
        f"placed as (select *, row_number() over () place from {source})",
        """runs as (select *, count(*) filter (role = 'user') over (partition by conv_id order by turn) run from placed where conv_id is not null and turn is not null
        union all select *, null from placed where conv_id is null or turn is null)""")


def _history(messages):
    done = re_.chat_history(messages)
    said = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return done.select("conv_id", "turn", "run", F.size("history").cast("bigint").alias("messages"), F.array_join(said, "\n").alias("history"))


@query("chat_history", _history_sql("{conversations}"))
def chat_history(spark, d):
    return _history(load(spark, d, "conversations"))


@query("chat_history_gaps", _history_sql("{loose_messages}"))
def chat_history_gaps(spark, d):
    """The same where some messages lack their conversation or their turn."""
    return _history(load(spark, d, "loose_messages"))


@query("failed_replies", with_views(
    """select conv_id, turn, reply from {replies} where contains(reply, 'Connection error') or contains(reply, '404')
    or contains(reply, 'Unknown model error') or lower(status) = 'error'"""))
def failed_replies(spark, d):
    rows = load(spark, d, "replies")
    return rows.filter(failed_reply(F.col("reply"), F.col("status"))).select("conv_id", "turn", "reply")


def _html_sql(text: str) -> str:
    out = f"coalesce({text}, '')"
    for pattern, replacement in [
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>"),
        ("`(.+?)`", r"<code>\1</code>"), (r"(?m)^\s*[-•]\s+(.+)", r"<li>\1</li>"), (r"(?m)^\s*(\d+)\.\s+(.+)", r"<li>\2</li>"), (r"\n", "<br>"),
    ]:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


@query("chat_html", with_views(f"select conv_id, turn, {_html_sql('marked')} html from {{replies}}"))
def chat_as_html(spark, d):
    return load(spark, d, "replies").select("conv_id", "turn", chat_html(F.col("marked")).alias("html"))


_IP = "coalesce(trim(split_part(forwarded_for, ',', 1)), real_ip, peer, '0.0.0.0')"
_AT = "strftime(ts + interval 330 minute, '%Y-%m-%d %H:%M:%S IST')"


@query("client_ip", with_views(f"select event_id, {_IP} ip from {{requests}}"))
def client_addresses(spark, d):
    return load(spark, d, "requests").select("event_id", client_ip(F.col("forwarded_for"), F.col("real_ip"), F.col("peer")).alias("ip"))


@query("event_time_ist", with_views(f"select event_id, {_AT} seen_at from {{events}}"))
def event_time_ist(spark, d):
    return load(spark, d, "events").select("event_id", india_time(F.col("ts")).alias("seen_at"))


@query("request_log", with_views(
    f"select event_id, {_AT} seen_at, {_IP} ip, '[IP: ' || {_IP} || '] ' || method || ' ' || path || ' → ' || status line from {{requests}}"))
def request_log(spark, d):
    return re_.log_lines(load(spark, d, "requests"))


@query("request_arrivals", with_views(f"select event_id, '[IP: ' || {_IP} || '] ' || method || ' ' || path line from {{requests}}"))
def request_arrivals(spark, d):
    return re_.arrival_lines(load(spark, d, "requests"))


@query("request_counts", with_views("select path, status, count(*) n from {requests} group by path, status"))
def request_counts(spark, d):
    return re_.log_counts(load(spark, d, "requests"))
