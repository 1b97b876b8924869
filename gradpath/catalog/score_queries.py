"""Queries on scoring, attribution, what-if and the composed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradpath.catalog import fragments as fr
from gradpath.catalog.profile_queries import TYPED_FORM
from gradpath.catalog.registry import catalogue_graph, encoded, engine, query
from gradpath.functions import bands
from gradpath.functions.numeric import fixed
from gradpath.functions.text import feature_display
from gradpath.operators import attribution as at
from gradpath.operators import validate as va
from gradpath.operators import whatif as wi
from gradpath.operators.graph import SkillGraph
from gradpath.operators.scoring import CARD, CARD_INTERCEPT, ExpressionScorer, score, with_bands
from gradpath.plans import answers
from gradpath.schema import FEATURES
from gradpath.sources.views import load, with_views
from gradpath.sources.writers import to_json_rows

# a second score card, under which moving to a hostel helps
HOSTEL_CARD = {**CARD, "Hostel": 0.2}
CGPA_GRID = [7.5, 7.6, 7.7, 7.8, 9.0]
GRID = {"CGPA": CGPA_GRID, "Internships": [0, 1, 2, 3], "HistoryOfBacklogs": [0, 1]}


@query("score_profiles", with_views(f"select id, cast(p > 0.5 as int) prediction, round(p, 6) p from (select id, {fr.probability()} p from encoded) x", fr.encoded()))
def score_profiles(spark, d):
    scored = with_bands(score(encoded(spark, d), ExpressionScorer()))
    return scored.select("id", "prediction", F.round("p", 6).alias("p"))


@query("placement_bands", with_views(
    f"select id, {fr.level('p')} risk_level, {fr.confidence('p')} confidence, round(p * 100, 2) probability_percentage from (select id, {fr.probability()} p from encoded) x",
    fr.encoded()))
def placement_bands(spark, d):
    return with_bands(score(encoded(spark, d), ExpressionScorer())).select("id", "risk_level", "confidence", "probability_percentage")


def _impacts_sql() -> tuple[str, ...]:
    rows = " union all ".join(
        f"select id, {i} pos, '{f}' feature, {f}::double as value, round({CARD[f]}::double * ({f} - (select avg({f}) from encoded)), 6) + 0::double shap from encoded"
        for i, f in enumerate(FEATURES)
    )
    ranked = "ranked as (select *, row_number() over (partition by id order by abs(shap) desc, pos) rank from impacts)"
    return (fr.encoded(), f"impacts as ({rows})", ranked)


def _attributed(spark, d, sign: str = "additive"):
    coded = encoded(spark, d)
    return at.signed(at.LinearAttribution.fit(ExpressionScorer(), coded).attach(coded), sign)


_IMPACTS = _impacts_sql()


@query("linear_attribution", with_views("select id, feature, shap, shap as impact from impacts", *_IMPACTS))
def linear_attribution(spark, d):
    return at.impact_rows(_attributed(spark, d)).select("id", "feature", (F.col("shap") + 0.0).alias("shap"), "impact")


@query("negated_attribution", with_views("select id, cast(rank as int) as rank, feature, -shap + 0::double as impact from ranked", *_IMPACTS))
def negated_attribution(spark, d):
    """All factors under the sign convention that turns attributions round."""
    return at.factor_rows(_attributed(spark, d, "reference"), None).select("id", "rank", "feature", "impact")


@query("top_factors", with_views("select id, cast(rank as int) as rank, feature, shap as impact from ranked where rank <= 5", *_IMPACTS))
def top_factors(spark, d):
    return at.factor_rows(_attributed(spark, d)).select("id", "rank", "feature", "impact")


_LABEL = """case feature when 'HistoryOfBacklogs' then case when value = 0 then 'No Backlogs' else 'History of Backlogs' end
  when 'Internships' then concat(cast(value as int), ' Internships') when 'CGPA' then concat('CGPA (', value, ')') else feature end"""
_TITLE = "upper(left(feature, 1)) || lower(substring(feature, 2))"
_STRENGTH = "case when abs(shap) > 0.3 then 'significantly' when abs(shap) > 0.1 then 'moderately' else 'slightly' end"
_TEXT = f"concat_ws(' ', {_TITLE}, {_STRENGTH}, case when shap > 0 then 'improves' else 'reduces' end, 'placement chances')"
_DIRECTION = "case when shap > 0 then 'Improves Chances' else 'Reduces Chances' end"
_SHOWN = _LABEL.replace("else feature end", f"else {_TITLE} end")


@query("factor_labels", with_views(f"select id, feature, {_SHOWN} as label from impacts", *_IMPACTS))
def factor_labels(spark, d):
    rows = at.impact_rows(_attributed(spark, d))
    return rows.select("id", "feature", bands.factor_label(F.col("feature"), F.col("value")).alias("label"))


@query("factor_text", with_views(f"select id, feature, {_DIRECTION} direction, {_TEXT} interpretation from impacts", *_IMPACTS))
def factor_text(spark, d):
    rows = at.impact_rows(_attributed(spark, d))
    return rows.select("id", "feature", bands.direction(F.col("impact")).alias("direction"), bands.interpretation(F.col("feature"), F.col("impact")).alias("interpretation"))


@query("factor_share", with_views(
    "select id, feature, case when m > 0 then round(abs(shap) / m * 100, 6) end as share from (select *, max(abs(shap)) over (partition by id) m from impacts) x", *_IMPACTS))
def factor_share(spark, d):
    return at.factor_shares(_attributed(spark, d))


@query("signed_text", with_views(f"select id, feature, case when shap > 0 then '+' else '' end || {fr.fixed('shap', 3)} as text from impacts", *_IMPACTS))
def signed_text(spark, d):
    return at.signed_text(_attributed(spark, d))


@query("feature_display", with_views(
    """select distinct id, name, case when name like 'Stream%' then 'Stream: ' || StreamName when name like 'Gender%' then 'Gender: ' || GenderName
      when name = 'HistoryOfBacklogs' then 'Academic Backlogs' else upper(left(split_part(name, '_', 1), 1)) || substring(split_part(name, '_', 1), 2) || ' ' ||
        upper(left(split_part(name, '_', 2), 1)) || substring(split_part(name, '_', 2), 2) end display
    from (select *, unnest(['Stream_' || replace(StreamName, ' ', '_'), 'Gender_' || GenderName, 'HistoryOfBacklogs', 'extra_' || lower(GenderName)]) as name from encoded) x""", fr.encoded()))
def feature_names(spark, d):
    """Display names of one-hot style column names made from each profile."""
    coded = encoded(spark, d)
    names = F.array(
        F.concat(F.lit("Stream_"), F.replace("StreamName", F.lit(" "), F.lit("_"))), F.concat(F.lit("Gender_"), "GenderName"),
        F.lit("HistoryOfBacklogs"), F.concat(F.lit("extra_"), F.lower("GenderName")),
    )
    return coded.select("id", F.explode(names).alias("name")).withColumn("display", feature_display(F.col("name")))


def _whatif(spark, d, coefs=None):
    scorer = ExpressionScorer(coefs) if coefs else ExpressionScorer()
    return answers.whatif(engine(spark, d, scorer=scorer), load(spark, d, "profiles"))


_SCENARIOS = fr.scenarios()
_SCENARIO_COLUMNS = """id, scenario_id, title, description, change_summary, original_risk, modified_risk, risk_delta, risk_reduction_percent,
  icon, factor_changed, original_value, suggested_value"""


@query("whatif_scenarios", with_views(f"select {_SCENARIO_COLUMNS} from scenarios", *_SCENARIOS))
def whatif_scenarios(spark, d):
    return wi.scenario_rows(_whatif(spark, d)).drop("rank", "combined_risk")


@query("whatif_hostel", with_views(f"select {_SCENARIO_COLUMNS} from scenarios", *fr.scenarios(HOSTEL_CARD)))
def whatif_hostel(spark, d):
    """Scenarios under a score card where a hostel place helps."""
    return wi.scenario_rows(_whatif(spark, d, HOSTEL_CARD)).drop("rank", "combined_risk")


@query("whatif_ranked", with_views("select id, rank, scenario_id, title, risk_delta from scenarios", *_SCENARIOS))
def whatif_ranked(spark, d):
    return wi.scenario_rows(_whatif(spark, d)).select("id", "rank", "scenario_id", "title", "risk_delta")


@query("whatif_best", with_views(
    "select b.id, s.title, s.risk_delta from base b left join scenarios s on s.id = b.id and s.rank = 1", *_SCENARIOS))
def whatif_best(spark, d):
    return _whatif(spark, d).select("id", "best.title", "best.risk_delta")


@query("whatif_combined", with_views(
    f"select id, orig original_risk, {fr.level('orig / 100')} original_risk_level, comb combined_risk, {fr.level('comb / 100')} combined_risk_level from base", *_SCENARIOS))
def whatif_combined(spark, d):
    return _whatif(spark, d).select("id", "original_risk", "original_risk_level", "combined_risk", "combined_risk_level")


@query("whatif_summary", with_views(
    f"""select id, cast(n as int) scenario_count, n > 1 shown, round(comb - orig, 6) delta, round(orig - comb, 6) ui_delta,
    round(case when orig > 0 then round(orig - comb, 6) / orig * 100 else 0 end, 6) ui_percent,
    {fr.level('orig / 100')} original_risk_level, {fr.level('comb / 100')} combined_risk_level
    from (select *, (select count(*) from scenarios s where s.id = base.id) n from base) x""", *_SCENARIOS))
def whatif_summary(spark, d):
    return wi.combined_summary(_whatif(spark, d))


@query("scenario_display", with_views(
    f"""select id, scenario_id, risk_delta > 0 improves, {fr.half_up('abs(risk_delta)', 1)} delta_abs,
    {fr.half_up('abs(risk_reduction_percent)', 1)} percent_abs, least(abs(risk_reduction_percent), 100::double) bar_width from scenarios""", *_SCENARIOS))
def scenario_display(spark, d):
    return wi.scenario_display(_whatif(spark, d))


_UNKNOWN = (
    TYPED_FORM, "valid_form as (select * from typed_form where Age between 15 and 40 and Internships >= 0 and CGPA between 0 and 10 and Gender is not null and Stream is not null "
    "and Hostel between 0 and 1 and HistoryOfBacklogs between 0 and 1)",
    fr.encoded("valid_form"), fr.encoded("(select * replace ('Computer Science' as Stream) from valid_form)", name="switched"),
    f"""switch as (select e.id, {fr.percent()} as orig, s.moved from encoded e
      join (select id, {fr.percent()} as moved from switched) s on s.id = e.id where e.StreamName <> 'Computer Science')""",
)


@query("whatif_unknown", with_views("select id, orig original_risk, moved modified_risk from switch where moved > orig", *_UNKNOWN))
def whatif_unknown(spark, d):
    """The switch of stream for forms, unknown classes among them: the changed form is encoded anew."""
    forms = va.coerce_form(load(spark, d, "forms"))
    rows = wi.scenario_rows(answers.whatif(engine(spark, d), forms)).filter("title = 'Switch to CS'")
    return rows.select("id", "original_risk", "modified_risk")


def _grid_sql(grid: dict) -> str:
    rows = " union all ".join(
        f"select id, '{f}' field, {i} nr, {v}::double as value, {fr.percent({f: f'{v}::double'})} as percent, {fr.percent()} base from encoded"
        for f, values in grid.items() for i, v in enumerate(values)
    )
    return f"grid as ({rows})"


@query("sweep_cgpa", with_views("select id, field, value, percent from grid", fr.encoded(), _grid_sql({"CGPA": CGPA_GRID})))
def sweep_cgpa(spark, d):
    return wi.sweep_rows(wi.sweep(encoded(spark, d), ExpressionScorer(), {"CGPA": CGPA_GRID}))


@query("sweep_plateaus", with_views(
    """select id, field, value, round(percent, 2) as percent, coalesce(round(percent, 2) = lag(round(percent, 2)) over (partition by id, field order by nr), false) plateau from grid""",
    fr.encoded(), _grid_sql(GRID)))
def sweep_plateaus(spark, d):
    return wi.sweep_plateaus(wi.sweep(encoded(spark, d), ExpressionScorer(), GRID))


@query("sweep_delta", with_views(
    f"""select id, field, value, delta, case when delta > 0 then 'up' when delta < 0 then 'down' else 'same' end sense
    from (select *, {fr.half_up('(percent - base)', 1)} + 0::double delta from grid) x""", fr.encoded(), _grid_sql(GRID)))
def sweep_delta(spark, d):
    return wi.sweep_delta(wi.sweep(encoded(spark, d), ExpressionScorer(), GRID))


@query("sweep_grid", with_views(
    f"""select id, field, value, used, percent, delta, case when delta > 0 then 'up' when delta < 0 then 'down' when delta = 0 then 'same' end sense
    from (select *, {fr.half_up('(percent - base)', 1)} + 0::double delta from scored) x""",
    fr.encoded(), "points as (select *, greatest(least(coalesce(nullif(value, 0), low), high), low) used from {grid_points})",
    f"""scored as (select p.id, p.field, p.value, p.used, case when e.id is not null and p.field <> 'Height' then {fr.percent({f: f"(case when p.field = '{f}' then p.used else e.{f} end)" for f in FEATURES})} end percent,
      case when e.id is not null and p.field <> 'Height' then {fr.percent({f: f"e.{f}" for f in FEATURES})} end base from points p left join encoded e on e.id = p.id)"""))
def sweep_grid(spark, d):
    """Each profile at points of its own, within bounds of its own, from a table."""
    return wi.sweep_grid(encoded(spark, d), ExpressionScorer(), load(spark, d, "grid_points"))


CASES = [
    {"Age": 21, "Internships": 2, "CGPA": 8.5, "HistoryOfBacklogs": 0},
    {"Age": 24, "Internships": 0, "CGPA": 6.25, "HistoryOfBacklogs": 1},
    {"Age": 19, "Internships": 4, "CGPA": 9.75, "HistoryOfBacklogs": 0},
]
_JOINT = "grid as (" + " union all ".join(
    f"select id, {i} as case_nr, {fr.percent({f: f'{v}::double' for f, v in case.items()})} as percent, {fr.percent()} base from encoded" for i, case in enumerate(CASES)) + ")"


@query("sweep_joint", with_views(f"""select id, case_nr as "case", percent, {fr.half_up('(percent - base)', 1)} + 0::double delta from grid""", fr.encoded(), _JOINT))
def sweep_joint(spark, d):
    """Profiles under settings of age, internships, CGPA and backlogs all at once."""
    return wi.sweep_joint(encoded(spark, d), ExpressionScorer(), CASES)


_PREDICT = (
    *fr.GRAPH, fr.VOTES, fr.BEST, fr.gap_of("gap", "select id, recommended job from best"), fr.encoded(),
    f"scored as (select id, {fr.probability()} p from encoded)",
    f"""predicted as (select s.id, cast(p > 0.5 as int) prediction, round(p * 100, 2) probability_percentage, {fr.level('p')} risk_level, {fr.confidence('p')} confidence,
      b.recommended recommended_job, coalesce((select string_agg(g.skill, ', ' order by g.skill) from gap g where g.id = s.id), '') missing_skills,
      case when exists (select 1 from {{skills}} k where k.id = s.id) then coalesce(nullif(w.desired_role, ''), b.recommended) end target_role
    from scored s left join best b on b.id = s.id left join {{desired}} w on w.id = s.id)""",
)


def _predict(spark, d, graph=None):
    ready = engine(spark, d, graph or catalogue_graph(spark, d))
    return answers.predict(ready, load(spark, d, "profiles"), load(spark, d, "skills"), load(spark, d, "desired"))


@query("predict_batch", with_views("select * from predicted", *_PREDICT))
def predict_batch(spark, d):
    return _predict(spark, d).withColumn("missing_skills", F.array_join("missing_skills", ", "))


@query("predict_maps", with_views(
    """select id, centre, node, case when node = centre then 'centre' when exists (select 1 from {skills} s where s.id = x.id and s.skill = node) then 'owned' else 'missing' end status
    from (select p.id, p.target_role centre, unnest([p.target_role, a.dst]) node from predicted p join adj a on a.src = p.target_role) x group by all""", *_PREDICT))
def predict_maps(spark, d):
    """Gap maps of all predictions."""
    graph = catalogue_graph(spark, d)
    ready = engine(spark, d, graph)
    return answers.predict_maps(ready, _predict(spark, d, graph), load(spark, d, "skills"))


@query("result_json", with_views(
    """select id, '{{"prediction":' || prediction || ',"probability_percentage":' || probability_percentage || ',"risk_level":"' || risk_level || '","confidence":"' || confidence || '"'
    || coalesce(',"recommended_job":"' || recommended_job || '"', '') || ',"missing_skills":[' || case when missing_skills = '' then '' else '"' || replace(missing_skills, ', ', '","') || '"' end
    || ']' || coalesce(',"target_role":"' || target_role || '"', '') || '}}' as json from predicted""".replace("{{", "{").replace("}}", "}"), *_PREDICT))
def result_json(spark, d):
    return to_json_rows(_predict(spark, d))


_BASE = f"{CARD_INTERCEPT}::double + " + " + ".join(f"{CARD[f]}::double * (select avg({f}) from encoded)" for f in FEATURES)


@query("explain_batch", with_views(
    f"""select r.id, cast(r.rank as int) as rank, {_SHOWN} feature, round(shap, 4) impact, {_DIRECTION} direction, {_TEXT} interpretation, t.base_value, t.prediction_value
    from ranked r join (select id, round({_BASE}, 4) base_value,
      round({_BASE} + sum(shap), 4) prediction_value from impacts group by id) t on t.id = r.id
    where r.rank <= 5""", *_IMPACTS))
def explain_batch(spark, d):
    """The five strongest factors of every profile, with base and prediction value."""
    profiles = load(spark, d, "profiles")
    ready = engine(spark, d)
    attribution = at.LinearAttribution.fit(ExpressionScorer(), ready.encode(profiles))
    done = answers.explain(ready, profiles, attribution)
    return done.select("id", F.posexplode_outer("factors").alias("place", "f"), "base_value", "prediction_value").select(
        "id", (F.col("place") + 1).alias("rank"), "f.*", "base_value", "prediction_value"
    )


_CAREER = (*fr.GRAPH, fr.VOTES, fr.BEST, fr.WISH, fr.WALKS, fr.ROUTES, fr.CAREER)


@query("whatif_batch", with_views(
    f"select rank, {_SCENARIO_COLUMNS}, comb combined_risk from scenarios join (select id, comb from base) c using (id)",
    *_CAREER, *fr.scenarios(career=True)))
def whatif_batch(spark, d):
    """All scenarios of every profile, the career suggestion among them."""
    ready = engine(spark, d, catalogue_graph(spark, d))
    done = answers.whatif(ready, load(spark, d, "profiles"), load(spark, d, "skills"), load(spark, d, "desired"))
    return wi.scenario_rows(done)


@query("options", with_views(
    """select distinct 'stream' kind, Stream as value from {profiles} union all select distinct 'skill', skill from edges union all select distinct 'job', job from edges""",
    fr.TOKENS, fr.EDGES))
def options(spark, d):
    graph = SkillGraph.from_catalogue(load(spark, d, "catalogue"), measure=False)
    return answers.options(engine(spark, d, graph), load(spark, d, "profiles"))
