"""Queries on profiles: scans, validation, coercion, encoding, balancing, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradpath.catalog import fragments as fr
from gradpath.catalog.registry import dictionaries, encoded, query
from gradpath.functions.numeric import clamp
from gradpath.functions.text import yes_no
from gradpath.operators import balance as ba
from gradpath.operators import validate as va
from gradpath.operators.scale import MedianImputer, PopulationScaler
from gradpath.schema import FEATURES, LABEL
from gradpath.sources.readers import catalogue_columns
from gradpath.sources.views import load, with_views

PROFILE = ["id", "Age", "Gender", "Stream", "Internships", "CGPA", "Hostel", "HistoryOfBacklogs"]


@query("scan_profiles", with_views("select * from {profiles}"))
def scan_profiles(spark, d):
    return load(spark, d, "profiles").select(*PROFILE, LABEL)


@query("scan_catalogue", with_views("select row_id, job, skills, langs, tools from {catalogue}"))
def scan_catalogue(spark, d):
    """The catalogue under the padded header names of its source file."""
    raw = load(spark, d, "catalogue").toDF("row_id", " Job roles ", "Skills ", " Programming Languages", "Tools\t")
    return catalogue_columns(raw)


TYPED_FORM = r"""typed_form as (
select id, try_cast(regexp_extract(regexp_replace(age_text, '^{SPACE}+|{SPACE}+$', '', 'g'), '^[+-]?[0-9]+') as int) Age, Gender, Stream, coalesce(try_cast(trunc(try_cast(internships_text as double)) as int), 0) Internships,
  coalesce(try_cast(cgpa_text as double), 0) CGPA, Hostel, HistoryOfBacklogs,
  array_to_string(list_filter(list_transform(string_split(skills_text, ','), lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda s: s <> ''), '|') skills,
  nullif(role_text, '') desired_role, answer_text from {forms})""".replace("{SPACE}", fr.SPACE)


@query("coerce_form", with_views("select * exclude (answer_text) from typed_form", TYPED_FORM))
def coerce_form(spark, d):
    done = va.coerce_form(load(spark, d, "forms"))
    return done.select(*PROFILE, F.array_join("skills", "|").alias("skills"), "desired_role")


@query("validate_profiles", with_views(
    """select id, array_to_string([r for r in [
      case when Age is null then 'Age missing' end, case when Age < 15 then 'Age below 15' end, case when Age > 40 then 'Age above 40' end,
      case when Internships < 0 then 'Internships below 0' end,
      case when CGPA < 0 then 'CGPA below 0' end, case when CGPA > 10 then 'CGPA above 10' end,
      case when Hostel < 0 then 'Hostel below 0' end, case when Hostel > 1 then 'Hostel above 1' end,
      case when HistoryOfBacklogs < 0 then 'HistoryOfBacklogs below 0' end,
      case when HistoryOfBacklogs > 1 then 'HistoryOfBacklogs above 1' end] if r is not null], '; ') reasons from typed_form""", TYPED_FORM))
def validate_profiles(spark, d):
    """Every form with the reasons to reject it; valid ones have none."""
    marked = va.mark_violations(va.coerce_form(load(spark, d, "forms")))
    return marked.select("id", F.array_join("violations", "; ").alias("reasons"))


@query("normalise_flags", with_views(
    """select id, cast(case when Hostel = 1 then 1 else 0 end as int) Hostel,
    cast(case when HistoryOfBacklogs = 1 then 1 else 0 end as int) HistoryOfBacklogs from {forms}"""))
def normalise_flags(spark, d):
    return va.normalise_flags(load(spark, d, "forms")).select("id", "Hostel", "HistoryOfBacklogs")


@query("flags_yes_no", with_views(
    """select id, case when lower(trim(answer_text)) in ('true', 'yes', '1', '01') then 'Yes' else 'No' end answer,
    case when Hostel = 1 then 'Yes' else 'No' end hostel from {forms}"""))
def flags_yes_no(spark, d):
    return load(spark, d, "forms").select("id", yes_no(F.col("answer_text")).alias("answer"), yes_no(F.col("Hostel"), numeric=True).alias("hostel"))


@query("encode_profiles", with_views(
    "select id, Age, Gender, Stream, Internships, CGPA, Hostel, HistoryOfBacklogs, GenderName, StreamName from encoded",
    TYPED_FORM, fr.encoded("typed_form")))
def encode_profiles(spark, d):
    """Forms with unknown classes, encoded by the dictionaries of the profiles."""
    forms = va.coerce_form(load(spark, d, "forms"))
    return va.encode(forms, *dictionaries(spark, d)).select("id", *FEATURES, "GenderName", "StreamName")


@query("label_dictionary", with_views(
    """select 'Gender' field, v as value, cast(row_number() over (order by v) - 1 as int) code from (select distinct Gender v from {profiles}) a
    union all select 'Stream', v, cast(row_number() over (order by v) - 1 as int) from (select distinct Stream v from {profiles}) b"""))
def label_dictionary(spark, d):
    gender, stream = dictionaries(spark, d)
    return gender.table.select(F.lit("Gender").alias("field"), "value", "code").unionByName(
        stream.table.select(F.lit("Stream").alias("field"), "value", "code")
    )


@query("clamp_inputs", with_views(
    """select id, case when coalesce(CGPA, 0) = 0 or CGPA < 0 then 0 when CGPA > 10 then 10 else CGPA end::double CGPA,
    case when coalesce(Age, 0) = 0 or Age < 15 then 15 when Age > 40 then 40 else Age end::double Age,
    case when coalesce(Internships, 0) = 0 or Internships < 0 then 0 when Internships > 10 then 10 else Internships end::double Internships
    from typed_form""", TYPED_FORM))
def clamp_inputs(spark, d):
    forms = va.coerce_form(load(spark, d, "forms"))
    limit = lambda c, low, high: clamp(F.col(c).cast("double"), low, high).alias(c)
    return forms.select("id", limit("CGPA", 0, 10), limit("Age", 15, 40), limit("Internships", 0, 10))


@query("smote_quota", with_views(
    """select PlacedOrNot, count(*) n, cast(max(count(*)) over () - count(*) as bigint) quota from {unbalanced} group by PlacedOrNot"""))
def smote_quota(spark, d):
    return ba.class_quota(load(spark, d, "unbalanced"))


def _square(a: str, b: str) -> str:
    return " + ".join(f"({a}.{f} - {b}.{f})::double * ({a}.{f} - {b}.{f})::double" for f in FEATURES)


_MINORITY = (
    fr.encoded("{unbalanced}", "{unbalanced}"),
    "minority as (select * from encoded where PlacedOrNot = 1)",
    f"""near as (select id, rank, neighbour, d2 from (
      select a.id, b.id neighbour, {_square('a', 'b')} d2, row_number() over (partition by a.id order by {_square('a', 'b')}, b.id) rank
      from minority a join minority b on a.id <> b.id) x where rank <= 5)""",
)


def _minority(spark, d):
    return encoded(spark, d, "unbalanced").filter(F.col(LABEL) == 1)


@query("smote_neighbours", with_views("select id, cast(rank as int) as rank, neighbour, round(sqrt(d2), 6) distance from near", *_MINORITY))
def smote_neighbours(spark, d):
    """The five nearest members of its class for every placed profile."""
    return ba.neighbour_rows(ba.class_neighbours(_minority(spark, d)))


def _broken(part: str) -> str:
    return part.replace("minority as (select * from encoded where PlacedOrNot = 1)", """minority as (select * replace (Age::double + (id % 7) / 8::double as Age, Internships::double + (id % 5) / 10::double as Internships)
      from encoded where PlacedOrNot = 1)""")


@query("smote_neighbours_broken", with_views("select id, cast(rank as int) as rank, neighbour, round(sqrt(d2), 6) distance from near", *map(_broken, _MINORITY)))
def smote_neighbours_broken(spark, d):
    """The same where ages and internships are broken numbers."""
    part = lambda n, by: (F.col("id") % n).cast("double") / by
    rows = _minority(spark, d).withColumns({"Age": F.col("Age").cast("double") + part(7, 8), "Internships": F.col("Internships").cast("double") + part(5, 10)})
    return ba.neighbour_rows(ba.class_neighbours(rows))


@query("smote_balance", with_views(
    f"""select id, 0 as copy, {', '.join(f'round({f}::double, 6) {f}' for f in FEATURES)}, PlacedOrNot from encoded
    union all
    select m.id, cast(c.copy as int), {', '.join(f'round(m.{f}::double + u * (t.{f}::double - m.{f}::double), 6)' for f in FEATURES)}, m.PlacedOrNot
    from picks c join minority m on m.id = c.id join near n on n.id = c.id and n.rank = c.pick join minority t on t.id = n.neighbour""",
    *_MINORITY,
    "totals as (select count(*) filter (PlacedOrNot = 1) m, count(*) filter (PlacedOrNot = 0) - count(*) filter (PlacedOrNot = 1) quota from encoded)",
    f"""donors as (select id, quota // m + case when row_number() over (order by {fr.unit('id', "'lucky'")}, id) <= quota % m then 1 else 0 end copies
      from minority, totals)""",
    "copies as (select id, unnest(range(1, copies + 1)) as copy from donors)",
    f"""picks as (select c.id, c.copy, {fr.unit('c.id', "('along' || c.copy)")} u,
      cast(floor({fr.unit('c.id', "('pick' || c.copy)")} * (select count(*) from near n where n.id = c.id)) as int) + 1 pick from copies c)"""))
def smote_balance(spark, d):
    done = ba.balance(encoded(spark, d, "unbalanced"))
    return done.select("id", "copy", *[F.round(f, 6).alias(f) for f in FEATURES], LABEL)


@query("train_test_split", with_views(f"select id, {fr.unit('id', "'split'")} < 0.8 in_train from {{profiles}}"))
def train_test_split(spark, d):
    return ba.split(load(spark, d, "profiles")).select("id", "in_train")


@query("oof_folds", with_views(f"select id, cast(floor({fr.unit('id', "'fold'")} * 5) as int) fold from {{profiles}}"))
def oof_folds(spark, d):
    return ba.assign_folds(load(spark, d, "profiles"), 5).select("id", "fold")


GAPPY = ["Age", "Internships", "CGPA"]


@query("impute_median", with_views(
    "select id, " + ", ".join(f"coalesce({c}, (select median({c}) from {{gappy}}))::double {c}" for c in GAPPY) + " from {gappy}"))
def impute_median(spark, d):
    gappy = load(spark, d, "gappy")
    return MedianImputer(inputCols=GAPPY).fit(gappy).transform(gappy)


@query("standardise", with_views(
    "select id, " + ", ".join(
        f"round(({c} - (select avg({c}) from encoded)) / (select case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end from encoded), 6) {c}"
        for c in FEATURES) + " from encoded", fr.encoded()))
def standardise(spark, d):
    coded = encoded(spark, d)
    done = PopulationScaler(inputCols=FEATURES).fit(coded).transform(coded)
    return done.select("id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in FEATURES])
