"""Named pieces of checking SQL, written for the checking engine only.

They state each result in the plainest relational form (all pairs, windows over whole
groups, recursion), not in the form the Spark operators compute it.
"""

from __future__ import annotations

from gradpath.operators.scoring import CARD, CARD_INTERCEPT
from gradpath.operators.whatif import CS, TEXTS
from gradpath.schema import FEATURES

# white space of every kind, as the characters themselves
SPACE = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

TOKENS = r"""tokens as (
select job, row_id ord_row, i ord_pos, regexp_replace(parts[i + 1], '^{SPACE}+|{SPACE}+$', '', 'g') skill
from (select *, unnest(range(len(parts))) i from (
  select row_id, job, string_split(coalesce(skills, '') || ',' || langs || ',' || coalesce(tools, ''), ',') parts from {catalogue}) a
where parts is not null) b)""".replace("{SPACE}", SPACE)

EDGES = """edges as (
select job, skill, ord_row, cast(ord_pos as int) ord_pos from (
  select *, row_number() over (partition by job, skill order by ord_row, ord_pos) rn from tokens where length(skill) > 1) a where rn = 1)"""

ADJ = """adj as (
select src, dst, ord_row, ord_pos from (
  select *, row_number() over (partition by src, dst order by ord_row, ord_pos) rn from (
    select job src, skill dst, ord_row, ord_pos from edges union all select skill, job, ord_row, ord_pos from edges) a) b where rn = 1)"""

GRAPH = (TOKENS, EDGES, ADJ)

VOTES = """votes as (
select id, job, votes, row_number() over (partition by id order by votes desc, pos, ord_row, ord_pos) rank from (
  select id, dst job, pos, ord_row, ord_pos, count(*) over (partition by id, dst) votes,
    row_number() over (partition by id, dst order by pos, ord_row, ord_pos) first
  from {skills} join adj on skill = src) a where first = 1)"""

BEST = "best as (select id, job recommended, votes from votes where rank = 1)"

WISH = "wish as (select id, desired_role job from {desired} where desired_role <> '')"


def gap_of(name: str, targets: str) -> str:
    """(id, job, skill): what the target asks for and the person has not."""
    return f"""{name} as (
select t.id, t.job, a.dst skill from ({targets}) t join adj a on a.src = t.job
where not exists (select 1 from {{skills}} s where s.id = t.id and s.skill = a.dst))"""


def encoded(view: str = "{profiles}", trained_on: str = "{profiles}", name: str = "encoded") -> str:
    return f"""{name} as (
select p.* exclude (Gender, Stream, Hostel, HistoryOfBacklogs), p.Gender GenderName, p.Stream StreamName,
  cast(case when g.code is null or s.code is null then 0 else g.code end as int) Gender,
  cast(case when g.code is null or s.code is null then 0 else s.code end as int) Stream,
  cast(case when Hostel = 1 then 1 else 0 end as int) Hostel,
  cast(case when HistoryOfBacklogs = 1 then 1 else 0 end as int) HistoryOfBacklogs
from {view} p
left join (select v, row_number() over (order by v) - 1 code from (select distinct Gender v from {trained_on}) x) g on g.v = p.Gender
left join (select v, row_number() over (order by v) - 1 code from (select distinct Stream v from {trained_on}) x) s on s.v = p.Stream)"""


def margin(values: dict[str, str] | None = None, coefs: dict | None = None) -> str:
    values, coefs = values or {}, coefs or CARD
    return f"{CARD_INTERCEPT}::double" + "".join(f" + {coefs[f]}::double * {values.get(f, f)}" for f in FEATURES)


def probability(values: dict[str, str] | None = None, coefs: dict | None = None) -> str:
    return f"(1::double / (1::double + exp(-({margin(values, coefs)}))))"


def percent(values: dict[str, str] | None = None, coefs: dict | None = None) -> str:
    return f"round({probability(values, coefs)} * 100, 6)"


def level(p: str) -> str:
    return f"case when {p} >= 0.5 then 'LOW' when {p} >= 0.3 then 'MEDIUM' else 'HIGH' end"


def confidence(p: str) -> str:
    return (
        f"case when {p} >= 0.7 then 'Very High Confidence' when {p} >= 0.5 then 'High Confidence' "
        f"when {p} >= 0.3 then 'Moderate Confidence' else 'High Confidence' end"
    )


def unit(ident: str, label: str) -> str:
    return f"(('0x' || substr(md5({ident} || ':' || {label}), 1, 13))::bigint / {16**13}::double)"


def half_up(x: str, digits: int) -> str:
    scale = f"{10 ** digits}::double"
    return f"(sign({x}) * (floor(abs({x}) * {scale} + 0.5::double) / {scale}))"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {half_up(x, digits)} + 0::double)"


RAISED = {"CGPA": "least(CGPA + 1::double, 10::double)", "Internships": "(Internships + 1)", "HistoryOfBacklogs": "0"}
COMBINED = {
    "CGPA": f"(case when CGPA < 9 then {RAISED['CGPA']} else CGPA end)",
    "Internships": "(case when Internships < 3 then Internships + 1 else Internships end)",
    "HistoryOfBacklogs": "0",
}


def scenarios(coefs: dict | None = None, career: bool = False) -> tuple[str, ...]:
    """Fragments ending in ``scenarios``: numbered and ranked scenario rows."""
    base = f"base as (select *, {percent(None, coefs)} orig, {percent(COMBINED, coefs)} comb from encoded)"
    parts = [  # number, scenario, its score, old and new value, head of the summary, condition
        (1, "cgpa", percent({"CGPA": RAISED["CGPA"]}, coefs), "cast(CGPA as varchar)", f"cast({RAISED['CGPA']} as varchar)", "CGPA: ", "CGPA < 9"),
        (2, "internship", percent({"Internships": RAISED["Internships"]}, coefs), "cast(Internships as varchar)", "cast(Internships + 1 as varchar)", "Internships: ", "Internships < 3"),
        (3, "backlogs", percent({"HistoryOfBacklogs": "0"}, coefs), "'Yes'", "'No'", "Backlogs: ", "HistoryOfBacklogs = 1"),
        (4, "stream", percent({"Stream": "1"}, coefs), "StreamName", f"'{CS}'", "Stream: ", f"StreamName <> '{CS}' and modified > orig"),
        (5, "hostel", percent({"Hostel": "1"}, coefs), "'No'", "'Yes'", "Hostel: ", "Hostel = 0 and modified > orig"),
    ]
    rows = []
    for kind, name, modified, old, new, head, when in parts:
        title, text, icon, factor = TEXTS[name]
        rows.append(f"""select id, {kind} kind, '{title}' title, '{text}' description, '{head}' || {old} || ' → ' || {new} change_summary,
orig original_risk, modified modified_risk, '{icon}' icon, '{factor}' factor_changed, {old} original_value, {new} suggested_value
from (select *, {modified} modified from base) b where {when}""")
    if career:
        title, text, icon, factor = TEXTS["career"]
        rows.insert(0, f"""select b.id, 0 kind, '{title}' title, '{text}' description, 'Learn: ' || learn change_summary,
orig original_risk, orig modified_risk, '{icon}' icon, '{factor}' factor_changed, 'Current Skills' original_value, learn suggested_value
from base b join career c on c.id = b.id and c.learn <> ''""")
    numbered = f"""scenarios as (
select id, cast(row_number() over (partition by id order by risk_delta desc, scenario_id) as int) rank, title, description, change_summary,
  original_risk, modified_risk, risk_delta,
  round(case when original_risk > 0 then risk_delta / original_risk * 100 else risk_delta * 100 end, 6) risk_reduction_percent,
  icon, factor_changed, original_value, suggested_value, scenario_id
from (select *, round(modified_risk - original_risk, 6) risk_delta,
        cast(row_number() over (partition by id order by kind) as int) scenario_id
      from ({' union all '.join(rows)}) u) v)"""
    return (encoded(), base, numbered)


# shortest paths of the dense catalogue graph, by levels, with the least path kept
WALKS = """walks(source, node, hops, path) as (
select src, src, 0, [src] from (select distinct src from adj) a
union all
select source, node, hops, min(path) from (
  select w.source, a.dst node, w.hops + 1 hops, list_append(w.path, a.dst) path from walks w join adj a on a.src = w.node where w.hops < 6) x
group by source, node, hops)"""

ROUTES = """routes as (
select source, node target, hops, path from (
  select *, row_number() over (partition by source, node order by hops) rn from walks) w where rn = 1)"""

CAREER = """career_pairs as (select b.id, b.recommended source, w.job target from best b join wish w on w.id = b.id),
kinds as (select name, bool_or(j) is_job, bool_or(s) is_skill from (
  select job name, true j, false s from edges union all select skill, false, true from edges) x group by name),
found as (select c.id, c.source, c.target, r.hops, r.path from career_pairs c join routes r on r.source = c.source and r.target = c.target),
lessons as (
select source, target, string_agg(node, ', ' order by i) learn from (
  select source, target, path[i + 1] node, i from (
    select source, target, path, unnest(range(len(path))) i from (select distinct source, target, path from found) a) b) n
join kinds k on k.name = n.node where k.is_skill group by source, target),
career as (select f.*, coalesce(l.learn, '') learn from found f left join lessons l on l.source = f.source and l.target = f.target)"""
