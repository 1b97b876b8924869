"""Career and profile tables derived from the supplied star-schema tables.

Each view is one SQL text over the whole tables that means the same in Spark and in
the checking engine; a table or another view is named in braces. The operators under
test are not in here, only their inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

PROFILE_TEXT = """
select b.*, case when CGPA + cast(1.5 as double) * Internships - HistoryOfBacklogs
    + ((id * 7919) % 100) / cast(50 as double) > {limit} then 1 else 0 end PlacedOrNot
from (
  select c_custkey id, cast(18 + c_custkey % 13 as int) Age,
    case when c_custkey % 2 = 0 then 'Male' else 'Female' end Gender,
    case c_mktsegment when 'AUTOMOBILE' then 'Mechanical' when 'BUILDING' then 'Civil'
      when 'FURNITURE' then 'Electrical' when 'HOUSEHOLD' then 'Information Technology'
      else 'Computer Science' end Stream,
    cast(least(coalesce(n, 0) % 5, 3) as int) Internships,
    round(greatest(cast(0 as double), least(cast(10 as double), (c_acctbal + 1000) / 1100)), 2) CGPA,
    cast(c_nationkey % 2 as int) Hostel,
    case when c_custkey % 4 = 0 then 1 else 0 end HistoryOfBacklogs
  from {customer} left join (select o_custkey, count(*) n from {orders} group by o_custkey) oc
    on c_custkey = o_custkey) b
"""

VIEWS = {
    # one row per customer
    "profiles": PROFILE_TEXT.replace("{limit}", "8.5"),
    # the same with a smaller placed class, for balancing
    "unbalanced": PROFILE_TEXT.replace("{limit}", "11"),
    # one skill per order: tools, languages, some unknown skills, some job names
    "skills": """
select o_custkey id, pos, skill from (
select o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) pos,
  case when o_orderpriority = '1-URGENT' then concat('L', o_orderkey % 20)
       when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' then concat('S', o_orderkey % 7)
       when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then concat('Brand#', 1 + o_orderkey % 25, ' PROMO')
       else concat('T', 1 + o_orderkey % 50) end skill
from {orders}) listed""",
    # one row per part; null languages and tools on some rows
    "catalogue": """
select p_partkey row_id, concat(p_brand, ' ', p_type) job,
  concat(split_part(p_name, ' ', 1), ' , ', split_part(p_name, ' ', 2)) skills,
  case when p_partkey % 17 <> 0 then concat('L', p_size % 20) end langs,
  case when p_partkey % 5 <> 0 then concat('T', p_size) end tools
from {part}""",
    # points of the simulator, some beyond their bounds, missing, of unknown fields or profiles
    "grid_points": """
select c_custkey + case when o_orderkey % 41 = 0 then 1000000000 else 0 end id,
  case o_orderkey % 5 when 0 then 'CGPA' when 1 then 'Age' when 2 then 'Internships' when 3 then 'HistoryOfBacklogs' else case when o_orderkey % 9 = 4 then 'Height' else 'CGPA' end end field,
  case when o_orderkey % 23 = 0 then null else cast(o_orderkey % 40 as double) / cast(4 as double) end as value,
  cast(c_custkey % 3 as double) low, cast(5 + c_custkey % 6 as double) high
from {orders} join {customer} on o_custkey = c_custkey""",
    # messages of which some lack their conversation or their turn
    "loose_messages": """
select case when (conv_id + turn) % 11 = 3 then null else conv_id end conv_id, case when (conv_id + 3 * turn) % 13 = 2 then null else turn end turn, role, text from {conversations}""",
    # null, empty or a role name
    "desired": """
select c_custkey id, case when c_custkey % 3 = 0 then null
  when c_custkey % 3 = 1 and c_custkey % 7 = 0 then ''
  else concat('Brand#', 1 + c_custkey % 25, ' ', case c_custkey % 6 when 0 then 'ECONOMY' when 1 then 'LARGE'
    when 2 then 'MEDIUM' when 3 then 'PROMO' when 4 then 'SMALL' else 'STANDARD' end) end desired_role
from {customer}""",
    # customers as roles, the parts they bought as skills
    "trade_graph": """
select concat('C', o_custkey) job, concat('P', l_partkey) skill, min(l_orderkey) ord_row,
  cast(min(l_linenumber) as int) ord_pos
from {lineitem} join {orders} on l_orderkey = o_orderkey group by 1, 2""",
    # every customer and the customer with the next key
    "trade_pairs": """
select c_custkey id, concat('C', c_custkey) source, concat('C', c_custkey + 1) target from {customer}""",
    # web-form input as typed, with values out of range
    "forms": """
select c_custkey id,
  case when c_custkey % 19 = 0 then 'n/a' else cast(12 + c_custkey % 32 as varchar(9)) end age_text,
  case c_custkey % 7 when 0 then 'Other' when 1 then '' when 2 then 'Male' when 3 then 'Female'
    when 4 then 'Male' else 'Female' end Gender,
  case when c_custkey % 11 = 0 then 'Marine' when c_mktsegment = 'AUTOMOBILE' then 'Mechanical'
    when c_mktsegment = 'BUILDING' then 'Civil' when c_mktsegment = 'FURNITURE' then 'Electrical'
    when c_mktsegment = 'HOUSEHOLD' then 'Information Technology' else 'Computer Science' end Stream,
  case when c_custkey % 13 = 0 then 'many' else cast(c_custkey % 6 - 1 as varchar(9)) end internships_text,
  case when c_custkey % 23 = 0 then '' else cast(round((c_acctbal + 500) / 900, 2) as varchar(20)) end cgpa_text,
  cast(c_nationkey % 3 as int) Hostel, cast(c_custkey % 5 - 1 as int) HistoryOfBacklogs,
  concat(' T', 1 + c_nationkey, ' ,, L', c_custkey % 20, ',', c_name, ' , ') skills_text,
  case when c_custkey % 3 = 0 then '' else concat('Brand#', 1 + c_custkey % 25, ' PROMO') end role_text,
  case c_nationkey % 9 when 0 then ' TRUE ' when 1 then 'yes' when 2 then '1' when 3 then 'No'
    when 4 then '0' when 5 then 'maybe' when 6 then '01' when 7 then '1.0' else '' end answer_text
from {customer}""",
    # profiles with gaps
    "gappy": """
select id, case when id % 9 = 4 then null else Age end Age, case when Internships = 0 then null else Internships end Internships,
  case when CGPA < 1 then null else CGPA end CGPA from {profiles}""",
    # what a user typed into the skill box, and what was already chosen
    "typed": """
select id, pos, skill, case pos % 4 when 0 then concat('  ', lower(skill)) when 1 then upper(skill)
    when 2 then concat(skill, ' ') else skill end typed,
  lower(substring(skill, 2)) fragment from {skills}""",
    # request log
    "requests": """
select event_id, ts, case event_type when 'signup' then 'POST' when 'purchase' then 'POST' else 'GET' end method,
  concat('/', event_type) path, case when event_type = 'error' then 503 when value > 200 then 404 else 200 end status,
  case when user_id % 3 = 0 then concat(' 10.0.0.', user_id, ' , 172.16.0.1') end forwarded_for,
  case when user_id % 3 < 2 then concat('10.1.0.', user_id) end real_ip,
  case when event_id % 2 = 0 then concat('10.2.0.', user_id) end peer
from {events}""",
    # conversation texts with the mark-up and the failures a model reply may carry
    "replies": """
select conv_id, turn, role, concat('- **', role, '** & *turn* `', turn, '` <b>', chr(10), '  ', turn, '. item', chr(10), text) marked,
  case turn % 5 when 1 then concat('Connection error: ', text) when 3 then concat(text, ' HTTP 404')
    else text end reply, case when length(text) % 7 = 0 then 'ERROR' else 'ok' end status
from {conversations}""",
}


def _names(text: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", text)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table or one of the views above, lazily."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in set(_names(text))})


def with_views(body: str, *extra: str) -> str:
    """Checking SQL: ``body`` preceded by the views it names in braces.

    ``extra`` are further named fragments, each "name as (...)", placed before the body.
    """
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in needed:
                visit(VIEWS[n])
                needed.append(n)

    for text in (*extra, body):
        visit(text)
    parts = [f"{n} as ({VIEWS[n]})" for n in needed] + list(extra)
    head = "with recursive " + ",\n".join(parts) + "\n" if parts else ""
    return re.sub(r"\{(\w+)\}", r"\1", head + body)
