"""Queries on the job-skill graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradpath.catalog import fragments as fr
from gradpath.catalog.registry import catalogue_graph, query
from gradpath.operators import graph as gr
from gradpath.operators import paths, search
from gradpath.operators.graph import SkillGraph
from gradpath.plans.answers import career_skills
from gradpath.session import cut_lineage
from gradpath.sources.views import load, with_views


def _wish(spark, d):
    return load(spark, d, "desired").filter(F.col("desired_role") != "").select("id", F.col("desired_role").alias("job"))


@query("graph_edges", with_views("select * from edges", fr.TOKENS, fr.EDGES))
def graph_edges(spark, d):
    return gr.build_edges(load(spark, d, "catalogue"))


@query("skill_list", with_views("select distinct skill from edges", fr.TOKENS, fr.EDGES))
def skill_list(spark, d):
    return SkillGraph.from_catalogue(load(spark, d, "catalogue"), measure=False).skill_list()


@query("job_list", with_views("select distinct job from edges", fr.TOKENS, fr.EDGES))
def job_list(spark, d):
    return SkillGraph.from_catalogue(load(spark, d, "catalogue"), measure=False).job_list()


@query("graph_summary", with_views(
    """select (select count(distinct job) from edges) jobs, (select count(distinct skill) from edges) skills,
    (select count(distinct src) from adj) nodes, (select count(*) from adj where src <= dst) edges""", *fr.GRAPH))
def graph_summary(spark, d):
    return SkillGraph.from_catalogue(load(spark, d, "catalogue"), measure=False).summary()


@query("neighbours", with_views("select distinct skill as name, dst as neighbour from {skills} join adj on skill = src", *fr.GRAPH))
def neighbours(spark, d):
    """Neighbours of everything people list as a skill, role names among it."""
    return catalogue_graph(spark, d).neighbours(load(spark, d, "skills"), "skill")


@query("skill_gap", with_views("select * from gap", *fr.GRAPH, fr.WISH, fr.gap_of("gap", "select * from wish")))
def skill_gap(spark, d):
    """Missing skills for the desired roles, one row per skill."""
    return gr.gap_rows(catalogue_graph(spark, d), _wish(spark, d), load(spark, d, "skills"))


@query("recommend_role", with_views("select * from best", *fr.GRAPH, fr.VOTES, fr.BEST))
def recommend_role(spark, d):
    return gr.recommend(catalogue_graph(spark, d), load(spark, d, "skills"))


@query("recommend_topk", with_views("select id, cast(rank as int) as rank, job, votes from votes where rank <= 3", *fr.GRAPH, fr.VOTES))
def recommend_topk(spark, d):
    return gr.recommend_topk(catalogue_graph(spark, d), load(spark, d, "skills"), 3)


@query("recommend_gap", with_views(
    """select b.id, b.recommended, b.votes, coalesce(string_agg(g.skill, ', ' order by g.skill), '') missing, count(g.skill) missing_count
    from best b left join gap g on g.id = b.id group by b.id, b.recommended, b.votes""",
    *fr.GRAPH, fr.VOTES, fr.BEST, fr.gap_of("gap", "select id, recommended job from best")))
def recommend_gap(spark, d):
    """Everyone's recommended role and what they still lack for it."""
    graph, skills = catalogue_graph(spark, d), load(spark, d, "skills")
    best = cut_lineage(gr.recommend(graph, skills))
    found = gr.gaps(graph, best.select("id", F.col("recommended").alias("job")), skills)
    return best.join(found, "id").select(
        "id", "recommended", "votes", F.array_join("missing", ", ").alias("missing"), F.size("missing").cast("bigint").alias("missing_count")
    )


@query("desired_gap", with_views(
    """select w.id, w.job, exists(select 1 from adj where src = w.job) known_job,
    coalesce((select string_agg(g.skill, ', ' order by g.skill) from gap g where g.id = w.id), '') missing from wish w""",
    *fr.GRAPH, fr.WISH, fr.gap_of("gap", "select * from wish")))
def desired_gap(spark, d):
    found = gr.gaps(catalogue_graph(spark, d), _wish(spark, d), load(spark, d, "skills"))
    return found.select("id", "job", "known_job", F.array_join("missing", ", ").alias("missing"))


@query("readiness_text", with_views(
    """select w.id, w.job, case when count(g.skill) = 0 then 'None - Ready!' else string_agg(g.skill, ', ' order by g.skill) end readiness,
    count(g.skill) missing_count from wish w left join gap g on g.id = w.id group by w.id, w.job""",
    *fr.GRAPH, fr.WISH, fr.gap_of("gap", "select * from wish")))
def readiness(spark, d):
    found = gr.gaps(catalogue_graph(spark, d), _wish(spark, d), load(spark, d, "skills"))
    return found.select("id", "job", gr.readiness_text(F.col("missing")).alias("readiness"), F.size("missing").cast("bigint").alias("missing_count"))


_REACH = (
    "links as materialized (select job src, skill dst from {trade_graph} union select skill, job from {trade_graph})",
    """reach(source, node, hops) using key (source, node) as (
    select source, source, 0 from {trade_pairs} p where exists (select 1 from links where src = p.source)
    union
    select r.source, l.dst, min(r.hops + 1) from reach r join links l on l.src = r.node
      left join recurring.reach o on o.source = r.source and o.node = l.dst where o.node is null group by r.source, l.dst)""",
)


@query("transition_length", with_views(
    """select p.source, p.target, case when p.source = p.target then 0 when a.src is null or b.src is null then null else r.hops end hops
    from {trade_pairs} p left join reach r on r.source = p.source and r.node = p.target
    left join (select distinct src from links) a on a.src = p.source left join (select distinct src from links) b on b.src = p.target""", *_REACH))
def transition_length(spark, d):
    """Hops between neighbouring customers over the parts they bought."""
    graph = SkillGraph.from_edges(load(spark, d, "trade_graph"), measure=False)
    return paths.shortest_paths(graph, load(spark, d, "trade_pairs"), with_path=False)


_CAREER = (*fr.GRAPH, fr.VOTES, fr.BEST, fr.WISH, fr.WALKS, fr.ROUTES, fr.CAREER)


@query("transition_path", with_views(
    """select p.source, p.target, r.hops, array_to_string(r.path, ' > ') path
    from (select distinct source, target from career_pairs) p left join routes r on r.source = p.source and r.target = p.target""", *_CAREER))
def transition_path(spark, d):
    """Least shortest path from every recommended to every desired role that goes with it."""
    graph, skills = catalogue_graph(spark, d), load(spark, d, "skills")
    pairs = gr.recommend(graph, skills).join(_wish(spark, d), "id").select(F.col("recommended").alias("source"), F.col("job").alias("target"))
    found = paths.shortest_paths(graph, pairs)
    return found.select("source", "target", "hops", F.array_join("path", " > ").alias("path"))


@query("transition_steps", with_views(
    """select r.source, r.target, cast(i as int) step, r.path[i + 1] node, k.is_skill,
      k.is_job and r.path[i + 1] <> r.source and r.path[i + 1] <> r.target is_stone
    from (select *, unnest(range(len(path))) i from (select distinct source, target, path from career)) r join kinds k on k.name = r.path[i + 1]""", *_CAREER))
def transition_steps(spark, d):
    graph, skills = catalogue_graph(spark, d), load(spark, d, "skills")
    pairs = gr.recommend(graph, skills).join(_wish(spark, d), "id").select(F.col("recommended").alias("source"), F.col("job").alias("target"))
    return paths.path_steps(paths.shortest_paths(graph, pairs), graph)


@query("trade_paths", with_views(
    """select source, target, hops, array_to_string(path, ' > ') path, array_to_string(list_filter(path, lambda x: x[1] = 'P'), ' > ') skills_to_learn,
      array_to_string(list_filter(path, lambda x: x[1] = 'C' and x <> source and x <> target), ' > ') stepping_stones from walk where togo = 0""",
    *_REACH,
    """walk(source, target, hops, node, togo, path) as (
    select p.source, p.target, r.hops, p.source, r.hops, [p.source] from {trade_pairs} p join reach r on r.source = p.target and r.node = p.source
    union all
    select w.source, w.target, w.hops, min(l.dst), w.togo - 1, list_append(any_value(w.path), min(l.dst)) from walk w join links l on l.src = w.node
      join reach r on r.source = w.target and r.node = l.dst and r.hops = w.togo - 1 where w.togo > 0 group by w.source, w.target, w.hops, w.togo)"""))
def trade_paths(spark, d):
    """Paths with their skills and stepping stones on the large, sparse graph."""
    graph = SkillGraph.from_edges(load(spark, d, "trade_graph"), measure=False)
    found = paths.transitions(paths.shortest_paths(graph, load(spark, d, "trade_pairs")), graph)
    return found.select("source", "target", "hops", *[F.array_join(c, " > ").alias(c) for c in ("path", "skills_to_learn", "stepping_stones")])


@query("whatif_career", with_views("select id, source recommended, target desired_role, learn from career where learn <> ''", *_CAREER))
def whatif_career(spark, d):
    found = career_skills(catalogue_graph(spark, d), load(spark, d, "skills"), load(spark, d, "desired"))
    return found.select("id", "recommended", "desired_role", F.array_join("skills_to_learn", ", ").alias("learn"))


_TARGETS = "targets as (select id, job from wish where exists (select 1 from {skills} s where s.id = wish.id))"


def _targets(spark, d):
    return _wish(spark, d).join(load(spark, d, "skills").select("id").distinct(), "id", "left_semi")


@query("gap_map_nodes", with_views(
    """select id, centre, node, case when node = centre then 'centre'
      when exists (select 1 from {skills} s where s.id = x.id and s.skill = node) then 'owned' else 'missing' end status
    from (select t.id, t.job centre, t.job node from targets t where exists (select 1 from adj where src = t.job)
          union select t.id, t.job, a.dst from targets t join adj a on a.src = t.job) x""", *fr.GRAPH, fr.WISH, _TARGETS))
def gap_map_nodes(spark, d):
    return gr.gap_map_nodes(catalogue_graph(spark, d), _targets(spark, d), load(spark, d, "skills"))


@query("gap_map_edges", with_views(
    """select distinct m.centre, least(a.src, a.dst) a, greatest(a.src, a.dst) b
    from members m join adj a on a.src = m.node join members n on n.centre = m.centre and n.node = a.dst""",
    *fr.GRAPH, fr.WISH, """members as (select distinct job centre, job node from wish where exists (select 1 from adj where src = wish.job)
      union select distinct w.job, a.dst from wish w join adj a on a.src = w.job)"""))
def gap_map_edges(spark, d):
    return gr.gap_map_edges(catalogue_graph(spark, d), _wish(spark, d))


@query("skill_search", with_views(
    """select query_id, cast(rank as int) as rank, skill from (
      select q.query_id, c.skill, row_number() over (partition by q.query_id order by c.skill) rank
      from (select id * 1000 + pos query_id, id, fragment from {typed}) q join (select distinct skill from edges) c on contains(lower(c.skill), lower(q.fragment))
      where not exists (select 1 from {skills} s where s.id = q.id and s.skill = c.skill)) x where rank <= 50""", fr.TOKENS, fr.EDGES))
def skill_search(spark, d):
    typed = load(spark, d, "typed").select((F.col("id") * 1000 + F.col("pos")).alias("query_id"), "id", F.col("fragment").alias("text"))
    return search.skill_search(typed, load(spark, d, "skills"), gr.build_edges(load(spark, d, "catalogue")).select("skill"))


@query("canonical_skills", with_views(
    r"""select id * 1000 + pos entry_id, id, (select min(skill) from edges where lower(skill) = lower(plain)) skill
    from (select *, regexp_replace(typed, '^\s+|\s+$', '', 'g') plain from {typed}) t
    where plain <> '' and exists (select 1 from edges where lower(skill) = lower(plain))
      and not exists (select 1 from {skills} s where s.id = t.id and s.skill = t.plain)""", fr.TOKENS, fr.EDGES))
def canonical_skills(spark, d):
    typed = load(spark, d, "typed").select((F.col("id") * 1000 + F.col("pos")).alias("entry_id"), "id", "typed")
    return search.canonical_skills(typed, load(spark, d, "skills"), gr.build_edges(load(spark, d, "catalogue")))
