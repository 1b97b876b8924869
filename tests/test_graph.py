"""Edges, recommendation, gaps, maps and look-up on hand-made catalogues."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gradpath.operators import graph as gr
from gradpath.operators import search, voting
from gradpath.sources.readers import catalogue_columns, read_catalogue


@pytest.fixture(scope="module")
def graph(tiny_catalogue):
    return gr.SkillGraph.from_catalogue(tiny_catalogue)


def skills_of(spark, lists):
    rows = [(i, p, s) for i, listed in lists.items() for p, s in enumerate(listed)]
    return spark.createDataFrame(rows, "id bigint, pos int, skill string")


def edge_set(edges):
    return {(r["job"], r["skill"]) for r in edges.collect()}


def test_null_languages_void_the_row(tiny_catalogue):
    assert not any(j == "Job A" for j, _ in edge_set(gr.build_edges(tiny_catalogue)))
    lenient = edge_set(gr.build_edges(tiny_catalogue, "lenient"))
    assert {("Job A", "x1"), ("Job A", "y1"), ("Job A", "z1")} <= lenient


def test_short_and_blank_tokens_are_dropped(tiny_catalogue):
    mine = {s for j, s in edge_set(gr.build_edges(tiny_catalogue)) if j == "Job B"}
    assert mine == {"x1", "y1", "Go", "Rust"}


def test_first_seen_place(tiny_catalogue):
    place = {(r["job"], r["skill"]): (r["ord_row"], r["ord_pos"]) for r in gr.build_edges(tiny_catalogue).collect()}
    assert place["Job B", "y1"] == (2, 1)
    assert place["Job B", "Rust"] == (6, 2)


def test_missing_language_column(spark):
    df = spark.createDataFrame([(1, "J", "aa,bb", "tt")], ["row_id", " Job roles ", "Skills ", "Tools"])
    assert edge_set(gr.build_edges(catalogue_columns(df))) == {("J", "aa"), ("J", "bb"), ("J", "tt")}


def test_catalogue_file_with_padded_header(spark, tmp_path):
    text = 'Job roles, Skills ,Programming Languages,Tools\nJ1,"aa,bb",Go,tt\nJ2,"bb,aa",,tt\nJ3,cc,Go,\n'
    (tmp_path / "c.csv").write_text(text)
    df = read_catalogue(spark, str(tmp_path / "c.csv"))
    assert [r["row_id"] for r in df.orderBy("row_id").collect()] == [0, 1, 2]
    assert edge_set(gr.build_edges(df)) == {("J1", "aa"), ("J1", "bb"), ("J1", "Go"), ("J1", "tt"), ("J3", "cc"), ("J3", "Go")}


def test_totals_count_a_shared_name_once(graph):
    row = graph.summary().first()
    assert (row["jobs"], row["skills"]) == (5, 8)  # Job B, Job C, SQL, Job D, Isle
    assert row["nodes"] == 12
    assert row["edges"] == 4 + 3 + 2 + 2 + 1


def test_lists_are_sorted(graph):
    jobs = [r[0] for r in graph.job_list().collect()]
    assert jobs == sorted(jobs) and "SQL" in jobs


def test_vote_tie_goes_to_the_first_met(spark, graph):
    # x1 is asked for by Job B, Job C and SQL, in this order
    got = gr.recommend(graph, skills_of(spark, {1: ["x1"], 2: ["unknown"], 3: ["w1", "y1"], 4: ["y1", "w1"]}))
    assert {r["id"]: r["recommended"] for r in got.collect()} == {1: "Job B", 3: "Job C", 4: "Job B"}


def test_repeated_skill_votes_twice(spark, graph):
    got = gr.recommend(graph, skills_of(spark, {1: ["x1", "x1", "w1", "y1"], 2: ["w1", "w1", "x1", "y1"]}))
    assert {r["id"]: (r["recommended"], r["votes"]) for r in got.collect()} == {1: ("Job B", 3), 2: ("Job C", 3)}


def test_role_name_as_skill_brings_its_skills(spark, graph):
    # "SQL" is a role (with x1, q1) and a skill (of Job D)
    got = gr.recommend_topk(graph, skills_of(spark, {1: ["SQL"]}), 5)
    assert [(r["rank"], r["job"]) for r in got.orderBy("rank").collect()] == [(1, "x1"), (2, "q1"), (3, "Job D")]


def test_recommendation_against_plain_counting(spark, graph, tiny_catalogue):
    edges = sorted(gr.build_edges(tiny_catalogue).collect(), key=lambda r: (r["ord_row"], r["ord_pos"]))
    near = {}
    for r in edges:
        near.setdefault(r["job"], []).append(r["skill"])
        near.setdefault(r["skill"], []).append(r["job"])
    names = ["x1", "y1", "w1", "Go", "q1", "SQL", "Rust", "nope", "Job C"]
    people = {i: [names[(i * 7 + j * j) % len(names)] for j in range(1 + i % 6)] for i in range(40)}
    want = {}
    for i, listed in people.items():
        pool = [n for s in listed for n in near.get(s, [])]
        if pool:
            want[i] = Counter(pool).most_common(1)[0][0]
    for parts in (1, 5):
        got = gr.recommend(graph, skills_of(spark, people).repartition(parts)).collect()
        assert {r["id"]: r["recommended"] for r in got} == want
    unhinted = gr.SkillGraph.from_catalogue(tiny_catalogue, measure=False)
    assert {r["id"]: r["recommended"] for r in gr.recommend(unhinted, skills_of(spark, people)).collect()} == want


def test_gaps(spark, graph):
    targets = spark.createDataFrame([(1, "Job B"), (2, "Nowhere"), (3, "Isle"), (4, "job b")], "id bigint, job string")
    got = gr.gaps(graph, targets, skills_of(spark, {1: ["x1", "Go", "go"], 3: ["lone1"]}))
    rows = {r["id"]: (r["known_job"], r["missing"]) for r in got.collect()}
    assert rows == {1: (True, ["Rust", "y1"]), 2: (False, []), 3: (True, []), 4: (False, [])}
    text = got.select("id", gr.readiness_text(got["missing"]).alias("t"))
    assert {r["id"]: r["t"] for r in text.collect()}[1] == "Rust, y1"
    assert {r["id"]: r["t"] for r in text.collect()}[3] == "None - Ready!"


def test_target_role_prefers_a_desired_one(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    desired = spark.createDataFrame([(1, "Wish"), (2, "")], "id bigint, desired_role string")
    best = spark.createDataFrame([(1, "Rec"), (2, "Rec")], "id bigint, recommended string")
    got = {r["id"]: r["target"] for r in gr.target_roles(people, desired, best).collect()}
    assert got == {1: "Wish", 2: "Rec", 3: None}


def test_gap_map(spark, graph):
    targets = spark.createDataFrame([(1, "Job D"), (2, "Nowhere")], "id bigint, job string")
    nodes = gr.gap_map_nodes(graph, targets, skills_of(spark, {1: ["q1"]}))
    assert {(r["id"], r["node"], r["status"]) for r in nodes.collect()} == {(1, "Job D", "centre"), (1, "SQL", "missing"), (1, "q1", "owned")}
    edges = {(r["a"], r["b"]) for r in gr.gap_map_edges(graph, targets).collect()}
    # SQL and q1 are both neighbours of Job D and joined to one another
    assert edges == {("Job D", "SQL"), ("Job D", "q1"), ("SQL", "q1")}


def test_gap_map_of_a_shared_name(spark, graph):
    got = gr.gap_map_edges(graph, spark.createDataFrame([("SQL",)], "job string"))
    assert {(r["a"], r["b"]) for r in got.collect()} == {("SQL", "x1"), ("SQL", "q1"), ("Job D", "SQL"), ("Job D", "q1")}


def test_skill_search_keeps_a_full_page(spark):
    names = [f"Tool{i:03d}" for i in range(120)] + ["other"]
    catalogue = spark.createDataFrame([(n,) for n in names], "skill string")
    queries = spark.createDataFrame([(10, 1, "TOOL"), (11, 2, "tool"), (12, 2, ""), (13, 1, "zzz"), (14, 1, "HER")], "query_id bigint, id bigint, text string")
    chosen = spark.createDataFrame([(2, n) for n in names[:60]] + [(1, "other")], "id bigint, skill string")
    got = {}
    for r in search.skill_search(queries, chosen, catalogue).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["skill"])
    assert got == {10: names[:50], 11: names[60:110], 12: names[60:110]}


def test_canonical_spelling(spark):
    catalogue = spark.createDataFrame([("SQL",), ("Sql",), ("Go",)], "skill string")
    typed = spark.createDataFrame([(1, 1, " sql "), (2, 1, "Go"), (3, 1, "go"), (4, 1, "nope"), (5, 1, "  ")], "entry_id bigint, id bigint, typed string")
    chosen = spark.createDataFrame([(1, "Go")], "id bigint, skill string")
    got = {r["entry_id"]: r["skill"] for r in search.canonical_skills(typed, chosen, catalogue).collect()}
    assert got == {1: "SQL", 3: "Go"}  # entry 2 is chosen as typed, entry 3 is not


def test_edge_order_holds_any_row_and_place(spark):
    from gradpath.operators.graph import edge_order

    rows = [(2**62, 5), (2**62, 2**31 - 1), (2**62 + 1, 0), (3, 2**21)]
    got = spark.createDataFrame(rows, "ord_row bigint, ord_pos int").orderBy(edge_order()).collect()
    assert [tuple(r) for r in got] == sorted(rows)


def test_beyond_broadcast_and_a_skill_held_by_everyone(spark, monkeypatch):
    import random

    from gradpath.operators import paths

    rng = random.Random(3)
    edges = sorted({(f"J{rng.randrange(60)}", f"s{rng.randrange(40)}") for _ in range(400)} | {(f"J{k}", "hot") for k in range(60)})
    frame = spark.createDataFrame([(j, s, i, 0) for i, (j, s) in enumerate(edges)], "job string, skill string, ord_row bigint, ord_pos int")
    listed = skills_of(spark, {i: ["hot", *(f"s{rng.randrange(45)}" for _ in range(i % 4))] for i in range(400)})
    targets = spark.createDataFrame([(i, f"J{i % 70}") for i in range(400)], "id bigint, job string")
    pairs = spark.createDataFrame([(f"J{k}", f"J{(k * 7) % 60}") for k in range(60)], "source string, target string")

    def results(graph):
        frames = [gr.recommend_topk(graph, listed, 3), gr.gaps(graph, targets, listed), gr.gap_map_nodes(graph, targets, listed), paths.shortest_paths(graph, pairs)]
        return [sorted(map(str, f.collect())) for f in frames]

    small = gr.SkillGraph.from_edges(frame)
    want = results(small)
    monkeypatch.setattr(gr, "BROADCAST_BYTES", -1)
    large = gr.SkillGraph.from_edges(frame)
    assert small.is_small and not large.is_small
    assert results(large) == want
    own, _ = gr.dealt_by_skill(gr.listed_skills(large, listed), large.adj)
    held = own.groupBy("skill", "salt").count().filter("skill = 'hot'").select("count").collect()
    sizes = sorted(r["count"] for r in held)
    assert len(sizes) == 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_skill_search_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abAB é") for _ in range(rng.randrange(1, most)))
    names = sorted({word(9) for _ in range(160)} | {"İa", "ab%", "a_b"})
    people = {i: set(rng.sample(names, rng.randrange(0, 12))) for i in range(12)}
    texts = [""] * 5 + ["%", "_", "a", "AB", "zz", "abz", None] + [word(6) for _ in range(60)]
    asked = [(q, rng.randrange(14), t) for q, t in enumerate(texts)]
    lower = {r["t"]: r["low"] for r in spark.createDataFrame([(t,) for t in names + [t for t in texts if t]], "t string").selectExpr("t", "lower(t) low").collect()}
    want = {
        (q, k, n)
        for q, i, t in asked if t is not None
        for k, n in enumerate([n for n in names if (lower[t] if t else "") in lower[n] and n not in people.get(i, ())][:7], 1)
    }
    catalogue = spark.createDataFrame([(n,) for n in names + names[:9]] + [(None,)], "skill string")
    chosen = spark.createDataFrame([(i, n) for i, held in people.items() for n in held], "id bigint, skill string")
    got = search.skill_search(spark.createDataFrame(asked, "query_id bigint, id bigint, text string"), chosen, catalogue, page=7)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_votes_of_a_small_graph_are_counted_in_tasks(spark, tiny_catalogue):
    """The same rows as by joins, ties, repeats, null places and null ids among them, and no shuffle of (person, role) rows."""
    import dataclasses

    graph = gr.SkillGraph.from_catalogue(tiny_catalogue)
    listed = [(1, 0, "x1"), (1, 1, "y1"), (1, 2, "x1"), (2, 0, "q1"), (2, 1, "SQL"), (3, 0, "nothing"), (4, None, "y1"), (4, 1, "Go"), (5, None, "x1"), (None, 0, "x1"), (6, 0, None)]
    skills = spark.createDataFrame(listed, "id bigint, pos int, skill string")
    joined = dataclasses.replace(graph, is_small=False, adj_small=graph.adj)
    for k in (1, 2, 50):
        got, want = ([tuple(r) for r in gr.recommend_topk(g, skills, k).collect()] for g in (graph, joined))
        assert sorted(got) == sorted(want) and got
    plan = gr.recommend_topk(graph, skills, 1)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_only_pairs_of_the_best_roles_are_looked_up(monkeypatch):
    rng = np.random.default_rng(4)
    nodes, degree, persons = 40, 20, 60
    to = np.concatenate([rng.permutation(nodes)[:degree] for _ in range(nodes)])
    links = voting.Links(np.arange(nodes), pa.array(map(str, range(nodes))), np.arange(nodes + 1) * degree, to, rng.permutation(len(to)))
    person, skill = np.repeat(np.arange(persons), 4), rng.integers(0, nodes, persons * 4)
    times, pos = rng.integers(1, 3, len(person)), np.tile(np.arange(4), persons)
    wanted = []
    for p in range(persons):
        votes, met = {}, {}
        for s, n, at in zip(skill[person == p], times[person == p], pos[person == p]):
            for e in range(s * degree, (s + 1) * degree):
                votes[to[e]] = votes.get(to[e], 0) + n
                met[to[e]] = min(met.get(to[e], (99, 0)), (at, links.order[e]))
        wanted += [(p, rank, node, votes[node]) for rank, node in enumerate(sorted(votes, key=lambda v: (-votes[v], *met[v], v))[:2], 1)]
    looked, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: looked.append(len(v)) or plain(a, v, *rest))
    for cells in (voting.CELLS, 0):
        monkeypatch.setattr(voting, "CELLS", cells)
        assert list(zip(*(c.tolist() for c in voting.best(links, person, skill, times, pos, 2)))) == wanted
    assert max(looked) < len(person) * degree / 2
