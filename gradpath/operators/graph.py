"""Job-skill graph: edges, recommendation, gaps and gap maps for whole tables of people.

People come as a long table ``skills(id, pos, skill)``; ``pos`` is the order in which a
person listed them and duplicates are kept. The catalogue is a dimension: its adjacency
is broadcast where its measured size allows, so the person side is not shuffled for it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from gradpath.functions.sizing import BROADCAST_BYTES, broadcast_if_small, measured_bytes, shuffle_tasks
from gradpath.functions.text import blank_to_null, strip
from gradpath.operators import voting
from gradpath.session import cut_lineage


def skill_tokens(catalogue: DataFrame, null_mode: str = "reference") -> DataFrame:
    """(job, skill, ord_row, ord_pos) for every usable token of the catalogue.

    ``null_mode="reference"``: a null language list voids its row, null skills and tools
    do not. ``"lenient"``: all three count as empty.
    """
    if null_mode not in ("reference", "lenient"):
        raise ValueError(f"unknown null_mode {null_mode!r}")
    langs = F.col("langs") if null_mode == "reference" else F.coalesce("langs", F.lit(""))
    combined = F.concat(
        F.coalesce("skills", F.lit("")), F.lit(","), langs, F.lit(","), F.coalesce("tools", F.lit(""))
    )
    return (
        catalogue.select("job", F.col("row_id").alias("ord_row"), F.posexplode(F.split(combined, ",")).alias("ord_pos", "raw"))
        .select("job", strip(F.col("raw")).alias("skill"), "ord_row", "ord_pos")
        .filter(F.length("skill") > 1)
    )


def build_edges(catalogue: DataFrame, null_mode: str = "reference") -> DataFrame:
    """Distinct edges, each with the place where it was first seen."""
    return first_seen(skill_tokens(catalogue, null_mode), "job", "skill")


def edge_order() -> F.Column:
    """The place of an edge as one number that sorts like (row, place in the row).

    A place is below 2**31, as an array's index, and a decimal holds any row id before it;
    unlike a struct it keeps aggregates hash-based.
    """
    return F.col("ord_row").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("ord_pos").cast("decimal(10,0)")


def first_seen(df: DataFrame, a: str, b: str) -> DataFrame:
    return (
        df.groupBy(a, b)
        .agg(F.min(F.struct("ord_row", "ord_pos")).alias("ord"))
        .select(a, b, F.col("ord.ord_row").alias("ord_row"), F.col("ord.ord_pos").alias("ord_pos"))
    )


@dataclass
class SkillGraph:
    """Edges of the graph and its symmetric adjacency ``adj(src, dst, ord)``.

    A measured graph also has ``numbers(name, nr)`` and its adjacency ``src_nr, dst_nr``;
    the numbers sort like the names and are cheaper to shuffle and to group by.
    """

    edges: DataFrame
    adj: DataFrame
    adj_small: DataFrame  # adj, with a broadcast hint if it was measured to be small
    is_small: bool = False
    numbers: DataFrame | None = None
    kinds: DataFrame | None = None  # nodes(), where it was written

    @classmethod
    def from_edges(cls, edges: DataFrame, measure: bool = True) -> "SkillGraph":
        """Roles and skills share one name space, so a name that is both is one node.

        With ``measure`` the nodes are numbered, the adjacency is cached and its size taken
        once, which decides on broadcasting for every later join.
        """
        order = edge_order().alias("ord")
        both = edges.select(F.col("job").alias("src"), F.col("skill").alias("dst"), order).unionByName(
            edges.select(F.col("skill").alias("src"), F.col("job").alias("dst"), order)
        )
        adj = both.groupBy("src", "dst").agg(F.min("ord").alias("ord"))
        if not measure:
            return cls(edges, adj, adj)
        adj = cut_lineage(adj)  # read several times below
        names = adj.select(F.col("src").alias("name")).distinct().orderBy("name")
        numbers = cut_lineage(names.withColumn("nr", F.monotonically_increasing_id()))
        hint = broadcast_if_small(numbers)
        for end in ("src", "dst"):
            adj = adj.join(hint.select(F.col("name").alias(end), F.col("nr").alias(f"{end}_nr")), end)
        adj = cut_lineage(adj)
        small = measured_bytes(adj) <= BROADCAST_BYTES
        return cls(edges, adj, F.broadcast(adj) if small else adj, small, numbers)

    @classmethod
    def from_catalogue(cls, catalogue: DataFrame, null_mode: str = "reference", measure: bool = True) -> "SkillGraph":
        return cls.from_edges(build_edges(catalogue, null_mode), measure)

    def skill_list(self) -> DataFrame:
        return self.edges.select("skill").distinct().orderBy("skill")

    def job_list(self) -> DataFrame:
        return self.edges.select("job").distinct().orderBy("job")

    def nodes(self) -> DataFrame:
        """(name, is_job, is_skill)."""
        if self.kinds is not None:
            return self.kinds
        ends = self.edges.select(
            F.inline(
                F.array(
                    F.struct(F.col("job").alias("name"), F.lit(True).alias("is_job"), F.lit(False).alias("is_skill")),
                    F.struct(F.col("skill").alias("name"), F.lit(False).alias("is_job"), F.lit(True).alias("is_skill")),
                )
            )
        )
        return ends.groupBy("name").agg(F.bool_or("is_job").alias("is_job"), F.bool_or("is_skill").alias("is_skill"))

    def summary(self) -> DataFrame:
        """One row of totals; a name that is both role and skill counts once as node."""
        kinds = self.nodes().agg(
            F.count_if("is_job").alias("jobs"),
            F.count_if("is_skill").alias("skills"),
            F.count("*").alias("nodes"),
            F.lit(None).cast("bigint").alias("edges"),
        )
        links = self.adj.agg(
            *[F.lit(None).cast("bigint").alias(c) for c in ("jobs", "skills", "nodes")],
            F.count_if(F.col("src") <= F.col("dst")).alias("edges"),
        )
        return kinds.unionByName(links).agg(*[F.max(c).alias(c) for c in ("jobs", "skills", "nodes", "edges")])

    def neighbours(self, nodes: DataFrame, name: str = "name") -> DataFrame:
        """(name, neighbour) for a table of node names."""
        wanted = nodes.select(F.col(name).alias("src")).distinct()
        return wanted.join(self.adj_small, "src").select(F.col("src").alias("name"), F.col("dst").alias("neighbour"))


def listed_skills(graph: SkillGraph, skills: DataFrame) -> DataFrame:
    """(id, skill, times, pos): a person's skills, repeats counted, ``pos`` the first place.

    Where the graph is broadcast, only skills in it are kept, so a person has no more rows
    than the graph has nodes; these are brought together by person before they are expanded,
    and all counting after that needs no further shuffle.
    """
    own = skills.filter(F.col("skill").isNotNull())
    if graph.is_small:
        known = F.broadcast(graph.adj.select(F.col("src").alias("skill")).distinct())
        own = own.join(known, "skill", "left_semi")
    own = own.groupBy("id", "skill").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    return own.repartition(shuffle_tasks(own), "id") if graph.is_small else own


def dealt_by_skill(own: DataFrame, adj: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``own`` (id, skill, ...) and ``adj`` (src, ...) with a ``salt`` to be joined by as well.

    A skill with more than its share of a task is heavy: its persons are dealt over as many
    salts as there are tasks, and its edges are repeated for each. There can be no more
    heavy skills than tasks; all others have salt 0.
    """
    tasks = shuffle_tasks(own)
    counts = cut_lineage(own.groupBy("skill").agg(F.count("*").alias("n")))
    share = F.lit((counts.agg(F.sum("n").alias("n")).first()["n"] or 0) / tasks)
    heavy = [r["skill"] for r in counts.filter(F.col("n") > share).collect()]  # fewer than tasks
    if not heavy:
        return own.withColumn("salt", F.lit(0)), adj.withColumn("salt", F.lit(0))
    salt = F.when(F.col("skill").isin(heavy), F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int")).otherwise(0)
    salts = F.when(F.col("src").isin(heavy), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    return own.withColumn("salt", salt), adj.withColumn("salt", F.explode(salts))


def votes(graph: SkillGraph, own: DataFrame) -> DataFrame:
    """(id, key, votes): neighbours of a person's skills; a skill listed twice votes twice.

    ``key`` is the neighbour's number, in a graph that was not measured its name. Beyond
    what may be broadcast, heavy skills are dealt over all tasks.
    """
    if graph.is_small or graph.numbers is None:
        met = own.join(graph.adj_small, own["skill"] == F.col("src"))
    else:
        mine, edges = dealt_by_skill(own, graph.adj)
        met = mine.join(edges.withColumnRenamed("salt", "_salt"), (F.col("skill") == F.col("src")) & (F.col("salt") == F.col("_salt")))
    return (
        met.groupBy("id", F.col(_key(graph)).alias("key"))
        .agg(F.sum("times").alias("votes"))
    )


def _key(graph: SkillGraph) -> str:
    return "dst" if graph.numbers is None else "dst_nr"


def recommend_topk(graph: SkillGraph, skills: DataFrame, k: int) -> DataFrame:
    """(id, rank, job, votes): the k roles with most votes, the first met before others on a tie.

    First met means: by the skill's place in the person's list, then by the edge's place in
    the catalogue. That is looked up only for the roles whose votes reach the k-th place,
    all ties included. With a small graph all of it happens in a task's arrays.
    """
    own = listed_skills(graph, skills)
    if graph.is_small and graph.numbers is not None:
        return voting.topk(graph.numbers, graph.adj, own, k)
    by_votes = W.partitionBy("id").orderBy(F.desc("votes"))
    reach = votes(graph, own).withColumn("_r", F.rank().over(by_votes)).filter(F.col("_r") <= k).drop("_r")
    asked = graph.adj.select(F.col("src").alias("skill"), F.col(_key(graph)).alias("key"), F.col("dst").alias("job"), "ord")
    met = (
        reach.join(own.select("id", "skill", "pos"), "id")
        .join(F.broadcast(asked) if graph.is_small else asked, ["skill", "key"])
        .groupBy("id", "key", "job", "votes")
        .agg(F.min_by("ord", "pos").alias("ord"), F.min("pos").alias("pos"))
    )
    order = W.partitionBy("id").orderBy(F.desc("votes"), "pos", "ord", "job")
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("id", "rank", "job", "votes")


def recommend(graph: SkillGraph, skills: DataFrame) -> DataFrame:
    """(id, recommended, votes): the role with most votes, the first met on a tie.

    Persons none of whose skills are in the graph are absent.
    """
    return recommend_topk(graph, skills, 1).select("id", F.col("job").alias("recommended"), "votes")


def gap_rows(graph: SkillGraph, targets: DataFrame, skills: DataFrame) -> DataFrame:
    """(id, job, skill): skills the target role of a person asks for and the person lacks."""
    asked = targets.select("id", "job").join(graph.adj_small, F.col("job") == F.col("src")).select("id", "job", F.col("dst").alias("skill"))
    return asked.join(skills.select("id", "skill").distinct(), ["id", "skill"], "left_anti").select("id", "job", "skill")


def gaps(graph: SkillGraph, targets: DataFrame, skills: DataFrame) -> DataFrame:
    """(id, job, known_job, missing): one row per target, ``missing`` a sorted array.

    An unknown role and a role without gap both give an empty array; ``known_job`` tells
    them apart. A person's array is as long as the role's list of skills.
    """
    known = graph.adj.select(F.col("src").alias("job")).distinct().withColumn("known", F.lit(True))
    lacking = gap_rows(graph, targets, skills).groupBy("id", "job").agg(F.array_sort(F.collect_list("skill")).alias("missing"))
    return (
        targets.select("id", "job")
        .join(F.broadcast(known) if graph.is_small else known, "job", "left")
        .join(lacking, ["id", "job"], "left")
        .select(
            "id", "job", F.coalesce("known", F.lit(False)).alias("known_job"),
            F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        )
    )


def target_roles(people: DataFrame, desired: DataFrame, recommended: DataFrame) -> DataFrame:
    """(id, target): the desired role where one is given, else the recommended one."""
    return (
        people.select("id")
        .join(desired.select("id", "desired_role"), "id", "left")
        .join(recommended.select("id", "recommended"), "id", "left")
        .select("id", F.coalesce(blank_to_null(F.col("desired_role")), F.col("recommended")).alias("target"))
    )


def readiness_text(missing) -> "F.Column":
    """"None - Ready!" or the comma list of missing skills."""
    return F.when(F.size(missing) == 0, "None - Ready!").otherwise(F.array_join(missing, ", "))


def gap_map_nodes(graph: SkillGraph, targets: DataFrame, skills: DataFrame) -> DataFrame:
    """(id, centre, node, status): the target role with its neighbours.

    Status is centre, owned or missing. Unknown centres give no rows.
    """
    wanted = targets.select("id", F.col("job").alias("centre")).filter(F.col("centre").isNotNull()).distinct()
    spokes = wanted.join(graph.adj_small, F.col("centre") == F.col("src")).select("id", "centre", F.col("dst").alias("node"))
    known = graph.adj.select(F.col("src").alias("centre")).distinct()
    middle = wanted.join(F.broadcast(known) if graph.is_small else known, "centre", "left_semi")
    around = spokes.filter(F.col("node") != F.col("centre")).unionByName(middle.select("id", "centre", F.col("centre").alias("node")))
    own = skills.select("id", F.col("skill").alias("node"), F.lit(True).alias("own")).distinct()
    return around.join(own, ["id", "node"], "left").select(
        "id", "centre", "node",
        F.when(F.col("node") == F.col("centre"), "centre").when(F.col("own"), "owned").otherwise("missing").alias("status"),
    )


def gap_map_edges(graph: SkillGraph, centres: DataFrame) -> DataFrame:
    """(centre, a, b), a <= b: edges of the graph among a centre and its neighbours.

    Found once per distinct centre, not per person. Besides the spokes an edge can only
    close a triangle, and every triangle of this graph has a corner that is both role
    and skill; so neighbours are expanded only along edges touching such a name, or when
    the centre is one.
    """
    dual = graph.nodes().filter(F.col("is_job") & F.col("is_skill")).select(F.col("name"))
    wanted = centres.select(F.col("job").alias("centre")).filter(F.col("centre").isNotNull()).distinct()
    spokes = wanted.join(graph.adj_small, F.col("centre") == F.col("src")).select("centre", F.col("dst").alias("node"))
    adj = graph.adj.select("src", "dst")
    touching = adj.join(dual, adj["src"] == dual["name"], "left_semi").unionByName(
        adj.join(dual, adj["dst"] == dual["name"], "left_semi")
    ).distinct()
    centre_dual = spokes.join(dual, spokes["centre"] == dual["name"], "left_semi")
    centre_plain = spokes.join(dual, spokes["centre"] == dual["name"], "left_anti")
    reached = (
        centre_plain.join(touching, F.col("node") == F.col("src"))
        .select("centre", "src", "dst")
        .unionByName(centre_dual.join(adj, F.col("node") == F.col("src")).select("centre", "src", "dst"))
    )
    closed = reached.join(spokes.select("centre", F.col("node").alias("dst")), ["centre", "dst"], "left_semi")
    pairs = closed.select("centre", "src", "dst").unionByName(
        spokes.select("centre", F.col("centre").alias("src"), F.col("node").alias("dst"))
    )
    return pairs.select("centre", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
