"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should have.
The whole part is taken; the fraction is a probability. Two fractional documents meet and
mass (words) moves from one to the other, in a random direction that keeps both
expectations, until one of them is taken or not; the other goes on. Within a block of a few
hundred documents this is a fold; what a block leaves over meets the leftovers of other
blocks on the next level of a tree, so no task sees more than a block. Words are kept
exactly at each meeting. The larger document tends to go on, so a source is done in two
steps: documents above its mean size first, and what rounding the last of them adds or
lacks is spread over the probabilities of the others.

Null texts have no words and are never taken; null is a source of its own, the last.
Rows with equal id, source and size share one expectation. Random numbers are hashes, so
reruns agree. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradpath.functions.numbering import number_rows
from gradpath.functions.sizing import broadcast_if_small
from gradpath.llm.frames import SMALL, unused
from gradpath.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
#: Documents (or leftovers) that meet in one fold, on average.
BLOCK = 256
SEED = 20240607


def word_count(text: Column) -> Column:
    """Runs of bytes other than blank and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water filling: sources take ``share`` of all sizes in proportion to their weight; who
    would exceed ``most`` times its size stops there and the rest is shared again.
    """
    order = (F.col("source").isNull().cast("int"), F.col("source").asc())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(number_rows(sources, *order).select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")))
    total, level, before = None, 0.0, None
    while True:
        full = F.lit(False) if before is None else F.col("w") * level > F.col("cap")
        r = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("w"), F.count_if(full).alias("n")).first()
        if total is None:
            total = share * (r["all"] or 0)
        if not r["w"] or r["n"] == before:
            break
        level, before = max(level, (total - r["given"]) / r["w"]), r["n"]
    return ranked.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _meet(level: int):
    """The fold's step: the carried unit meets the next one."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["carry"]
        u = F.shiftrightunsigned(F.xxhash64(a["h"], b["h"], F.lit(level), F.lit(SEED)), 11) / float(1 << 53)
        mass_a, mass_b = a["size"] * a["p"], b["size"] * b["p"]
        free_a, free_b = a["size"] - mass_a, b["size"] - mass_b
        up, down = F.least(free_a, mass_b), F.least(mass_a, free_b)
        rises = u * (up + down) < down  # mass moves from b to a; its chance keeps the expectations
        moved = F.when(rises, up).otherwise(-down)
        a_ends = F.when(rises, free_a <= mass_b).otherwise(mass_a <= free_b)
        a_p, b_p = a["p"] + moved / a["size"], b["p"] - moved / b["size"]
        unit = lambda x, p: F.struct(x["size"].alias("size"), x["h"].alias("h"), x["what"].alias("what"), p.alias("p"))
        settled = F.when(a_ends, unit(a, F.when(rises, 1.0).otherwise(0.0))).otherwise(unit(b, F.when(rises, 0.0).otherwise(1.0)))
        goes_on = F.when(a_ends, unit(b, F.greatest(F.lit(0.0), F.least(F.lit(1.0), b_p)))).otherwise(unit(a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), a_p))))
        return F.struct(goes_on.alias("carry"), F.concat(acc["out"], F.array(settled)).alias("out"))

    return step


def round_pivotal(units: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(settled, last) from units (source, size double, h, what, p, n_units): settled units have
    p of 0 or 1; last has the one unit of each source that still has a fraction.

    ``n_units`` is the number of units of the source.
    """
    blocks = F.ceil(F.col("n_units") / block)
    now = units.select("source", F.struct("size", "h", "what", "p").alias("u"), blocks.alias("blocks"), F.pmod(F.xxhash64("h", F.lit(SEED)), blocks).alias("block"))
    done, level = None, 0
    while True:
        items = F.reverse(F.sort_array(F.collect_list("u")))
        first = F.struct(F.col("items")[0].alias("carry"), F.slice("items", 1, 0).alias("out"))
        folded = cut_lineage(
            now.groupBy("source", "blocks", "block").agg(items.alias("items"))
            .select("source", "blocks", "block", F.aggregate(F.slice("items", F.lit(2), F.size("items")), first, _meet(level)).alias("got"))
        )
        out = folded.select("source", F.explode("got.out").alias("u"))
        done = out if done is None else done.unionByName(out)
        if (folded.agg(F.max("blocks").alias("b")).first()["b"] or 1) <= 1:
            return done, folded.select("source", F.col("got.carry").alias("u"))
        fewer = F.ceil(F.col("blocks") / block)
        now = folded.select("source", F.col("got.carry").alias("u"), fewer.alias("blocks"), F.pmod("block", fewer).alias("block"))
        level += 1


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    kinds = cut_lineage(rows.groupBy("source", "id", "size").agg(F.count("*").alias("rows")))
    sizes = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("bigint").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    goal = broadcast_if_small(targets.withColumnRenamed("source", "_s"), SMALL)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    whole = F.floor(rate + 1e-12)
    planned = (
        kinds.join(goal, kinds["source"].eqNullSafe(F.col("_s"))).drop("_s")
        .withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0).cast("int"))
        .withColumn("due", F.when(F.col("size") > 0, F.col("rows") * F.greatest(F.lit(0.0), rate - whole)).otherwise(0.0))
        .withColumn("more", F.floor(F.col("due") + 1e-12).cast("bigint"))  # rows of this kind that get a further copy for sure
        .withColumn("p", F.greatest(F.lit(0.0), F.col("due") - F.col("more")))
        .withColumn("h", F.xxhash64("id", "size", "source", F.lit(SEED)))
        .withColumn("what", F.struct("id", "rows", "whole", "more", "source_size", "target"))
        .select("source", F.col("size").cast("double").alias("size"), "h", "what", "p")
    )
    planned = cut_lineage(planned)
    open_, sure = planned.filter("p > 1e-9"), planned.filter("not p > 1e-9")
    stats = cut_lineage(open_.groupBy("source").agg(F.avg("size").alias("mean")))
    mean = broadcast_if_small(stats.withColumnRenamed("source", "_s"), SMALL)
    open_ = open_.join(mean, open_["source"].eqNullSafe(F.col("_s"))).withColumn("late", F.col("size") <= F.col("mean")).drop("_s", "mean")
    parts = cut_lineage(open_.groupBy("source", "late").agg(F.count("*").alias("n_units"), F.sum("size").alias("words")))

    def step(late: bool, extra: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        side = parts.filter(F.col("late") == late).select(F.col("source").alias("_s"), "n_units", "words")
        if extra is not None:
            side = side.join(extra.select(F.col("source").alias("_e"), "owed"), F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e")
        side = broadcast_if_small(cut_lineage(side), SMALL)
        units = open_.filter(F.col("late") == late)
        units = units.join(side, units["source"].eqNullSafe(F.col("_s"))).drop("_s", "late")
        if extra is not None:
            moved = F.col("p") + F.coalesce("owed", F.lit(0.0)) / F.col("words")
            units = units.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))
        return round_pivotal(units.select("source", "size", "h", "what", "p", "n_units"), block)

    big, big_last = step(False, None)
    ends = F.when(F.col("u.p") >= 0.5, 1.0).otherwise(0.0)
    big_last = cut_lineage(big_last.select("source", "u", ends.alias("x"), ((F.col("u.p") - ends) * F.col("u.size")).alias("owed")))
    small, small_last = step(True, big_last)
    columns = ["source", "size", "what", "x"]
    settled = [
        sure.select("source", "size", "what", F.lit(0.0).alias("x")),
        big.select("source", F.col("u.size").alias("size"), F.col("u.what").alias("what"), F.col("u.p").alias("x")),
        small.select("source", F.col("u.size").alias("size"), F.col("u.what").alias("what"), F.col("u.p").alias("x")),
        big_last.select("source", F.col("u.size").alias("size"), F.col("u.what").alias("what"), "x"),
        small_last.select("source", F.col("u.size").alias("size"), F.col("u.what").alias("what"), F.when(F.col("u.p") >= 0.5, 1.0).otherwise(0.0).alias("x")),
    ]
    union = settled[0].select(columns)
    for part in settled[1:]:
        union = union.unionByName(part.select(columns))
    lucky = F.col("what.more") + F.col("x").cast("bigint")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("what.rows"))).alias("row")
    return union.select("source", "size", "what", lucky.alias("lucky"), each).select(
        F.col("what.id").alias("id"), "source", F.col("size").cast("bigint").alias("size"), F.col("what.source_size").alias("source_size"), F.col("what.target").alias("target"),
        (F.col("what.whole") + (F.col("row") <= F.col("lucky")).cast("int")).alias("copies"), "row",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, and the columns copy (from 1),
    source_words and source_target, which replace columns of these names."""
    plan = cut_lineage(mix(docs, id_col, text_col, source_col, **options).filter("copies > 0"))
    an_id, a_source, a_size, all_copies, words, target, row, taken, copy = unused(docs, "id", "of", "size", "copies", "words", "target", "row", "taken", "copy")
    # rows that agree in id, source and size take their copies together
    plan = plan.groupBy(F.col("id").alias(an_id), F.col("source").alias(a_source), F.col("size").alias(a_size)).agg(
        F.array_sort(F.collect_list("copies")).alias(all_copies), F.first("source_size").alias(words), F.first("target").alias(target))
    plan = cut_lineage(plan)
    same = docs[id_col].eqNullSafe(F.col(an_id)) & docs[source_col].eqNullSafe(F.col(a_source)) & (word_count(docs[text_col]) == F.col(a_size))
    joined = docs.join(broadcast_if_small(plan, SMALL), same)
    several = F.size(all_copies) > 1
    if plan.filter(several).isEmpty():
        copies = F.col(all_copies)[0]
    else:
        place = F.row_number().over(Window.partitionBy(an_id, a_source, a_size).orderBy(F.xxhash64(F.col(f"`{text_col}`"))))
        joined = joined.withColumn(row, place)
        copies = F.coalesce(F.get(F.reverse(all_copies), F.col(row) - 1), F.lit(0))
    copied = joined.withColumn(taken, copies).filter(F.col(taken) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(taken))))
    new = {"copy": copy, "source_words": words, "source_target": target}
    return copied.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new], *[F.col(c).alias(name) for name, c in new.items()])
