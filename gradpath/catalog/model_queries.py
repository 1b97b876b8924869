"""Queries on trained models at their full size, on all profiles.

A model is trained once per session and data folder and then used by every query that
needs it, as a served model would be; those of other sessions are let go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gradpath.catalog import fragments as fr
from gradpath.catalog.profile_queries import TYPED_FORM
from gradpath.catalog.registry import dictionaries, encoded, query
from gradpath.operators import attribution as at
from gradpath.operators import graph as gr
from gradpath.operators.balance import row_key
from gradpath.operators.models import BoosterModel, Settings, confusion, earlier_settings, fit_booster, fit_stack, safe_score
from gradpath.operators.scoring import score, with_bands
from gradpath.operators.trees import NODE
from gradpath.operators.treeshap import TreeAttribution
from gradpath.operators.validate import coerce_form
from gradpath.plans.train import Bundle, balanced_split, train
from gradpath.schema import FEATURES, LABEL
from gradpath.sources.views import load, with_views

_kept: dict[tuple[str, str, str], object] = {}


def _once(spark, d: str, what: str, make):
    """The result of ``make``, kept for this session and folder."""
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0]]:
            del _kept[old]
        _kept[key] = make()
    return _kept[key]


def bundle(spark, d) -> Bundle:
    return _once(spark, d, "bundle", lambda: train(load(spark, d, "unbalanced"), gr.build_edges(load(spark, d, "catalogue"))))


def training(spark, d) -> tuple:
    """(training rows, held-out rows), as the bundle has them."""
    return _once(spark, d, "split", lambda: balanced_split(encoded(spark, d, "unbalanced").select("id", *FEATURES, LABEL)))


def explainer(spark, d) -> BoosterModel:
    """The bundle's booster; where no bundle was trained yet, only the booster is."""
    if (spark.sparkContext.applicationId, d, "bundle") in _kept:
        return bundle(spark, d).booster
    return _once(spark, d, "booster", lambda: fit_booster(training(spark, d)[0]))


def earlier(spark, d) -> BoosterModel:
    """The earlier variant: a deeper booster on raw, unbalanced data."""
    return _once(spark, d, "earlier", lambda: fit_booster(encoded(spark, d, "unbalanced"), earlier_settings(), scale=False))


def _outcome(spark, d):
    """The hold-out rows scored by the stack, as one row of counts."""
    return confusion(score(training(spark, d)[1], bundle(spark, d).stack))


def _items(df, columns: list[str]):
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in columns])))


@query("train_report")
def train_report(spark, d):
    """(item, value): hold-out outcome, base value of the booster, size of the graph."""
    graph = gr.SkillGraph.from_edges(bundle(spark, d).edges, measure=False)
    base = F.round(F.lit(bundle(spark, d).attribution().base_value), 6)
    outcome = _items(_outcome(spark, d).withColumn("base_value", base), ["n", "true_pos", "false_pos", "true_neg", "false_neg", "accuracy", "base_value"])
    return outcome.unionByName(_items(graph.summary(), ["jobs", "skills", "nodes", "edges"]))


@query("holdout_accuracy")
def holdout_accuracy(spark, d):
    return _outcome(spark, d).select("n", "accuracy")


@query("stacked_scores")
def stacked_scores(spark, d):
    """Every profile scored by the stacked model."""
    trained = bundle(spark, d)
    coded = encoded(spark, d, "unbalanced")
    return with_bands(score(coded, trained.stack)).select("id", LABEL, "prediction", F.round("p", 6).alias("p"), "risk_level")


@query("tree_attribution")
def tree_attribution(spark, d):
    """Exact path-dependent Shapley values of the booster, one row per profile and feature."""
    booster = explainer(spark, d)
    attribution = TreeAttribution.from_trees(booster.model)
    coded = encoded(spark, d, "unbalanced").withColumn("phi", attribution.column(booster.inputs()))
    shap = {f: F.col("phi")[i] for i, f in enumerate(FEATURES)}
    done = at.signed(coded.withColumn("impacts", at.impact_array(shap)))
    return at.factor_rows(done, None).select("id", "rank", "feature", F.round("impact", 6).alias("impact"), F.round(F.lit(attribution.base_value), 6).alias("base_value"))


@query("plain_booster")
def plain_booster(spark, d):
    """The earlier variant: one booster on raw, unbalanced data; unusable rows score 0."""
    return safe_score(load(spark, d, "unbalanced"), earlier(spark, d), *dictionaries(spark, d, "unbalanced")).select("id", F.round("p", 6).alias("p"))


@query("train_counts", with_views(
    f"""select 'held out' item, count(*) n from {{unbalanced}} where not ({fr.unit('id', "'split'")} < 0.8)
    union all select 'held out, placed', count(*) from {{unbalanced}} where not ({fr.unit('id', "'split'")} < 0.8) and PlacedOrNot = 1
    union all select 'trained on', 2 * max(n) from (select count(*) n from {{unbalanced}} where {fr.unit('id', "'split'")} < 0.8 group by PlacedOrNot) x
    union all select 'edges', count(*) from edges
    union all select 'jobs', count(distinct job) from edges
    union all select 'skills', count(distinct skill) from edges""", fr.TOKENS, fr.EDGES))
def train_counts(spark, d):
    """What a training run counts: hold-out, balanced training rows, graph. No model is needed for it."""
    rows, held = training(spark, d)
    graph = gr.SkillGraph.from_edges(gr.build_edges(load(spark, d, "catalogue")), measure=False).summary()
    one = lambda item, n: F.struct(F.lit(item).alias("item"), n.cast("bigint").alias("n"))
    counts = held.agg(F.count("*").alias("n"), F.count_if(F.col(LABEL) == 1).alias("placed")).select(F.inline(F.array(one("held out", F.col("n")), one("held out, placed", F.col("placed")))))
    trained = rows.agg(F.count("*").alias("n")).select(F.inline(F.array(one("trained on", F.col("n")))))
    return counts.unionByName(trained).unionByName(graph.select(F.inline(F.array(*[one(c, F.col(c)) for c in ("edges", "jobs", "skills")]))))


@query("attribution_adds_up", with_views("select id, 0::double as off from {unbalanced}"))
def attribution_adds_up(spark, d):
    """Base value and attributions of every profile against the booster's margin: no difference."""
    booster = explainer(spark, d)
    attribution = TreeAttribution.from_trees(booster.model)
    attribution.inputs = booster.inputs
    done = at.signed(attribution.attach(score(encoded(spark, d, "unbalanced"), booster)))
    margin = F.log(F.col("p") / (1 - F.col("p")))
    return done.select("id", (F.round(at.prediction_value() - margin, 6) + 0.0).alias("off"))


OOF_SIZES = Settings(forest_trees=10, rounds=10)
_FOLD = f"""cast(floor({fr.unit("(id || '/0')", "'fold'")} * 5) as int)"""


@query("oof_cover", with_views(f"""select id, {_FOLD} fold, count(*) over () - count(*) over (partition by {_FOLD}) as trained_on, true as scored from {{unbalanced}}"""))
def oof_cover(spark, d):
    """Every row is scored once, by ensembles grown on all rows outside its fold."""
    rows = encoded(spark, d, "unbalanced").withColumn("copy", F.lit(0))
    fitted = fit_stack(rows, row_key(), OOF_SIZES)
    chances = [F.col(c).between(0, 1) for c in fitted.oof.columns if c.startswith("p_")]
    scored = fitted.oof.select("key", "fold", "trained_on", reduce(lambda a, b: a & b, chances).alias("scored"))
    return rows.select("id", F.xxhash64(row_key()).alias("key")).join(scored, "key").select("id", "fold", "trained_on", "scored")


FIRST_TREE = Settings(rounds=1)


def _first_tree_sql() -> str:
    """The booster's first tree by plain grouping: bins, sums of gradients and hessians, gains, leaves."""
    depth, rate, l2, least, bins = FIRST_TREE.booster_depth, FIRST_TREE.booster_rate, FIRST_TREE.booster_l2, FIRST_TREE.booster_least, FIRST_TREE.bins
    long = " union all ".join(f"select id, PlacedOrNot y, {i} f, {f}::double v from encoded" for i, f in enumerate(FEATURES))
    parts = [
        fr.encoded("{unbalanced}"), f"long as materialized ({long})",
        "kinds as (select f, v, count(*) over (partition by f) many, lead(v) over (partition by f order by v) after from (select distinct f, v from long) x)",
        f"""cuts as materialized (select f, cut, row_number() over (partition by f order by cut) - 1 b from (
          select f, (v + after) / 2 cut from kinds where many <= {bins} and after is not null
          union select f, unnest(quantile_disc(v, {[k / bins for k in range(1, bins)]})) from long where f in (select f from kinds where many > {bins}) group by f) x)""",
        "binned as materialized (select id, y, l.f, count(c.cut) b from long l left join cuts c on c.f = l.f and c.cut < l.v group by all)",
        "at0 as materialized (select distinct id, 0 node from long)",
    ]
    for level in range(depth + 1):
        score = lambda a, h: f"{a} * {a} / ({h} + {l2}::double)"
        parts.append(f"""cum{level} as (select node, f, b, sum(a) over w la, sum(h) over w lh, sum(n) over w ln, sum(a) over t ta, sum(h) over t th, sum(n) over t tn
          from (select node, f, b, sum(y - 0.5::double) a, sum(0.25::double) h, count(*) n from at{level} join binned using (id) group by all) x
          window w as (partition by node, f order by b), t as (partition by node, f))""")
        parts.append(f"whole{level} as (select distinct node, ta, th, tn from cum{level} where f = 0)")
        if level == depth:
            break
        parts.append(f"""best{level} as materialized (select node, f, b, gain from (
          select node, f, b, {score('la', 'lh')} + {score('(ta - la)', '(th - lh)')} - {score('ta', 'th')} gain from cum{level}
          where tn > ln and lh >= {least} and th - lh >= {least}) x where gain > 1e-9 qualify row_number() over (partition by node order by gain desc, f, b) = 1)""")
        parts.append(f"at{level + 1} as materialized (select id, 2 * s.node + 1 + (r.b > s.b)::int node from at{level} a join best{level} s on s.node = a.node join binned r using (id) where r.f = s.f)")
    names = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"
    rows = " union all ".join(
        f"select w.node, {level} as depth, " + (f"{names}[s.f + 1] feature, round(c.cut, 6) cut, round(s.gain, 6) gain" if level < depth else "null::varchar feature, null::double cut, null::double gain")
        + f", cast(tn as bigint) as rows, round(th, 6) cover, round({rate}::double * ta / (th + {l2}::double), 6) as value from whole{level} w"
        + (f" left join best{level} s on s.node = w.node left join cuts c on c.f = s.f and c.b = s.b" if level < depth else "") for level in range(depth + 1))
    return with_views(f'select cast(node as int) node, cast(depth as int) as depth, feature, cut, gain, "rows", cover, value from ({rows}) x', *parts)


@query("second_order_booster", _first_tree_sql())
def second_order_booster(spark, d):
    """The nodes of the second-order booster's first tree on raw profiles."""
    model = fit_booster(encoded(spark, d, "unbalanced"), FIRST_TREE, scale=False).model
    nodes = spark.createDataFrame(model.to_rows("first"), NODE)
    inner = F.col("feature") >= 0
    name = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature") + 1)
    six = lambda c: F.when(inner, F.round(c, 6))
    return nodes.select(
        "node", F.floor(F.log2(F.col("node") + 1)).cast("int").alias("depth"), F.when(inner, name).alias("feature"), six("cut").alias("cut"), six("gain").alias("gain"),
        "rows", F.round("cover", 6).alias("cover"), F.round("value", 6).alias("value"))


@query("unusable_rows", with_views(
    """select id, p.Gender is not null and p.Stream is not null and Age is not null and Internships is not null and CGPA is not null
      and exists (select 1 from {profiles} t where t.Gender = p.Gender) and exists (select 1 from {profiles} t where t.Stream = p.Stream) usable
    from typed_form p""", TYPED_FORM))
def unusable_rows(spark, d):
    """Forms that the earlier variant can score; the others get 0.0 and no factors."""
    forms = coerce_form(load(spark, d, "forms"))
    done = safe_score(forms, earlier(spark, d), *dictionaries(spark, d))
    return done.select("id", F.when((F.col("p") == 0.0) == F.col("usable"), None).otherwise(F.col("usable")).alias("usable"))
