"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradpath.llm import chat, exact, langid, licenses, lm, merkle, mixing, neardup, repeats, simhash, tiling, toxicity, whitening
from gradpath.llm.frames import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_license_scan")
def op1(spark: SparkSession, d: str) -> DataFrame:
    """The licenses that documents name."""
    return licenses.named(table(spark, d, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


@query("op2_toxicity")
def op2(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs, test = table(spark, d, "documents", "doc_id", "text"), held_out(F.col("doc_id"), 3)
    model = toxicity.train(docs, table(spark, d, "labels", "doc_id", "toxic").filter(~test))
    scored = docs.select("doc_id", test.alias("held_out"), toxicity.score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


WORDS = r"""list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"""
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op3_near_dedup",
    f"""
    with recursive w as materialized (select doc_id, {WORDS.format(text=LOWER)} as w from documents),
    d as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
    classes as materialized (select list_sort(s) as s, min(doc_id) as rep from d where len(s) > 0 group by list_sort(s)),
    x as materialized (select rep, len(s) as n, hash(unnest(s)) as h from classes),
    links as materialized (select a.rep as a, b.rep as b from x a join x b on a.h = b.h and a.rep < b.rep
        group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    both_ways as materialized (select a, b from links union all select b, a from links),
    reach as (select distinct a, a as b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
    smallest as (select a, min(b) as b from reach group by a)
    select d.doc_id, len(d.s) as n_shingles, coalesce(m.b, c.rep, d.doc_id) as component_id, d.doc_id = coalesce(m.b, c.rep, d.doc_id) as kept
    from d left join classes c on list_sort(d.s) = c.s left join smallest m on m.a = c.rep
    """,
)
def op3(spark: SparkSession, d: str) -> DataFrame:
    """The component of near duplicates of every document, on shingles of four words."""
    got = neardup.near_duplicates(table(spark, d, "documents", "doc_id", "text"), k=4, percent=80)
    return got.withColumnRenamed("id", "doc_id")


@query("op4_lm_scores")
def op4(spark: SparkSession, d: str) -> DataFrame:
    """Log10 probability of every document, learnt from those outside the held-out fold."""
    docs, test = table(spark, d, "documents", "doc_id", "text"), held_out(F.col("doc_id"), 5)
    got = lm.scores(docs, ~test)
    return got.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op5_pivotal_mixing")
def op5(spark: SparkSession, d: str) -> DataFrame:
    """Words taken of every document so that sources come near their targets."""
    got = mixing.mix(table(spark, d, "documents", "doc_id", "source", "text"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"))


@query("op6_decontamination")
def op6(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold items of the benchmark, with the items."""
    return tiling.leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")).withColumnRenamed("id", "doc_id")


@query(
    "op7_exact_dedup",
    """
    with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
    select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
           doc_id is not distinct from max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
    from t
    """,
)
def op7(spark: SparkSession, d: str) -> DataFrame:
    """The exact copies of every document."""
    got = exact.duplicates(table(spark, d, "documents", "doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.equal_null("id", "keep_id").alias("kept"), F.col("sha256").alias("text_sha256"))


@query("op8_language")
def op8(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document, learnt from those outside the held-out fold."""
    docs, test = table(spark, d, "documents", "doc_id", "lang", "text"), held_out(F.col("doc_id"), 3)
    model = langid.train(docs.filter(~test))
    found = docs.select("doc_id", test.alias("held_out"), langid.predict(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query(
    "op9_substring_dedup",
    f"""
    with w as materialized (select doc_id, {WORDS.format(text="coalesce(text, '')")} as w from documents),
    win as materialized (select doc_id, i, array_to_string(w[i:i + 12], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w)),
    firsts as (select t, min(doc_id) as first from win group by t),
    starts as (select doc_id, i from win join firsts using (t) where doc_id > first),
    gone as (select distinct doc_id, i + k as i from starts, range(13) r(k)),
    word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w),
    kept as (select word.doc_id, string_agg(x, ' ' order by i) as text, count(*) as n from word anti join gone using (doc_id, i) group by 1)
    select w.doc_id, len(w.w) as n_words, len(w.w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
    from w left join kept using (doc_id)
    """,
)
def op9(spark: SparkSession, d: str) -> DataFrame:
    """What is left of every document when passages that an earlier one has are removed."""
    got = repeats.strip_repeats(table(spark, d, "documents", "doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op10_chat_format",
    """
    with u as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
    r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from u),
    c as (select conv_id, count(*) as n, list(role || chr(31) || text order by k) as turns from r group by conv_id),
    same as (select turns, n, min(conv_id) as conv_id, count(*) as copies from c group by turns, n),
    longest as (select a.conv_id, a.copies from same a where not exists (
        select 1 from same b where b.n > a.n and b.turns[1] = a.turns[1] and b.turns[1:a.n] = a.turns))
    select r.conv_id, (r.k - 1) // 64 as segment, cast(count(*) as int) as n_turns, m.copies,
           string_agg('<|im_start|>' || r.role || chr(10) || r.text || '<|im_end|>' || chr(10), '' order by r.k) as text
    from r join longest m on r.conv_id is not distinct from m.conv_id group by r.conv_id, (r.k - 1) // 64, m.copies
    """,
)
def op10(spark: SparkSession, d: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.render(table(spark, d, "conversations", "conv_id", "turn", "role", "text"))


@query("op11_whitening")
def op11(spark: SparkSession, d: str) -> DataFrame:
    """Every embedding along the leading components of all embeddings."""
    return whitening.whitened(table(spark, d, "embeddings", "vec_id", "embedding")).withColumnRenamed("id", "vec_id")


#: crc32 of a decimal number, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
LEAF = " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text"))
RAISE = """select level + 1, tree, i // 2, sha256(string_agg(digest, '' order by i)), any_value((n + 1) // 2) from {0} where n > 1 group by level, tree, i // 2"""


@query(
    "op12_merkle_manifest",
    f"""
    with recursive d as materialized (select doc_id, lang, sha256({LEAF.format(n_chars="n_chars")}) as leaf,
        sha256({LEAF.format(n_chars=f"(n_chars + case when {CRC32} % 7 = 0 then 1 else 0 end)")}) as seen from documents),
    trees as materialized (select lang, row_number() over (order by lang nulls first) - 1 as tree, count(*) as n from documents group by lang),
    leaves as materialized (select d.*, tree, n, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i
        from d join trees on d.lang is not distinct from trees.lang),
    lo(level, tree, i, digest, n) as (select 0::bigint, tree, i, leaf, n from leaves union all {RAISE.format("lo")}),
    subroots as materialized (select tree, digest from lo where n = 1),
    hi(level, tree, i, digest, n) as (select 0::bigint, -1::bigint, tree, digest, (select count(*) from subroots) from subroots union all {RAISE.format("hi")}),
    ways as materialized (
        select l.tree, l.i, p.level, s.i < p.i as before, s.digest from leaves l join lo p on p.tree = l.tree and p.n > 1 and p.i = l.i >> p.level
        left join lo s on s.tree = l.tree and s.level = p.level and s.i = xor(p.i, 1)
        union all
        select l.tree, l.i, 1000 + p.level, s.i < p.i, s.digest from leaves l join hi p on p.n > 1 and p.i = l.tree >> p.level
        left join hi s on s.level = p.level and s.i = xor(p.i, 1)),
    lists as materialized (select tree, i, list({{'before': before, 'digest': digest}} order by level) as steps from ways group by tree, i),
    fold(tree, i, k, acc, steps) as (select l.tree, l.i, 1::bigint, l.seen, coalesce(w.steps, []) from leaves l left join lists w using (tree, i) union all
        select tree, i, k + 1, sha256(case when steps[k].before then steps[k].digest else '' end || acc || case when not steps[k].before then steps[k].digest else '' end), steps
        from fold where k <= len(steps))
    select l.doc_id, l.leaf, s.digest as subroot, r.digest as root,
           sha256(coalesce(array_to_string(list_transform(w.steps, lambda x: coalesce(x.digest, '')), ''), '')) as proof_sha256, f.acc as folded_root, f.acc = r.digest as verified
    from leaves l join subroots s using (tree) cross join (select digest from hi where n = 1) r left join lists w using (tree, i)
    join fold f on f.tree = l.tree and f.i = l.i and f.k = len(f.steps) + 1
    """,
)
def op12(spark: SparkSession, d: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that its leaf gives after some were tampered with."""
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = lambda n_chars: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    original = docs.withColumn("leaf", fields(F.col("n_chars"))).withColumn("seen", F.when(hit, fields(F.col("n_chars") + 1)).otherwise(F.col("leaf")))
    found = merkle.proofs(merkle.manifest(original.select("doc_id", "lang", "leaf", "seen"), "lang", "doc_id", "leaf"))
    root = merkle.folded(F.col("data.seen"), F.col("steps"))
    got = found.select("data.doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), root.alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_simhash")
def op13(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of every document and the component of fingerprints close to it."""
    got = simhash.near_duplicates(table(spark, d, "documents", "doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
