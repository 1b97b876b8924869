"""Language identification: the family first, then one-versus-one linear SVMs within it.

A text's features are its byte pairs and triples, lower-cased, with everything but letters
read as a blank, hashed to 4,096 counts, square-rooted and scaled to length 1. A bounded
number of documents of each language, the first by a hash of their id, is the sample. Each
classifier is fitted in a task of its own: one against the rest for each family, and one
for each pair of languages of a family. The weights (16 kB a classifier) are broadcast and
all texts are scored in one pass.

The score is the family's share of belief times the language's within the family. A text
that is null or has no letter is ``und`` with score 0, and so is every text when there was
nothing to learn from. Languages that the table of families doesn't name form one family.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradpath.functions.sizing import broadcast_if_small
from gradpath.llm.frames import SMALL, map_text
from gradpath.llm.toxicity import text_slices
from gradpath.llm.words import LOWER, text_buffer
from gradpath.session import cut_lineage

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "nb", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "ky", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "semitic": ["ar", "he", "mt"],
    "dravidian": ["kn", "ml", "ta", "te"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
DIMS = 4096
#: Documents of a language that are learnt from, at most.
PER_LANGUAGE = 800
ROUNDS, PENALTY, SHARP = 150, 1e-4, 4.0

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
READ_AS = np.where(_LETTER, _BYTES, 32).astype(np.uint8)


def vectors(column: pa.Array) -> np.ndarray:
    """One row of features for each text of a small slice."""
    raw, ends = text_buffer(column)
    n = len(column)
    data = READ_AS[LOWER[raw]].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(ends))
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(data))
    counts = np.zeros(n * DIMS)
    pair = data[:-1] | data[1:] << np.uint32(8) if len(data) > 1 else data[:0]
    triple = pair[:-1] | data[2:] << np.uint32(16) if len(data) > 2 else data[:0]
    for code, size, salt in ((pair, 2, 0x9E3779B1), (triple, 3, 0x85EBCA77)):
        inside = (left[: len(code)] >= size) & (code != (0x2020 if size == 2 else 0x202020))
        hashed = (code * np.uint32(salt)) ^ ((code * np.uint32(salt)) >> np.uint32(15))
        place = (hashed * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        counts += np.bincount(doc[: len(code)][inside] * DIMS + place[inside], minlength=n * DIMS)
    x = np.sqrt(counts.reshape(n, DIMS)).astype(np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def has_letter(column: pa.Array) -> np.ndarray:
    raw, ends = text_buffer(column)
    low = LOWER[raw]
    ascii_ = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
    found = ascii_[ends[1:]] > ascii_[ends[:-1]]
    for i in np.flatnonzero(~found & (np.diff(ends) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def fit_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, classes weighted alike; accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1.0 / (4.0 + PENALTY)
    w = v = np.zeros(x.shape[1], np.float32)
    for k in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ v))
        nxt = v - step * (PENALTY * v - 2 * x.T @ (share * y * slack))
        v, w = nxt + k / (k + 3.0) * (nxt - w), nxt
    return w


@dataclass
class Model:
    families: list[str]
    languages: list[str]
    family_of: list[int]  # for each language
    family_rows: np.ndarray  # a row of weights for each family, none if there is one family
    pairs: list[tuple[int, int]]
    pair_rows: np.ndarray


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from the rows of ``docs`` that have a language; at most ``per_language`` of each."""
    named = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id"))
    chosen = cut_lineage(named.withColumn("_n", first).filter(F.col("_n") <= per_language).drop("_n").distinct())
    languages = sorted(r["_lang"] for r in chosen.select("_lang").distinct().collect())
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.join(broadcast_if_small(chosen, SMALL), rows["id"].eqNullSafe(F.col("_id")) & (rows["lang"] == F.col("_lang"))).select("text", "lang")
    family = [FAMILY_OF.get(code, "other") for code in languages]
    families = sorted(set(family))
    pairs = [(i, j) for i in range(len(languages)) for j in range(i + 1, len(languages)) if family[i] == family[j]]
    tasks = [(code, f"family {f}", 1 if family[i] == f else -1) for f in families if len(families) > 1 for i, code in enumerate(languages)]
    tasks += [(languages[k], f"pair {i} {j}", 1 if k == i else -1) for i, j in pairs for k in (i, j)]
    empty = np.zeros((0, DIMS + 1), np.float32)
    if not tasks:
        return Model(families, languages, [families.index(f) for f in family], empty, pairs, empty)

    def featured(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [vectors(piece).astype(np.float16) for piece in text_slices(batch.column("text"), 512)]
        return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([row.tobytes() for part in out for row in part], pa.binary())], ["lang", "x"])

    def fitted(key: tuple, group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group["x"].to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
        w = fit_svm(x, np.asarray(group["y"], dtype=np.float32))
        return pa.table({"task": [key[0].as_py()], "w": [w.tobytes()]})

    sample = map_text(rows, "text", featured, "lang string, x binary")
    work = docs.sparkSession.createDataFrame(tasks, "lang string, task string, y int")
    got = sample.join(F.broadcast(work), "lang").groupBy("task").applyInArrow(fitted, "task string, w binary").collect()  # a row for each classifier
    rows_of = {r["task"]: np.frombuffer(r["w"], np.float32) for r in got}
    stack = lambda names: np.stack([rows_of[n] for n in names]) if names else empty
    return Model(
        families, languages, [families.index(f) for f in family],
        stack([f"family {f}" for f in families] if len(families) > 1 else []), pairs, stack([f"pair {i} {j}" for i, j in pairs]),
    )


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang, score) of a text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def predicted(column: pa.Array) -> pa.Array:
        m, langs, scores = shared.value, [], []
        names = np.array([*m.languages, "und"], dtype=object)
        for piece in text_slices(column, 1024):
            n, last = len(piece), len(m.languages)
            if not last:
                langs.append(np.full(n, "und", dtype=object))
                scores.append(np.zeros(n))
                continue
            x = vectors(piece)
            margin = lambda rows: x @ rows[:, :-1].T + rows[:, -1]
            belief = np.ones((n, len(m.families)))
            if len(m.families) > 1:
                belief = np.exp(SHARP * margin(m.family_rows))
                belief /= belief.sum(1, keepdims=True)
            votes, met = np.zeros((n, last)), np.zeros(last)
            if m.pairs:
                for (i, j), p in zip(m.pairs, (1 / (1 + np.exp(-SHARP * margin(m.pair_rows)))).T):
                    votes[:, i] += p
                    votes[:, j] += 1 - p
                    met[[i, j]] += 1
            votes = np.where(met > 0, votes, 1.0)
            of = np.array(m.family_of)
            inside = of[None, :] == belief.argmax(1)[:, None]
            total = (votes * inside).sum(1)
            best = np.where(inside, votes, -1.0).argmax(1)
            score = belief.max(1) * votes[np.arange(n), best] / total
            ok = has_letter(piece)
            langs.append(names[np.where(ok, best, last)])
            scores.append(np.where(ok, score, 0.0))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(langs) if langs else [], pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang", "score"])

    return predicted(text)
