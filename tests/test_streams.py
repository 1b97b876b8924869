"""Streams: whole answers with rejects, conversation context; restarts and replays."""

import json
import random

import pytest

from gradpath.operators import reports
from gradpath.operators.graph import SkillGraph
from gradpath.operators.scoring import ExpressionScorer
from gradpath.operators.validate import LabelDictionary
from gradpath.plans import answers
from gradpath.plans.answers import Engine
from gradpath.sources.readers import read_requests
from gradpath.streaming import answer as sa
from gradpath.streaming import score as st

MESSAGE = "conv_id bigint, turn bigint, role string, text string"


@pytest.fixture(scope="module")
def engine(spark):
    edges = spark.createDataFrame([("Dev", "Python", 0, 0), ("Dev", "Go", 0, 1), ("Data", "Python", 1, 0), ("Data", "Spark", 1, 1)], "job string, skill string, ord_row bigint, ord_pos int")
    people = LabelDictionary.of(spark, "Gender", ["Female", "Male"]), LabelDictionary.of(spark, "Stream", ["Civil", "Computer Science"])
    return Engine(ExpressionScorer(), *people, SkillGraph.from_edges(edges))


def request(i, **more):
    return json.dumps({"id": i, "Age": 22, "Gender": "Male", "Stream": "Civil", "Internships": i % 3, "CGPA": 6 + i % 4, "Hostel": 0, "HistoryOfBacklogs": i % 2,
                       "skills": [["Python"], ["Spark", "Go"], []][i % 3], "desired_role": "Data" if i % 4 == 0 else None} | more)


def test_answers_and_rejects_of_a_stream_equal_the_batch(spark, engine, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(request(i, Age=99 if i % 5 == 0 else 22) for i in range(10 * k, 10 * k + 10)) + "\n")
    run = lambda: sa.start_answers(engine, st.request_stream(spark, source, 1), out, check).awaitTermination()
    run()
    (tmp_path / "in" / "3.json").write_text(request(40) + "\n" + request(41, CGPA=11) + "\n")
    run()  # a restart takes the new file only
    want = answers.answer_all(engine, read_requests(spark, source))
    columns = [c for c in want.columns if c != "violations"]
    plain = lambda df: sorted((str(r.asDict(recursive=True)) for r in df.collect()))
    got = spark.read.parquet(f"{out}/answers")
    assert plain(got.select(columns)) == plain(want.filter("size(violations) = 0").select(columns))
    assert plain(spark.read.parquet(f"{out}/rejected").select("id", "violations")) == plain(want.filter("size(violations) > 0").select("id", "violations"))
    assert got.select("batch").distinct().count() == 4 and got.filter("id = 40").select("target_role").first()[0] == "Data"


def test_a_replayed_batch_adds_no_rows(spark, engine, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(request(i, Age=99 if i == 2 else 22) for i in range(6)) + "\n")
    batch, out = read_requests(spark, str(tmp_path / "r.json")), str(tmp_path / "out")
    write = sa.write_answers(engine, out)
    write(batch.filter("id < 3"), 0)
    write(batch.filter("id >= 3"), 1)
    for _ in range(2):
        write(batch.filter("id >= 3"), 1)
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/answers").collect()) == [0, 1, 3, 4, 5]
    assert [r["id"] for r in spark.read.parquet(f"{out}/rejected").collect()] == [2]


def test_context_of_a_stream_equals_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, per_file = [], []
    turns = {c: 0 for c in range(6)}
    for k in range(4):
        file = []
        for _ in range(60):
            c = rng.randrange(6)
            file.append((c, turns[c], rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([None, "", f"m{rng.randint(0, 99)} \"é\""])))
            turns[c] += 1
        file += [(None, k, "user", "stray"), (1, None, "user", "lost")]
        per_file.append(file)
        rows += file
    (tmp_path / "in").mkdir()
    stream = sa.conversation_context(spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    for k, file in enumerate(per_file):
        spark.createDataFrame(file, MESSAGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k % 2:  # two files, then a restart
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    plain = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.select("conv_id", "turn", "run", "history").collect())
    got, want = spark.read.parquet(str(tmp_path / "out")), reports.chat_history(spark.createDataFrame(rows, MESSAGE))
    assert plain(got) == plain(want)
