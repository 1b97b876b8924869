"""Chat, logs, reports, sources, sinks and the scoring stream."""

import json

from pyspark.sql import functions as F

from gradpath.functions import text
from gradpath.operators import reports as rp
from gradpath.operators.scoring import ExpressionScorer
from gradpath.operators.validate import LabelDictionary
from gradpath.schema import PROFILE_REQUEST
from gradpath.sources import readers, writers
from gradpath.streaming import score as st

MESSAGE = "conv_id bigint, turn bigint, role string, text string"


def plain_history(rows, keep):
    """For one conversation: run numbers and the messages of the last ``keep`` runs."""
    run, runs = 0, []
    for turn, role in rows:
        run += role == "user"
        runs.append((turn, run))
    return {t: [u for u, q in runs if r - keep <= q < r] for t, r in runs}


def test_history_keeps_five_runs(spark, monkeypatch):
    monkeypatch.setattr(rp, "TURN_BLOCK", 7)
    roles = ["system", "assistant"] + ["user", "assistant", "assistant", "user", "system"] * 12
    rows = [(1, t, r, f"m{t}") for t, r in enumerate(roles)] + [(2, t, "user", f"n{t}") for t in range(3)]
    got = rp.chat_history(spark.createDataFrame(rows, MESSAGE).repartition(4)).collect()
    mine = {r["turn"]: [h["turn"] for h in r["history"]] for r in got if r["conv_id"] == 1}
    assert mine == plain_history(list(enumerate(roles)), 5)
    assert {r["turn"]: len(r["history"]) for r in got if r["conv_id"] == 2} == {0: 0, 1: 1, 2: 2}
    assert all(h["text"] == f"m{h['turn']}" for r in got if r["conv_id"] == 1 for h in r["history"])


def test_failed_replies(spark):
    rows = [("Connection error.", "ok"), ("a 404 b", None), ("Unknown model error", ""), ("fine", "Error"), ("fine", "ok"), (None, None)]
    df = spark.createDataFrame(rows, "t string, s string")
    assert [r[0] for r in df.select(text.failed_reply(F.col("t"), F.col("s"))).collect()] == [True] * 4 + [False] * 2


def test_chat_markup(spark):
    cases = {
        "a < b & c > d": "a &lt; b &amp; c &gt; d",
        "**bold** and *it* and `x*y*`": "<strong>bold</strong> and <em>it</em> and <code>x<em>y</em></code>",
        "- one\n• two\n12. three": "<li>one</li><br><li>two</li><br><li>three</li>",
        "a\n\n- b": "a<br><li>b</li>",
        None: "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(text.chat_html(F.col("t"))).collect()] == list(cases.values())


def test_client_address(spark):
    rows = [(" 1.1.1.1 , 2.2.2.2", "3.3.3.3", "4"), (None, "3.3.3.3", "4"), (None, None, "4"), (None, None, None)]
    df = spark.createDataFrame(rows, "f string, r string, p string")
    assert [r[0] for r in df.select(text.client_ip(*[F.col(c) for c in "frp"])).collect()] == ["1.1.1.1", "3.3.3.3", "4", "0.0.0.0"]


def test_feature_names(spark):
    cases = {"Age": "Student Age", "Stream_Computer_Science": "Stream: Computer Science", "other_fieldName": "Other FieldName", "Hostel": "Hostel Accommodation"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert [r[0] for r in df.select(text.feature_display(F.col("n"))).collect()] == list(cases.values())


def test_advice_by_band(spark):
    rows = [(1, "HIGH", "Role", ["a", "b"]), (2, "MEDIUM", None, []), (3, "LOW", "Role", None)]
    df = spark.createDataFrame(rows, "id bigint, risk_level string, recommended string, missing array<string>")
    got = {}
    for r in rp.advice_rows(df).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["title"])
    assert got == {
        1: ["Skill Development", "Improve Academics", "Career Path", "Continuous Learning", "Skill Gaps"],
        2: ["Networking", "Continuous Learning"],
        3: ["Prepare for Interviews", "Career Path", "Continuous Learning"],
    }


def test_report_defaults(spark):
    schema = """Age int, GenderName string, StreamName string, Internships int, CGPA double, Hostel int, HistoryOfBacklogs int, skills array<string>,
      desired_role string, probability_percentage double, risk_level string, confidence string, recommended string,
      factors array<struct<feature:string,impact:double,direction:string,interpretation:string>>,
      scenarios array<struct<title:string,description:string,original_risk:double,modified_risk:double,risk_delta:double>>,
      combined_risk double, combined_risk_level string"""
    df = spark.createDataFrame([(None,) * 17, (21, "Male", "CS", 2, 8.5, 1, 0, ["a", "b"], "R", 61.25, "LOW", "High Confidence", "Q",
                                              [("F", 0.1, "D", "I")], [("T", "W", 50.0, 49.5, -0.5)], 70.0, "LOW")], schema)
    empty, full = [r[0] for r in df.select(rp.assessment_report(df)).collect()]
    for part in ("Age: N/A years", "Hostel: No", "Desired Role: Not Specified", "Placement Chance: ?%", "(None available)", "(None generated)\n\n="):
        assert part in empty
    for part in ("CGPA: 8.5", "Skills: a, b", "  - F | D | I", "  - T: 50.0% -> 49.5% (delta: -0.5%) | W", "70.0% (LOW)"):
        assert part in full


def test_profiles_from_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Age,Gender,Stream,Internships,CGPA,Hostel,HistoryOfBacklogs,PlacedOrNot\n21,Male,Civil,1,7.5,0,1,1\n")
    row = readers.read_profiles(spark, str(tmp_path / "p.csv")).first()
    assert tuple(row) == (0, 21, "Male", "Civil", 1, 7.5, 0, 1, 1)  # the line order stands in for an id


def test_nested_json_round_trip(spark, tmp_path):
    body = {"id": 1, "Age": 21, "Gender": "Male", "Stream": "Civil", "Internships": 1, "CGPA": 7.5, "Hostel": 0, "HistoryOfBacklogs": 1, "skills": ["a"]}
    bare = {k: v for k, v in body.items() if k != "skills"} | {"id": 2}
    (tmp_path / "r.json").write_text(json.dumps(body) + "\n" + json.dumps(bare) + "\n")
    rows = {r["id"]: r for r in readers.read_requests(spark, str(tmp_path / "r.json")).collect()}
    assert rows[1]["skills"] == ["a"] and rows[2]["skills"] == [] and rows[2]["desired_role"] is None
    texts = spark.createDataFrame([(json.dumps(body),)], "body string")
    parsed = readers.parse_requests(texts)
    assert parsed.first() == rows[1]
    out = json.loads(writers.to_json_rows(parsed).first()["json"])
    assert out == {k: v for k, v in body.items() if k != "id"}
    writers.write_json(parsed, str(tmp_path / "out"))
    assert readers.read_requests(spark, str(tmp_path / "out")).first() == rows[1]
    writers.write_parquet(parsed, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).first() == rows[1]


def test_stream_equals_batch(spark, tmp_path):
    gender = LabelDictionary.of(spark, "Gender", ["Female", "Male"])
    stream = LabelDictionary.of(spark, "Stream", ["Civil", "Computer Science"])
    source = tmp_path / "in"
    source.mkdir()

    def drop(name, ids):
        lines = [json.dumps({"id": i, "Age": 10 + i, "Gender": "Male", "Stream": "Civil", "Internships": i % 4, "CGPA": 6.5, "Hostel": 0, "HistoryOfBacklogs": 0}) for i in ids]
        (source / name).write_text("\n".join(lines))

    def run():
        scored = st.score_requests(st.request_stream(spark, str(source), 1), ExpressionScorer(), gender, stream)
        query = st.start(scored, str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination(120)
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))

    drop("a.json", range(0, 10))
    first = run()
    drop("b.json", range(10, 40))
    second = run()
    batch = st.score_requests(readers.with_request_defaults(spark.read.schema(PROFILE_REQUEST).json(str(source))), ExpressionScorer(), gender, stream)
    assert second == sorted(map(tuple, batch.collect()))
    assert len(first) == 5 and len(second) == 26  # ages below 15 and above 40 are rejected


def test_profiles_by_header_name_and_in_file_order(spark, tmp_path):
    head, tail = "PlacedOrNot,CGPA,Gender,Age,Stream,Internships,Hostel,HistoryOfBacklogs\n", "1,7.5,Male,21,\"Civil, \"\"new\"\"\",1,0,1\n"
    (tmp_path / "b.csv").write_text(head + tail * 3)
    (tmp_path / "a.csv").write_text(head + "0,x,Female,22,Civil,2,1,0\n" + tail * 40)
    got = readers.read_profiles(spark, str(tmp_path)).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(44))
    assert tuple(got[0]) == (0, 22, "Female", "Civil", 2, None, 1, 0, 0) and got[1]["Stream"] == 'Civil, "new"'


def test_catalogue_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Job roles,Skills ,Programming Languages,Tools\n"A, ""x""","s1,\ns2",p,t\nB,s3,,\n')
    got = readers.read_catalogue(spark, str(tmp_path / "c.csv")).orderBy("row_id").collect()
    assert [(r["row_id"], r["job"], r["skills"]) for r in got] == [(0, 'A, "x"', "s1,\ns2"), (1, "B", "s3")]


def test_display_name_after_any_boundary(spark):
    from gradpath.functions.text import feature_display

    got = spark.createDataFrame([("max_score(raw)-value",)], "n string").select(feature_display(F.col("n"))).first()[0]
    assert got == "Max Score(Raw)-Value"


def test_requests_are_answered_or_rejected_with_reasons(spark):
    from gradpath.operators.graph import SkillGraph
    from gradpath.operators.scoring import ExpressionScorer
    from gradpath.operators.validate import LabelDictionary
    from gradpath.plans import answers

    edges = spark.createDataFrame([("Dev", "Go", 0, 0), ("Dev", "SQL", 0, 1), ("Lead", "SQL", 1, 0)], "job string, skill string, ord_row bigint, ord_pos int")
    engine = answers.Engine(ExpressionScorer(), LabelDictionary.of(spark, "Gender", ["Female", "Male"]), LabelDictionary.of(spark, "Stream", ["Civil", "Computer Science"]), SkillGraph.from_edges(edges))
    rows = [(1, 21, "Male", "Civil", 1, 7.5, 0, 1, ["Go"], "Lead"), (2, 99, "Male", None, 1, 7.5, 0, 1, [], None), (3, 20, "Female", "Civil", 0, 6.0, 1, 0, [], None)]
    requests = spark.createDataFrame(rows, "id bigint, Age int, Gender string, Stream string, Internships int, CGPA double, Hostel int, HistoryOfBacklogs int, skills array<string>, desired_role string")
    from gradpath.operators.attribution import LinearAttribution

    attribution = LinearAttribution.fit(ExpressionScorer(), engine.encode(requests))
    got = {r["id"]: r for r in answers.answer_all(engine, requests, attribution).collect()}
    assert got[2]["violations"] == ["Age above 40", "Stream missing"] and got[2]["scenarios"] is None
    assert got[1]["recommended_job"] == "Dev" and got[1]["target_role"] == "Lead" and got[1]["violations"] == [] and len(got[1]["factors"]) == 5
    assert got[3]["recommended_job"] is None and got[3]["scenarios"]
    assert {r["id"] for r in answers.rejected(requests).collect()} == {2}


def test_steps_are_forgotten(spark, tmp_path, monkeypatch):
    from gradpath import session

    folder = tmp_path / "steps"  # of its own, as other tests still read the session's tables
    monkeypatch.setattr(session, "steps_folder", lambda _: str(folder))
    assert session.cut_lineage(spark.range(3)).count() == 3
    assert any(folder.iterdir())
    session.forget_steps(spark)
    assert not folder.exists()


def test_messages_without_a_place_come_back(spark):
    rows = [(1, 0, "user", "a"), (1, None, "user", "lost"), (None, 3, "user", "stray"), (None, None, "user", "x"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (None, 3, "user", "stray")]
    got = rp.chat_history(spark.createDataFrame(rows, MESSAGE)).collect()
    assert sorted(((r["conv_id"], r["turn"], r["run"], len(r["history"])) for r in got), key=str) == sorted(
        [(1, 0, 1, 0), (1, 1, 1, 0), (1, 2, 2, 2), (1, None, None, 0), (None, 3, None, 0), (None, 3, None, 0), (None, None, None, 0)], key=str)
