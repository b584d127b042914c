"""Files to profiles, matching arithmetic, projection and evaluation."""

import json

import pytest
from pyspark.sql import functions as F

from confluo.cli import main
from confluo.operators import components, evaluate, merge, resolve
from confluo.operators.project import Config, ProjectionError
from confluo.plans.engine import Engine
from confluo.plans.scratch import Scratch

# Two invented people. One is in the table and the list, which name different phones; the other in the table and a note.
CSV = 'display_name,mail,mobile,country_code,technologies,years_experience\nInes Okafor,ines.okafor@post.example,(212) 555-0143,de,"nlp / sql",4\nHenrik Dahl,h.dahl@fjord.example,,canada,,\n'
ATS = {"data": ["header", {"candidate": "Ines T. Okafor", "email_address": "INES.OKAFOR@post.example", "phone_number": "+1 212 555 0199", "skill_set": ["sql"]}]}
NOTES = "Wrote to h.dahl@fjord.example, who prefers mornings.\nSkills: python\nDOB: 7 May 1990\n"
CONFIG = {"fields": [{"path": "full_name", "rename": "name"}, {"path": "email"}, {"path": "phone"}, {"path": "country"}, {"path": "skills"}, {"path": "experience_yrs"}, {"path": "date_of_birth", "rename": "born"}], "include_confidence": True, "include_provenance": True}


@pytest.fixture
def files(tmp_path):
    for name, text in {"a.csv": CSV, "b.json": json.dumps(ATS), "d.txt": NOTES, "config.json": json.dumps(CONFIG), "bad.json": "{"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return tmp_path


def _run(engine, files):
    return engine.run_with_metrics(CONFIG, csv=[f"{files}/a.csv"], ats=[f"{files}/bad.json", f"{files}/b.json"], resume=[f"{files}/missing.txt"], notes=[f"{files}/d.txt"])


def test_files_to_profiles(spark, files):
    with Engine(spark) as engine:
        out, metrics = _run(engine, files)
        henrik, ines = out.collect()  # in the order of e-mails
        m = metrics.first()
    assert (henrik.name, henrik.email, henrik.phone, henrik.country, henrik.skills, henrik.experience_yrs, henrik.born) == ("Henrik Dahl", "h.dahl@fjord.example", None, "CA", ["Python"], None, "1990-05-07")
    # the longest name; each phone once, with as many digits, so the source of higher priority decides
    assert (ines.name, ines.email, ines.phone, ines.country, ines.skills, ines.experience_yrs) == ("Ines T. Okafor", "ines.okafor@post.example", "+12125550199", "DE", ["NLP", "SQL"], 4.0)
    # one of two sources: 0.85 * (0.6 + 0.4 * 1.0), less 0.2 * (2 - 1) / 2 for the other value
    assert (ines.name_confidence, ines.phone_confidence) == (0.75, 0.75)
    # both sources: 0.92 * (0.6 + 0.4 * 0.95) = 0.9016
    assert ines.email_confidence == 0.9 and sorted(ines.email_provenance) == ["ATS:b.json#2", "CSV:a.csv#row1"]
    # one source: 0.85 * (0.6 + 0.4 * 0.9) = 0.816, and of Notes 0.85 * (0.6 + 0.4 * 0.8) = 0.782
    assert (ines.country_confidence, henrik.country_confidence, henrik.skills_confidence) == (0.82, 0.82, 0.78)
    assert ines.phone_provenance == ["ATS:b.json#2"] and henrik.born_provenance == ["Notes:d.txt"]
    assert (m.records_processed, m.profiles_generated, m.records_merged, m.duplicate_rate) == (4, 2, 2, 50.0)


def test_other_trust_and_keys(spark, files):
    """Trust decides confidences; a further key joins what nothing else does."""
    with Engine(spark, trust_weights={"ATS": 0.5, "CSV": 1.0}, keys=[F.coalesce("country", F.lit("none")), F.when(F.col("source_type") == "Notes", "x").when(F.col("country") == "DE", "x")]) as engine:
        out, metrics = _run(engine, files)
        (row,) = out.collect()
    # of four records one has this phone, of the least trusted source: 0.85 * (0.6 + 0.4 * 0.5) - 0.2 * (2 - 1) / 2
    assert row.phone == "+12125550199" and row.phone_confidence == 0.58


def test_command_line(spark, files):
    assert main(["--config", f"{files}/config.json", "--input-notes", f"{files}/d.txt", "--output", f"{files}/out/x.json", "--pretty"]) == 0
    got = json.loads((files / "out/x.json").read_text())
    assert [x["email"] for x in got] == ["h.dahl@fjord.example"] and got[0]["phone"] is None
    assert main(["--config", f"{files}/bad.json", "--output", f"{files}/y.json"]) == 2


def _probability(spark, **signals):
    known = dict.fromkeys(resolve.WEIGHTS, 0.5) | signals
    return spark.range(1).select(resolve.match_probability({k: F.lit(v) for k, v in known.items()})).first()[0]


def test_match_probability(spark):
    assert _probability(spark, name=0.9) == 0.684  # 8.95 of 15.5
    assert _probability(spark, email=0.0, phone=1.0, name=1.0) == 0.656  # 8.75
    assert _probability(spark, skills=1.0, country=0.0) == 0.540  # 8


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    edges = [(1, 2), (2, 3), (5, 4), (6, 6), (9, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)] + [(100, k) for k in range(101, 160)]
    labels = components.connected_components(spark.createDataFrame(edges, "src long, dst long"), scratch := Scratch(spark))
    want = {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 6: 6, **{k: 20 for k in range(20, 26)}, **{k: 100 for k in range(100, 160)}}
    assert dict(labels.collect()) == want
    more = components.joined_components(labels, spark.createDataFrame([(25, 130), (7, 9), (7, 8), (6, 6), (200, 201)], "src long, dst long"), scratch)
    moved = {k: 20 if v == 100 else v for k, v in want.items()}
    assert dict(more.collect()) == moved | {7: 1, 8: 1, 200: 200, 201: 200}
    scratch.drop()
    assert components.connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark)).count() == 0


def test_confidence_parts(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert [one(merge.agreement_base(F.lit(n))) for n in range(6)] == [0.0, 0.85, 0.92, 0.96, 0.99, 0.99]
    assert one(merge.string_penalty(F.lit(3), F.lit(5))) == pytest.approx(0.08)
    assert one(merge.confidence_of(F.lit(0.96), F.lit(0.9), F.lit(0.08))) == 0.84
    of = dict.fromkeys(merge.OVERALL_WEIGHTS, F.lit(None).cast("double"))
    assert one(merge.overall_confidence(of)) == 0.0
    assert one(merge.overall_confidence(of | {"full_name": F.lit(0.6), "email": F.lit(0.8), "country": F.lit(0.9)})) == 0.74


def test_projection_rules(spark, files):
    records = Engine(spark).read(notes=[f"{files}/d.txt"])
    found = Engine(spark).profiles(records)
    from confluo.operators.project import project

    row = project(found, Config({"fields": [{"path": "email"}, {"path": "skills", "from": "skills[].name"}, {"path": "phones", "from": "phones"}]})).first()
    assert row.email == "h.dahl@fjord.example" and row.phones is None and [s.name for s in row.skills] == ["Python"]
    with pytest.raises(Exception, match="Required field 'phone' is missing"):
        project(found, Config({"fields": [{"path": "phone", "required": False}], "on_missing": "error"})).collect()
    full = project(found, Config({"fields": [{"path": "email"}], "output_format": "enterprise"})).first()
    assert full.email.value == "h.dahl@fjord.example" and full.email.sources == ["Notes:d.txt"] and full.match_probability == 1.0
    with pytest.raises(ProjectionError, match="not array<string>"):
        project(found.withColumn("skills", F.lit("SQL")), Config({"fields": [{"path": "skills", "required": True}]}))
    for bad in ({"fields": [{"path": "nope"}]}, {"fields": [{"path": "email"}, {"path": "emails", "rename": "email"}]}, {"on_missing": "x"}):
        with pytest.raises(ProjectionError):
            Config(bad)


def test_evaluation(spark):
    df = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.2, 0), (1.0, 1)], "p double, y int")
    assert evaluate.brier_score(df.where("p < 1"), "p", "y").first()[0] == pytest.approx(0.41 / 3)
    assert evaluate.brier_score(df.where("p > 2"), "p", "y").first()[0] == 1.0
    buckets = evaluate.reliability_buckets(df, "p", "y", 5).orderBy("bucket").collect()
    assert len(buckets) == 5 and [b.n for b in buckets] == [0, 1, 0, 1, 1]
    got = spark.range(1).select(*[c.alias(k) for k, c in evaluate.precision_recall_f1(F.lit(7), F.lit(3), F.lit(1)).items()]).first()
    assert (got.precision, got.recall) == (0.7, 0.875)
    assert spark.range(1).select(evaluate.precision_recall_f1(F.lit(0), F.lit(0), F.lit(0))["f1"]).first()[0] == 0.0


def test_stream(spark, files, tmp_path):
    from confluo.streaming.ingest import start, text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/n.txt").write_text(NOTES, encoding="utf-8")
    start(text_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert [(r.email, r.skills) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("h.dahl@fjord.example", ["Python"])]
