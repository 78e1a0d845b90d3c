from pyspark.sql import functions as F

from spandrel.operators import registry as V

SCHEMA = "element_id string, generation int, is_manual boolean, artifact_id string, seq long"


def log(spark, *rows):
    return spark.createDataFrame([(e, g, m, f"{e}{i}", i) for i, (e, g, m) in enumerate(rows)], SCHEMA)


def verdicts(spark, *winners):
    return spark.createDataFrame([("Winner", w) for w in winners], "verdict string, winner string")


def test_current_view_keeps_the_first_of_equals(spark):
    got = V.current_view(log(spark, ("e", 0, False), ("e", 1, False), ("e", 1, False))).first()
    assert (got.generation, got.seq) == (1, 1)


def test_resolve(spark):
    rows = log(spark, ("a", 0, True), ("a", 1, False), ("b", 1, False), ("b", 1, False), ("c", 0, False), ("c", 5, True))
    got = {r.element_id: r.seq for r in V.resolve(rows, verdicts(spark)).collect()}
    assert got == {"a": 0, "b": 3, "c": 5}
    won = {r.element_id: r.seq for r in V.resolve(rows, verdicts(spark, "c4", "a1")).collect()}
    assert won == {"a": 1, "b": 3, "c": 4}


def test_replay_changes_nothing_but_the_log(spark):
    rows = log(spark, ("a", 0, False), ("a", 1, False), ("b", 0, False))
    once = {(r.element_id, r.generation) for r in V.resolve(rows, verdicts(spark)).collect()}
    again = rows.unionByName(rows.withColumn("seq", F.col("seq") + 3))
    assert {(r.element_id, r.generation) for r in V.resolve(again, verdicts(spark)).collect()} == once


def artifacts(spark, *rows):
    df = spark.createDataFrame([(i, f"e{i}", g, f"a{i}.{g}", list(p)) for i, g, p in rows], "ord int, element_id string, generation int, artifact_id string, parents array<string>")
    empty = {"doc": F.lit("d"), "page": F.lit(1), "bbox": F.lit(None).cast("struct<x0:float,y0:float,x1:float,y1:float>"), "content_hash": F.lit("h"), "status": F.lit("ok"), "kind": F.lit("HtmlTable"), "is_manual": F.lit(False), "payload": F.lit("")}
    return df.withColumns(empty)


def test_registry(spark, tmp_path):
    r = V.Registry(spark, str(tmp_path / "reg"))
    assert r.observations.count() == 0 and r.current().count() == 0
    r.append(artifacts(spark, (0, 0, ()), (1, 0, ("a0.0",))))
    assert r.observations.count() == 2 and [x.relation for x in r.lineage.collect()] == ["Derive"]
    r.append(artifacts(spark, (0, 1, ())))
    assert r.observations.count() == 3 and r.current().count() == 2
    r.append(artifacts(spark, (2, 0, ("a0.0", "a1.0"))))
    assert r.lineage.where("relation = 'Merge'").count() == 2 and r.manifest().count() == 1
    kinds = V.lineage_kinds(r.lineage.unionByName(spark.createDataFrame([("gone", "x", 0, "Derive")], V.LINEAGE)), r.observations)
    assert {(k.parent, k.parent_kind) for k in kinds.collect()} >= {("gone", "?"), ("a0.0", "HtmlTable")}
    assert {(x.child, x.ancestor, x.steps) for x in V.ancestors(r.lineage).collect()} == {("a1.0", "a0.0", 1), ("a2.0", "a0.0", 1), ("a2.0", "a1.0", 1)}
    r.to_json_lines(str(tmp_path / "lines"))
    assert V.read_json_lines(spark, str(tmp_path / "lines/observations"), V.OBSERVATION).count() == 4
    assert V.read_json_lines(spark, str(tmp_path / "none"), V.OBSERVATION).count() == 0


def test_stream(spark, tmp_path):
    from spandrel.streaming import registry_stream as S

    r = V.Registry(spark, str(tmp_path / "src"))
    r.append(artifacts(spark, (0, 0, ())))
    S.append(S.observations(spark, str(tmp_path / "src/observations")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert V.Registry(spark, str(tmp_path / "out")).observations.count() == 1


def test_appended_and_streamed_rows_are_one_log(spark, tmp_path):
    from spandrel.streaming import registry_stream as S

    source, r = V.Registry(spark, str(tmp_path / "src")), V.Registry(spark, str(tmp_path / "out"))
    source.append(artifacts(spark, (0, 0, ())))
    r.append(artifacts(spark, (1, 0, ())))
    for check in ("ck", "other"):
        S.append(S.observations(spark, str(tmp_path / "src/observations")), str(tmp_path / "out"), str(tmp_path / check)).awaitTermination(120)
    assert sorted(x.element_id for x in r.observations.collect()) == ["e0", "e0", "e1"]
    r.append(artifacts(spark, (2, 0, ())))
    S.append(S.observations(spark, str(tmp_path / "src/observations")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(x.element_id for x in r.observations.collect()) == ["e0", "e0", "e1", "e2"]


def test_payload_envelope(spark):
    import pytest

    rows = V.enveloped(spark.createDataFrame([("a", "Table", 0.5)], "artifact_id string, label string, confidence double"), "Region", ["label", "confidence"])
    back = V.opened(rows.select("artifact_id", "kind", "payload"), "Region", "label string, confidence double").first()
    assert (back.artifact_id, back.kind, back.label, back.confidence) == ("a", "Region", "Table", 0.5)
    with pytest.raises(ValueError):
        V.enveloped(rows, "Nonsense", ["label"])
    with pytest.raises(Exception, match="MALFORMED"):
        V.opened(rows.withColumn("payload", F.lit("{not json")), "Region", "label string").collect()
