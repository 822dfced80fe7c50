import json

from plumbline import report
from plumbline.rules import engine
from plumbline.sources.sqlfiles import decode, sql_files
from plumbline.streaming.rescan import rescan


def test_decode():
    assert decode("é".encode()) == "é" and decode("é".encode("latin-1")) == "é"
    assert decode(b"\xef\xbb\xbfa") == "a" and decode("aé".encode("utf-16")) == "aé" and decode(b"") == ""


def test_files_to_findings_to_sinks(spark, tmp_path):
    src = tmp_path / "src" / "deep"
    src.mkdir(parents=True)
    (src / "a.sql").write_bytes("delete from dbo.t\nGO\nselect * from dbo.é\nGO 2\n".encode("utf-16"))
    (src / "b.sql").write_text("  \n")
    (src / "c.txt").write_text("delete from dbo.t")
    mods = sql_files(spark, str(tmp_path / "src"))
    assert [(r.batch, r.line, r.repeats) for r in mods.orderBy("batch").collect()] == [(0, 1, 1), (1, 3, 2)]
    found, broken = engine.scan(mods)
    ranked = engine.ranked(engine.best_of_duplicates(found))
    text = report.to_text(ranked)
    assert not broken and "query/unbounded-table-write (High)" in text
    doc = json.loads(report.to_sarif(ranked))
    assert {r["ruleId"] for r in doc["runs"][0]["results"]} >= {"query/unbounded-table-write", "statement-shape/bare-select-star"}
    report.write_json(ranked, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == len(doc["runs"][0]["results"])
    assert report.summary(found).where("rule_id = 'query/unbounded-table-write'").first().n_findings == 1


def test_rescan_of_a_stream(spark, tmp_path):
    ddl = "module_id long, definition string"
    spark.createDataFrame([(1, "delete from dbo.t"), (2, None)], ddl).write.parquet(str(tmp_path / "in"))
    go = lambda: rescan(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    spark.createDataFrame([(3, "select * from dbo.t")], ddl).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    got = {(r.module_id, r.rule_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, "query/unbounded-table-write") in got and (3, "statement-shape/bare-select-star") in got
    assert spark.read.parquet(str(tmp_path / "out")).where("module_id = 1 and rule_id = 'query/unbounded-table-write'").count() == 1
