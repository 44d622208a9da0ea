import io
import json

from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftwork import cli
from weftwork.session import discard, written
from weftwork.sources import files
from weftwork.sources.providers import RuleProvider
from weftwork.streaming.extract import flat_result, stream_extract
from weftwork.operators.extract import extract


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert {"doc_id", "status", "n_nodes", "n_edges", "valid"} <= set(df.columns) and df.count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo", encoding="utf-8")
    (tmp_path / "s.json").write_text('{"entityTypes": ["x"], "maxNodes": 3}')
    (tmp_path / "bad.json").write_text("{")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"
    assert files.read_input(None, io.StringIO("in")) == "in"
    assert files.read_schema(str(tmp_path / "s.json")).max_nodes == 3
    assert files.read_graphs(spark, str(tmp_path / "bad.json")).first().value is None
    for call in (lambda: files.read_schema(str(tmp_path / "bad.json")), lambda: files.read_schema(str(tmp_path / "none")), lambda: files.read_input(str(tmp_path / "none"))):
        try:
            call()
        except (ValueError, FileNotFoundError):
            continue
        raise AssertionError
    files.write_json(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"k":1,"v":"a"}'


def test_cli_config(capsys):
    args = cli.parse_args(["-i", "x", "--stop", "a", "--stop", "b", "-p", "--unknown", "--max-nodes", "3"])
    assert (args["input"], args["stop"], args["pretty"], args["max_nodes"]) == ("x", ["a", "b"], True, "3")
    assert cli.main(["--help"]) == 0 and cli.main(["validate", "--version"]) == 0


def test_cli_codes(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    good, text = tmp_path / "g.json", tmp_path / "t.txt"
    good.write_text('{"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"id": "e", "source": "a", "target": "b"}]}')
    text.write_text("Alice met Bob.")
    assert cli.main(["validate", str(good)]) == 0
    (tmp_path / "i.json").write_text('{"nodes": [{}]}')
    assert cli.main(["validate", str(tmp_path / "i.json")]) == 2
    assert cli.main(["validate", str(tmp_path / "none")]) == 3
    assert cli.main(["canvas", str(good), "-o", str(tmp_path / "c.json")]) == 0
    document = json.loads((tmp_path / "c.json").read_text())
    assert len(document["nodes"]) == 2 and len(document["edges"]) == 1
    assert cli.main(["-i", str(text), "--provider", "rule", "-o", str(tmp_path / "o.json")]) == 0
    assert len(json.loads((tmp_path / "o.json").read_text())["nodes"]) == 2
    assert cli.main(["-i", str(text), "--provider", "openai"]) == 4
    assert cli.main(["-i", str(text), "-m", "x", "--max-nodes", "0"]) == 4
    assert cli.main(["-i", str(text), "-m", "x", "--response-format", "xml"]) == 1
    assert cli.main(["-i", str(tmp_path / "none")]) == 3


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Alice{i} met Bob and Carl") for i in range(20)] + [(20, " ")], "doc_id bigint, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    stream_extract(stream, str(tmp_path / "out"), str(tmp_path / "log"), RuleProvider).awaitTermination()
    key = lambda r: tuple(map(str, r))
    batch = flat_result(extract(docs, RuleProvider))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).drop("batch").collect(), key=key) == sorted(batch.collect(), key=key)


def test_cli_canvas_writes_every_item(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    n = 5200
    graph = {"nodes": [{"id": f"n{k}"} for k in range(n)], "edges": [{"id": f"e{k}", "source": f"n{2 * k}", "target": f"n{2 * k + 1}"} for k in range(n // 2)]}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    assert cli.main(["canvas", str(tmp_path / "g.json"), "-o", str(tmp_path / "c.json")]) == 0
    document = json.loads((tmp_path / "c.json").read_text())
    assert [x["id"] for x in document["nodes"]] == [x["id"] for x in graph["nodes"]]
    assert [x["id"] for x in document["edges"]] == [x["id"] for x in graph["edges"]]
    (tmp_path / "e.json").write_text("{}")
    assert cli.main(["canvas", str(tmp_path / "e.json"), "-o", str(tmp_path / "c.json")]) == 0
    assert json.loads((tmp_path / "c.json").read_text()) == {"nodes": [], "edges": []}


def test_stream_drops_documents_sent_again(spark, tmp_path):
    schema = "doc_id bigint, text string, at timestamp"
    rows = spark.createDataFrame([(k, f"Alice{k} met Bob") for k in range(6)], "doc_id bigint, text string").withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("doc_id < 3").withColumn("at", F.lit("2024-01-01 01:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_extract(stream, str(tmp_path / "out"), str(tmp_path / "log"), RuleProvider, time="at").awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))


def test_discard(spark):
    kept = written(spark.range(3), "numbers")
    assert kept.count() == 3 and discard(spark) >= 1 and discard(spark) == 0
