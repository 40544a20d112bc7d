"""Readers, sinks, catalog, lineage and streams."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiforge.sources import catalog as K, lineage as L, readers as R
from lexiforge.streaming import events as S


def test_jsonl_skips(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('---\n{"a": 1, "b": "x"}\n\n{"a": 2}\n{"a": 3, "b":\n')
    assert sorted(r.a for r in R.read_any(spark, str(path)).collect()) == [1, 2]


def test_csv_and_superset(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("x,y\n1,hello\n2,\n")
    df = R.read_any(spark, str(tmp_path / "a.csv.gz"))
    assert df.count() == 2 and df.columns == ["x", "y"]
    R.write_csv(df, str(tmp_path / "out.csv"), ["y", "z"])
    back = R.read_csv(spark, str(tmp_path / "out.csv"))
    assert back.columns == ["y", "z"] and back.count() == 2


def test_lines_and_unknown(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one \n\n two\n")
    assert [r.line for r in R.read_any(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        R.read_any(spark, "a.xyz")


def test_zipped(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.xml", "<a>1</a>")
        z.writestr("word/document.xml", "<w>Hello <b>there</b></w>")
    assert sorted(r.member for r in R.read_zipped(spark, str(tmp_path / "a.zip")).collect()) == ["one.xml", "word/document.xml"]
    assert R.read_packed_text(spark, str(tmp_path / "a.zip")).first()["text"] == "Hello there"


def test_annotated(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("#FORMAT\n\n#Text=Two words\n1-1\t0-3\tTwo\tA\t_\n1-2\t4-9\twords\t_\tB\n\n#Text=More\n2-1\t10-14\tMore\tC\t_\n")
    rows = R.read_annotated(spark, str(path)).orderBy("sentence", "begin").collect()
    assert [(r.sentence, r.text, r.surface, r.begin, r.end, r.layers[0]) for r in rows] == [(1, "Two words", "Two", 0, 3, "A"), (1, "Two words", "words", 4, 9, "_"), (2, "More", "More", 10, 14, "C")]


def test_provenance(spark, tmp_path):
    df = spark.range(3)
    R.write_parquet(df, str(tmp_path / "t.parquet"), "numbers", ["nothing"])
    back, found = R.read_parquet(spark, str(tmp_path / "t.parquet"))
    assert back.count() == 3 and found["name"] == "numbers" and found["parents"] == ["nothing"]
    assert spark.read.text(str(tmp_path / "t.parquet.meta")).count() == 1


def test_catalog_layers_and_errors(spark, tmp_path):
    (tmp_path / "datasets.toml").write_text(f'[tiers.a]\nroot = "{tmp_path}"\n[tiers.b]\nroot = "/nowhere"\n[datasets.x]\ntier = "a"\npath = "x.parquet"\n[datasets.y]\ntier = "b"\npath = "y"\n[datasets.z]\ntier = "c"\npath = "z"\n')
    (tmp_path / "datasets.local.toml").write_text('[datasets.x]\npath = "other.parquet"\n')
    c = K.Catalog.load(tmp_path / "datasets.toml")
    assert c.resolve("x").endswith("other.parquet")
    for name, kind in (("nope", K.UnknownDataset), ("y", K.TierUnavailable), ("z", K.UnknownTier)):
        with pytest.raises(kind):
            c.resolve(name)
    assert {r.name: r.state for r in c.check(spark).collect()} == {"x": "ok", "y": "tier missing", "z": "unknown tier"}
    assert K.find_manifest(tmp_path) == tmp_path / "datasets.toml"
    with pytest.raises(ValueError):
        K.path_or_name(c, path="/gold.csv")


def test_log_appends(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "h", "t")], "child string, parent string, digest string, stamp string")
    for _ in range(2):
        L.append_log(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_stream_resumes(spark, tmp_path):
    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    rows = spark.range(6).select(F.col("id").alias("event_id"), stamp.alias("ts"), F.lit(1.0).alias("value"))
    rows.where("event_id < 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: S.drained(S.deduplicated(S.event_stream(spark, str(tmp_path / "in")), "event_id", "ts").select("event_id"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert run().count() == 4
    rows.where("event_id >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r.event_id for r in run().collect()) == [0, 1, 2, 3, 4, 5]


def test_jsonl_sink_and_sidecar(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    record = R.write_jsonl(df, str(tmp_path / "x.jsonl"), "things", ["raw"])
    assert record["records"] == 2 and spark.read.text(str(tmp_path / "x.jsonl.meta")).count() == 1
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "x.jsonl")).collect()) == ['{"a":1,"b":"é"}', '{"a":2,"b":null}']


def test_import_of_labelled_rows(spark, tmp_path):
    (tmp_path / "gold.csv").write_text("id,labelled,frame\n1,yes,A\n2,,B\n3,TRUE,C\n")
    df = R.import_labelled(spark, str(tmp_path / "gold.csv"), str(tmp_path / "gold.parquet"), str(tmp_path / "gold.jsonl"))
    assert sorted(r.id for r in df.collect()) == ["1", "3"] and spark.read.text(str(tmp_path / "gold.jsonl")).count() == 2
    (tmp_path / "none.csv").write_text("id,labelled\n1,no\n")
    with pytest.raises(ValueError):
        R.import_labelled(spark, str(tmp_path / "none.csv"), str(tmp_path / "n.parquet"), str(tmp_path / "n.jsonl"))
    assert not (tmp_path / "n.parquet").exists() and not (tmp_path / "n.jsonl").exists()


def test_records_and_separators(spark, tmp_path):
    (tmp_path / "export.csv").write_text('\ufeffsep=;\ntitle;year\n"A; or B";1650\nC;\n')
    got = R.read_separated(spark, str(tmp_path / "export.csv"))
    assert got.columns == ["title", "year"] and sorted((r.title, r.year) for r in got.collect()) == [("A; or B", "1650"), ("C", None)]
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n")
    assert [tuple(r) for r in R.read_separated(spark, str(tmp_path / "plain.csv")).collect()] == [("1", "2")]
    xml = spark.createDataFrame([(1, "<r><t>One</t><y>1650</y><y>1651</y></r>")], "n int, xml string")
    row = R.read_records(xml, "xml", {"title": "<t>(.*?)</t>", "years": "<y>(.*?)</y>"}).first()
    assert row.title == ["One"] and row.years == ["1650", "1651"]


def test_assets_and_sheets(spark, tmp_path):
    (tmp_path / "shots.json").write_text('[{"text": "a", "labels": ["x"]}, {"text": "b", "labels": []}]')
    assert R.load_assets(spark, str(tmp_path / "shots.json"), "text string, labels array<string>") == [{"text": "a", "labels": ["x"]}, {"text": "b", "labels": []}]
    with pytest.raises(RuntimeError):
        R.read_sheet(spark, str(tmp_path / "none.xlsx"))


def test_lineage_goes_on_or_raises(spark):
    rows = [(f"n{i}", f"n{i + 1}" if i < 20 else None) for i in range(21)]
    catalog = spark.createDataFrame(rows, "name string, parent string")
    assert L.chain(catalog).where("child = 'n0'").count() == 21
    with pytest.raises(Exception, match="too long"):
        L.chain(catalog, 10).collect()
