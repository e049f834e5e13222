import datetime
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from presswork import session
from presswork.operators import corpus
from presswork.sources import readers, schemas, sinks
from presswork.streaming.score_stream import score_stream


def data_files(path):
    return [f for f in os.listdir(path) if f.startswith("part-")]


def test_raw_articles(spark, tmp_path):
    record = {"source": "north-wire", "title": "Bees", "sapo": None, "body": "<p>Caf&eacute;</p>", "id": 5, "tags": [],
              "keywords": ["k1", "k2"], "cates": ["Nhà đất", "Khác"]}
    lines = [
        json.dumps(record, ensure_ascii=False)[:-1] + ', "publish": ISODate("2031-09-05T06:07:08Z")}',
        json.dumps({**record, "id": 6, "cates": [], "publish": {"$date": "2031-09-05T06:07:08Z"}}),
        "not a record",
    ]
    (tmp_path / "raw.json").write_text("\n".join(lines), encoding="utf-8")
    raw, rejects = readers.read_articles(spark, str(tmp_path / "raw.json"))
    raw = raw.orderBy("id")
    assert [r["value"] for r in rejects.collect()] == ["not a record"]
    assert [r["publish"] for r in raw.collect()] == [datetime.datetime(2031, 9, 5, 6, 7, 8)] * 2
    articles = corpus.assemble_articles(raw).orderBy("id").collect()
    assert [tuple(r) for r in articles] == [(5, "Bees Café k1 k2", "Nha dat"), (6, "Bees Café k1 k2", None)]


def test_article_on_several_lines(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "id": 9,\n "title": "Two lines",\n "publish": ISODate("2031-09-05T06:07:08Z")\n}')
    (tmp_path / "two.json").write_text("{")
    raw, rejects = readers.read_articles(spark, str(tmp_path), layout="files")
    assert [(r["id"], r["title"]) for r in raw.collect()] == [(9, "Two lines")] and rejects.count() == 1


def record_file(layout, n=60):
    """Records with lengths that differ, in one of several layouts; every fifth has no end."""
    texts = []
    for i in range(n):
        record = {"id": i, "title": "Tï {\n{ " + "x" * (i * 7 % 23), "keywords": ["a}", "{b"], "source": "]},"}
        text = json.dumps(record, ensure_ascii=False, indent=1 + i % 3 if layout != "dense" and i % 4 else None)
        texts.append(text[:-1 - i % 2] if i % 5 == 0 and i else text)
    if layout == "array":
        return "[\n" + ",\n".join(texts) + "\n]\n"
    return ("\r\n" if layout == "crlf" else "\n").join(texts) + "\n" * (layout == "crlf")


@pytest.mark.parametrize("layout", ["mixed", "dense", "array", "crlf"])
@pytest.mark.parametrize("size", [1 << 20, 701, 97, 64, 31])
def test_records_are_cut_alike_by_any_split(spark, tmp_path, layout, size):
    """Whatever byte ranges the tasks get, each record is read once and no unfinished one is taken."""
    text = record_file(layout)
    (tmp_path / "big.json").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        raw, rejects = readers.read_articles(spark, str(tmp_path / "big.json"), layout="records")
        tasks, rows, left = raw.rdd.getNumPartitions(), raw.collect(), rejects.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 1 or size > len(text)
    broken = [i for i in range(1, 60) if i % 5 == 0]
    assert sorted(r.id for r in rows) == sorted(set(range(60)) - set(broken))
    assert len(left) == len(broken) and all(r.value.startswith("{") for r in left)
    for r in rows:
        assert r.title == "Tï {\n{ " + "x" * (r.id * 7 % 23) and r.keywords == ["a}", "{b"] and r.source == "]},"


def test_records_of_an_empty_file(spark, tmp_path):
    (tmp_path / "none.json").write_text("")
    (tmp_path / "blank.json").write_text("\n \n")
    (tmp_path / "junk.json").write_text("no record")
    raw, rejects = readers.read_articles(spark, str(tmp_path), layout="records")
    assert raw.count() == 0 and [r.value for r in rejects.collect()] == ["{no record"]


def test_jsonl_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": 1}\n{"id": \n')
    rows = readers.read_jsonl(spark, str(tmp_path / "x.json"), schemas.PROCESSED_ARTICLE, bad="_bad").collect()
    assert sorted((r["id"], r["_bad"]) for r in rows if r["id"]) == [(1, None)] and [r["_bad"] for r in rows if r["_bad"]] == ['{"id": ']


def test_jsonl_file_count_and_existing_path(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(100).select("id", F.lit("x").alias("processed_content"), F.lit("c").alias("category"))
    sinks.write_jsonl(df, path, n_files=1)
    assert len(data_files(path)) == 1
    assert readers.read_jsonl(spark, path, schemas.PROCESSED_ARTICLE).count() == 100
    with pytest.raises(AnalysisException):
        sinks.write_jsonl(df, path)


def test_config_on_several_lines(spark, tmp_path):
    (tmp_path / "c.json").write_text('{\n "epochs": 5,\n "batch_size": 16,\n "dropout_rate": 0.3\n}')
    row = readers.read_config(spark, str(tmp_path / "c.json"), schemas.BEST_PARAMETERS).first()
    assert (row["epochs"], row["batch_size"], row["dropout_rate"], row["dense_units"]) == (5, 16, 0.3, None)


def test_report_csv_has_label_first(spark, tmp_path):
    report = spark.createDataFrame([(0.1, "a", 0.2, 0.3, 4.0)], "precision double, label string, recall double, f1_score double, support double")
    sinks.write_report_csv(report, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns[0] == "label"
    assert tuple(readers.read_csv_table(spark, str(tmp_path / "r"), schemas.REPORT).first()) == ("a", 0.1, 0.2, 0.3, 4.0)


def test_feature_store_prunes_splits(spark, tmp_path):
    df = spark.range(30).select("id", F.element_at(F.array(*map(F.lit, corpus.SPLITS)), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    sinks.write_features(df, str(tmp_path / "f"))
    train = readers.read_features(spark, str(tmp_path / "f"), "train")
    assert train.count() == 10 and len(train.inputFiles()) > 0
    assert "PartitionFilters: [split" in train._jdf.queryExecution().toString().replace("isnotnull(split#", "split#")


def stub_session(master, folder=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


def test_shared_dir_follows_the_setting():
    assert session.shared_dir(stub_session("yarn", "hdfs://shared/tables/")) == "hdfs://shared/tables"
    local = session.shared_dir(stub_session("local[2]"))
    assert os.path.isdir(local) and session.shared_dir(stub_session("local[2]")) == local
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(stub_session("yarn"))


def test_stream_equals_batch_and_a_rerun_adds_nothing(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "chk"))
    df = spark.range(20).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"))
    df.filter("id < 12").repartition(3).write.json(source)

    def score(batch):
        return batch.select("id", F.length("text").alias("n"))

    def run():
        score_stream(spark, source, df.schema, score, out, checkpoint, file_format="json", files_per_trigger=2)
        return sorted((r["id"], r["n"]) for r in spark.read.parquet(out).collect())

    want = sorted((r["id"], r["n"]) for r in score(df).collect())
    assert run() == want[:12]
    assert run() == want[:12]
    df.filter("id >= 12").write.mode("append").json(source)
    assert run() == want
