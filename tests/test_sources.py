import os
import tempfile
import uuid

import pandas as pd
import pytest

from verdin.session import scratch_table_path
from verdin.sources import tabular


def test_cp1251_semicolon_csv(spark):
    d = tempfile.mkdtemp(prefix="verdin-test-", dir="/tmp")
    pd.DataFrame({"Час": range(10), "Температура": [1.5] * 10, "Потребление": [float(i) for i in range(10)]}) \
        .to_csv(os.path.join(d, "energy.csv"), sep=";", index=False, encoding="cp1251")
    probe = tabular.probe_csv(spark, d).first()
    assert probe["encoding"] == "cp1251" and probe["sep"] == ";"
    assert probe["header"] == "Час;Температура;Потребление" and not probe["multiline"]
    df = tabular.read_tabular(spark, os.path.join(d, "energy.csv"))
    assert df.columns == ["Час", "Температура", "Потребление"] and df.count() == 10


def test_normalize_and_records(spark):
    df = spark.createDataFrame([(" a ", None, 1), (None, None, None)], "`﻿ x ` string, empty string, `   ` int")
    out = tabular.normalize_frame(df)
    assert out.columns == ["x", "column_2"] and out.count() == 1
    with pytest.raises(ValueError):
        tabular.frame_from_records(spark, [])
    assert tabular.frame_from_records(spark, [{"a": 1}]).count() == 1


def test_snapshot_roundtrip_and_delete(spark):
    root = scratch_table_path(spark, f"snap-{uuid.uuid4().hex[:8]}")
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "feature long, target double")
    tabular.save_dataset(df, root, "p1", "v1")
    back = tabular.load_dataset(spark, root, "p1", "v1")
    assert sorted(back.collect()) == sorted(df.collect())
    assert tabular.delete_path(spark, tabular.dataset_path(root, "p1"))
    js = tabular.json_safe(spark.createDataFrame([(float("nan"),)], "x double")).first()["record"]
    assert js == "{}"


def _folder(**files):
    d = tempfile.mkdtemp(prefix="verdin-test-", dir="/tmp")
    for name, content in files.items():
        with open(os.path.join(d, f"{name.replace('__', '-')}.csv"), "wb") as fh:
            fh.write(content)
    return d


def test_files_of_one_delimiter_keep_their_own_headers(spark):
    days = [f"2024-01-0{k} 00:00:00" for k in range(1, 7)]
    d = _folder(part__a="\n".join(["ts,load,temp", *[f"{t},{100 + k},{k}" for k, t in enumerate(days)]]).encode(),
                part__b="\n".join(["cloud,ts,wind", *[f"{7 + k},{t},3" for k, t in enumerate(days)]]).encode())
    raw = tabular.read_csv_collection(spark, d, infer=False).collect()
    assert sorted(r["load"] for r in raw if r["_source"] == "part-a.csv") == [str(100 + k) for k in range(6)]
    assert sorted(int(r["cloud"]) for r in raw if r["_source"] == "part-b.csv") == list(range(7, 13))
    assert all(r["ts"] in days for r in raw)
    merged = tabular.ingest(spark, d, target="load").orderBy("load").collect()
    assert [(r["load"], r["cloud"], r["wind"]) for r in merged] == [(100 + k, 7 + k, 3) for k in range(6)]


def test_encoding_from_the_whole_file_and_quoted_fields(spark):
    late = b"a;b\n" + b"1;plain\n" * 5000 + "2;поздно\n".encode("cp1251")
    d = _folder(late=late)
    assert tabular.probe_csv(spark, d).first()["encoding"] == "cp1251"
    assert [r["b"] for r in tabular.read_csv_collection(spark, d).filter("a = 2").collect()] == ["поздно"]
    d = _folder(quoted=b'a,b\n1,"line one\nline ""two"""\n2,x\n')
    got = tabular.read_csv_collection(spark, d).orderBy("a").collect()
    assert [r["b"] for r in got] == ['line one\nline "two"', "x"]


def test_snapshots_of_two_schemas_live_together(spark):
    root = scratch_table_path(spark, f"snap-{uuid.uuid4().hex[:8]}")
    tabular.save_dataset(spark.createDataFrame([(1, 2.0)], "a long, b double"), root, "p1", "v1")
    tabular.save_dataset(spark.createDataFrame([("x",)], "c string"), root, "p2", "v1")
    assert tabular.load_dataset(spark, root, "p2", "v1").collect() == [("x",)]
    assert tabular.load_dataset(spark, root, "p1", "v1").collect() == [(1, 2.0)]


def test_rows_without_an_order_key_are_staged(spark):
    from verdin.streaming.streams import stage_ordered_files
    rows = spark.createDataFrame([(i if i % 5 else None, i) for i in range(100)], "k long, v long")
    path = stage_ordered_files(rows, scratch_table_path(spark, f"slices-{uuid.uuid4().hex[:8]}"), "k")
    assert spark.read.parquet(path).count() == 100


def test_probe_reads_files_in_splits(spark):
    d = _folder(late=b"a;b\n" + b"1;plain\n" * 3000 + "2;поздно\n".encode("cp1251"), bom="\ufeffa,b\r\n1,é\r\n".encode(), empty=b"",
                quoted=b"a\tb\n" + b"1\tx\n" * 3000 + b'2\t"one\ntwo"\n', undefined=b"a|b\n1|\x98\n2|\xe9\n", open__end="ч,b\n1,й".encode())
    settings = {"spark.sql.sources.binaryFile.maxLength": "16", "spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0",
                "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {os.path.basename(r["path"]): tuple(r)[1:] for r in tabular.probe_csv(spark, d).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {"late.csv": ("cp1251", ";", "a;b", False), "bom.csv": ("utf-8-sig", ",", "a,b", False),
                   "quoted.csv": ("utf-8-sig", "\t", "a\tb", True), "undefined.csv": ("latin-1", "|", "a|b", False), "open-end.csv": ("utf-8-sig", ",", "ч,b", False)}


def test_hourly_sources_are_written_by_many_tasks(spark, monkeypatch):
    from conftest import SF0001
    from verdin.plans import ingest as plans
    parts, read = [], tabular.ingest

    def counted(session, location, **options):
        files = session.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.csv").load(location.rstrip("/*"))
        parts.append(files.select("path").count())
        return read(session, location, **options)

    monkeypatch.setattr(tabular, "ingest", counted)
    want = sorted(map(repr, plans.collection_ingest(spark, SF0001).collect()))
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(map(repr, plans.collection_ingest(spark, SF0001).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want and len(want) > 0 and parts[1] > len(plans._LAYOUT)
