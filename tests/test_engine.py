"""Conversions end to end, packing, streaming and the registry."""

import json
import random
import threading
from datetime import datetime
from pathlib import Path

import fixtures
import pytest
from pyspark.sql import functions as F

from docmill import cli, engine
from docmill.cancellation import Cancellation
from docmill.operators import blocks, packing
from docmill.sinks import parts
from docmill.streaming import landing


def run(spark, path, out, **settings):
    report = engine.convert(spark, str(path), str(out), engine.Settings(**settings))
    files = {p.name: p.read_text() for p in (out / "PRONTO_PARA_IA").iterdir()}
    assert not [p for p in out.rglob(".*") if not p.name.endswith(".crc")]
    assert json.loads((out / "relatorio_conversao.json").read_text())["result"] == report["result"]
    assert {p["file"] for p in report["parts"]} == set(files)
    for p in report["parts"]:
        assert p["size_bytes"] == len(files[p["file"]].encode())
    return report, files


@pytest.mark.parametrize("profile", ["platform", "api"])
def test_mailbox(spark, tmp_path, profile):
    (tmp_path / "a.mbox").write_bytes(fixtures.MBOX)
    report, files = run(spark, tmp_path / "a.mbox", tmp_path / "out", profile=profile)
    assert report["counts"] == {"messages": 3, "converted": 3, "failed": 0, "segmented": 0, "oversized": 0, "attachments": 1} and report["result"] == "success"
    (body,) = files.values()
    records = json.loads(body) if profile == "platform" else [json.loads(x) for x in body.splitlines()]
    assert [r["subject"] for r in records] == ["Sø og vind", None, "two"] and "message_id" not in records[0] and records[2]["attachments"] == [{"file_name": "a.pdf", "media_type": "application/pdf"}]
    with pytest.raises(FileExistsError):
        engine.convert(spark, str(tmp_path / "a.mbox"), str(tmp_path / "out"))


def test_oversized_messages_are_cut(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(b"From x\nFrom: a@b.c\nSubject: s\nMessage-ID: <1@x>\n\n" + b"line of text\n" * 300)
    report, files = run(spark, tmp_path / "a.mbox", tmp_path / "out", max_mib=1500 / (1 << 20), max_tokens=750, profile="api")
    records = [json.loads(x) for name in sorted(files) for x in files[name].splitlines()]
    assert report["counts"]["segmented"] == 1 and report["warnings"] == ["oversized_message_segmented"] and report["result"] == "success_with_warnings" and len(records) > 1
    assert "".join(r["body"] for r in records) == "line of text\n" * 300
    assert [r["segment"] for r in records] == [f"{i}/{len(records)}" for i in range(1, len(records) + 1)]
    assert all(len(t.encode()) <= 1500 for t in files.values())


def test_messages_that_no_cut_helps_are_flagged(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(b"From x\nFrom: a@b.c\nSubject: " + b"s" * 3000 + b"\nMessage-ID: <1@x>\n\nbody\n")
    report, _ = run(spark, tmp_path / "a.mbox", tmp_path / "out", max_mib=1500 / (1 << 20), max_tokens=750, profile="api")
    assert report["counts"]["oversized"] == 1 and report["counts"]["segmented"] == 0 and "record_exceeds_partition_limits" in report["warnings"] and report["result"] == "success_with_warnings"


def test_every_error_is_reported(spark, tmp_path, monkeypatch):
    (tmp_path / "a.mbox").write_bytes(b"".join(b"From x\nMessage-ID: <%d@x>\nContent-Type: text/plain; charset=a\0b\n\nb\n" % i for i in range(1100)) + b"From x\nSubject: ok\n\nb\n")
    report = engine.convert(spark, str(tmp_path / "a.mbox"), str(tmp_path / "out"))
    assert len(report["errors"]) == report["counts"]["failed"] == 1100
    monkeypatch.setattr(cli, "convert", lambda *a, **k: report)
    assert cli.main([str(tmp_path / "a.mbox"), "--output", str(tmp_path / "other")]) == 2


def test_earlier_conversions_and_folder_names(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a;b\n1;2\n")
    first = engine.convert(spark, str(tmp_path / "d.csv"), str(tmp_path / "one"))
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "relatorio_conversao.json").write_text("{not json")
    (tmp_path / "one" / "deep").mkdir()
    (tmp_path / "one" / "deep" / "relatorio_conversao.json").write_text('{"sources": [{"file_name": "d.csv", "size_bytes": 8}]}')
    again = engine.convert(spark, str(tmp_path / "d.csv"), str(tmp_path / "two"))
    assert first["possible_duplicates"] == [] and again["possible_duplicates"] == ["one"]
    assert engine.convert(spark, str(tmp_path / "d.csv"), str(tmp_path / "three"))["possible_duplicates"] == ["one", "two"]
    at = datetime(2031, 5, 6, 7, 8, 9)
    names = []
    for _ in range(3):
        names.append(parts.fresh_folder(spark, "/x/Über Größe (1).csv", str(tmp_path / "auto"), at))
        Path(names[-1]).mkdir(parents=True)
    assert [n.rsplit("/", 1)[-1] for n in names] == ["uber_groe_1__20310506_070809", "uber_groe_1__20310506_070809__02", "uber_groe_1__20310506_070809__03"]


def test_cancelled_conversions_keep_complete_parts(spark, tmp_path, monkeypatch):
    (tmp_path / "d.csv").write_text("a;b\n1;2\n")
    stop = Cancellation(spark)

    def slow(spark, path, ready, settings):
        parts.write(spark.createDataFrame([("dados_parte_0001.json", "[]")], "file string, content string"), ready)
        threading.Timer(1.0, stop.cancel).start()
        spark.range(8, numPartitions=8).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L)").collect()
        raise AssertionError("not stopped")

    monkeypatch.setitem(engine.CONVERTERS, "tabular_dataset", slow)
    report = engine.convert(spark, str(tmp_path / "d.csv"), str(tmp_path / "out"), cancellation=stop)
    assert report["result"] == "cancelled" and [p["file"] for p in report["parts"]] == ["dados_parte_0001.json"]
    early = Cancellation(spark)
    early.cancel()
    assert engine.convert(spark, str(tmp_path / "d.csv"), str(tmp_path / "early"), cancellation=early)["parts"] == []
    monkeypatch.setattr(cli, "convert", lambda *a, **k: report)
    assert cli.main([str(tmp_path / "d.csv"), "--output", str(tmp_path / "x")]) == 130


def test_outlines_of_any_depth(spark):
    nodes = spark.createDataFrame([("a", i, i - 1 if i > 1 else None) for i in range(1, 41)] + [("a", 99, 98)], "doc string, node int, parent int")
    assert {r.node: r.depth for r in blocks.outline_depths(nodes).collect()} == {i: i for i in range(1, 41)}


def test_tables_texts_and_documents(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id;nome\n001;Ana\n002;Bia\n")
    report, files = run(spark, tmp_path / "t.csv", tmp_path / "o1")
    assert json.loads(files["dados_parte_0001.json"]) == [{"source": "t.csv", "rows": {"start": 1, "end": 2, "total": 2}, "columns": ["id", "nome"], "data": [["001", "Ana"], ["002", "Bia"]]}]
    (tmp_path / "d.txt").write_text("TÍTULO AQUI\n\n" + "palavra " * 300 + "\nfim\n")
    report, files = run(spark, tmp_path / "d.txt", tmp_path / "o2", max_mib=900 / (1 << 20), max_tokens=450)
    assert len(files) > 1 and report["result"] == "success_with_warnings" and all(len(t.encode()) <= 900 for t in files.values())
    assert files["documento_parte_0001.md"].startswith("> Fonte: d.txt — parte 1/") and "# TÍTULO AQUI" in files["documento_parte_0001.md"]
    fixtures.workbook(str(tmp_path / "v.xlsx"))
    report, files = run(spark, tmp_path / "v.xlsx", tmp_path / "o3")
    records = json.loads(files["dados_parte_0001.json"])
    assert records[0]["sheet"] == "Vendas" and records[0]["formulas"][0] == {"cell": "C2", "formula": "=B2*2"} and report["counts"]["sheets"] == 3
    fixtures.word(str(tmp_path / "w.docx"))
    report, files = run(spark, tmp_path / "w.docx", tmp_path / "o4")
    assert "## Parte" in files["documento_parte_0001.md"] and report["counts"]["tables"] == 2
    fixtures.pdf(str(tmp_path / "p.pdf"))
    report, files = run(spark, tmp_path / "p.pdf", tmp_path / "o5")
    assert "> Páginas 1–3; 1 imagem(ns) não extraída(s); 1 arquivo(s) incorporado(s) não extraído(s)." in files["documento_parte_0001.md"]
    fixtures.pdf(str(tmp_path / "x.pdf"), encrypted=True)
    report = engine.convert(spark, str(tmp_path / "x.pdf"), str(tmp_path / "o6"))
    assert report["result"] == "failure" and report["errors"][0]["error"] == "PdfReadError" and report["parts"] == []


def test_registry():
    assert engine.resolve("/a/B.MARKDOWN") == "text_document"
    for bad in ("/a/b.zip", "/a/b"):
        with pytest.raises(engine.UnknownFormat):
            engine.resolve(bad)
    before = dict(engine.SUFFIXES)
    with pytest.raises(ValueError):
        engine.register("other", ["new", "csv"], lambda *a: {})
    assert engine.SUFFIXES == before
    for bad in ({"max_mib": 0}, {"max_tokens": -1}, {"profile": "x"}):
        with pytest.raises(ValueError):
            engine.Settings(**bad)


def plain_parts(sizes, limit):
    out, held, part = [], 0, 0
    for s in sizes:
        if part == 0 or held + s > limit:
            held, part = 0, part + 1
        held += s
        out.append(part)
    return out


def test_summaries_compose():
    import numpy as np

    rng = random.Random(3)
    for _ in range(500):
        limit = rng.randint(5, 60)
        sizes = np.array([rng.choice([rng.randint(1, 10), rng.randint(1, 80)]) for _ in range(rng.randint(1, 30))])
        steps = packing.summary(sizes, limit)
        for held in [1 << 61] + [rng.randint(0, 100) for _ in range(5)]:
            now, opened = held, 0
            for s in sizes:
                now, opened = (s, opened + 1) if now + s > limit else (now + s, opened)
            _, leaves, opens = steps[int(np.searchsorted([m for m, *_ in steps], held))]
            assert (held + int(sizes.sum()) if leaves < 0 else leaves, opens) == (now, opened)


def test_packing_over_many_partitions(spark):
    rng = random.Random(4)
    rows = [("a", i, rng.randint(1, 50)) for i in range(1500)] + [("b", i, rng.choice([3, 500])) for i in range(40)] + [("c", 0, 900)]
    frame = spark.createDataFrame(rows, "source string, ord long, bytes long").repartition(7)
    got = {(r.source, r.ord): r.part for r in packing.packed(frame, 200, 100, "source", "ord", "bytes").collect()}
    for name in "abc":
        mine = [(o, b) for s, o, b in rows if s == name]
        assert [got[name, o] for o, _ in mine] == plain_parts([b + 1 for _, b in mine], 200)


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Olá mundo​")
    stream = landing.texts(spark, str(tmp_path / "in"))
    for name, text in ((None, None), ("b.md", "# x")):
        if name:
            (tmp_path / "in" / name).write_text(text)
        landing.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    rows = {r.file_name: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {"a.txt": "Olá mundo", "b.md": "# x"}


def test_part_files_are_renamed_on_commit(spark, tmp_path):
    rows = spark.range(5).select(F.format_string("f_%d.txt", "id").alias("file"), F.col("id").cast("string").alias("content"))
    ready = parts.prepare(str(tmp_path / "x"))
    parts.write(rows, ready)
    assert sorted(p.name for p in (tmp_path / "x" / "PRONTO_PARA_IA").iterdir()) == [f"f_{i}.txt" for i in range(5)]
