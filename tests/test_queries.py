"""Every registered query against its SQL twin, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators import packing
from docmill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    twin = duck.sql(catalog.ORACLES[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in twin.fetchall())


def test_entities_without_semicolon(spark, tmp_path):
    pages = ["<title>a&amp;&amp</title><style>p{x}</style><p>b", "<title>a&am</title><style>p{x}</style><p>&copy;&lt;", "a &amp b &quot;c&quot; &lt &nosuch; &amp;"]
    spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["html_to_text"](spark, str(tmp_path)).select("page_id", "text_sha256", "n_characters").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLES["html_to_text"]).fetchall())
    whole = spark.createDataFrame([("a &amp b &lt",)], "h string").select(tx.html_text("h"), tx.html_text("h", terminated=True)).first()
    assert tuple(whole) == ("a & b <", "a &amp b &lt")  # mail decodes what HTML decodes


@pytest.fixture(scope="module")
def brim(spark, tmp_path_factory):
    """Documents that are rendered to 2,998 up to 3,002 bytes."""
    folder = str(tmp_path_factory.mktemp("brim"))
    rows = [(k, ("word " * 600)[: n - 12 - len(f"d{k}.txt") - 3] + "end") for k, n in enumerate(range(2998, 3003), 7)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return folder, con


def same_at_the_brim(spark, brim, name):
    folder, con = brim
    twin = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, folder).select(*twin.columns).collect()
    assert sorted(map(tuple, got)) == sorted(twin.fetchall())


def test_routing_at_the_brim(spark, brim):
    same_at_the_brim(spark, brim, "oversize_routing")
    rows = spark.read.parquet(f"{brim[0]}/documents.parquet").withColumn("name", F.concat(F.lit("d"), "doc_id", F.lit(".txt")))
    whole = packing.segments(rows, "doc_id", "text", 3000, 1500, "name").where("segments = 1").collect()
    assert sorted(r.doc_id for r in whole) == [7, 8, 9]  # of their own accord, texts use the limit up


def test_segments_at_the_brim(spark, brim):
    same_at_the_brim(spark, brim, "plain_segments")


def test_segments_fit_and_cover(spark):
    rows = catalog.QUERIES["oversize_segments"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for k, parts in by.items():
        parts.sort(key=lambda r: r.segment)
        assert "".join(texts[k][r.start : r.start + r.length] for r in parts) == texts[k]
        assert all(r.oversized or len(texts[k][r.start : r.start + r.length].encode()) <= 3000 for r in parts)


def test_breaks_use_whole_texts_up(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by = {}
    for r in catalog.QUERIES["preferred_breaks"](spark, FOLDER).collect():
        by.setdefault(r.doc_id, []).append((r.start, r.cut))
    assert any(len(t) > 400 for t in texts.values())
    for k, text in texts.items():
        at = 0
        for start, cut in sorted(by.get(k, [])):
            assert start == at and 0 < cut <= 400
            at += cut
        assert at == len(text)


def test_cells_and_formulas_of_all_rows(spark):
    total = lambda name, column: sum(r[column] for r in catalog.QUERIES[name](spark, FOLDER).collect())
    events, orders = (spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("events", "orders"))
    assert total("column_lattice", "rows") == total("demoted_cells", "n") == events
    assert total("cached_values", "formulas") == orders


def test_structure_of_whole_texts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 6 = 4").collect()}
    ends = {}
    for r in catalog.QUERIES["text_sections"](spark, FOLDER).where("doc_id % 6 = 4").collect():
        ends[r.doc_id] = max(ends.get(r.doc_id, 0), r.end_line)
    assert docs and ends == {k: 3 + len((t.removesuffix("\n") if t else "").split("\n")) if t else 3 for k, t in docs.items()}
