"""The pipeline's stages against plain versions of their decisions."""

import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from docmill.llm import decontaminate, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made(tmp_path, spark):
    rng = random.Random(8)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100 % 6]}" for i in range(600)]
    clean = [" ".join(rng.choices(words, k=60)) for _ in range(120)]
    item = " ".join(rng.choices(words, k=20))
    texts = [*clean, clean[0], clean[1] + " tail", "123 456", None, "", clean[2] + " " + item]
    shouted = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=60)) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*texts, *shouted])]
    labels = [(i, int(i < len(texts)), 0) for i, t in enumerate([*texts, *shouted]) if t and i not in range(120, 126)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, item


def test_pipeline_keeps_clean_documents_and_drops_the_planted(spark, tmp_path):
    rows, item = made(tmp_path, spark)
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t, *_ in rows}
    lettered = [i for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    good = [i for i in lettered if i < 126]
    first = [i for i in good if not any((fps[i] ^ fps[j]).bit_count() <= 4 for j in good if j < i)]
    bench = [decontaminate.words_of(item.encode())]
    want = set()
    for i in first:
        words = decontaminate.words_of(rows[i][1].encode())
        at, _ = decontaminate.brute_force(words, bench)
        if not (at and 20 * len(at) >= len(words)):
            want.add(i)
    assert got == want and 125 not in got and 120 not in got


def test_repeated_ids_extra_columns_and_empty_tables(spark, tmp_path):
    rows, item = made(tmp_path, spark)
    clash = spark.createDataFrame([(i, t, x, s, n, "c", 0.5, 1) for i, t, x, s, n in [*rows, rows[3], (3, rows[4][1] + " more words here", "en", "s", 1), (None, rows[5][1].replace("w", "v"), None, None, None)]], COLUMNS + ", fp string, score double, row_ int")
    other = tmp_path / "clash"
    clash.write.parquet(f"{other}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").withColumn("text_", F.lit("c")).write.parquet(f"{other}/{t}.parquet")
    plain = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(other)).collect()))
    assert not plain - got and sum((got - plain).values()) <= 2 and any(k[0] is None for k in got)
    none = tmp_path / "none"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(none)).collect() == []


def test_stages_leave_only_the_last_table(spark, tmp_path):
    made(tmp_path, spark)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "docmill"
    before = set(folder.glob("*")) if folder.exists() else set()
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before] == ["stage-decontamination"]


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    made(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes


def test_near_dedup_keeps_one_row_a_group_whatever_the_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e, f = (" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(6))
    # null ids with texts of their own, a null-id copy of a document, an id with two texts, a repeated row
    rows = [(None, a), (None, b), (1, c), (None, c), (2, d), (2, e), (3, f), (3, f), (4, a + " z"), (5, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    near = lambda s, t: (simhash.fingerprint(s.encode()) ^ simhash.fingerprint(t.encode())).bit_count() <= 4
    assert not any(near(s, t) for x, s in enumerate((a, b, c, d, e, f)) for t in (a, b, c, d, e, f)[:x])
    got = sorted(map(repr, ((r.doc_id, r.text) for r in corpus_pipeline.deduplicated(spark, docs, "").collect())))
    first = [(4, a + " z")] if near(a, a + " z") else [(None, a), (4, a + " z")]
    assert got == sorted(map(repr, [*first, (None, b), (1, c), (2, d), (2, e), (3, f)]))
