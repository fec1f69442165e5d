"""Queries over tabular inputs: dialects, headers, types, ranges, reports and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as tx
from docmill.operators import checks, packing, reports, tabular

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- dialect and header -----------------------------------------------------------------
# A file per nation key modulo 5, in which customers are written with that file's delimiter.
DELIMS = [",", ";", "\t", "|", ":"]
LINES_SQL = """WITH f AS (SELECT c_custkey % 5 AS dataset, c_custkey AS line_no, CASE c_custkey % 5 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) WHEN 3 THEN '|' ELSE ':' END AS d, * FROM customer),
l AS (SELECT dataset, line_no, c_name || d || c_custkey || d || c_mktsegment || CASE WHEN c_custkey % 17 = 0 THEN d || 'x' ELSE '' END || CASE WHEN c_custkey % 11 = 0 THEN ', extra' ELSE '' END AS line FROM f)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    d = F.element_at(F.array(*map(F.lit, DELIMS)), (key % 5 + 1).cast("int"))
    line = F.concat("c_name", d, key.cast("string"), d, "c_mktsegment", F.when(key % 17 == 0, F.concat(d, F.lit("x"))).otherwise(""), F.when(key % 11 == 0, ", extra").otherwise(""))
    return table(spark, sf_dir, "customer").select((key % 5).alias("dataset"), key.alias("line_no"), line.alias("line"))


SCORES_SQL = LINES_SQL + """, o AS (SELECT * FROM (VALUES (',', 0), (';', 1), (chr(9), 2), ('|', 3)) v(delimiter, preference)),
c AS (SELECT dataset, delimiter, preference, line_no, length(line) - length(replace(line, delimiter, '')) AS hits FROM l, o WHERE trim(line) <> ''),
w AS (SELECT dataset, delimiter, preference, hits, count(*) AS n, min(line_no) AS first FROM c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, delimiter ORDER BY (hits = 0), n DESC, first) AS k, sum(n * hits) OVER (PARTITION BY dataset, delimiter) AS total FROM w),
s AS (SELECT dataset, delimiter, preference, CASE WHEN hits > 0 THEN n ELSE 0 END AS frequency, CASE WHEN hits > 0 THEN hits + 1 ELSE 0 END AS width, CASE WHEN hits > 0 THEN total ELSE 0 END AS occurrences FROM r WHERE k = 1)"""


@query(SCORES_SQL + " SELECT dataset, delimiter, preference, CAST(frequency AS BIGINT) AS frequency, CAST(width AS BIGINT) AS width, CAST(occurrences AS BIGINT) AS occurrences FROM s")
def delimiter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.delimiter_scores(_lines(spark, sf_dir))


@query(SCORES_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY frequency DESC, width DESC, occurrences DESC, preference) AS k2 FROM s)
SELECT dataset, CASE WHEN frequency > 0 THEN delimiter ELSE ',' END AS delimiter, CASE WHEN frequency = 0 THEN 'csv_dialect_detection_failed_comma_assumed' END AS warning FROM b WHERE k2 = 1""")
def best_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.best_delimiter(tabular.delimiter_scores(_lines(spark, sf_dir)))


# Files of suppliers: some with a header line, one headed by a number, one by a repeated name, one of a single line.
HEADER_SQL = """WITH s AS (SELECT s_nationkey % 6 AS dataset, s_suppkey + 10 AS row_no, s_name AS a, CASE WHEN s_nationkey % 6 = 2 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END AS b FROM supplier),
h AS (SELECT * FROM (VALUES (0, 'name', 'key'), (1, 'name', '12'), (2, 'Name', 'name'), (3, 'name', ''), (4, 'a', 'A'), (5, 'b', 'c'), (6, 'only', 'one')) v(dataset, a, b)),
u AS (SELECT dataset, row_no, a, b, false AS head FROM s UNION ALL SELECT dataset, 0, a, b, true FROM h)
SELECT dataset, CASE WHEN count(*) < 2 THEN true WHEN dataset IN (1, 3) THEN false WHEN bool_or(NOT head AND regexp_matches(b, '^[0-9]+$')) THEN true ELSE max(CASE WHEN head THEN lower(a) END) <> max(CASE WHEN head THEN lower(b) END) END AS has_header,
 CASE WHEN count(*) < 2 THEN 'csv_header_detection_insufficient_rows_first_row_assumed' END AS warning FROM u GROUP BY dataset"""


@query(HEADER_SQL)
def header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.col("s_nationkey") % 6
    body = table(spark, sf_dir, "supplier").select(group.alias("dataset"), (F.col("s_suppkey") + 10).alias("row_no"), F.concat("s_name", F.lit(";"), F.when(group == 2, F.col("s_name")).otherwise(F.col("s_suppkey").cast("string"))).alias("line"))
    heads = ["name;key", "name;12", "Name;name", "name;", "a;A", "b;c", "only;one"]
    first = spark.createDataFrame([(i, 0, h) for i, h in enumerate(heads)], "dataset int, row_no bigint, line string")
    return tabular.has_header(tabular.cells(first.union(body), ";"))


# -- cells ------------------------------------------------------------------------------
# Values of many kinds in one column a modulus: (events)
CELL_SQL = """SELECT event_id, CASE event_id % 16 WHEN 0 THEN 'sim' WHEN 1 THEN 'Não' WHEN 2 THEN '00' || event_id WHEN 3 THEN '1,5' WHEN 4 THEN CAST(event_id AS VARCHAR) WHEN 5 THEN '-' || event_id || '.25'
 WHEN 6 THEN '2026-02-' || printf('%02d', event_id % 40) WHEN 7 THEN '2026-01-05T10:' || printf('%02d', event_id % 60) || ':00' WHEN 8 THEN printf('%02d', event_id % 30) || ':15' WHEN 9 THEN '' WHEN 10 THEN '  ' || event_type || '  '
 WHEN 11 THEN '+7' WHEN 12 THEN 'TRUE' WHEN 13 THEN '1e5' WHEN 14 THEN '2026-01-05 99:00' ELSE '007.5' END AS raw, event_id % 7 AS col_no FROM events"""
KIND_SQL = """CASE WHEN v = '' THEN 'empty' WHEN lower(v) IN ('true', 'sim', 'yes', 'false', 'não', 'nao', 'no') THEN 'boolean' WHEN regexp_matches(v, '^[-+]?(0|[1-9][0-9]*)$') THEN 'integer'
 WHEN regexp_matches(v, '^[-+]?[0-9]+[.,][0-9]+$') THEN 'number' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(v AS DATE) IS NOT NULL THEN 'date'
 WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?$') AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL THEN 'datetime' WHEN regexp_matches(v, '^([01][0-9]|2[0-3]):[0-5][0-9]$') THEN 'time' ELSE 'string' END"""


def _cells(spark: SparkSession, sf_dir: str, pick: Column | None = None) -> DataFrame:
    """A cell of each event; ``pick`` is the number of its value, by default the id modulo 16."""
    i = F.col("event_id")
    two = lambda n: F.format_string("%02d", i % n)
    values = [
        F.lit("sim"), F.lit("Não"), F.concat(F.lit("00"), i), F.lit("1,5"), i.cast("string"), F.concat(F.lit("-"), i, F.lit(".25")), F.concat(F.lit("2026-02-"), two(40)),
        F.concat(F.lit("2026-01-05T10:"), two(60), F.lit(":00")), F.concat(two(30), F.lit(":15")), F.lit(""), F.concat(F.lit("  "), "event_type", F.lit("  ")),
        F.lit("+7"), F.lit("TRUE"), F.lit("1e5"), F.lit("2026-01-05 99:00"), F.lit("007.5"),
    ]
    raw = F.element_at(F.array(*values), ((i % 16 if pick is None else pick) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.lit("events").alias("dataset"), i.alias("row_no"), (i % 7).alias("col_no"), raw.alias("raw"))


@query(f"""WITH c AS ({CELL_SQL}), k AS (SELECT event_id, trim(raw) AS v, {KIND_SQL} AS kind FROM (SELECT *, trim(raw) AS v FROM c))
SELECT event_id, kind, CASE kind WHEN 'empty' THEN NULL WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 'sim', 'yes') THEN 'true' ELSE 'false' END WHEN 'integer' THEN replace(v, '+', '')
 WHEN 'number' THEN CAST(CAST(replace(v, ',', '.') AS DOUBLE) AS VARCHAR) ELSE '"' || v || '"' END AS json FROM k""")
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.typed_cells(_cells(spark, sf_dir)).select(F.col("row_no").alias("event_id"), "kind", "json")


TYPE_SQL = """CASE WHEN ks IS NULL OR len(ks) = 0 THEN 'empty' WHEN ks = ['integer', 'number'] THEN 'number' WHEN ks = ['date', 'datetime'] THEN 'datetime' WHEN len(ks) = 1 THEN ks[1] WHEN list_contains(ks, 'string') THEN 'string' ELSE 'mixed' END"""


# A mixture of kinds a column, over all events: each takes its column's next value.
MIXTURES = [(4, 5, 9), (4, 9), (6, 7), (0, 4), (9,), tuple(range(16)), (0, 1)]
PICK_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {col} THEN {list(ks)}[event_id // 7 % {len(ks)} + 1]" for col, ks in enumerate(MIXTURES)) + " END"
LATTICE_SQL = f"""WITH c AS (SELECT event_id, col_no, trim(raw) AS v FROM ({CELL_SQL.replace("CASE event_id % 16", f"CASE {PICK_SQL}")})),
k AS (SELECT col_no, {KIND_SQL} AS kind FROM c), g AS (SELECT col_no, count(*) AS rows, bool_or(kind = 'empty') AS nullable, list_sort(list(DISTINCT kind) FILTER (kind <> 'empty')) AS ks FROM k GROUP BY col_no)"""


def _mixed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, pick = F.col("event_id"), F.lit(None)
    for col, ks in enumerate(MIXTURES):
        pick = F.when(i % 7 == col, F.element_at(F.array(*map(F.lit, ks)), (F.floor(i / 7) % len(ks) + 1).cast("int"))).otherwise(pick)
    return _cells(spark, sf_dir, pick)


@query(LATTICE_SQL + f" SELECT col_no, {TYPE_SQL} AS inferred_type, nullable, rows FROM g")
def column_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.column_types(tabular.typed_cells(_mixed_cells(spark, sf_dir))).select("col_no", "inferred_type", "nullable", "rows")


@query(LATTICE_SQL + f""", t AS (SELECT col_no, {TYPE_SQL} AS ty FROM g), q AS (SELECT c.col_no, {KIND_SQL} AS kind FROM c)
SELECT q.col_no, CASE WHEN ty = 'string' AND kind <> 'empty' THEN 'string' ELSE kind END AS kind, count(*) AS n FROM q JOIN t USING (col_no) GROUP BY ALL""")
def demoted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.demoted(tabular.typed_cells(_mixed_cells(spark, sf_dir))).groupBy("col_no", "kind").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT CAST(p_size AS BIGINT) AS dataset, p_partkey AS col_no, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN 'Código é ' || (p_partkey % 3) WHEN 2 THEN '' ELSE p_type END AS source_name FROM part),
b AS (SELECT *, trim(lower(regexp_replace(strip_accents(source_name), '[^a-zA-Z0-9]+', '_', 'g')), '_') AS base FROM h), c AS (SELECT dataset, col_no, source_name, CASE WHEN base = '' THEN 'coluna_' || col_no ELSE base END AS base FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset, base ORDER BY col_no) AS k FROM c) SELECT dataset, col_no, source_name, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM n""")
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.col("p_brand")).when(k % 5 == 1, F.concat(F.lit("Código é "), k % 3)).when(k % 5 == 2, "").otherwise(F.col("p_type"))
    return tabular.named_columns(table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("dataset"), k.alias("col_no"), name.alias("source_name")))


@query("""WITH r AS (SELECT o_orderpriority AS dataset, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT dataset, (rn - 1) // 1000 + 1 AS segment, min(rn) AS row_start, max(rn) AS row_end, any_value(n) AS total_rows FROM r GROUP BY dataset, (rn - 1) // 1000""")
def row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.row_ranges(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 1000)


@query("""WITH l AS (SELECT doc_id AS dataset, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT dataset, len(string_split(line, ',')) AS n, len(list_filter(string_split(line, ','), lambda x: trim(x) <> '')) > 0 AS filled FROM l),
m AS (SELECT dataset, max(n) FILTER (filled) AS w FROM s GROUP BY dataset)
SELECT s.dataset, CAST(coalesce(any_value(w), 0) AS INTEGER) AS width, count(*) FILTER (filled AND n <> w) AS ragged, count(*) FILTER (NOT filled) AS blank, count(*) FILTER (filled) AS rows FROM s JOIN m USING (dataset) GROUP BY s.dataset""")
def ragged_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dataset"), F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    return tabular.shape(rows, ",")


@query("""SELECT doc_id, sha256(array_to_string(list_transform(range(1, CASE WHEN doc_id % 2 = 0 THEN 7 ELSE 4 END), lambda i: coalesce(string_split(text, ',')[i], '')), chr(31))) AS cells_sha256 FROM documents""")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("doc_id") % 2 == 0, 6).otherwise(3)
    cells = tabular.padded(F.split("text", ","), width)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(cells, "\x1f"), 256).alias("cells_sha256"))


@query("""SELECT n_regionkey AS dataset, '{"source":"nation' || n_regionkey || '.csv","rows":{"start":1,"end":' || count(*) || ',"total":' || count(*) || '},"columns":["Key","name"],"data":[' || string_agg('[' || n_nationkey || ',"' || n_name || '"]', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation GROUP BY n_regionkey""")
def compact_tabular_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('"]'))
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("dataset")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("j")))).alias("r"))
    columns = F.array(F.struct(F.lit("Key").alias("source_name"), F.lit("key").alias("name")), F.struct(F.lit("").alias("source_name"), F.lit("name").alias("name")))
    made = packing.compact_tabular(F.concat(F.lit("nation"), "dataset", F.lit(".csv")), F.lit(1), F.size("r"), F.size("r"), columns, F.transform("r", lambda x: x["j"]))
    return rows.select("dataset", made.alias("json"))


# -- joins of the spreadsheet reader ----------------------------------------------------
@query("""WITH f AS (SELECT l_orderkey % 50 AS sheet, row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey, l_linenumber) AS row_no, l_linenumber FROM lineitem)
SELECT sheet, (row_no - 1) // 100 AS segment, count(*) AS formulas, CAST(sum(l_linenumber) AS BIGINT) AS total FROM f WHERE l_linenumber = 2 GROUP BY ALL""")
def formula_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas by the segment whose row range holds them: the range join as an equi-join on the segment number."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("dataset"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_linenumber")
    rows = packing.numbered_rows(items)
    segment = F.floor((F.col("row_no") - 1) / 100).cast("bigint")
    ranges = rows.groupBy("dataset", segment.alias("segment")).agg(F.min("row_no").alias("row_start"), F.max("row_no").alias("row_end"))
    formulas = rows.where("l_linenumber = 2").withColumn("segment", segment)
    inside = formulas.join(ranges, ["dataset", "segment"]).where("row_no between row_start and row_end")
    return inside.groupBy(F.col("dataset").alias("sheet"), "segment").agg(F.count("*").alias("formulas"), F.sum("l_linenumber").cast("bigint").alias("total"))


@query("""SELECT o_custkey % 100 AS sheet, count(*) AS formulas, count(*) FILTER (o_totalprice < 100000) AS without_cache FROM orders GROUP BY ALL""")
def cached_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula cells with the cached value of the same place (the zip of two loads as an equi-join)."""
    orders = table(spark, sf_dir, "orders")
    formulas = orders.select((F.col("o_custkey") % 100).alias("sheet"), F.col("o_orderkey").alias("row_no"))
    cached = orders.where("o_totalprice >= 100000").select((F.col("o_custkey") % 100).alias("sheet"), F.col("o_orderkey").alias("row_no"), F.col("o_totalprice").alias("value"))
    return formulas.join(cached, ["sheet", "row_no"], "left").groupBy("sheet").agg(F.count("*").alias("formulas"), F.count_if(F.col("value").isNull()).alias("without_cache"))


@query("""SELECT l_suppkey AS sheet, min(l_orderkey) FILTER (l_discount > 0) AS first_row, max(l_orderkey) FILTER (l_discount > 0) AS last_row, min(l_linenumber) FILTER (l_discount > 0) AS first_col, max(l_linenumber) FILTER (l_discount > 0) AS last_col,
 count(*) FILTER (l_discount > 0) AS filled, count(*) AS cells FROM lineitem GROUP BY l_suppkey""")
def used_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of a sheet's filled cells, among all its cells."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_orderkey").alias("row_no"), F.col("l_linenumber").alias("col_no"), (F.col("l_discount") > 0).alias("filled"))
    return tabular.used_range(cells, "sheet")


# -- reports ----------------------------------------------------------------------------
@query("""WITH r AS (SELECT source, lang, count(*) AS converted, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (n_chars > 20000) AS oversized, count(*) FILTER (toxic = 1) AS warned FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT source, lang, converted, failed, oversized, warned,
 CASE WHEN failed + oversized > 0 THEN 'success_with_warnings' ELSE 'success' END AS email_status,
 CASE WHEN failed + oversized + warned > 0 THEN 'success_with_warnings' ELSE 'success' END AS document_status,
 CASE WHEN converted - failed = 0 AND failed > 0 THEN 'failure' WHEN failed + warned + oversized > 0 THEN 'success_with_warnings' ELSE 'success' END AS tabular_status FROM r""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, sf_dir, "labels")
    counts = docs.join(labels, "doc_id", "left").groupBy("source", "lang").agg(
        F.count("*").alias("converted"), F.count_if(F.col("quality") == 0).alias("failed"), F.count_if(F.col("n_chars") > 20000).alias("oversized"), F.count_if(F.col("toxic") == 1).alias("warned")
    )
    c, none = F.col, F.lit(0)
    return counts.select(
        "*", reports.status("email", c("converted"), c("failed"), none, c("oversized"), c("warned")).alias("email_status"),
        reports.status("document", c("converted"), c("failed"), none, c("oversized"), c("warned")).alias("document_status"),
        reports.status("tabular", c("converted") - c("failed"), c("failed"), none, c("oversized"), c("warned")).alias("tabular_status"),
    )


@query("""SELECT d.source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters, CAST(max(n_chars) AS BIGINT) AS longest, count(*) FILTER (quality = 1) AS good, count(*) FILTER (trim(text) <> '') AS with_text,
 array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.source""")
def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", (tx.stripped(F.col("text")) != "").alias("filled"))
    joined = rows.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.max("n_chars").alias("longest"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if("filled").alias("with_text"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"),
    )


@query("""WITH s AS (SELECT o_custkey AS key, o_orderkey AS ord, o_totalprice > 200000 AS oversized FROM orders)
SELECT key, count(*) AS segments, min(ord) AS total_rows, count(*) FILTER (oversized) AS oversized, count(*) > 1 AS segmented FROM s GROUP BY key""")
def dataset_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("total_rows"), (F.col("o_totalprice") > 200000).alias("oversized"))
    return reports.catalogue(segments)


@query("""SELECT o_orderpriority AS key, array_to_string(list_sort(list(DISTINCT w)), ',') AS warnings FROM (SELECT o_orderpriority, 'encoding_low_confidence' AS w FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderpriority, 'csv_ragged_rows_normalized:' || (o_orderkey % 3) FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1""")
def warning_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    each = F.array_compact(F.array(F.when(k % 7 == 0, "encoding_low_confidence"), F.when(k % 5 == 0, F.concat(F.lit("csv_ragged_rows_normalized:"), k % 3))))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.explode(each).alias("w"))
    return rows.groupBy("key").agg(F.array_join(reports.union_of(F.array(F.collect_set("w"))), ",").alias("warnings"))


@query("""SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' bytes' WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0) WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824.0) ELSE printf('%.2f TB', b / 1099511627776.0) END AS size,
 CASE WHEN o_orderkey % 500 >= 60 THEN (o_orderkey % 500) // 60 || ' min ' || printf('%02d', o_orderkey % 500 % 60) || ' s' ELSE (o_orderkey % 500) || ' s' END AS duration
 FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 1024 WHEN 1 THEN o_orderkey * 512 WHEN 2 THEN o_orderkey * 65536 WHEN 3 THEN o_orderkey * 67108864 ELSE o_orderkey * 68719476736 END AS b FROM orders)""")
def human_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    size = F.when(k % 5 == 0, k % 1024).when(k % 5 == 1, k * 512).when(k % 5 == 2, k * 65536).when(k % 5 == 3, k * 67108864).otherwise(k * 68719476736)
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.human_size(size).alias("size"), tx.human_duration((k % 500).cast("double")).alias("duration"))


@query("""WITH c AS (SELECT o_orderpriority AS dataset, o_orderkey AS idx, CASE WHEN o_orderkey % 13 = 0 THEN 'Name' WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'c' || o_orderkey END AS name FROM orders)
SELECT dataset, bool_and(idx >= 1) AS index_ok, bool_and(trim(name) <> '') AS name_ok, count(DISTINCT lower(name)) = count(*) AS unique_ok FROM c GROUP BY dataset""")
def column_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.when(k % 13 == 0, "Name").when(k % 17 == 0, " ").otherwise(F.concat(F.lit("c"), k))
    return checks.columns(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), k.alias("idx"), name.alias("name")))


@query("""WITH s AS (SELECT o_custkey AS dataset, o_orderkey AS row_start, o_orderkey + o_custkey % 3 AS row_end, o_custkey % 2 + 2 AS n, o_orderkey + 1 AS total FROM orders)
SELECT dataset, count(*) FILTER (NOT (row_end = row_start + n - 1 AND row_end <= total)) AS broken FROM s GROUP BY dataset""")
def range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(c.alias("dataset"), k.alias("row_start"), (k + c % 3).alias("row_end"), (c % 2 + 2).alias("n"), (k + 1).alias("total"))
    return rows.groupBy("dataset").agg(F.count_if(~checks.range_ok(F.col("row_start"), F.col("row_end"), F.col("n"), F.col("total"))).alias("broken"))


@query("""SELECT n_regionkey AS sheet, bool_and(trim(n_name) <> '') AND count(DISTINCT lower(n_name)) = count(*) AS looks_like_header FROM nation GROUP BY n_regionkey""")
def sheet_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("sheet")).agg(F.collect_list("n_name").alias("cells"))
    return rows.select("sheet", checks.looks_like_header(F.col("cells")).alias("looks_like_header"))


