"""URL rules, WARC archives and shards."""

import base64
import gzip
import hashlib
import io
import itertools
import random
import re
import string
import zlib
from collections import Counter

import pytest

from docmill.llm import runtime, sharding, urlfilter, warc
from docmill.llm.runtime import fresh_path

PAGES = "page_id long, url string, html string, rule string, bytes string"


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "nope", "http://com", "http://com/", "http://A.WWW.Example.com/en/x?y", "https://example.com/en", "https://example.com/en/", "https://xexample.com/en/a", "http://x.net#/es/", "://net/fr/",
    "http://com/a://b", "http:///en/", "http://a..com/", "http://www.example.com/es/#x", "http://a.net/fr/é", "http://a.net/es", "http://com:80/", "http://com/", "http://.com/",
]


def test_rules_against_a_plain_reading(spark):
    rows = [(i, u, None, "clash", "c") for i, u in enumerate(URLS)] + [(1, URLS[5], None, "c", "c"), (None, URLS[7], None, "c", "c")]
    got = urlfilter.digest(urlfilter.judged(spark.createDataFrame(rows, PAGES))).collect()
    assert Counter(map(tuple, got)) == Counter((i, *plain_rule(u)) for i, u, *_ in rows)


def test_random_rules_longest_first(spark):
    rng = random.Random(7)
    labels, ways = ["a", "b", "com", "net"], ["", "/", "/x", "/x/", "/long/path", "/y"]
    pick = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    rules = [("a.com", "/", "allow"), ("com", "/longpath/", "block")] + [(pick(), rng.choice(ways), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = ["http://x.a.com/longpath/y"] + [f"http://{pick()}{rng.choice(ways)}{rng.choice(['', '/', 'z?q', '#'])}" for _ in range(300)]
    frame = spark.createDataFrame([(i, u, None, "c", "c") for i, u in enumerate(urls)], PAGES)
    want = Counter()
    last = {(h, p): v for h, p, v in rules}
    for i, u in enumerate(urls):
        host, path, *_ = plain_rule(u)
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in last.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        want[i, host, path, best[2], best[3]] += 1
    assert want[0, "x.a.com", "/longpath/y", "com/longpath/", "block"] == 1
    for part in (None, 20):
        assert Counter(map(tuple, urlfilter.judged(frame, rules, part=part).collect())) == want
    table = spark.createDataFrame([(h, p, v) for (h, p), v in last.items()] + [(None, "/", "block")], "host string, path string, verdict string")
    assert Counter(map(tuple, urlfilter.judged(frame, table).collect())) == want


def test_very_long_hosts(spark):
    urls = ["http://" + "a." * 500_000 + "net/es/x", "http://" + "b" * 1_000_000 + ".com/" + "p" * 100_000, "http://" + "." * 100_000]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judged(spark.createDataFrame([(i, u, None, "c", "c") for i, u in enumerate(urls)], PAGES)).collect()}
    assert got == {0: ("net/es/", "block"), 1: ("com/", "allow"), 2: (None, "allow")}
    assert urlfilter.judged(spark.createDataFrame([(1, "http://a.net/es/", None, "c", "c")], PAGES), []).collect()[0].verdict == "allow"


def test_a_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = keys.where("crc32(key) % 9 = 0")
    made = urlfilter.cascade(listed, keys)
    wrong = keys.withColumn("is", made.holds(keys["key"])).where("`is` <> (crc32(key) % 9 = 0)")
    assert wrong.count() == 0 and len(made.levels) > 1
    assert urlfilter.digest(urlfilter.judged(spark.createDataFrame([], PAGES))).collect() == []


def payloads():
    member = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n").decode("latin-1")
    return ["x" * 10, "x" * 10, None, "", "y\r\n\r\nz", "\x1f\x8b\x08" * 500, "é" * 30_000, "x" * 10, member]


@pytest.mark.parametrize("split", [97, 5000, 1 << 22])
def test_archives_come_back_whatever_the_ranges(spark, split):
    rows = [(i + 1, f"http://h/{i} a\r\nEvil: 1", p, "c", "c") for i, p in enumerate(payloads())] + [(None, None, "x" * 10, "c", "c"), (1, "again", "x" * 10, "c", "c")]
    pages = spark.createDataFrame(rows, PAGES)
    manifest = warc.write(pages, fresh_path(spark, "warc"))
    records = warc.read(manifest, split).collect()
    assert len(records) == len(rows) == sum(r.records for r in manifest.collect())
    body = {r.record_id: bytes(r.payload) for r in records if r.record_type == "response"}
    for i, _, p, *_ in rows:
        own = next(r for r in records if r.record_id == f"{warc.RECORD}{'' if i is None else i}")
        assert (body.get(own.record_id) if own.record_type == "response" else body[own.refers_to]) == (p or "").encode()


def test_digest_rows(spark):
    rows = [(i + 1, "u", p, "c", "c") for i, p in enumerate(payloads())]
    got = warc.round_trip(spark, spark.createDataFrame(rows, PAGES)).collect()
    first = {}
    for i, _, p, *_ in rows:
        first.setdefault(p or "", i)
    want = set()
    for i, _, p, *_ in rows:
        data = (p or "").encode()
        again = first[p or ""] != i
        want.add((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[p or ""] if again else None))
    assert set(map(tuple, got)) == want
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).collect() == []


def test_damage_costs_one_record():
    good = [warc.gzipped(warc.record_of("response", str(i), "d", "u", b"p" * 50, 50, "D", None)) for i in range(3)]
    good[1] = good[1][:30] + b"\x00\x00\x00" + good[1][33:]
    data = b"".join(good)
    found = list(warc.read_range(io.BytesIO(data), len(data), 0, len(data)))
    assert [h["warc-record-id"] for h, _ in found] == [f"<{warc.RECORD}0>", f"<{warc.RECORD}2>"]


@pytest.mark.parametrize("length", [70_000, 1_000_000])
def test_headers_of_any_length(spark, length):
    members = [warc.gzipped(warc.record_of("response", str(i), "d", f"http://h/{i}" + "u" * (length if i == 1 else 0), b"p" * 50, 50, "D", None)) for i in range(3)]
    data = b"".join(members)
    for cut in (1, len(members[0]) - 1, len(members[0]), len(members[0]) + 1, len(members[0]) + len(members[1]), len(data) - 1):
        parts = [list(warc.read_range(io.BytesIO(data), len(data), a, b)) for a, b in ((0, cut), (cut, len(data)))]
        assert [h["warc-record-id"] for p in parts for h, _ in p] == [f"<{warc.RECORD}{i}>" for i in range(3)], cut
    rng = random.Random(1)  # urls that do not compress, so that a header spans ranges
    urls = ["http://h/" + "".join(rng.choices(string.ascii_letters, k=length if i % 2 else 9)) for i in range(6)]
    manifest = warc.write(spark.createDataFrame([(i, u, "x" * i, "c", "c") for i, u in enumerate(urls)], PAGES).coalesce(1), fresh_path(spark, "warc"))
    for split in (1 << 16, 1 << 22):
        assert sorted((r.url, bytes(r.payload)) for r in warc.read(manifest, split).collect()) == sorted((u, b"x" * i) for i, u in enumerate(urls))


def test_hot_payloads_and_short_ones(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT", 4)
    rows = [(i, "u", "hot" if i % 3 else f"own {i // 6}", "c", "c") for i in range(60, 0, -1)] + [(None, "u", "hot", "c", "c"), (61, "u", "", "c", "c"), (62, "u", None, "c", "c")]
    for least in (0, 4):
        got = {(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark, spark.createDataFrame(rows, PAGES), least=least).collect()}
        first = {}
        for i, _, p, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            first.setdefault(p or "", i)
        own = lambda i, p: len(p or "") < least or first[p or ""] == i
        assert got == {(i, "response" if own(i, p) else "revisit", None if own(i, p) else first[p or ""]) for i, _, p, *_ in rows}


def shards_of(spark, rows, **options):
    return sharding.digest(sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string, h string, shard string"), **options)).collect()


@pytest.mark.parametrize("kind", ["even", "hot", "empty third", "nulls", "few", "none", "repeated"])
def test_shards_are_even_and_slots_gapless(spark, kind):
    n = 2000
    rows = {
        "even": [(i, "t" * (i * 37 % 400), "c", "c") for i in range(n)],
        "hot": [(i * 1000 - 5, "same" * 50 if i % 3 else f"other {i}" * (i % 50), "c", "c") for i in range(n)],
        "empty third": [(i, "" if i % 3 == 0 else f"é{i}" * 20, "c", "c") for i in range(n)],
        "nulls": [(None if i % 5 == 0 else i, None if i % 7 == 0 else f"x{i}", "c", "c") for i in range(n)],
        "few": [(i, f"x{i}", "c", "c") for i in range(5)],
        "none": [],
        "repeated": [(i % 10, f"x{i % 10}", "c", "c") for i in range(300)],
    }[kind]
    got = shards_of(spark, rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t, *_ in rows)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got)
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    sizes = Counter()
    for s in range(16):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        sizes[s] = sum(r.size for r in mine)
    assert all(0 <= r.shard < 16 for r in got)
    if kind in ("even", "hot", "empty third", "nulls"):
        share, longest = sum(sizes.values()) / 16, max(r.size for r in got)
        assert all(abs(sizes[s] - share) <= 2 * (longest + sharding.TOLERANCE * share) for s in range(16))


@pytest.mark.parametrize("cell", [100_000, 40])
def test_shards_whatever_the_order_of_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    rows = [(i, "same" if i % 3 else f"text {i // 6}", "c", "c") for i in range(600)] + [(i % 7, "twice", "c", "c") for i in range(300)] + [(None, "nobody" if i % 2 else f"n{i}", "c", "c") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, h string, shard string")
    other = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), frame.schema).repartition(7)
    got, again = (sharding.digest(sharding.sharded(f, shards=4)).collect() for f in (frame, other))
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # equal texts stand together, and are in two shards only where a splitter cuts them
    runs = [k for k, _ in itertools.groupby((r.shard, r.text_crc32) for r in sorted(got, key=lambda r: (r.shard, r.slot)))]
    assert len(runs) == len({(r.shard, r.text_crc32) for r in got}) <= len({r.text_crc32 for r in got}) + 3
    share = sum(r.size for r in got) / 4
    assert all(abs(sum(r.size for r in got if r.shard == s) - share) <= 2 * (8 + sharding.TOLERANCE * share) for s in range(4))


def test_shards_by_other_ids(spark):
    frame = spark.createDataFrame([(f"id {i % 50}", "t" * (i % 9)) for i in range(200)], "g string, size string")
    got = sharding.sharded(frame, 3, "g", "size").collect()
    assert Counter(r.g for r in got) == Counter({f"id {i}": 4 for i in range(50)}) and len({(r.shard, r.slot) for r in got}) == 200
