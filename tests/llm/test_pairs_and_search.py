"""Near-duplicates, components, top-k and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docmill.llm import components, decontaminate, runtime, simhash, topk

DOCS = "doc_id long, text string, fp string, score double"


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 40, 200]))) for _ in range(40)]
    near = [b + " tail" for b in base[:20]] + [base[0].upper(), base[1].replace(" ", "\n\t")]
    return [*base, *near, *base[:3], None, "", " \n", "one", "É é", "x " * 30_000]


def test_fingerprints_follow_the_definition():
    for t in texts():
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


def test_near_duplicates_against_all_pairs(spark):
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(texts())] + [(0, texts()[0], "clash", 1.0), (None, texts()[0], "clash", 1.0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    want_root = roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    smallest = {}
    for (i, *_), r in zip(rows, want_root, strict=True):
        if i is not None:
            smallest[r] = min(smallest.get(r, i), i)
    want = Counter((i, f"{f:016x}", smallest[r]) for (i, *_), f, r in zip(rows, fps, want_root, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_no_documents_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("deep", [False, True])
def test_dense_clusters_lose_no_link(spark, monkeypatch, deep):
    sizes = {"SAMPLE": 256, "LEAVES": 16, "BLOCK": 50, "CROWDED": 4000}
    for name, value in (sizes | ({"LEAVES": 4, "STAGE": 2, "LEAF": 16, "SALTED": 200, "DENSE": 0.3} if deep else {})).items():
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(1)

    def around(centre, n, bits):
        out = []
        for _ in range(n):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, bits + 1), replace=False):
                x ^= 1 << int(b)
            out.append(x)
        return np.array(out, np.uint64)

    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, around(base[0], 500, 5), around(base[1], 200, 9)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components.connected(simhash.near_links(frame)).collect()}
    want = np.arange(len(fps))
    for i in range(0, len(fps), 200):
        x, y = np.nonzero(np.bitwise_count(fps[i : i + 200, None] ^ fps[None, :]) <= 4)
        simhash.unite(want, x + i, y)
    mine = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(mine, want.tolist(), strict=True))) == len(set(mine)) == len(set(want.tolist()))


def test_near_duplicates_with_dense_clusters(spark, monkeypatch):
    """A cluster with a third of all fingerprints, through the whole operator, with hot keys everywhere."""
    for module, name, value in ((simhash, "SAMPLE", 128), (simhash, "LEAVES", 16), (simhash, "BLOCK", 20), (runtime, "HOT", 8)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=300)
    near = [" ".join(base[:i] + [rng.choice(words)] + base[i + 1 :]) for i in range(0, 300, 2)]
    rows = [(i, t, "c", 0.0) for i, t in enumerate([*near, *(" ".join(rng.choices(words, k=80)) for _ in range(200)), *[" ".join(base)] * 100])]
    rows += [(None, rows[0][1], "c", 0.0)] * 50
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    fps = sorted({plain_fingerprint(t) for _, t, *_ in rows})
    group = dict(zip(fps, roots(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4), strict=True))
    least = {}
    for i, t, *_ in rows:
        r = group[plain_fingerprint(t)]
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{plain_fingerprint(t):016x}", least[group[plain_fingerprint(t)]]) for i, t, *_ in rows)


def test_deep_trees_find_homes_and_neighbours():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    tree = simhash.Tree(fps[:500], simhash.bands_of(4)[0][0], 1, 4)
    home = tree.home(fps)
    below = {int(x): simhash.Tree(fps[home == x], tree.mask, 1, 3) for x in np.unique(home)[:-1]}
    tree.deepened(3, np.array(list(below)), np.stack([t.vantage for t in below.values()]), np.stack([t.inner for t in below.values()]))
    row, leaf, is_home = tree.route(fps)
    deep = tree.home(fps)
    assert tree.depth == 7 and (deep >> 3 == home).all() and (np.bincount(row[is_home], minlength=len(fps)) == 1).all() and (leaf[is_home] == deep[row[is_home]]).all()
    reach = set(zip(row.tolist(), leaf.tolist(), strict=True))
    x, y = np.nonzero(np.bitwise_count((fps[:300, None] ^ fps[None, :]) & tree.mask) <= 1)
    assert all((int(a), int(deep[b])) in reach for a, b in zip(x, y, strict=True))


def test_components_of_stars_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT", 3)
    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 2000) for i in range(50)] + [(0, 5)] * 30 + [(5000, 5001)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len(got) == 400 + 51 + 2
    assert len({got[i] for i in range(400)}) == 1 and len({got[i] for i in [*range(1000, 1050), 2000]}) == 1 and len(set(got.values())) == 3


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]


def test_automaton_against_every_window():
    rng = random.Random(1)
    for trial in range(150):
        letters = [b"a", b"b", b"c", b"d"][: rng.choice([2, 3, 4])]
        window = rng.choice([3, 4, 5])
        items = [[rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 4, 6, 15]))] for _ in range(rng.randint(0, 5))]
        if trial % 2:
            items = [i for i in items if len(i) >= 3]
        automaton = decontaminate.Automaton(list(enumerate(items)), window)
        words = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 40))]
        spans, found, _ = automaton.stream(words)
        assert ({i for a, b in spans for i in range(a, b)}, found) == decontaminate.brute_force(words, items, window)


BENCH = [(1, "The quick, brown fox-jumps over the lazy dog; then it sleeps well tonight ok"), (2, "only two"), (3, None), (4, "..."), (10, "ONLY two")]
CASES = [
    (1, "so THE quick brown fox jumps over the lazy dog then it sleeps well tonight ok yes", "c", 0.0), (2, None, "c", 0.0), (3, "", "c", 0.0), (4, "we saw only two of them", "c", 0.0),
    (5, "clean words here", "c", 0.0), (5, "clean words here", "c", 0.0), (6, "only two " + "filler " * 100, "c", 0.0), (None, "only-two", "c", 0.0),
]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_hits_whatever_the_groups_of_items(spark, limit):
    docs, bench = spark.createDataFrame(CASES, DOCS), spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontaminate.digest(decontaminate.hits(docs, bench, limit=limit)).collect()
    items = [(str(i), decontaminate.words_of((t or "").encode())) for i, t in BENCH]
    want = Counter()
    for i, t, *_ in CASES:
        words = decontaminate.words_of((t or "").encode())
        at, found = decontaminate.brute_force(words, [w for _, w in items])
        names = sorted({items[k][0] for k in found})
        import hashlib

        want[i, len(words), len(at), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(at) and 20 * len(at) >= len(words)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_spans_are_cut_and_covered_documents_go(spark):
    docs, bench = spark.createDataFrame(CASES, DOCS), spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(r.doc_id, r.text) for r in decontaminate.cleaned(docs, bench).collect()}
    assert {i for i, _ in got} == {2, 3, 5, 6}
    assert next(t for i, t in got if i == 6).strip().startswith("filler")
    assert decontaminate.cleaned(docs, bench).columns == docs.columns
    assert decontaminate.hits(docs.limit(0), bench.limit(0)).collect() == []


@pytest.mark.parametrize("cut", [True, False])
def test_many_groups_of_items_clean_like_one(spark, cut):
    docs, bench = spark.createDataFrame([*CASES, (None, "clean", "d", 0.0), (None, "clean", "d", 0.0)], DOCS), spark.createDataFrame(BENCH, "item_id long, text string")
    assert len(list(decontaminate.groups_of(bench, "item_id", "text", 1))) > 4
    one, many = (decontaminate.cleaned(docs, bench, limit=limit, cut=cut) for limit in (decontaminate.GROUP_BYTES, 1))
    assert many.dtypes == docs.dtypes
    assert Counter(map(tuple, many.collect())) == Counter(map(tuple, one.collect()))


def test_pieces_of_long_items_hold_its_windows():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"bb", b"ccc", b"d" * 40]) for _ in range(rng.randint(0, 60))]
        window, limit = rng.randint(1, 5), rng.choice([1, 20, 100])
        pieces = [decontaminate.words_of(p) for p in decontaminate.pieces_of(b" ".join(words), limit, window)]
        of = lambda x: {tuple(x[i : i + window]) for i in range(len(x) - window + 1)}  # noqa: B023, E731
        assert set().union(*map(of, pieces), set()) == of(words)
        assert len(pieces) < 2 or all(len(p) >= window for p in pieces)


def test_long_texts_items_and_many_groups(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 30, 4000])))) for i in range(25)]
    docs = [(1, " ".join(rng.choices(words, k=100_000)) + " " + items[3][1], "c", 0.0), (2, items[7][1], "c", 0.0), (2, items[7][1], "c", 0.0), (3, " ".join(rng.choices(words, k=500)), "c", 0.0)]
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, (3, items[4][1])], "item_id long, text string")
    rows = lambda limit: sorted(map(str, decontaminate.digest(decontaminate.hits(frame, bench, limit=limit)).collect()))
    assert rows(1 << 20) == rows(5000)
    kept = {r.doc_id for r in decontaminate.kept(frame, bench, limit=5000).collect()}
    assert 2 not in kept and 3 in kept


def brute_top(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("kind", ["lengths", "clusters", "ties", "few", "none", "huge"])
def test_top_k_against_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "lengths":
        rows = [(i, (rng.standard_normal(8) * rng.exponential(3)).astype("f4").tolist()) for i in range(500)]
    elif kind == "clusters":
        rows = [(i, (np.eye(8)[i % 8] * 5 + rng.standard_normal(8) * 0.1).astype("f4").tolist()) for i in range(600)]
    elif kind == "ties":
        rows = [(i, [1.0, float(i % 3)]) for i in range(300)] + [(900, None), (901, [None, 1.0]), (902, [float("nan"), 1.0]), (None, [1.0, 1.0]), (1000, [0.0, 0.0])]
    elif kind == "few":
        rows = [(0, [1.0]), (1, [2.0]), (2, [-3.0])]
    elif kind == "huge":
        rows = [(i, [float(np.float32(1e4 * (i + 1))), 1.0]) for i in range(120)]
    else:
        rows = []
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("norm", F.lit("clash"))
    got = topk.digest(topk.exact_top_k(frame, F.col("vec_id") % 100 == 0)).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute_top(rows)


def test_products_saturate_beyond_a_bigint():
    a = np.array([[2.0**40, 1.0]])
    assert topk.products(a, np.array([[2.0**40, 0.0], [-(2.0**40), 0.0], [2.0**20, 3.0]])).tolist() == [[topk.TOP, -topk.TOP - 1, 2**60 + 3]]


def test_huge_rows_leave_the_others_alone():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-1000, 1000, (5, 4)).astype(float), rng.integers(-1000, 1000, (7, 4)).astype(float)
    c[2] *= 2.0**50
    q[1, 0] = 2.0**60
    want = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in c] for a in q]
    assert topk.products(q, c).tolist() == [[min(max(x, -topk.TOP - 1), topk.TOP) for x in row] for row in want]
