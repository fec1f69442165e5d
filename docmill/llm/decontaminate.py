"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one suffix automaton.  Training
tokens are streamed through it: the automaton's state and the length of the
longest match ending at each word are tracked; where the match is at least a
window long, the window's words are hit and the items that hold the window are
known from the state.  Items shorter than a window are windows of their own,
found on the state's suffix links.

A word run is streamed only where every adjacent word pair occurs in the items
(a hashed bitmap, no false negatives): all others cannot hold a window.

Items travel to the tasks in groups of at most ``GROUP_BYTES`` of text, each
group with an automaton of its own (a longer item is cut into pieces that overlap
by a window less a word, which have the item's windows between them).  So the
driver and the tasks hold one group at a time whatever the benchmark's size; with
several groups the documents are read once a group, and the hits, the only rows
that are kept of all but the first reading, are merged by document.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.runtime import kept as worker_kept
from docmill.llm.runtime import utf8, written

WINDOW = 13
GROUP_BYTES = 4 << 20
#: Lower-cases A-Z and blanks the ASCII characters that are neither letters nor digits.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PAIRS = 1 << 22


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(FOLD).split()


class Automaton:
    """A generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(k, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for k, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.holders: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.pairs = np.zeros(PAIRS, bool)
        self.least = min([window, *(len(c) for _, c in coded)])
        for k, codes in coded:
            a = np.array(codes, np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True
            state = 0
            for i, c in enumerate(codes):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.holders.setdefault(self._cut(state), set()).add(k)
            if len(codes) < window:
                self.short.setdefault(state, []).append((len(codes), k))
        # of each state: the nearest state on its suffix links, itself included, at which a short item ends
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.ending = [-1] * len(self.link)
        for s in order:
            self.ending[s] = s if s in self.short else self.ending[self.link[s]] if self.link[s] >= 0 else -1

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7919) & (PAIRS - 1)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(moves)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of state q for the strings as long as p's plus c, taking over the moves to q."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item went this way
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _cut(self, state: int) -> int:
        """The state of the last ``window`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit word ranges [start, end), the items found, and the longest match."""
        n = len(words)
        if n < self.least:
            return [], set(), 0
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, n)
        known = codes >= 0
        good = known.copy() if self.least == 1 else np.concatenate([known[:-1] & known[1:] & self.pairs[self._pair(codes[:-1], codes[1:])], [False]])
        need = max(1, self.least - 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest = 0
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start >= need:
                longest = max(longest, self._run(codes[start : min(n, stop + 1)].tolist(), start, spans, found))
        return spans, found, longest

    def _run(self, codes: list[int], offset: int, spans: list[tuple[int, int]], found: set[int]) -> int:
        state = length = longest = 0
        for i, c in enumerate(codes, offset + 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
                longest = max(longest, length)
            if length >= self.window:
                spans.append((i - self.window, i))
                found |= self.holders[self._cut(state)]
            at = self.ending[state]
            while at >= 0:
                for size, item in self.short[at]:
                    if size <= length:
                        spans.append((i - size, i))
                        found.add(item)
                at = self.ending[self.link[at]] if self.link[at] >= 0 else -1
        return longest


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def without(data: bytes, spans: list[list[int]]) -> bytes:
    """A text without the words of the ranges and what lies between them."""
    if not spans:
        return data
    places = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for start, stop in spans:
        out.append(data[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*out, data[at:]])


def pieces_of(text: bytes, limit: int, window: int) -> Iterator[bytes]:
    """A text, or, if it is longer than ``limit``, the pieces that hold all its windows, each of a window at least."""
    if len(text) <= limit:
        yield text
        return
    words = words_of(text)
    start = 0
    while start < len(words):
        stop, size = min(len(words), start + window), 0
        size = sum(len(w) + 1 for w in words[start:stop])
        while stop < len(words) and size + len(words[stop]) + 1 <= limit:
            size += len(words[stop]) + 1
            stop += 1
        yield b" ".join(words[start:stop])
        if stop == len(words):
            return
        start = stop - window + 1


def groups_of(benchmark: DataFrame, item_col: str, text_col: str, limit: int, window: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """The items in groups of at most ``limit`` bytes of text (one piece at least), one at a time."""
    group: list[tuple[str, bytes]] = []
    size = 0
    for r in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("k"), utf8(text_col).alias("t")).toLocalIterator():
        for piece in pieces_of(bytes(r.t or b""), limit, window):
            if group and size + len(piece) > limit:
                yield group
                group, size = [], 0
            group.append((r.k, piece))
            size += len(piece)
    if group:
        yield group


def automaton_of(name: str, items: list[tuple[str, bytes]], window: int) -> Automaton:
    """The automaton of a group of items, which a Python worker keeps for its next tasks."""
    return worker_kept(name, lambda: Automaton([(i, words_of(t)) for i, (_, t) in enumerate(items)], window))


def scan(docs: DataFrame, items: list[tuple[str, bytes]], id_col: str, text_col: str, window: int) -> DataFrame:
    """``(id, n_words, spans, items, longest)`` of every document against one group of items."""
    ids = [k for k, _ in items]
    id_type = docs.schema[id_col].dataType.simpleString()
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(name, items, window)
        for batch in batches:
            n, spans, names, longest = [], [], [], []
            for x in batch.column(1):
                words = words_of(x.as_py())
                hit, found, most = automaton.stream(words)
                n.append(len(words))
                spans.append([i for pair in merged(hit) for i in pair])
                names.append(sorted({ids[i] for i in found}))
                longest.append(most)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int32())],
                [id_col, "n_words", "spans", "items", "longest"],
            )

    return docs.select(id_col, utf8(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_words bigint, spans array<int>, items array<string>, longest int")


def _by_group(docs: DataFrame, groups: Iterable[list[tuple[str, bytes]]], id_col: str, text_col: str, window: int) -> DataFrame:
    """:func:`scan` against all groups; the ids of ``docs``, a written table, are unique."""
    every: DataFrame | None = None
    for group in groups:
        found = scan(docs, group, id_col, text_col, window)
        part = written(found if every is None else found.where("longest > 0 and size(items) > 0"), "hits")
        every = part if every is None else every.unionByName(part)
    join = F.pandas_udf(lambda s: s.map(lambda x: [int(i) for r in merged([(a[j], a[j + 1]) for a in x for j in range(0, len(a), 2)]) for i in r]), "array<int>")
    return (
        every.groupBy(id_col)
        .agg(F.max("n_words").alias("n_words"), join(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
        .select(id_col, "n_words", "spans", "items", "longest")
    )


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: int = GROUP_BYTES) -> DataFrame:
    """Per document row: ``(id, n_words, spans, items, longest, n_hit)``.

    ``spans`` is a flat array of word ranges [start, end), in order and disjoint;
    ``items`` the ids (as strings, sorted) of items with an occurring window;
    ``longest`` the longest matching length met in a group of items.  Null texts
    have no words; items without words have no window; a null item id counts as the
    empty string, and items of equal id as one.  Repeated document rows give
    repeated rows: with several groups, rows are told apart by a number fixed in a
    written table.  Texts and items may be of any length; an empty table gives no
    rows, an empty benchmark no hits.
    """
    groups = groups_of(benchmark, item_col, item_text, limit, window)
    first, second = next(groups, []), next(groups, None)
    if second is None:
        found = scan(docs, first, id_col, text_col, window)
    else:
        keyed = written(docs.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n")).alias("key"), F.col(text_col).alias("text")), "keyed")
        every = _by_group(keyed, itertools.chain([first, second], groups), "key", "text", window)
        found = every.select(F.col("key.id").alias(id_col), "n_words", "spans", "items", "longest")
    return _measured(found)


def _measured(found: DataFrame) -> DataFrame:
    """Adds ``n_hit``, the words in the spans."""
    width = F.aggregate(
        F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("bigint"), lambda acc, i: acc + F.element_at("spans", i + 2) - F.element_at("spans", i + 1)
    )
    return found.withColumn("n_hit", F.when(F.size("spans") >= 2, width).otherwise(F.lit(0).cast("bigint")))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds ``contaminated``: some word is hit and at least 1 in ``share`` words is."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def cleaned(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = 20, limit: int = GROUP_BYTES, cut: bool = True,
) -> DataFrame:
    """``docs`` without contaminated rows, and the others without the spans that are hit.

    A document goes if its hits reach the coverage limit (1 in ``share`` words);
    else, with ``cut``, the hit spans are cut out of its text.  Columns stay as
    they are.  Null and empty texts have no words and stay; repeated rows are
    judged alike and stay or go together; texts, items and the benchmark may be of
    any size; an empty benchmark changes nothing.  More than one group of items is
    scanned group by group, and the hits are merged by row.
    """
    groups = groups_of(benchmark, item_col, item_text, limit, window)
    first, second = next(groups, []), next(groups, None)
    if second is not None:
        return _cleaned_by_group(docs, itertools.chain([first, second], groups), text_col, window, share, cut)
    at, name = docs.columns.index(text_col), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(name, first, window)
        for batch in batches:
            keep, texts = [], []
            for x in batch.column(at):
                value = x.as_py()
                data = value.encode() if value is not None else b""
                words = words_of(data)
                spans = merged(automaton.stream(words)[0])
                n = sum(b - a for a, b in spans)
                keep.append(not (n and share * n >= len(words)))
                texts.append(value if not n or not cut else without(data, spans).decode("utf-8", "replace"))
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _cleaned_by_group(docs: DataFrame, groups: Iterable[list[tuple[str, bytes]]], text_col: str, window: int, share: int, cut: bool) -> DataFrame:
    """:func:`cleaned` whatever the number of groups."""
    row, spans = "row_", "spans_"
    taken = {c.lower() for c in docs.columns}
    while row in taken or spans in taken:
        row, spans = row + "_", spans + "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = judged(_measured(_by_group(numbered, groups, row, text_col, window)), share)
    left = numbered.join(found.where("not contaminated").select(row, F.col("spans").alias(spans)).hint("merge"), row).drop(row)
    if not cut:
        return left.drop(spans)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x, y in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                value, flat = x.as_py(), y.as_py()
                texts.append(without(value.encode(), [flat[j : j + 2] for j in range(0, len(flat), 2)]).decode("utf-8", "replace") if flat else value)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return left.mapInArrow(run, docs.schema)


def kept(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated rows, the others as they are."""
    return cleaned(docs, benchmark, cut=False, **options)


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of :func:`hits`."""
    return judged(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def brute_force(words: list[bytes], items: list[list[bytes]], window: int = WINDOW) -> tuple[set[int], set[int]]:
    """Hit positions and items by comparing every window with every place (for tests)."""
    at: set[int] = set()
    found: set[int] = set()
    for k, item in enumerate(items):
        size = min(window, len(item))
        for j in range(len(item) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == item[j : j + size]:
                    at |= set(range(i, i + size))
                    found.add(k)
    return at, found


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (
  SELECT item, w, least(13, len(w)) AS k FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
), places AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT p.r, p.i, p.k, v.item FROM places p JOIN windows v ON p.k = v.k AND p.s = v.s
), words AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r
), held AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN held USING (r)
"""
