"""Byte-level BPE by monoid tree reduction.

Token sequences of a piece of text form a monoid: the unit is the empty
sequence, and two neighbours are joined by re-encoding a window around their
boundary.  A sequence is *the* encoding of its bytes exactly if every two
neighbouring tokens are: encoding the two tokens' bytes gives the two tokens
back.  So once the tokens at both ends of the re-encoded window agree with what
lies outside, everything outside has provably settled; until then the window
grows.  A piece (one match of the pattern) is encoded by halving it down to
leaves and joining up the tree; a text is the concatenation of its pieces.
Decoding concatenates up the same kind of tree.

Three shortcuts change no result.  A single space between two non-spaces always
starts a match (the pattern's only way past it begins there), so a text is cut
at such spaces and the encoding of every such chunk is remembered by a worker, up
to twice ``REMEMBER`` chunks and matches.  Small nodes of the trees, windows of joins,
and what two neighbouring tokens become are remembered likewise.  A match taken alone is
one match, so chunks and matches share what is remembered.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame

from docmill.llm.runtime import kept, map_texts

#: Bytes of a leaf, encoded by plain merging: so few that most leaves have been met before.
LEAF = 4
#: Bytes of the longest node of a tree, or window of a join, that is remembered.
NODE = 8
#: Remembered nodes, as many token pairs, and twice as many chunks and matches, a worker; the older half goes when that many are exceeded.
REMEMBER = 200_000
#: The rank of what is no token.
NONE = 1 << 60


def forget(memory: dict) -> None:
    """Drop the older half."""
    for old in list(itertools.islice(memory, len(memory) // 2)):
        del memory[old]


class Encoder:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.codes = {i: struct.pack("<I", i) for i in self.tokens}
        self.longest = max(map(len, self.ranks), default=0)
        self.beyond = max(self.tokens, default=0) + 1
        # the bytes of all tokens, one after the other, and where each token's begin and how many they are
        self.flat = np.frombuffer(b"".join(self.ranks), np.uint8)
        self.lengths = np.full(self.beyond, -1)  # ids that are no token cannot be decoded
        self.starts = np.zeros(self.beyond, np.int64)
        at = 0
        for token, i in self.ranks.items():
            self.starts[i], self.lengths[i] = at, len(token)
            at += len(token)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.short: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Encode a few bytes: merge the neighbours whose union has the least rank, leftmost first."""
        get = self.ranks.get
        whole = get(data)
        if whole is not None:
            return (whole,)
        parts = [data[i : i + 1] for i in range(len(data))]
        unions = [get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while unions and (least := min(unions)) < NONE:
            i = unions.index(least)
            parts[i] += parts.pop(i + 1)
            del unions[i]
            if i:
                unions[i - 1] = get(parts[i - 1] + parts[i], NONE)
            if i < len(unions):
                unions[i] = get(parts[i] + parts[i + 1], NONE)
        return tuple([self.ranks[p] for p in parts])

    def merged(self, data: bytes) -> tuple[int, ...]:
        """:meth:`merge`, remembered."""
        return self.short.get(data) or self.kept(data, self.merge(data))

    def kept(self, data: bytes, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(data) <= NODE:
            if len(self.short) >= REMEMBER:
                forget(self.short)
            self.short[data] = ids
        return ids

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of two neighbouring tokens' bytes; nothing if they are their own encoding."""
        key = a * self.beyond + b
        found = self.pairs.get(key)
        if found is None:
            found = self.merge(self.tokens[a] + self.tokens[b])
            if found == (a, b):
                found = ()
            if len(self.pairs) >= REMEMBER:
                forget(self.pairs)
            self.pairs[key] = found
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right:
            return left or right
        window = self.pair(left[-1], right[0])
        if not window:
            return left + right
        i = j = 1
        while True:
            out_left = i >= len(left) or not self.pair(left[-i - 1], window[0])
            out_right = j >= len(right) or not self.pair(window[-1], right[j])
            if out_left and out_right:
                return left[: len(left) - i] + window + right[j:]
            if not out_left:
                i = min(len(left), i + max(1, i // 2))
            if not out_right:
                j = min(len(right), j + max(1, j // 2))
            window = self.merged(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))

    def piece(self, data: bytes) -> tuple[int, ...]:
        """Encode one piece: its halves, recursively, then their join."""
        found = self.short.get(data)
        if found is not None:
            return found
        n = len(data)
        if n <= LEAF:
            return self.kept(data, self.merge(data))
        if n <= self.longest:
            whole = self.ranks.get(data)
            if whole is not None:
                return (whole,)
        half = n // 2
        return self.kept(data, self.join(self.piece(data[:half]), self.piece(data[half:])))

    def remembered(self, text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.known) >= 2 * REMEMBER:
                forget(self.known)
            self.known[text] = ids
        return ids

    def match(self, text: str) -> bytes:
        """Encode one match of the pattern; ids as little-endian unsigned 32-bit integers."""
        return self.remembered(text, b"".join(map(self.codes.__getitem__, self.piece(text.encode()))))

    def chunk(self, text: str) -> bytes:
        """Encode a chunk of whole matches, likewise."""
        pieces = self.pieces(text)
        if len(pieces) == 1:
            return self.match(pieces[0])
        get = self.known.get
        return self.remembered(text, b"".join([get(p) or self.match(p) for p in pieces]))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        get = self.known.get
        return b"".join([get(c) or self.chunk(c) for c in chunks_of(text)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, concatenated up a tree whose leaves hold 4,096 tokens."""
        codes = np.frombuffer(ids, "<u4")
        parts = [self._bytes(codes[i : i + 4096]) for i in range(0, len(codes), 4096)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]

    def _bytes(self, codes: np.ndarray) -> bytes:
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        # the place of each byte of the result among all tokens' bytes
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[codes] - ends + lengths, lengths)].tobytes()


def encoder_of(path: str, pattern: str) -> Encoder:
    """The encoder of a Python worker: what it remembers serves the worker's next tasks too."""
    return kept((path, pattern), lambda: Encoder(path, pattern))


def chunks_of(text: str) -> list[str]:
    """Cut before every single space that stands between two characters that are no white space.

    ``str.isspace`` is at least as wide as the pattern's white space for this
    use: a doubtful character only keeps two chunks together.
    """
    words = text.split(" ")
    if len(words) == 1:
        return words if text else []
    if "" not in words and list(map(str.strip, words)) == words:
        return [words[0], *[" " + w for w in words[1:]]]
    out = [words[0]]
    before = words[0]
    held = None  # a chunk that goes on
    for w in words[1:]:
        if w and before and not w[0].isspace() and not before[-1].isspace():
            if held is not None:
                out[-1] = "".join(held)
                held = None
            out.append(" " + w)
        else:
            if held is None:
                held = [out[-1]]
            held.append(" " + w)
        before = w
    if held is not None:
        out[-1] = "".join(held)
    return out


def tokenized(docs: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids (``array<int>``) for every whole text; null text: null."""

    def start() -> Callable:
        encoder = encoder_of(path, pattern)
        return lambda data: (None if data is None else np.frombuffer(encoder.encode(data.decode()), "<u4").astype(np.int32),)

    names = [c for c in docs.columns if c != to]
    return map_texts(docs, start, f"{to} array<int>", names, text_col, [to], (path, pattern))


def detokenized(tokens: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", to: str = "text") -> DataFrame:
    """The inverse of :func:`tokenized` (invalid UTF-8 gives the replacement character)."""
    import pyarrow as pa

    keep = [c for c in tokens.columns if c != to]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*keep).schema.fields) + f", `{to}` string"
    at = keep.index(ids_col)

    def run(batches):
        encoder = encoder_of(path, pattern)
        for batch in batches:
            texts = [None if x is None else encoder.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, to])

    return tokens.select(*keep).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256, n_bytes)``: encode every whole text, then decode the ids.

    Null counts as the empty text (no tokens).  Texts may be of any length; repeated
    rows give repeated rows, an empty table none.
    """

    def start() -> Callable:
        encoder = encoder_of(path, pattern)

        def both(data: bytes | None) -> tuple:
            ids = encoder.encode((data or b"").decode())
            back = encoder.decode(ids)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), len(back)

        return both

    return map_texts(docs, start, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint", [id_col], text_col, ["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"], (path, pattern))


