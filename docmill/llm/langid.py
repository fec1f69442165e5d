"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits; for up to seven languages the
exhaustive code (all ways to split them in two), beyond it fixed pseudo-random
codewords.  One binary classifier a bit, logistic over hashed n-grams of one to
four bytes of the lower-cased letters, predicts the bit.  Decoding is
loss-weighted: the language whose codeword has the least total logistic loss
wins.  Where the runner-up's loss is nearly as small, the text is flagged as
ambiguous.

All values of the language column are learned, however many.  Training takes at
most ``PER_LANGUAGE`` texts a language and about ``SAMPLE`` in all (of very many
languages one each), those first in a hashed order.  Training and prediction use
whole texts: the tasks reduce each sampled text to the counts of its hashed
n-grams, which are bounded by the number of buckets, and only these go to the
driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.runtime import map_texts, released, remainder, utf8

PER_LANGUAGE, SAMPLE = 300, 12_000
BUCKET_BITS = 16
#: Bytes scored at a time.
BLOCK = 1 << 16
UNKNOWN = "und"
#: A text is ambiguous if the winner's probability is below this.
CLEAR = 0.5
#: Margins are mean n-gram scores, times this.
SCALE = 50.0
#: Blanks the ASCII characters that are no letters.
LETTERS = bytes(b if 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 else 32 for b in range(256))


def normalized(data: bytes | None) -> bytes:
    """The lower-cased letters of a text, words apart by one space; empty if it has no letter."""
    text = (data or b"").decode("utf-8", "ignore")
    if not any(c.isalpha() for c in text):
        return b""
    return b" ".join([b"", *text.lower().encode().translate(LETTERS).split(), b""])


def grams(text: bytes) -> np.ndarray:
    """Hashed n-grams of one to four bytes."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    out, code = [], np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        code = code[: len(b) - n + 1] << np.uint32(8) | b[n - 1 :]
        out.append((code * np.uint32(2654435761) + np.uint32(n << 28)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


def gram_counts(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text's n-grams, in order, and how many fall into each; empty without letters."""
    text = normalized(data)
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for i in range(0, len(text), BLOCK):
        total += np.bincount(grams(text[i : i + BLOCK + 3]), minlength=len(total))
    used = np.flatnonzero(total)
    return used, total[used]


def codewords(n: int) -> np.ndarray:
    """The codewords of ``n`` languages, a row each."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1, *c] for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, np.float64).T
    rng = np.random.default_rng(n)
    return rng.choice([-1.0, 1.0], (n, int(15 * np.ceil(np.log2(n)))))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray

    def scorer(self) -> Callable[[bytes | None], tuple]:
        """The function text -> (language, probability, ambiguous)."""
        def score(data: bytes | None) -> tuple:
            text = normalized(data)
            if not text or not self.languages:
                return UNKNOWN, 0.0, True
            bits, n = np.zeros(len(self.bias)), 0
            for i in range(0, len(text), BLOCK):
                g = grams(text[i : i + BLOCK + 3])
                bits += self.weights.take(g, axis=0).sum(axis=0, dtype=np.float64)
                n += len(g)
            margin = bits / n * SCALE + self.bias
            loss = np.logaddexp(0, -self.code * margin).sum(axis=1)
            best = int(loss.argmin())
            share = float(1 / np.exp(loss[best] - loss).sum())
            return self.languages[best], share, share < CLEAR

        return score


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 80, decay: float = 1e-5) -> Model:
    """Train the bit classifiers on (language, buckets, counts) rows by full-batch logistic gradient steps (Adam)."""
    languages = sorted({lang for lang, *_ in rows})
    code = codewords(len(languages))
    index = {x: i for i, x in enumerate(languages)}
    ids, values, starts, labels = [], [], [0], []
    for lang, g, n in rows:
        if len(g):
            ids.append(g)
            values.append(SCALE * n / n.sum())
            starts.append(starts[-1] + len(g))
            labels.append(index[lang])
    if not labels:
        return Model([], np.ones((0, 1)), np.zeros((1, 1), np.float32), np.zeros(1))
    at, x = np.concatenate(ids), np.concatenate(values)
    used, at = np.unique(at, return_inverse=True)
    row = np.repeat(np.arange(len(labels)), np.diff(starts))
    want = code[labels]
    share = np.bincount(labels, minlength=len(languages))
    importance = (len(labels) / (len(languages) * share))[labels] / len(labels)
    small = np.zeros((len(used), code.shape[1]))
    bias = np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for step in range(1, rounds + 1):
            z = np.bincount(row, x * w[:-1][at], len(labels)) + w[-1]
            pull = -want[:, b] / (1 + np.exp(np.clip(want[:, b] * z, -50, 50))) * importance
            g = np.append(np.bincount(at, x * pull[row], len(used)) + decay * w[:-1], pull.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        small[:, b], bias[b] = w[:-1], w[-1]
    weights = np.zeros((1 << BUCKET_BITS, code.shape[1]), np.float32)
    weights[used] = small
    return Model(languages, code, weights, bias)


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts as their buckets (16 bits each) and counts."""
    released()
    for batch in batches:
        found = [gram_counts(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        made = [pa.array([c[i].astype(t).tobytes() for c in found], pa.binary()) for i, t in enumerate((np.uint16, np.uint32))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "g", "n"])


def train(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the usable rows with a language: a bounded sample, even over languages.

    Repeated rows count once.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"))
    counts = known.groupBy("l").agg(F.count("*").alias("n")).collect()  # a row a language
    if not counts:
        return fit([])
    per = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    # a local relation: the planner knows its size, and broadcasts it if that is small
    shares = docs.sparkSession.createDataFrame(pa.table({"l": [r.l for r in counts], "share": [min(1.0, (per + 5 * per**0.5 + 10) / r.n) for r in counts]}))
    ticket = F.shiftrightunsigned(F.xxhash64(F.col("id_").cast("string"), "t"), 11) / F.lit(float(1 << 53))
    drawn = known.withColumn("k", ticket).join(shares, "l").where("k < share").select("l", "k", F.xxhash64("t").alias("h"), utf8("t").alias("t"))
    sample = drawn.dropDuplicates(["l", "k", "h"]).mapInArrow(_reduced, "l string, k double, h bigint, g binary, n binary")
    place = F.expr("row_number() over (partition by l order by k, h)")
    rows = sample.withColumn("place", place).where(F.col("place") <= per).select("l", "g", "n").collect()
    rows.sort(key=lambda r: (r.l, bytes(r.g), bytes(r.n)))  # sums of doubles should not depend on the tasks' order
    return fit([(r.l, np.frombuffer(r.g, np.uint16), np.frombuffer(r.n, np.uint32)) for r in rows])


def identified(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` and ``ambiguous`` for every whole text.

    Null texts and texts without a letter get ``und`` with score 0, flagged as
    ambiguous; so does everything if no row could be learned from.  Of languages
    with the same loss the first by name wins.  Texts of any length are read whole,
    a block at a time; repeated rows give repeated rows, an empty table none; kept
    columns with the names of the results are replaced.
    """
    return map_texts(docs, model.scorer, "lang_pred string, score double, ambiguous boolean", keep, text_col, ["lang_pred", "score", "ambiguous"])


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Learn from the rows whose id's crc32 leaves no 2 modulo 4, then judge all rows."""
    held_out = remainder(id_col, 4) == 2
    model = train(docs, ~held_out, id_col, text_col, lang_col)
    keep = keep if keep is not None else [id_col]
    return identified(docs, model, keep, text_col).withColumn("held_out", held_out)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
