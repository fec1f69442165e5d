"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes weighted term counts.  Terms are its words, the shapes of its
words (letter case, digits and punctuation), and how often a word or a line
repeats the one before it.  A term's weight is its inverse document frequency
times its information about the label in the training sample.  The first
singular vectors of the sample's weighted counts span the latent space.  The
sample's vectors and labels, bounded by ``SAMPLE`` rows, go to every task, which
computes exact cosines of all its documents with all of them in blocks; the
``NEIGHBOURS`` most similar vote with their similarity as weight.  Cosines count
to five decimals; of equally similar rows the first ones of the sample vote, whose
order is that of a hash of their ids.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.runtime import map_texts, released, remainder, utf8
from docmill.llm.toxicity import labelled_sample

SAMPLE = 4000
VOCABULARY, LEAST = 1000, 5
#: Shares of repeating words or lines, each a term of its own.
GRADES = (0.0, 0.02, 0.05, 0.15, 0.4)
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 4.0
THRESHOLD = 0.3
#: Documents whose cosines are computed at a time, and the steps of a cosine.
BLOCK, STEPS = 256, 100_000
#: Shapes of words up to so many bytes are remembered.
REMEMBER = 32
CLASSES = bytes(
    97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)
)


REPEATS = re.compile(rb"(.)\1{2,}", re.DOTALL)


def shape(run: bytes) -> bytes:
    """A word's classes with repeats collapsed to two at most."""
    return REPEATS.sub(rb"\1\1", run)


def terms_of(data: bytes | None, words: frozenset | None = None, shapes: dict | None = None) -> dict[bytes, int]:
    """Term counts of a whole text; of its words only those in ``words``, if given."""
    data = data or b""
    tokens = data.split()
    found: dict[bytes, int] = {}
    shapes = {} if shapes is None else shapes
    for run, n in Counter(data.translate(CLASSES).split()).items():
        s = shapes.get(run)
        if s is None:
            s = b"~" + shape(run)
            if len(run) <= REMEMBER:
                if len(shapes) > 20_000:
                    shapes.clear()
                shapes[run] = s
        found[s] = found.get(s, 0) + n
    again = sum(map(bytes.__eq__, tokens, tokens[1:]))
    lines = data.split(b"\n")
    again_lines = sum(1 for a, b in zip(lines, lines[1:], strict=False) if a and a == b)
    for name, n, of in ((b"=word", again, len(tokens)), (b"=line", again_lines, len(lines))):
        for i, share in enumerate(GRADES):
            if n >= 4 and n >= share * of:
                found[name + str(i).encode()] = n
    if not tokens:
        found[b"=empty"] = 1
    if words is None:
        found |= Counter(tokens)
    else:
        found |= Counter(filter(words.__contains__, tokens))
    return found


@dataclass
class Model:
    terms: dict[bytes, int]
    weights: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # unit rows of the sample
    labels: np.ndarray
    prior: float

    def vector(self, counts: dict[bytes, int]) -> np.ndarray:
        at = [(self.terms[t], n) for t, n in counts.items() if t in self.terms]
        if not at:
            return np.zeros(self.axes.shape[1], np.float32)
        ids = np.array([i for i, _ in at])
        values = (1 + np.log([n for _, n in at])) * self.weights[ids]
        v = values @ self.axes[ids]
        return (v / max(1e-12, float(np.sqrt(v @ v)))).astype(np.float32)

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        """The weighted votes of the nearest sample rows; the prior for vectors without terms."""
        out = np.full(len(vectors), self.prior)
        n = len(self.labels)
        kind = np.int32 if (STEPS + 1) * n < 1 << 31 else np.int64
        k, first = min(NEIGHBOURS, n), np.arange(n, dtype=kind)[::-1]
        for i in range(0, len(vectors) if k else 0, BLOCK):
            cosines = np.rint(vectors[i : i + BLOCK] @ self.vectors.T * STEPS).astype(kind)
            near = np.argpartition(cosines * kind(n) + first, -k, axis=1)[:, -k:]
            near.sort(axis=1)  # sums in the sample's order
            weight = np.clip(np.take_along_axis(cosines, near, axis=1) / STEPS, 0, 1) ** SHARPNESS
            total = weight.sum(axis=1)
            some = total > 1e-9
            out[i : i + BLOCK][some] = ((weight * self.labels[near]).sum(axis=1)[some] / total[some]).clip(0, 1)
        return out


def fit(rows: Iterable[tuple[int, dict[bytes, int]]]) -> Model:
    """Fit the space on (label, term counts) rows."""
    number: dict[bytes, int] = {}
    labels, coded = [], []
    for label, counts in rows:
        labels.append(label)
        ids = np.array([number.setdefault(t, len(number)) for t in counts], np.int32)
        coded.append((ids, np.array(list(counts.values()), np.float32)))
    y, n = np.array(labels, float), len(labels)
    if not n:
        return Model({}, np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1), np.float32), y, 0.5)
    prior = float((y.sum() + 0.5) / (n + 1))
    row, col = np.repeat(np.arange(n), [len(i) for i, _ in coded]), np.concatenate([i for i, _ in coded])
    tf = 1 + np.log(np.concatenate([v for _, v in coded]))
    df = np.bincount(col, minlength=len(number))
    pos = np.bincount(col, y[row], len(number))

    def entropy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = np.clip(a / np.maximum(b, 1e-9), 1e-9, 1 - 1e-9)
        return -(p * np.log(p) + (1 - p) * np.log(1 - p))

    whole = entropy(np.array([y.sum()]), np.array([float(n)]))
    gain = np.clip(whole - df / n * entropy(pos, df) - (n - df) / n * entropy(y.sum() - pos, n - df), 0, None)
    weight = (np.log((n + 1) / (df + 1)) + 0.1) * gain
    weight[df < min(LEAST, n)] = 0
    # counts vary too: terms that are in nearly all texts inform by how often they occur
    take = np.argsort(-weight * np.sqrt(df), kind="stable")[:VOCABULARY]
    take = take[weight[take] > 0]
    place = np.full(len(number), -1)
    place[take] = np.arange(len(take))
    names = {t: int(place[i]) for t, i in number.items() if place[i] >= 0}
    weights = weight[take]
    x = np.zeros((n, max(1, len(take))), np.float32)
    use = place[col] >= 0
    x[row[use], place[col[use]]] = tf[use] * weights[place[col[use]]]
    rng = np.random.default_rng(0)
    r = min(DIMENSIONS, *x.shape)
    basis = x.T @ rng.standard_normal((n, min(r + 8, n))).astype(np.float32)
    for _ in range(3):
        basis, _ = np.linalg.qr(basis)
        basis = x.T @ (x @ basis)
    basis, _ = np.linalg.qr(basis)
    _, _, vt = np.linalg.svd(x @ basis, full_matrices=False)
    axes = (basis @ vt.T[:, :r]).astype(np.float32)[: len(take)]
    vectors = x[:, : len(take)] @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(names, weights, axes, vectors, y, prior)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the usable labelled documents, drawn by a hash of the id.

    Tasks reduce the texts to their term counts before the driver gets them.
    """

    def start() -> Callable:
        return lambda data: (pickle.dumps(terms_of(data)),)

    drawn = labelled_sample(docs, labels, usable, label_col, sample, id_col, text_col).withColumn("h", F.xxhash64("t")).dropDuplicates(["k", "h"])
    found = map_texts(drawn, start, "terms binary", ["y", "k", "h"], "t", ["terms"]).orderBy("k", "y", "h").limit(sample)
    return fit((r.y, pickle.loads(r.terms)) for r in found.toLocalIterator())


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with ``score`` and ``predicted`` for every whole text.

    Null counts as empty; texts without a term of the model, and all texts if no
    row could be learned from, get the sample's share of good rows.  Of several
    labels of a document the greatest counts; repeated rows give repeated rows, an
    empty table none; kept columns with the names of the results are replaced.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        words = frozenset(t for t in model.terms if t[:1] not in (b"~", b"="))
        shapes: dict = {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            score = []
            for i in range(0, len(texts), BLOCK):
                vectors = np.stack([model.vector(terms_of(x.as_py(), words, shapes)) for x in texts.slice(i, BLOCK)])
                score.append(model.votes(vectors))
            made = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.float64())], [*keep, "score"])

    out = docs.select(*keep, utf8(text_col).alias("bytes_")).mapInArrow(run, ", ".join(x for x in (ddl, "score double") if x))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Learn from rows whose id's crc32 leaves no 0 modulo 5, then score all rows."""
    held_out = remainder(id_col, 5) == 0
    model = train(docs, labels, ~held_out, "quality", id_col, text_col)
    return scored(docs, model, keep if keep is not None else [id_col], text_col).withColumn("held_out", held_out)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "held_out", "score", "predicted")
