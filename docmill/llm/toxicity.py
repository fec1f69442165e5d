"""Toxicity: a logistic classifier kept from judging by identity terms.

Features are the distinct words of a text and their first bytes.  Words are
chosen by a chi-squared test over the training sample, and identity terms are
always among them.  For every labelled sentence that mentions an identity term,
the term is swapped for others of its list (the counterfactuals); training
minimises the logistic loss plus ``BALANCE`` times the squared change of the
score's logit under the swaps.  So a term that merely keeps company with insults
gets little weight of its own, and neutral mentions of a group stay below the
threshold.

Identity terms are the given lists, a parameter, and lists found in the sample
itself (:func:`found_terms`): words that keep company with insults and are in
clean texts as well, put together by the company they keep.

The sample is at most ``SAMPLE`` labelled documents, those first in a hashed
order of ids; scoring uses whole texts and needs one look-up a distinct word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.runtime import map_texts, remainder, utf8

SAMPLE = 12_000
#: Chosen words at most, and the least chi-squared statistic and document count.
VOCABULARY, EVIDENCE, LEAST = 20_000, 12.0, 3
BALANCE = 4.0
#: Weight of a toxic row: the threshold is low, so misses cost more than false alarms.
POSITIVE = 2.5
SWAPS = 4
#: Found identity terms: at most, in how many toxic and clean texts each at least, in what share of all at most (or in SOME).
FOUND, COMPANY, SHARE, SOME = 48, 2, 0.02, 12
#: Words whose company makes a context, the least cosine of contexts of a list, and its least length.
CONTEXT, LIKE, LEAST_LIST = 200, 0.8, 3
THRESHOLD = 0.3
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (5, 7)
#: Keeps letters and digits; everything else in ASCII is blanked.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Lists of exchangeable group terms, by language; a parameter of :func:`train`.
IDENTITY = (
    ("women", "men", "gay", "straight", "lesbian", "trans", "black", "white", "asian", "latino", "arab", "muslim", "christian", "jewish", "hindu", "buddhist", "immigrant", "refugee", "disabled", "deaf", "blind", "old", "young"),
    ("frauen", "männer", "schwule", "lesben", "schwarze", "weiße", "muslime", "christen", "juden", "flüchtlinge", "behinderte"),
    ("femmes", "hommes", "homosexuels", "lesbiennes", "noirs", "blancs", "musulmans", "chrétiens", "juifs", "réfugiés", "handicapés"),
    ("mujeres", "hombres", "homosexuales", "lesbianas", "negros", "blancos", "musulmanes", "cristianos", "judíos", "refugiados", "discapacitados"),
)


def words_of(data: bytes | None) -> set[bytes]:
    return set((data or b"").decode("utf-8", "ignore").lower().encode().translate(FOLD).split())


def features_of(words: set[bytes]) -> set[bytes]:
    return words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in BEGINNINGS))


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = 0.0
    identity: tuple = ()  # the lists whose terms were swapped
    swaps: int = 0

    def scorer(self) -> Callable[[bytes | None], tuple]:
        weights, bias = self.weights, self.bias
        whole = {w for w in weights if not w.startswith(b"^")}
        starts = {w[1:]: v for w, v in weights.items() if w.startswith(b"^")}

        def score(data: bytes | None) -> tuple:
            words = words_of(data)
            z = bias + sum(weights[w] for w in sorted(words & whole))
            if starts:
                for n in BEGINNINGS:
                    z += sum(starts[p] for p in sorted({w[:n] for w in words if len(w) > n} & starts.keys()))
            return (1 / (1 + float(np.exp(-min(max(z, -40.0), 40.0)))),)

        return score


def swapped(words: set[bytes], identity: tuple = IDENTITY) -> list[tuple[bytes, bytes]]:
    """Pairs of an identity term of a text and another of its list that takes its place."""
    out = []
    for terms in identity:
        own = [t.encode() for t in terms]
        if words.isdisjoint(own):
            continue
        others = [o for o in own if o not in words]
        out += [(t, o) for t in own if t in words for o in others[:: max(1, len(others) // SWAPS)][:SWAPS]]
    return out


def differences(words: set[bytes], pairs: list[tuple[bytes, bytes]]) -> list[dict[bytes, float]]:
    """Of each swap, the features that go (1) and come (-1)."""
    starts = Counter(b"^" + w[:n] for w in words for n in BEGINNINGS if len(w) > n)
    out = []
    for t, o in pairs:
        gone = {f for f in features_of({t}) if f == t or starts[f] == 1}
        come = {f for f in features_of({o}) if f == o or not starts[f]}
        out.append({f: 1.0 for f in gone - come} | {f: -1.0 for f in come - gone})
        for f in features_of({t}) & features_of({o}):  # a beginning that both have stays
            out[-1].pop(f, None)
    return out


class Rows:
    """(label, words) rows, kept as numbers of words, iterated as often as wanted."""

    def __init__(self, rows: Iterable[tuple[int, Iterable[bytes]]]) -> None:
        number: dict[bytes, int] = {}
        self.labels, self.ids = [], []
        for label, words in rows:
            self.labels.append(label)
            self.ids.append(np.array(sorted({number.setdefault(w, len(number)) for w in words}), np.int32))
        self.words = list(number)

    def __iter__(self) -> Iterator[tuple[int, set[bytes]]]:
        for label, ids in zip(self.labels, self.ids, strict=True):
            yield label, {self.words[i] for i in ids}


def found_terms(rows: Rows, most: int | None = None) -> tuple[tuple[str, ...], ...]:
    """Lists of exchangeable words found in (label, words) rows.

    Candidates are the words that are oftenest in toxic rows among those that are
    in clean rows too, in few rows altogether, and whose label share is not far
    from that of all (the chi-squared test would not choose them).  Two are
    exchangeable if they keep the same company: the cosine of their rows' counts
    of the most frequent words is at least ``LIKE``.
    """
    n, positive = len(rows.labels), sum(rows.labels)
    total, toxic = Counter(), Counter()
    for y, words in rows:
        total.update(words)
        if y:
            toxic.update(words)
    fit_ = [w for w, a in toxic.items() if a >= COMPANY and total[w] - a >= COMPANY and total[w] <= max(SOME, SHARE * n)]
    fit_ = [w for w in fit_ if chi_squared(toxic[w], total[w] - toxic[w], positive, n - positive) < EVIDENCE]
    terms = sorted(fit_, key=lambda w: (-toxic[w], w))[: FOUND if most is None else most]
    for t in terms:
        del total[t]
    common = {w: i for i, (w, _) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:CONTEXT])}
    company = {t: np.zeros(len(common)) for t in terms}
    for _, words in rows:
        for t in words & company.keys():
            for w in words & common.keys():
                company[t][common[w]] += 1
    lists: list[list[bytes]] = []
    for t in terms:
        v = company[t] / max(1e-9, float(np.linalg.norm(company[t])))
        for group in lists:
            lead = company[group[0]] / max(1e-9, float(np.linalg.norm(company[group[0]])))
            if float(v @ lead) >= LIKE:
                group.append(t)
                break
        else:
            lists.append([t])
    return tuple(tuple(t.decode("utf-8", "replace") for t in group) for group in lists if len(group) >= LEAST_LIST)


def chi_squared(a, b, positive: int, negative: int):
    """Of words in ``a`` of the positive and ``b`` of the negative rows."""
    c, d = positive - a, negative - b
    return (positive + negative) * (a * d - b * c) ** 2 / np.maximum(1, (a + b) * (c + d) * positive * negative)


@dataclass
class Problem:
    """What training minimises, over the features' weights and the bias."""

    y: np.ndarray
    row: np.ndarray
    col: np.ndarray
    swap: tuple[np.ndarray, np.ndarray, np.ndarray]  # of the swaps' differences: swap, feature, value
    swaps: int
    features: int
    balance: float = BALANCE
    decay: float = 3e-5

    def at(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Value and gradient: weighted logistic loss, decay, and the squared changes under the swaps."""
        z = np.clip(np.bincount(self.row, w[:-1][self.col], len(self.y)) + w[-1], -40, 40)
        weight = (1 + (POSITIVE - 1) * self.y) / len(self.y)
        value = float((weight * (np.logaddexp(0, z) - self.y * z)).sum() + self.decay / 2 * (w[:-1] @ w[:-1]))
        pull = (1 / (1 + np.exp(-z)) - self.y) * weight
        g = np.append(np.bincount(self.col, pull[self.row], self.features) + self.decay * w[:-1], pull.sum())
        if self.swaps:
            at, feature, by = self.swap
            change = np.bincount(at, by * w[:-1][feature], self.swaps)
            value += self.balance / self.swaps * float(change @ change)
            g[:-1] += 2 * self.balance / self.swaps * np.bincount(feature, by * change[at], self.features)
        return value, g


def fit(rows: Iterable[tuple[int, Iterable[bytes]]], identity: tuple = IDENTITY, balance: float = BALANCE, rounds: int = 300, found: int | None = None) -> Model:
    """Train on (label, words) rows."""
    given = Rows(rows)
    y = np.array(given.labels, float)
    positive, negative = int(y.sum()), len(y) - int(y.sum())
    if not positive or not negative:
        rate = min(max((positive + 0.01) / (len(y) + 0.1), 0.01), 0.99) if len(y) else 0.05
        return Model({}, float(np.log(rate / (1 - rate))))
    identity = (*identity, *found_terms(given, found))
    terms = {t.encode() for group in identity for t in group}
    number: dict[bytes, int] = {}
    coded = [np.array(sorted(number.setdefault(f, len(number)) for f in features_of(words)), np.int32) for _, words in given]
    row, col = np.repeat(np.arange(len(coded)), [len(c) for c in coded]), np.concatenate(coded)
    del coded
    a = np.bincount(col, y[row], len(number))
    b = np.bincount(col, minlength=len(number)) - a
    chi = chi_squared(a, b, positive, negative)
    chi[a + b < LEAST] = 0
    take = chi >= EVIDENCE
    if take.sum() > VOCABULARY:
        take = chi > np.partition(chi, -VOCABULARY)[-VOCABULARY]
    for t in terms & number.keys():
        take[number[t]] = True
    names = [f for f, i in number.items() if take[i]]
    place = np.full(len(number), -1)
    place[[number[f] for f in names]] = np.arange(len(names))
    at = {f: i for i, f in enumerate(names)}
    row, col = row[place[col] >= 0], place[col][place[col] >= 0]
    swap, swaps = [], 0
    for _, words in given:
        for change in differences(words, swapped(words, identity)) if not words.isdisjoint(terms) else ():
            swap += [(swaps, at[f], v) for f, v in sorted(change.items()) if f in at]
            swaps += 1
    parts = tuple(np.array([s[i] for s in swap], np.int64 if i < 2 else float) for i in range(3))
    problem = Problem(y, row, col, parts, swaps, len(names), balance)
    w, m, v = (np.zeros(len(names) + 1) for _ in range(3))
    for step in range(1, rounds + 1):
        _, g = problem.at(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Model({f: float(x) for f, x in zip(names, w[:-1], strict=True) if abs(x) > 1e-3}, float(w[-1]), identity, swaps)


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(y, t, k)``: labels and texts of at most ``limit`` labelled documents, those first in a hashed order of ids.

    Labels are one a document (the greatest of several); the sampled ids, bounded
    by ``limit``, are what is broadcast to the scan of the texts.
    """
    one = labels.where(F.col(label_col).isNotNull() & usable).groupBy(F.col(id_col).alias("id_")).agg(F.max(label_col).cast("int").alias("y"))
    total = one.count()
    ticket = F.shiftrightunsigned(F.xxhash64("id_"), 11) / F.lit(float(1 << 53))
    drawn = one.where(ticket < (min(1.0, 1.2 * limit / total + 1e-9) if total else 0.0)).withColumn("k", ticket).orderBy("k", "id_").limit(limit)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id_"), utf8(text_col).alias("t"))
    return texts.join(F.broadcast(drawn), "id_").select("y", "t", "k")


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", identity: tuple = IDENTITY, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the usable labelled documents.

    Tasks reduce the texts to their distinct words before the driver gets them.
    """
    drawn = labelled_sample(docs, labels, usable, label_col, sample, id_col, text_col)

    def start() -> Callable:
        return lambda data: (b" ".join(sorted(words_of(data))),)

    found = map_texts(drawn, start, "words binary", ["y", "k"], "t", ["words"]).dropDuplicates().orderBy("k", "y", "words").limit(2 * sample)
    return fit(((r.y, bytes(r.words).split()) for r in found.toLocalIterator()), identity)


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns with ``score`` and ``predicted`` for every whole text.

    Null counts as empty and, like every text without a feature of the model, gets
    the score of the bias; so does everything if no row could be learned from.  A
    word counts once a text, whatever the text's length; texts with the same words
    have the same score.  Of several labels of a document the greatest counts;
    repeated rows give repeated rows, an empty table none; kept columns with the
    names of the results are replaced.
    """
    out = map_texts(docs, model.scorer, "score double", [c for c in keep if c != "predicted"], text_col, ["score"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Learn from rows whose id's crc32 leaves no 2 modulo 4, then score all rows."""
    held_out = remainder(id_col, 4) == 2
    model = train(docs, labels, ~held_out, "toxic", id_col, text_col)
    return scored(docs, model, keep if keep is not None else [id_col], text_col).withColumn("held_out", held_out)


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "held_out", "score", "predicted")
