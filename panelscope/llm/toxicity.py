"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Instances are words. The kernel counts common subsequences of three characters,
each weighted by DECAY to the length that it spans, so gaps and inserted
characters cost weight but don't break a match. A document is as toxic as its
worst word: the machine is fitted on labelled documents as bags of words, where
a toxic bag's witness is chosen by the machine itself from round to round.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fold, lean, table

ORDER, DECAY = 3, 0.75
#: Longest instance; longer words are cut into overlapping windows of this length.
WINDOW = 22
#: Bounds of the labelled sample and of what is fitted on it.
TOXIC_DOCS, CLEAN_DOCS = 1500, 9000
POSITIVES, NEGATIVES, LANDMARKS, ROUNDS = 1500, 4000, 160, 3
#: Entries of a worker's memory of word scores, which is emptied when full.
MEMO = 150_000
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
GAPS = re.compile(r"[\s.\-_*]+")
SPELLED = re.compile(r"(?:(?<=\s)|^)\w(?:[\s.\-_*]+\w(?!\w)){2,}")
#: Words decided together; each length of word costs a fixed time per call.
AT_ONCE = 50_000
NOTHING = -1.5
#: Most weights held as a table of all triples of letters; larger alphabets are searched.
CELLS = 4_000_000


def word_instances(w: str) -> list[str]:
    """Instances of one lower-case token: without punctuation at its ends, between boundary marks."""
    if not w.isalnum():
        w = EDGE.sub("", w)
    if len(w) > WINDOW:
        return [w[i : i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)]
    return [f"^{w}$"] if len(w) > 1 else []


def spelled(low: str) -> list[str]:
    """Instances of runs of single characters, joined."""
    out = []
    for w in SPELLED.findall(low):
        run = GAPS.sub("", w)
        out += [f"^{run[i : i + WINDOW]}$" for i in range(0, max(1, len(run) - WINDOW // 2), WINDOW // 2)]
    return out


def instances(text: str) -> set[str]:
    """Distinct instances of a text's words and spelled-out runs."""
    low = text.lower()
    return {x for w in {*low.split()} for x in word_instances(w)} | {*spelled(low)}


def codes(strings: list[str]) -> np.ndarray:
    """Code points of strings of equal length."""
    n = len(strings[0])
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)


def self_kernel(c: np.ndarray) -> np.ndarray:
    """Subsequence kernel of each row with itself."""
    n, size = c.shape
    t = np.ascontiguousarray(c.T)
    inner = None
    for step in range(ORDER):
        new, total = np.zeros((size + 1, size + 1, n)), np.zeros(n)
        for i in range(1, size + 1):
            row = np.zeros(n)
            for j in range(1, size + 1):
                hit = (t[i - 1] == t[j - 1]) * (DECAY**2)
                if inner is not None:
                    hit = hit * inner[i - 1, j - 1]
                total += hit
                row = DECAY * row + hit
                new[i, j] = DECAY * new[i - 1, j] + row
        inner = new
    return total


def triples(size: int) -> Iterator[tuple[int, int, int, float]]:
    for i in range(size - 2):
        for k in range(i + 2, size):
            for j in range(i + 1, k):
                yield i, j, k, DECAY ** (k - i + 1)


def by_length(strings: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    sizes: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        sizes.setdefault(len(s), []).append(i)
    for own in sizes.values():
        for at in range(0, len(own), 2000):
            yield own[at : at + 2000], codes([strings[i] for i in own[at : at + 2000]])


def least_norm(size: int) -> float:
    """No instance of `size` characters has a smaller norm: that of one without a repeated subsequence."""
    return math.sqrt(max(sum((size - s) * (s - 1) * DECAY ** (2 * s + 2) for s in range(ORDER - 1, size)), 1e-12))


def norms(strings: list[str]) -> np.ndarray:
    out = np.ones(len(strings))
    for own, c in by_length(strings):
        out[own] = np.sqrt(np.maximum(self_kernel(c), 1e-12))
    return out


def _triple_codes(c: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Letter numbers from 1; 0 stands for letters outside `letters`."""
    at = np.minimum(np.searchsorted(letters, c), len(letters) - 1)
    return np.where(letters[at] == c, at + 1, 0).astype(np.int64)


def cross(strings: list[str], marks: list[str]) -> np.ndarray:
    """Normalised kernel of all strings with all landmarks, over the subsequences
    that occur in a landmark."""
    letters = np.unique(np.concatenate([codes([m])[0] for m in marks]))
    n = len(letters) + 1
    parts = []
    for r, m in enumerate(marks):
        k = _triple_codes(codes([m]), letters)[0]
        parts += [((k[i] * n + k[j]) * n + k[x], r, w) for i, j, x, w in triples(len(k))]
    known, col = np.unique(np.array([p[0] for p in parts], np.int64), return_inverse=True)
    phi = np.zeros((len(known) + 1, len(marks)), np.float32)  # the last row stands for subsequences of no landmark
    np.add.at(phi, (col, np.array([p[1] for p in parts])), np.array([p[2] for p in parts], np.float32))
    out = np.zeros((len(strings), len(marks)))
    for own, c in by_length(strings):
        k = _triple_codes(c, letters)
        for i, j, x, w in triples(c.shape[1]):
            code = (k[:, i] * n + k[:, j]) * n + k[:, x]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = np.flatnonzero(known[at] == code)
            if len(hit):
                out[np.array(own)[hit]] += w * phi[at[hit]]
    return out / norms(strings)[:, None] / norms(marks)[None, :]


@dataclass
class Model:
    """The machine's decision as a sum over landmarks, collapsed into one weight for
    each subsequence of three characters that occurs in a landmark."""

    letters: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = NOTHING
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, strings: list[str]) -> np.ndarray:
        """Sum over each instance's weighted subsequences, before its norm."""
        out, n = np.zeros(len(strings)), len(self.letters) + 1
        if not len(self.codes):
            return out
        dense = None
        if n**ORDER <= CELLS:
            dense = np.zeros(n**ORDER)
            dense[self.codes] = self.weights
        for own, c in by_length(strings):
            if c.shape[1] < ORDER:
                continue
            k = np.ascontiguousarray(_triple_codes(c, self.letters).T)
            first, second, total = k * (n * n), k * n, np.zeros(len(c))
            for i, x in combinations(range(c.shape[1]), 2):
                if x - i > 1:
                    ends = first[i] + k[x]
                    total += DECAY ** (x - i + 1) * sum(self._weight(dense, ends + second[j]) for j in range(i + 1, x))
            out[own] = total
        return out

    def _weight(self, dense: np.ndarray | None, code: np.ndarray) -> np.ndarray:
        """Weights by code: from a table of all codes where that is small, else by search."""
        if dense is not None:
            return dense[code]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.weights[at], 0.0)

    def decide(self, strings: list[str]) -> np.ndarray:
        """Decision value of each instance: sum over its subsequences' weights,
        divided by its norm."""
        out = self.raw(strings)
        live = np.flatnonzero(out > 0)  # only these can exceed the bias; the rest need no norm
        if len(live):
            out[live] /= norms([strings[i] for i in live])
        return np.maximum(out, 0) + self.bias

    def probability(self, worst: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * worst + self.shift))))


def collapse(marks: list[str], beta: np.ndarray, bias: float) -> Model:
    letters = np.unique(np.concatenate([codes([m])[0] for m in marks]))
    n = len(letters) + 1
    parts = []
    for m, b, norm in zip(marks, beta, norms(marks)):
        k = _triple_codes(codes([m]), letters)[0]
        parts += [((k[i] * n + k[j]) * n + k[x], b / norm * w) for i, j, x, w in triples(len(k))]
    known, at = np.unique(np.array([p[0] for p in parts], np.int64), return_inverse=True)
    return Model(letters, known, np.bincount(at, weights=[p[1] for p in parts], minlength=len(known)), bias)


def choose_landmarks(strings: list[str], n: int) -> list[str]:
    """Farthest first among at most 2 x n strings: each landmark is the one least
    like those chosen."""
    strings = strings[: 2 * n]
    if len(strings) <= n:
        return strings
    gram, chosen = cross(strings, strings), [0]
    near = gram[0]
    while len(chosen) < n and near.min() < 0.999:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, gram[chosen[-1]])
    return [strings[i] for i in chosen]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on its support vectors."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        sv = y * (z @ w) < 1
        zs = z[sv] * (c * weight[sv])[:, None]
        new = np.linalg.solve(ridge + zs.T @ z[sv], zs.T @ y[sv])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(positives: dict[str, int], negatives: list[str]) -> Model:
    """`positives` counts the toxic bags that each word is the witness of."""
    marks = choose_landmarks(sorted(positives, key=lambda w: (-positives[w], w)), LANDMARKS * 3 // 4)
    marks += choose_landmarks([s for s in negatives if s not in positives], LANDMARKS - LANDMARKS * 3 // 4)
    value, vector = np.linalg.eigh(cross(marks, marks))
    keep = value > 1e-4
    whiten = vector[:, keep] / np.sqrt(value[keep])
    strings = [*positives, *negatives]
    y = np.array([1.0] * len(positives) + [-1.0] * len(negatives))
    weight = np.concatenate([np.array(list(positives.values()), float) / sum(positives.values()), np.full(len(negatives), 1 / len(negatives))]) * len(y) / 2
    w, b = svm(cross(strings, marks) @ whiten, y, weight)
    return collapse(marks, whiten @ w, b)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [sorted(instances(t or "")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.list_(pa.string()))], names=["toxic", "words"])


def _worst(shared):
    """Label, decision value and word of each bag's worst instance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                bags = part.column(1).to_pylist()
                flat = list({w for b in bags for w in b})
                value = dict(zip(flat, shared.value.decide(flat).tolist()))
                worst = [max(b, key=lambda w: (value[w], w), default=None) for b in bags]
                score = [NOTHING if w is None else value[w] for w in worst]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(worst, pa.string())], names=["toxic", "f", "word"])

    return run


def _counts(words: DataFrame) -> dict[str, int]:
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(POSITIVES)
    return {r["word"]: r["count"] for r in top.collect()}


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows: about TOXIC_DOCS and CLEAN_DOCS,
    chosen by a hash of the id. Of several labels of an id the largest holds;
    null labels, ids and texts are left out."""
    spark = docs.sparkSession
    truth = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in truth.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(shift=math.log((sizes.get(1, 0) + 0.5) / (sizes.get(0, 0) + 1.5)), slope=0.0)
    share = F.when(F.col("toxic") == 1, TOXIC_DOCS / sizes[1]).otherwise(CLEAN_DOCS / sizes[0])
    some = truth.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = F.broadcast(some).join(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL"), "_id").select("toxic", "text")
    bags = checkpointed(rows.mapInArrow(lean(_bags), "toxic int, words array<string>").distinct())
    drawn = bags.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    base = (drawn["t"] or 0) / max(drawn["n"], 1)
    words = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    gain = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base) + 1e-9)
    words = checkpointed(words.withColumn("z", gain))
    # The first witness of a toxic bag is its word that marks toxic bags most clearly.
    toxic = bags.filter("toxic = 1").select(F.xxhash64("words").alias("bag"), F.explode("words").alias("word"))
    first = toxic.join(words.filter("t >= 1"), "word").groupBy("bag").agg(F.max_by("word", F.struct("z", "word")).alias("word"))
    positives = _counts(first)
    clean = words.filter("t < 0.5 * n").select("word", "n")
    common = clean.orderBy(F.desc("n"), "word").limit(NEGATIVES // 2)
    random = clean.orderBy(F.xxhash64("word")).limit(NEGATIVES // 2)
    negatives = sorted({r["word"] for r in common.union(random).collect()} - set(positives))
    if not positives or not negatives:
        return Model(shift=math.log((sizes[1] + 0.5) / (sizes[0] + 0.5)), slope=0.0)
    model = fit(positives, negatives)
    for _ in range(ROUNDS):
        seen = checkpointed(bags.mapInArrow(lean(_worst(spark.sparkContext.broadcast(model))), "toxic int, f double, word string"))
        # Where the machine errs on a clean bag, its worst word is a negative; a toxic bag's worst word is its witness.
        hard = {r["word"] for r in seen.filter("toxic = 0 AND f > -0.5 AND word IS NOT NULL").groupBy("word").agg(F.max("f").alias("f")).orderBy(F.desc("f"), "word").limit(NEGATIVES // 2).collect()}
        positives = {w: n for w, n in _counts(seen.filter("toxic = 1 AND word IS NOT NULL")).items() if w not in hard} or positives
        negatives = sorted(({*negatives} | hard) - set(positives))
        model = fit(positives, negatives)
    shared = spark.sparkContext.broadcast(model)
    seen = bags.mapInArrow(lean(_worst(shared)), "toxic int, f double, word string").select("toxic", "f").toPandas()
    model.slope, model.shift = calibrate(seen["f"].to_numpy(), seen["toxic"].to_numpy())
    return model


def calibrate(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the worst words' decision values; its middle is put
    where the fewest sample documents err, halfway between their values."""
    order = np.argsort(f, kind="stable")
    f, y = f[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum() - np.concatenate([[0], np.cumsum(1 - y)]))
    edge = np.concatenate([[f[0] - 1], (f[:-1] + f[1:]) / 2, [f[-1] + 1]])
    ok = np.concatenate([[True], f[1:] > f[:-1], [True]])
    best = np.flatnonzero(ok & (wrong == wrong[ok].min()))
    middle = float(edge[best[len(best) // 2]])
    if len(best) == 1 and 0 < best[0] < len(f):
        middle = float((f[best[0] - 1] + f[best[0]]) / 2)
    return 5.0, -5.0 * middle


class _Memory:
    """Numbers of the instances met so far, with their decision values. An instance
    has an upper bound until it may be a document's worst; then its norm is taken."""

    def __init__(self, model: Model):
        self.model = model
        self.least = np.array([least_norm(n) for n in range(WINDOW + 3)])
        self.clear()

    def clear(self) -> None:
        self.tokens: dict[str, int] = {}  # -1: no instance, or several
        self.several: dict[str, list[int]] = {}
        self.number: dict[str, int] = {}
        self.strings: list[str] = []
        self.value, self.exact = np.zeros(0), np.zeros(0, bool)

    def numbers(self, text: str) -> np.ndarray:
        low = text.lower()
        words = {*low.split()}
        for w in [w for w in words if w not in self.tokens]:
            own = [self._number(x) for x in word_instances(w)]
            self.tokens[w] = own[0] if len(own) == 1 else -1
            if len(own) > 1:
                self.several[w] = own
        out = np.fromiter(map(self.tokens.__getitem__, words), np.int32, len(words))
        more = [n for w in words if w in self.several for n in self.several[w]] + [self._number(x) for x in spelled(low)]
        return np.concatenate([out[out >= 0], np.array(more, np.int32)])

    def _number(self, x: str) -> int:
        n = self.number.setdefault(x, len(self.strings))
        if n == len(self.strings):
            self.strings.append(x)
        return n

    def waiting(self) -> int:
        return len(self.strings) - len(self.value)

    def _settle(self, some: np.ndarray) -> None:
        some = np.unique(some[~self.exact[some]])
        if len(some):
            self.value[some] = self.model.decide([self.strings[i] for i in some])
            self.exact[some] = True

    def worst(self, bags: list[np.ndarray]) -> list[float]:
        if self.waiting():
            new = self.strings[len(self.value) :]
            raw = self.model.raw(new)
            bound = np.maximum(raw, 0) * (1 + 1e-9) / self.least[[len(x) for x in new]] + self.model.bias
            self.value, self.exact = np.append(self.value, bound), np.append(self.exact, raw <= 0)
        out = np.full(len(bags), NOTHING)
        full = [i for i, b in enumerate(bags) if len(b)]
        if full:
            flat, size = np.concatenate(bags), [len(bags[i]) for i in full]
            start = np.cumsum([0, *size[:-1]])
            self._settle(flat[self.value[flat] == np.repeat(np.maximum.reduceat(self.value[flat], start), size)])
            known = np.maximum.reduceat(np.where(self.exact[flat], self.value[flat], -np.inf), start)
            self._settle(flat[self.value[flat] > np.repeat(known, size)])
            out[full] = np.maximum.reduceat(np.where(self.exact[flat], self.value[flat], -np.inf), start)
        return out.tolist()


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(shared.value)
        for batch in batches:
            score, bags = [], []
            for text in batch.column(1):
                bags.append(memory.numbers(text.as_py() or ""))
                if memory.waiting() >= AT_ONCE:
                    score += map(memory.model.probability, memory.worst(bags))
                    bags = []
                    if max(len(memory.strings), len(memory.tokens)) > MEMO:
                        memory.clear()
            score += map(memory.model.probability, memory.worst(bags))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for each row and whole text of `docs`.

    Every word of a text is scored; words beyond WINDOW characters in overlapping
    windows. Null and empty texts have no word and get a low score. Without
    labels of both kinds every text gets their share as its score. Repeated rows
    are scored alike; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(lean(_scored(shared)), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))


def drop_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that aren't predicted toxic, with all their columns. Null and
    empty texts have no word and stay unless the model knows no words at all;
    repeated rows fare alike; an empty table gives an empty one."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["doc_id", "text"])
            mask = [s < 0.5 for b in _scored(shared)(iter([two])) for s in b.column(1).to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
