"""Language identification by words first, backing off to character n-grams.

A known word adds its log frequency in each language. An unseen word adds the
mean log frequency of its longest known n-grams: those of five characters, else
of four, down to one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, fold, table

#: Bounds of the fitted model and of the sample that it is fitted on.
TRAIN_DOCS_PER_LANG = 4000
KNOWN_WORDS, KNOWN_GRAMS = 20_000, 4_000
#: Words, and n-grams of each size, of all languages together; shared evenly among them.
ALL_WORDS, ALL_GRAMS = 2_000_000, 400_000
GRAM_SIZES = (5, 4, 3, 2, 1)
#: Entries of a worker's memory of unseen words, which is emptied when full.
MEMO = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters (Unicode category L); numerals such as ½ or Ⅷ part them."""
    out = []
    for w in LETTERS.findall(text.lower()):
        out += [w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split()
    return out


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and n-grams by language, summed within a batch."""
    for batch in batches:
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, Counter()).update(words(text))
        for lang, count in by_lang.items():
            sums: dict[int, Counter] = {n: Counter() for n in GRAM_SIZES}
            for w, c in count.items():
                for n in GRAM_SIZES:
                    for g in grams(w, n):
                        sums[n][g] += c
            for n, got in ((0, count), *sums.items()):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(got), pa.string()), pa.array([n] * len(got), pa.int32()), pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["lang", "size", "gram", "n"])


class Model:
    """Log frequencies by language; `tables[0]` has words, `tables[n]` n-grams."""

    def __init__(self, langs: list[str], docs: list[int], tables: dict[int, dict[str, np.ndarray]]):
        self.langs, self.tables = langs, tables
        self.prior = np.log(np.array(docs, float) / sum(docs)) if docs else np.zeros(0)
        self.forget()

    def forget(self) -> None:
        """Rows of `self.seen` by word; row 0 is zero, for words that tell nothing."""
        self.row: dict[str, int] = {}
        self.seen = np.zeros((1024, len(self.langs)))
        self.used = 1

    def unseen(self, word: str) -> np.ndarray | None:
        for n in GRAM_SIZES:
            known = [v for g in grams(word, n) if (v := self.tables[n].get(g)) is not None]
            if known:
                return sum(known) / len(known)
        return None

    def score(self, word: str) -> np.ndarray | None:
        v = self.tables[0].get(word)
        return self.unseen(word) if v is None else v

    def number(self, word: str) -> int:
        v = self.score(word)
        if v is None:
            self.row[word] = 0
            return 0
        if self.used == len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.seen[self.used] = v
        self.row[word] = self.used
        self.used += 1
        return self.used - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        count = Counter(words(text or ""))
        if not count or not self.langs:
            return "und", 0.0
        if len(self.row) >= MEMO:
            self.forget()
        row = self.row
        at = [row[w] if w in row else self.number(w) for w in count]
        total = self.prior + np.fromiter(count.values(), np.float64, len(count)) @ self.seen[at]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Fit on rows with a text and a language; of each language at most about
    TRAIN_DOCS_PER_LANG rows, chosen by a hash of the id. No language is left
    out; the more there are, the fewer words and n-grams of each are known.
    Repeated rows count each; an empty table gives a model that knows nothing."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], [], {n: {} for n in (0, *GRAM_SIZES)})
    langs = sorted(sizes)
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, TRAIN_DOCS_PER_LANG / sizes[lang]))])[F.col("lang")]
    sample = rows.filter(at < share).select("text", "lang")
    counts = checkpointed(sample.mapInArrow(_counted, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))
    totals = {(r["lang"], r["size"]): (r["n"], r["v"]) for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    order = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.when(F.col("size") == 0, min(KNOWN_WORDS, max(1, ALL_WORDS // len(langs)))).otherwise(min(KNOWN_GRAMS, max(1, ALL_GRAMS // len(langs)))))
    known = top.select("size", "gram").distinct()
    tables: dict[int, dict[str, np.ndarray]] = {n: {} for n in (0, *GRAM_SIZES)}
    index = {lang: i for i, lang in enumerate(langs)}
    floor = {n: np.array([math.log(0.5 / (totals.get((lang, n), (0, 0))[0] + 0.5 * (totals.get((lang, n), (0, 1))[1] + 1))) for lang in langs]) for n in tables}
    frame = counts.join(known, ["size", "gram"], "left_semi").toPandas()
    for lang, n, gram, c in zip(frame["lang"], frame["size"], frame["gram"], frame["n"]):
        i = index[lang]
        # Where a language lacks it, all languages have the same floor, or the smallest would be the likeliest.
        v = tables[n].setdefault(gram, np.full(len(langs), floor[n].min()))
        v[i] = floor[n][i] + math.log((c + 0.5) / 0.5)
    return Model(langs, [sizes[lang] for lang in langs], tables)


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row and whole text of `docs`.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if
    nothing was learned; a text of letters never met gets the most frequent
    language. score is the posterior share of that language. Repeated rows are
    predicted alike; extra columns are ignored. The model is broadcast; its size
    is bounded by KNOWN_WORDS, KNOWN_GRAMS, ALL_WORDS and ALL_GRAMS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predicted(shared), f"doc_id {kind}, lang_pred string, score double")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
