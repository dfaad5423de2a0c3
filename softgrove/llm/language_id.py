"""Language identification, word first with backoff to character n-grams.

A text is the sum of its words' log frequencies by language. A word that the
model does not know is scored by its longest character n-grams that the model
knows: the mean of their log frequencies, tried from the longest order down to
single characters. The language with the highest sum wins; the score is its
share of the languages' likelihoods (the sums taken as logarithms).

Bounds of the fit (documented parameters): ``max_docs`` labelled documents of
each language, drawn by a hash of the id over all of them, and the
``max_words`` and ``max_grams`` (of each order) most frequent entries, which are
broadcast. Counting is distributed. Scoring reads every whole text in one pass
without a shuffle, and keeps the scores of words met in a cache of bounded size.

A null text or one without a letter is ``und`` with score 0. So is every text if
there is nothing to learn from. Rows that repeat an id are scored one by one. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from softgrove.llm.common import small_batches, written

UNKNOWN = "und"
MAX_DOCS = 5_000
MAX_WORDS = 60_000
MAX_GRAMS = 20_000
LONGEST_GRAM = 4
MIN_COUNT = 3
CACHE_WORDS = 300_000
SMOOTHING = 0.5
#: runs of letters, as far as a pattern can say; the rest is checked by isalpha
RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return RUN.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    """Character n-grams of the word with its ends marked; single characters without the marks."""
    if order == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[k:k + order] for k in range(len(marked) - order + 1)]


@dataclass(frozen=True)
class LanguageModel:
    """``rows`` maps a word, or an n-gram after a zero byte, to its row of log frequencies by language."""

    languages: tuple[str, ...]
    rows: dict[str, int]
    scores: np.ndarray
    longest: int


class Scorer:
    """Scores of words with a cache; one per Python task."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.fresh()

    def fresh(self) -> None:
        n = len(self.model.languages)
        self.row: dict[str, int] = {}
        self.table = np.zeros((CACHE_WORDS + 1, n), np.float64)

    def evidence(self, word: str) -> np.ndarray:
        rows, scores = self.model.rows, self.model.scores
        if word in rows:
            return scores[rows[word]]
        for order in range(self.model.longest, 0, -1):
            known = [rows[g] for g in ("\0" + x for x in grams_of(word, order)) if g in rows]
            if known:
                return scores[known].mean(0)
        return np.zeros(len(self.model.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        found = Counter(words)
        for w in [w for w in found if not w.isalpha() and not any(c.isalpha() for c in w)]:
            del found[w]
        if not found or not self.model.languages:
            return UNKNOWN, 0.0
        new = [w for w in found if w not in self.row]
        if len(self.row) + len(new) > CACHE_WORDS:
            self.fresh()
            new = list(found)
        total = np.zeros(len(self.model.languages))
        for w in new:
            e = self.evidence(w)
            if len(self.row) < CACHE_WORDS:
                self.row[w] = len(self.row)
                self.table[self.row[w]] = e
            else:  # a single text with more words than the cache holds
                total += found[w] * e
        held = [(self.row[w], k) for w, k in found.items() if w in self.row]
        at, times = np.array(held, np.int64).T
        total += times @ self.table[at]
        best = int(np.argmax(total))
        share = np.exp(total - total[best])
        return self.model.languages[best], float(share[best] / share.sum())


def _counted(rows: DataFrame, make) -> DataFrame:
    """(language, order, gram, n) from batches through ``make``, counted in tasks and then over all."""
    schema = T.StructType([T.StructField("language", T.StringType()), T.StructField("order", T.IntegerType()),
                           T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            make(batch, counts)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())],
                schema=pa.schema([("language", pa.string()), ("order", pa.int32()), ("gram", pa.string()),
                                  ("n", pa.int64())]))

    return rows.mapInArrow(run, schema).groupBy("language", "order", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS,
        longest: int = LONGEST_GRAM, min_count: int = MIN_COUNT) -> LanguageModel:
    """Model from the rows for which ``learn`` holds and language and text are known."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.filter(learn & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[id_col].alias("id"), docs[lang_col].alias("language"), docs[text_col].alias("text"))
    sizes = {r["language"]: r["n"] for r in rows.groupBy("language").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), {}, np.zeros((0, 0)), longest)
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, max_docs / sizes[k])))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = rows.filter(draw < F.element_at(share, F.col("language"))).select("language", "text")

    def words(batch: pa.RecordBatch, counts: Counter) -> None:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w, k in Counter(words_of(text)).items():
                counts[language, 0, w] += k

    def grams(batch: pa.RecordBatch, counts: Counter) -> None:
        for language, w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for order in range(1, longest + 1):
                for g in grams_of(w, order):
                    counts[language, order, g] += k

    by_word = written(_counted(rows, words), "language-words")
    by_gram = written(_counted(by_word.select("language", "gram", "n"), grams), "language-grams")
    both = by_word.unionByName(by_gram).groupBy("order", "gram").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("by"))
    both = written(both.filter(F.col("total") >= min_count), "language-counts")
    index: dict[str, int] = {}
    values: list[np.ndarray] = []
    for order in range(longest + 1):
        part = both.filter(F.col("order") == order).orderBy(F.desc("total"), "gram")
        top = part.limit(max_grams if order else max_words).collect()  # bounded by the parameters
        if not top:
            continue
        n = np.array([[r["by"].get(k, 0) for k in languages] for r in top], float)
        for r in top:
            index[("\0" if order else "") + r["gram"]] = len(index)
        size = np.maximum(n.sum(0), 1)  # an entry that a language lacks weighs the same for all languages
        values.append(np.log(n / size + SMOOTHING / size.max()))
    scores = np.concatenate(values) if values else np.zeros((0, len(languages)))
    return LanguageModel(languages, index, scores, longest)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with one more column ``__language``: lang_pred and score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(schema)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in parts:
            found = [scorer.predict(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())],
                                             names=["lang_pred", "score"])

    return docs.withColumn("__language", run(docs[text_col]))
