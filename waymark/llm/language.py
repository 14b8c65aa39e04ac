"""Language identification by words first: known words vote by their frequency in each language, unknown ones back off to shorter and shorter n-grams.

The model has, for each level (words, then character n-grams from ``LONGEST`` down to 1, taken from words between blanks), the most frequent
entries of each language with their counts in all languages. A word of a text is scored by its per-language log frequency if any language
knows it; else by the mean over those of its n-grams that are known, at the longest length that has any. A language that lacks an entry is
charged as if it had been seen half a time. A text's score is the sum over its words, and the share of the best language among all is its confidence.

Fitted on a bounded sample: ``label_rows`` labelled rows per language, by hash order (half of ``entries`` goes to the words, the rest to the
n-gram lengths, shared among the languages), so the model that tasks hold is bounded whatever the corpus. All rows are scored, on their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import small_batches, staged

LONGEST = 5
UNKNOWN = "und"
#: Letters with the marks on them, as both sides read them.
WORD = r"\p{L}[\p{L}\p{M}]*"
#: Words not in the model whose scores a task remembers, and words of a text that are looked up at a time.
REMEMBERED = 100_000
AT_ONCE = 20_000


@dataclass(frozen=True)
class Model:
    """``rows[level][entry]`` is a row of ``table``: log frequencies by language. Level 0 is words, level n its n-grams."""

    languages: list[str]
    rows: list[dict[str, int]]
    table: np.ndarray
    prior: np.ndarray


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: crc32 of the key as text is a multiple of 5. False for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", label_rows: int = 5000, entries: int = 120_000, languages: int = 50) -> Model:
    """Learn from the rows that have a key that isn't held out, a text and a label; of more than ``languages`` labels, the most frequent."""
    seen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).alias("lang"))
    seen = seen.where(F.col("key").isNotNull() & ~held_out(F.col("key")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = seen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    names = sorted(r["lang"] for r in total)
    if not names:
        return Model([], [{} for _ in range(LONGEST + 1)], np.zeros((0, 0), np.float32), np.zeros(0))
    hashed = F.xxhash64("key", F.lit("sample"))
    # the share of hashes that holds label_rows rows of a language and a margin; the cut to label_rows follows
    share = F.create_map(*[x for r in total for x in (F.lit(r["lang"]), F.lit(min(1.0, (label_rows + 6 * label_rows**0.5) / r["count"])))])
    drawn = seen.where(F.pmod(hashed, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).withColumn("h", hashed)
    kept = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key", F.xxhash64("text")))).where(F.col("rank") <= label_rows)
    words = kept.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("entry"))
    counts = staged(words.groupBy("lang", "entry").agg(F.count(F.lit(1)).alias("n")), "language-words")

    around = F.concat(F.lit(" "), F.col("entry"), F.lit(" "))
    size = F.length(around)
    grams = [counts.select(F.lit(0).alias("level"), "lang", "entry", "n")]
    for n in range(1, LONGEST + 1):
        each = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i, n=n: F.substr(around, i, F.lit(n)))
        part = counts.where(size >= n).select("lang", F.explode(each).alias("entry"), "n").groupBy("lang", "entry").agg(F.sum("n").alias("n"))
        grams.append(part.select(F.lit(n).alias("level"), "lang", "entry", "n"))
    every = grams[0]
    for part in grams[1:]:
        every = every.unionByName(part)
    every = staged(every, "language-counts")
    sums = {(r["level"], r["lang"]): (r["n"], r["types"]) for r in every.groupBy("level", "lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    per = {level: max(1, entries // len(names) // (2 if level == 0 else 2 * LONGEST)) for level in range(LONGEST + 1)}
    limit = F.when(F.col("level") == 0, per[0]).otherwise(per[1])
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("level", "lang").orderBy(F.desc("n"), "entry")))
    chosen = best.where((F.col("rank") <= max(per.values())) & (F.col("rank") <= limit)).select("level", "entry").distinct()
    cells = every.join(chosen, ["level", "entry"], "left_semi").orderBy("level", "entry").toPandas()

    at = {name: k for k, name in enumerate(names)}
    rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    for level, entry in zip(cells["level"], cells["entry"], strict=True):
        rows[level].setdefault(entry, sum(map(len, rows)))
    found = np.full((sum(map(len, rows)), len(names)), 0.5)
    place = [rows[level][entry] for level, entry in zip(cells["level"], cells["entry"], strict=True)]
    found[place, [at[x] for x in cells["lang"]]] = cells["n"]
    table = np.empty(found.shape, np.float32)
    for level in range(LONGEST + 1):
        mine = np.fromiter(rows[level].values(), np.int64, len(rows[level]))
        whole = np.array([sum(sums.get((level, name), (0, 0))) + 1 for name in names], float)
        table[mine] = np.log(found[mine] / whole)
    size_of = np.array([next(r["count"] for r in total if r["lang"] == name) for name in names], float)
    return Model(names, rows, table, np.log(size_of / size_of.sum()))


class Scorer:
    """Scores texts; remembers the scores of words that the model doesn't have, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.word = model, regex.compile(WORD)
        self.table = np.concatenate([model.table, np.zeros((REMEMBERED + AT_ONCE, len(model.languages)), np.float32)])
        self.known, self.added = dict(model.rows[0]), []

    def unseen(self, word: str) -> np.ndarray:
        around = f" {word} "
        for n in range(LONGEST, 0, -1):
            known = self.model.rows[n]
            hits = [k for i in range(len(around) - n + 1) if (k := known.get(around[i : i + n])) is not None]
            if hits:
                return self.model.table[hits].mean(0)
        return np.zeros(len(self.model.languages), np.float32)

    def places(self, words: list[str]) -> list[int]:
        if len(self.added) > REMEMBERED:
            for word in self.added:
                del self.known[word]
            self.added = []
        for word in {w for w in words if w not in self.known}:
            row = len(self.model.table) + len(self.added)
            self.table[row] = self.unseen(word)
            self.known[word] = row
            self.added.append(word)
        return [self.known[w] for w in words]

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = self.word.findall((text or "").lower())
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        total = self.model.prior.copy()
        for a in range(0, len(words), AT_ONCE):
            total += self.table[self.places(words[a : a + AT_ONCE])].sum(0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def identify(model: Model, text: Column) -> Column:
    """struct(lang, score) of each whole text: ``und`` and 0 where it is null or has no letter, or nothing was learnt; of equal languages the first by name."""

    @F.pandas_udf("lang string, score double")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame([scorer(t) for t in batch], columns=["lang", "score"])

    return identified(text)


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", label_rows: int = 5000) -> DataFrame:
    """key, held_out, lang_pred, score for every row; keys and labels are learnt from and never looked at in a prediction.

    Repeated rows are predicted alike; other columns aren't read, whatever their names. An empty table gives no rows.
    """
    found = identify(fit(docs, key, text, label, label_rows), F.col("__text"))
    rows = small_batches(docs).select(F.col(key).alias("__key"), F.col(text).alias("__text")).withColumn("__found", found)
    return rows.select(F.col("__key").alias(key), held_out(F.col("__key")).alias("held_out"), F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"))
