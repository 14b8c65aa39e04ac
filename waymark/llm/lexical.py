"""Ranked lexical search: one automaton of all items' terms reads the documents, no index of the documents is made.

The terms of all items form an Aho-Corasick automaton. A term is guarded by a blank on either side and whatever isn't part of a term is a
blank in the text, so only whole terms are found, and the same blank ends one term and begins the next. A first scan counts document
frequencies and sizes, one small row set per task; a second counts term frequencies straight from the text, weighs them, maps the
automaton's outputs to the items that have the term, and keeps each item's best documents of its task. Nothing is shuffled but these.

Items are dealt into slices of about ``slice_terms`` terms, so what a task holds is bounded by that and by the longest item, however many
items there are; each slice is a pair of scans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import small_batches, staged

K1, B = 8, 75
#: Cells (document, item) worked on at a time.
CELLS = 2_000_000
TERM_BYTES = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
_BLANKED = bytes(ord(chr(c).lower()) if c < 0x80 and c in TERM_BYTES else c if c >= 0x80 else 32 for c in range(256))
OUTPUT = itemgetter(1)


def blanked(text: str | None) -> bytes:
    """UTF-8 of the text between two blanks, A-Z lower-cased, a blank for each character that isn't part of a term."""
    return b" " + (text or "").encode("utf-8", "replace").translate(_BLANKED) + b" "


def n_terms(data: bytes) -> int:
    inside = np.frombuffer(data, np.uint8) != 32
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        made.add_word((b" " + term + b" ").decode("latin-1"), k)
    made.make_automaton()
    return made


def found(made: ahocorasick.Automaton, data: bytes) -> Counter:
    """Term number to frequency."""
    return Counter(map(OUTPUT, made.iter(data.decode("latin-1")))) if len(made) else Counter()


@dataclass(frozen=True)
class Slice:
    """Terms of some items; ``starts[t] : starts[t + 1]`` are the places in ``items`` and ``times`` of term t."""

    terms: list[bytes]
    numbers: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray


def make_slice(rows: list[tuple[int, bytes, int]]) -> Slice:
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    terms = sorted({r[1] for r in rows})
    numbers = np.unique(np.array([r[0] for r in rows], np.int64))
    at = {t: k for k, t in enumerate(terms)}
    starts = np.searchsorted(np.array([at[r[1]] for r in rows], np.int64), np.arange(len(terms) + 1))
    return Slice(terms, numbers, starts, np.searchsorted(numbers, np.array([r[0] for r in rows], np.int64)), np.array([r[2] for r in rows], np.int64))


def statistics(docs: DataFrame, part: Slice) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each term of the slice, over all documents."""
    terms = part.terms

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, df, docs_with, total = automaton(terms), np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for text in batch["text"]:
                data = blanked(text)
                n = n_terms(data)
                if n:
                    docs_with, total = docs_with + 1, total + n
                    df[list(found(made, data))] += 1
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-2, -1, seen], "n": np.r_[docs_with, total, df[seen]]})

    rows = small_batches(docs).select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    by = {r["term"]: r["n"] for r in rows}
    return by.get(-2, 0), by.get(-1, 0), np.array([by.get(t, 0) for t in range(len(terms))], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The ``k`` best rows of each item so far: score downwards, rows without a key last, then the key upwards."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k, self.kth = k, np.zeros(n_items, np.int64)
        self.held = pd.DataFrame({"item": np.empty(0, np.int64), "score": np.empty(0, np.int64), "no_key": np.empty(0, bool), "key": np.empty(0, object)})

    def add(self, scores: np.ndarray, no_key: np.ndarray, key: np.ndarray) -> None:
        least = np.maximum(self.kth, 1)
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, item = np.nonzero(scores >= least)
        if not len(row):
            return
        new = pd.DataFrame({"item": item, "score": scores[row, item], "no_key": no_key[row], "key": key[row]})
        both = pd.concat([self.held, new], ignore_index=True) if len(self.held) else new
        both = both.sort_values(["item", "score", "no_key", "key"], ascending=[True, False, True, True], kind="stable", ignore_index=True)
        place = both.groupby("item").cumcount()
        self.held = both[place < self.k].reset_index(drop=True)
        full = both[place == self.k - 1]
        self.kth[full["item"].to_numpy(np.int64)] = full["score"].to_numpy(np.int64)


def ranked_slice(docs: DataFrame, part: Slice, k: int) -> DataFrame:
    """(number, score, no_key, key) of the best documents of each task for each item of the slice."""
    n_docs, total, df = statistics(docs, part)
    weight, terms, width = weights(n_docs, df), part.terms, np.diff(part.starts)

    def scores(data: list[bytes], made: ahocorasick.Automaton) -> np.ndarray:
        out = np.zeros((len(data), len(part.numbers)), np.int64)
        for row, text in enumerate(data):
            hits = found(made, text)
            if not hits:
                continue
            m = 100 - B + B * n_terms(text) * n_docs // total
            t, tf = np.fromiter(hits.keys(), np.int64, len(hits)), np.fromiter(hits.values(), np.int64, len(hits))
            value = weight[t] * (1_000_000_000 * tf // (1000 * tf + K1 * m))
            n = width[t]
            at = np.repeat(part.starts[t] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            np.add.at(out[row], part.items[at], part.times[at] * np.repeat(value, n))
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, best, step = automaton(terms), Best(len(part.numbers), k), max(1, CELLS // max(1, len(part.numbers)))
        for batch in batches:
            no_key, key = batch["no_key"].to_numpy(bool), batch["key"].to_numpy()
            for a in range(0, len(batch), step):
                some = slice(a, a + step)
                best.add(scores([blanked(t) for t in batch["text"].iloc[some]], made), no_key[some], key[some])
        held = best.held
        yield held.assign(number=part.numbers[held.pop("item").to_numpy(np.int64)])[["number", "score", "no_key", "key"]]

    return docs.mapInPandas(scan, f"number long, score long, no_key boolean, key {dict(docs.dtypes)['key']}")


def item_terms(items: DataFrame) -> DataFrame:
    """(number, term, times) of the items (number, text); terms as UTF-8."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, term, times) for n, text in zip(batch["number"], batch["text"], strict=True) for term, times in Counter(blanked(text).split()).items()]
            yield pd.DataFrame(rows, columns=["number", "term", "times"])

    return items.mapInPandas(cut, "number long, term binary, times long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", slice_terms: int = 200_000) -> DataFrame:
    """The ``k`` best documents of each item: (item, rank, key, score); score above 0, equal scores by ascending key, null keys last.

    Every row of either table counts for itself, repeated ones too. Null and empty texts have no terms: such an item gets no rows, such a
    document is in none. Other columns aren't read, whatever their names. Empty tables give no rows.
    """
    kind = dict(docs.dtypes)[key]
    rows = small_batches(docs).select(F.col(text).alias("text"), F.col(key).isNull().alias("no_key"), F.coalesce(F.col(key), F.lit(0).cast(kind)).alias("key"))
    asked = staged(items.select(F.monotonically_increasing_id().alias("number"), F.col(item).alias("item"), F.col(item_text).alias("text")), "items")
    wanted = staged(item_terms(asked.select("number", "text")), "item-terms")
    n_slices = max(1, math.ceil(wanted.count() / slice_terms))
    out = None
    for s in range(n_slices):
        mine = wanted.where(F.pmod(F.xxhash64("number"), F.lit(n_slices)) == s).collect()
        part = ranked_slice(rows, make_slice([(r["number"], bytes(r["term"]), r["times"]) for r in mine]), k)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "no_key", "key")
    top = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = top.join(asked.select("number", "item"), "number")
    return named.select(F.col("item").alias(item), "rank", F.when(~F.col("no_key"), F.col("key")).alias(key), "score")
