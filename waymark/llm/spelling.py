"""Spelling variants: words that differ by one edit, grouped under their most frequent form.

Words are counted over whole texts by Spark. Near words are found by blocked Gram matrices: words of one length and of the next form
adjacent length blocks, each word is a vector of letter counts, and one NumPy product of two blocks gives all squared distances at once.
One edit changes the counts by a squared distance of 1 (a letter more) or 2 (a letter replaced), so pairs beyond two are dropped and the
few that are left are verified letter by letter.

Whole length blocks would be quadratic in the vocabulary. One edit leaves either the first or the second half of the shorter word as it
is, so a length block is divided by the words' first halves, and once more by their second halves: no near pair is lost, and a pair that
agrees in both is counted once. A division of many words is dealt over tasks as pairs of sub-blocks. A task returns one row per
word (number of near words, best of them), never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_ROWS, UPPER, heavy_keys, salted_join, staged

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Words in a sub-block; a task holds two of them at a time.
BLOCK = 2048
#: Words of small divisions that go through one product together.
TOGETHER = 256
#: Rows of a product at a time.
STRIP = 512
LETTERS = 26 + 64
_LETTER = np.zeros(256, np.int64)
_LETTER[ord("a") : ord("z") + 1] = np.arange(26)
_LETTER[0xC0:0x100] = np.arange(26, LETTERS)

NEAR = "word string, n_near long, best_n long, best string"


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_n: int = 3, typo: int | None = 97) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z lower-cased, with ``least_length`` code points and ``least_n`` occurrences at least.

    With ``typo``, a run whose crc32 with its document's key is a multiple of it loses one letter first: planted misspellings. A null
    text has no runs, a null key reads as an empty one. Repeated rows count each time.
    """
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    low = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))
    words = runs.select("id", low.alias("word"))
    if typo:
        crc = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = crc.select(F.when(F.col("h") % typo == 0, shorter).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def divisions(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each word in the divisions where its near words are: (size, side, half, i, j, longer, part, word, n).

    ``size`` is the length of the shorter word of a pair, ``side`` says which half is equal; (i, j) is a pair of sub-blocks of a division.
    """
    word, length, places = F.col("word"), F.length("word"), []
    for longer in (0, 1):
        size = (length - longer).cast("int")
        middle = F.floor(size / 2).cast("int")
        for side, half in ((0, F.substr(word, F.lit(1), middle)), (1, F.substr(word, middle + 1 + longer))):
            places.append(F.struct(size.alias("size"), F.lit(side).alias("side"), half.alias("half"), F.lit(longer).alias("longer")))
    keys = ["size", "side", "half"]
    rows = words.select("word", "n", F.inline(F.array(*places)))
    large = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block)
    large = staged(large.withColumn("parts", F.ceil(F.col("__n") / block).cast("int")).drop("__n"), "divisions")
    rows = rows.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, keys, "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(*keys, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "longer", "part", "word", "n")


def codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length)


def letter_counts(code: np.ndarray) -> np.ndarray:
    at = np.arange(len(code))[:, None] * LETTERS + _LETTER[code]
    return np.bincount(at.ravel(), minlength=len(code) * LETTERS).reshape(len(code), LETTERS).astype(np.float32)


def close(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the rows of both blocks whose squared distance is two at most, from the product of the blocks."""
    left, right, yy = [], [], (y * y).sum(1)
    for a in range(0, len(x), STRIP):
        part = x[a : a + STRIP]
        i, j = np.nonzero((part * part).sum(1)[:, None] + yy - 2 * (part @ y.T) < 2.5)
        left.append(i + a)
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def one_edit(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which rows of ``u`` become those of ``v`` (as long, or longer by one) by one edit."""
    if u.shape[1] == v.shape[1]:
        return (u != v).sum(1) == 1
    head = np.cumprod(u == v[:, :-1], 1).sum(1)
    tail = np.cumprod((u == v[:, 1:])[:, ::-1], 1).sum(1)
    return head + tail >= u.shape[1]


def near_pairs(size: int, side: int, group: np.ndarray, longer: np.ndarray, part: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of near words among those of some divisions of one size and side; ``part`` is 0 or 1 where two sub-blocks meet, else -1."""
    short, long = np.flatnonzero(longer == 0), np.flatnonzero(longer == 1)
    code = {0: codes([words[k] for k in short], size), 1: codes([words[k] for k in long], size + 1)}
    count = {k: letter_counts(c) for k, c in code.items()}
    found = []
    for kind, other in ((0, short), (1, long)):
        for a, b in ((-1, -1), (0, 1), (1, 0)):
            if (a, kind) == (1, 0):
                continue  # two sub-blocks of equal lengths meet once
            rows, cols = np.flatnonzero(part[short] == a), np.flatnonzero(part[other] == b)
            if not len(rows) or not len(cols):
                continue
            i, j = close(count[0][rows], count[kind][cols])
            i, j = rows[i], cols[j]
            ok = group[short[i]] == group[other[j]]
            if kind == 0 and a == -1:
                ok &= i < j
            i, j = i[ok], j[ok]
            u, v = code[0][i], code[kind][j]
            ok = one_edit(u, v)
            if side == 1:
                ok &= ~(u[:, : size // 2] == v[:, : size // 2]).all(1)  # found by the first halves
            found.append((short[i[ok]], other[j[ok]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))


def best_near(i: np.ndarray, j: np.ndarray, words: list[str], n: np.ndarray) -> pd.DataFrame:
    """Per word of the pairs: how many near words, and the most frequent of them (ties: the least)."""
    of, near = np.r_[i, j], np.r_[j, i]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], of))
    of, near = of[order], near[order]
    which, first, count = np.unique(of, return_index=True, return_counts=True)
    return pd.DataFrame({"word": [words[k] for k in which], "n_near": count, "best_n": n[near[first]], "best": [words[k] for k in near[first]]})


def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Near words inside whole divisions, in the order of their keys."""
    keys = ["size", "side", "half", "i", "j"]
    new = np.r_[True, (rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(1)]
    starts = [*np.flatnonzero(new).tolist(), len(rows)]
    size, side, n, longer = (rows[k].to_numpy() for k in ("size", "side", "n", "longer"))
    part = np.where(rows["i"] == rows["j"], -1, (rows["part"] == rows["j"]).astype(int))
    words, group, a = rows["word"].tolist(), np.cumsum(new), 0
    for g in range(1, len(starts)):
        end = starts[g]
        last = g == len(starts) - 1
        if not last and starts[g + 1] - a <= TOGETHER and (size[end], side[end]) == (size[a], side[a]):
            continue
        if end - a > 1:
            i, j = near_pairs(int(size[a]), int(side[a]), group[a:end], longer[a:end], part[a:end], words[a:end])
            if len(i):
                yield best_near(i, j, words[a:end], n[a:end])
        a = end


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near ones."""
    keys = ["size", "side", "half", "i", "j"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            changes = np.flatnonzero((batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(1))
            same = not held or (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all()
            if not same:
                yield from compare(pd.concat(held, ignore_index=True))
                held = []
            if len(changes):
                cut = int(changes[-1]) + 1
                yield from compare(pd.concat([*held, batch[:cut]], ignore_index=True))
                held = [batch[cut:]]
            else:
                held.append(batch)
        if held:
            yield from compare(pd.concat(held, ignore_index=True))

    dealt = divisions(words, block).repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInPandas(blocks, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    return found.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, the way ahead doubled in each round.

    A form is more frequent than its word by a factor, so there are no circles and the number of rounds is the logarithm of a logarithm.
    """
    ahead = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        total = ahead.count()
        heavy = heavy_keys(ahead.groupBy("root").count(), "root", "count", total)
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        moved = salted_join(ahead, further, "root", heavy, F.col("word"))
        moved = staged(moved.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        ahead = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return ahead


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_n: int = 3, typo: int | None = 97, factor: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per word (see :func:`word_counts`): word, n, n_near, form, form_n, root.

    ``form`` is the near word of largest n (ties: the least in code-point order) if that is ``factor`` times the word's own at least, else
    null; ``root`` is the last form of the chain, the word itself if it has none. Other columns of ``docs`` aren't read, whatever their
    names; empty and null texts add nothing, an empty table gives no rows.
    """
    words = staged(word_counts(docs, key, text, least_length, least_n, typo), "words")
    near = words.join(near_words(words, block), "word", "left")
    known = staged(near.withColumn("form", F.when(F.col("best_n") >= factor * F.col("n"), F.col("best"))), "near")
    ends = roots(known.where(F.col("form").isNotNull()))
    out = known.join(ends, "word", "left")
    return out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form",
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"), F.coalesce("root", "word").alias("root"),
    )
