"""Near-duplicates by SetSketch registers.

A document is the set of its word shingles. Documents with one set form a class. A class is sketched by registers: exponentially
spaced, truncated minima over the set, so the sketch of a union is the register-wise maximum, and registers of similar sets agree
often. Bands of registers are bucket keys. Inside a bucket, in blocks of bounded size, both registers and set sizes give the likeliest
similarity; pairs that can't be ruled out are verified on their full sets. Verified links join classes into components.

A link of similarity j is missed if no band agrees, (1 - j^ROWS)^BANDS (2e-8 at 0.85, 3e-6 at 0.8), or if the estimate is SIGMAS standard
deviations low. Similarity classes that hold many rows travel as one row; a bucket of many classes is dealt over block pairs, and
a block pair returns a forest of links, never its pairs. The work inside a bucket is quadratic in its number of different sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import at_rest, heavy_keys, located, salted_join, sized_semi_join, small_batches, staged, without

ROWS, BANDS = 4, 24
M = ROWS * BANDS
BASE, RATE, TOP = 1.001, 20.0, 65_535
SIGMAS = 5
#: Classes in a block; a task holds two blocks at a time.
BLOCK = 512
_RNG = np.random.default_rng(20240)
_MUL = _RNG.integers(0, 2**63, M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, M, dtype=np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``width`` give one shingle, no words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    whole = b" ".join(words)
    starts = [0, *ends[:-width].tolist()]
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts)))


def registers(shingle_set: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set: floor(1 - log_BASE(min h)), h exponential with RATE, cut to 0..TOP."""
    low = np.full(M, 2**64 - 1, np.uint64)
    for i in range(0, len(shingle_set), 1024):
        low = np.minimum(low, (shingle_set[i : i + 1024, None] * _MUL + _ADD).min(0))
    u = (low.astype(np.float64) + 1) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint16)


def likeliest(more: np.ndarray, less: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Likeliest similarity from the numbers of registers in which the first set is larger, and smaller, and from both sizes."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    log = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)  # noqa: E731  share of registers

    def score(j: np.ndarray) -> np.ndarray:
        p, q = log(u - v * j), log(v - u * j)
        return more * np.log(p) + less * np.log(q) + (M - more - less) * np.log(np.maximum(1 - p - q, 1e-12))

    a, b = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(25):  # the likelihood has one peak
        c, d = a + (b - a) / 3, b - (b - a) / 3
        left = score(c) < score(d)
        a, b = np.where(left, c, a), np.where(left, b, d)
    return (a + b) / 2


def plausible(r: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray, band: int, share: float) -> np.ndarray:
    """Which pairs (positions ``first``, ``second``) may be linked and meet in ``band`` for the first time."""
    keys = r.view(np.uint64)
    ok = np.minimum(n[first], n[second]) >= share * np.maximum(n[first], n[second]) - 1e-9
    sigma = np.sqrt(share * (1 - share) / M)
    for i in range(0, len(first), 16_384):
        at = np.flatnonzero(ok[i : i + 16_384]) + i
        a, b = first[at], second[at]
        meet = (keys[a] == keys[b]).argmax(1) == band
        same = (r[a] == r[b]).sum(1) >= M * (share - (SIGMAS + 1) * sigma)
        ok[at] = meet & same
        at, a, b = (x[meet & same] for x in (at, a, b))
        if len(at):
            x, y = r[a], r[b]
            ok[at] = likeliest((x > y).sum(1), (x < y).sum(1), n[a], n[b]) >= share - SIGMAS * sigma
    return ok


def pairs_of(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block with itself, or of a block with another."""
    if side.min() == side.max():
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def by_group(batches: Iterator[pd.DataFrame], keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Apply ``f`` to each run of equal keys of sorted batches; only the last run of a batch waits for the next one."""
    held: list[pd.DataFrame] = []

    def runs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        k = rows[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield rows.iloc[a:b]

    for batch in batches:
        if not len(batch):
            continue
        *done, last = runs(batch)
        if held and (held[-1][keys].iloc[-1].tolist() == batch[keys].iloc[0].tolist()):
            if not done:
                held.append(batch)
                continue
            done[0] = pd.concat([*held, done[0]])
        elif held:
            done.insert(0, pd.concat(held))
        held = [last]
        if out := [x for x in map(f, done) if len(x)]:
            yield pd.concat(out)
    if held and len(out := f(pd.concat(held))):
        yield out


def linked(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Root of each position, by the pairs whose sets are similar enough."""
    root = np.arange(len(sets))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(first.tolist(), second.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            shared = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))])


GROUP = ["bucket", "i", "j"]


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """id, locator, n (set size), cls (digest of the set), regs for each row; no words: n 0."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.pop("text")]
            yield batch.assign(
                n=[len(s) for s in sets], cls=[hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                regs=[registers(s).tobytes() if len(s) else b"" for s in sets],
            )

    kind = dict(docs.dtypes)["id"]
    flat = docs.select("id", F.col("locator.file").alias("file"), F.col("locator.row").alias("row"), "text")
    out = small_batches(flat).mapInPandas(sketch, f"id {kind}, file string, row long, n long, cls binary, regs binary")
    return out.select("id", F.struct("file", "row").alias("locator"), "n", "cls", "regs")


def bucket_blocks(classes: DataFrame, share: float) -> DataFrame:
    """Members (bucket, i, j, side, band, cls, n, regs, locator) of all block pairs of buckets with two classes or more."""
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("regs", b * (2 * ROWS) + 1, 2 * ROWS)).alias("bucket"))))
    members = classes.select("cls", bands.alias("x")).select("cls", "x.band", "x.bucket")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = members.join(sizes, "bucket").withColumn("g", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("g")).cast("int"))
    full = staged(placed.drop("size"), "members").join(classes, "cls")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    dealt = full.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
    return dealt.select(*GROUP, "side", "band", "cls", "n", "regs", "locator")


def candidates(blocks: DataFrame, share: float) -> DataFrame:
    """Members of each block pair that may be linked to another member there."""

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        if rows["i"].iloc[0] != rows["j"].iloc[0] and side.min() == side.max():
            return rows[:0]
        a, b = pairs_of(side)
        r = np.frombuffer(b"".join(rows["regs"]), np.uint16).reshape(-1, M)
        ok = plausible(r, rows["n"].to_numpy(), a, b, int(rows["band"].iloc[0]), share)
        return rows.iloc[np.unique(np.concatenate([a[ok], b[ok]]))]

    flat = blocks.select(*GROUP, "side", "band", "cls", "n", "regs", F.col("locator.file").alias("file"), F.col("locator.row").alias("row"))
    sorted_rows = flat.repartition(*GROUP).sortWithinPartitions(*GROUP)
    kept = sorted_rows.mapInPandas(lambda it: by_group(it, GROUP, keep), flat.schema)
    return kept.select(*GROUP, "side", "band", "cls", "n", "regs", F.struct("file", "row").alias("locator"))


def links(found: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): each class of a block pair next to the first class that verified links lead to."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        none = pd.DataFrame({"a": [], "b": []})
        if len(rows) < 2 or rows["i"].iloc[0] != rows["j"].iloc[0] and side.min() == side.max():
            return none
        a, b = pairs_of(side)
        r = np.frombuffer(b"".join(rows["regs"]), np.uint16).reshape(-1, M)
        ok = plausible(r, rows["n"].to_numpy(), a, b, int(rows["band"].iloc[0]), percent / 100)
        a, b = a[ok], b[ok]
        near = np.argsort(-(r[a] == r[b]).sum(1), kind="stable")
        root = linked([shingles(t, width) for t in rows["text"]], a[near], b[near], percent)
        moved = np.flatnonzero(root != np.arange(len(root)))
        cls = rows["cls"].to_numpy()
        return pd.DataFrame({"a": cls[moved], "b": cls[root[moved]]})

    rows = found.join(texts, "locator").select(*GROUP, "side", "band", "cls", "n", "regs", "text").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return rows.mapInPandas(lambda it: by_group(it, GROUP, verify), "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(cls, root) for every class with a link: all that reach each other have one root, a class of theirs.

    Each class points to its least neighbour. No ring of more than two can form so, and of two the lesser one points to itself. Pointers are
    followed to their ends, the links between different ends stay, and ends with links go through the same again: half of them at most
    are left each time, so both loops grow with the logarithm, whatever the links look like. They run until nothing is left to do.
    """
    left = staged(edges.union(edges.select("b", "a")).toDF("cls", "to").where("cls != to").distinct(), "edges")
    rounds = []
    while True:
        ends = staged(left.groupBy("cls").agg(F.min("to").alias("root")), "labels")
        moved = True
        while moved:
            over = F.when(F.col("next") == F.col("cls"), F.least("cls", "root")).otherwise(F.col("next"))
            jump = staged(ends.join(ends.toDF("root", "next"), "root").select("cls", "root", over.alias("now")), "labels")
            ends, moved = jump.select("cls", F.col("now").alias("root")), bool(jump.where("root != now").limit(1).count())
        rounds.append(ends)
        near = left.join(ends, "cls").select(F.col("root").alias("near"), "to")
        left = near.join(ends.toDF("to", "far"), "to").where("near != far").select(F.col("near").alias("cls"), F.col("far").alias("to")).distinct()
        left = staged(left, "edges")
        if not left.limit(1).count():
            break
    roots = rounds.pop()
    while rounds:
        roots = rounds.pop().join(roots.toDF("root", "top"), "root", "left").select("cls", F.coalesce("top", "root").alias("root"))
        roots = staged(roots, "labels")
    return roots


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``locator``, ``n_shingles``, ``component_id``, ``kept``.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Documents are linked when 100 * shared >= ``percent`` * union.
    A text without words, empty or null is linked with nothing and stays. ``component_id`` is the smallest key reachable; rows that
    share the smallest key all stay. A null key loses to any other; rows of a component with null keys only all stay.
    Other columns aren't read, whatever their names; an empty table gives an empty result.
    """
    share = percent / 100
    places = located(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    rows = staged(sketched(places, width), "sketches")
    full = rows.where("n > 0")
    classes = full.groupBy("cls").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.min(F.struct("locator", "n", "regs")).alias("x"))
    classes = staged(classes.select("cls", "least", "size", "x.n", "x.regs", "x.locator"), "classes")
    found = staged(candidates(bucket_blocks(classes.select("cls", "n", "regs", "locator"), share), share), "candidates")
    wanted = staged(found.select("locator").distinct(), "wanted")
    texts = sized_semi_join(places.select("locator", "text"), wanted, ["locator"], wanted.count())
    roots = components(staged(links(found, texts, width, percent), "links"))

    labelled = classes.select("cls", "least", "size").join(roots, "cls", "left")
    members = labelled.where("root is not null")
    ids = members.groupBy("root").agg(F.min("least").alias("component"))
    known = labelled.where("root is null and size > 1").select("cls", "size", F.col("least").alias("component"))
    known = staged(known.unionByName(members.join(ids, "root").select("cls", "size", "component")), "components")
    total = full.count()
    placed = salted_join(full.select("id", "locator", "n", "cls"), known, "cls", heavy_keys(known, "cls", "size", total), F.col("locator"))
    placed = placed.select("id", "locator", "n", F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
    alone = rows.where("n = 0").select("id", "locator", "n", F.col("id").alias("component"))
    return placed.unionByName(alone).select(
        F.col("id").alias(key), "locator", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = at_rest(docs)
    gone = staged(near_dedup(docs, key, text, width, percent).where(~F.col("kept")).select("locator"), "near-copies")
    return without(docs, gone, gone.count())
