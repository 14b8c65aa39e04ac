"""Best-fit packing planned on the histogram of lengths.

Documents become token ids, an end id follows each, and what is longer than a sequence is cut into full pieces (the first piece takes the
rest). The planner sees only how many pieces have each length: at most ``capacity`` numbers, whatever the corpus. It goes from the longest
length to the shortest and puts all pieces of a length into the open sequences with the least room that fits, counts at a time. Its plan says
for each length which ranks go to which sequences and places, and pieces take their slots by their rank within their length.

Ranks are taken in sub-groups of a length, as many as its count asks for, so that a length which many documents have is dealt over tasks. Full
pieces, most of a corpus of long texts, need no plan: each is a sequence.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm.common import BROADCAST_ROWS, located, small_batches, staged

CAPACITY = 2048
#: Pieces of one length that a task ranks: longer lists are dealt into sub-groups of about this size.
RANKED_ROWS = 1024
END_OF_TEXT = "<|endoftext|>"
#: What splits a text before merges: the vocabulary's own pattern, without backing up inside words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

#: White space as the pattern has it, in runs so long that its look-ahead might run out of stack (seen from a million on).
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}+")


def parts(text: str) -> Iterator[str]:
    """``text`` cut where the pattern splits anyway: before the last blank of each long run that something follows."""
    at = 0
    if len(text) >= 100_000:
        for run in LONG_BLANK.finditer(text):
            if run.end() < len(text):
                yield text[at : run.end() - 1]
                at = run.end() - 1
    yield text[at:]


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, from the rank file of a byte-level vocabulary.

    The file lists the same vocabulary as the tokenizers file byte_bpe_50k.json, and the ids are the same; the rank file is
    encoded several times faster. The end-of-text string inside a text is the special id, as it is there.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.special = {END_OF_TEXT: len(ranks)}
        self.encoding = tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> bytes:
        ids: list[int] = []
        for k, piece in enumerate(text.split(END_OF_TEXT)):
            if k:
                ids.append(self.special[END_OF_TEXT])
            for part in parts(piece):
                ids += self.encoding.encode_ordinary(part)
        return np.array(ids, "<u4").tobytes()


class Checked:
    """Ids by the tokenizers file ``path``, as its library gives them with add_special_tokens=False.

    The rank file of the same vocabulary is several times faster, so it is used as long as it agrees: the first and the longest of the first
    texts are encoded by both, and where they differ the tokenizers file encodes all.
    """

    def __init__(self, path: str, ranks: str) -> None:
        self.exact, self.fast, self.agreed = Tokenizer.from_file(path), Encoder(ranks), None

    def slowly(self, text: str) -> bytes:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.agreed is None and texts:
            self.agreed = all(self.fast.encode(t) == self.slowly(t) for t in {texts[0], max(texts, key=len)})
        return [self.fast.encode(t) if self.agreed else self.slowly(t) for t in texts]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = 0, path: str | None = None, ranks: str | None = None, ids: bool = False) -> DataFrame:
    """id, file, row, piece, start, length, ids_crc32 (and ids, if asked for) of each piece of each row of (id, locator, text)."""
    vocabulary = path or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Checked(*vocabulary)
        for batch in batches:
            rows = []
            for k, data in enumerate(enc([text or "" for text in batch["text"]])):
                data += tail
                n = len(data) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for p, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    part = data[4 * a : 4 * b]
                    rows.append((k, p, a, b - a, zlib.crc32(part), part if ids else None))
            made = pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32", "ids"])
            place = batch[["id", "file", "row"]].iloc[made.pop("k")].reset_index(drop=True)
            yield pd.concat([place, made if ids else made.drop(columns="ids")], axis=1)

    kind = dict(docs.dtypes)["id"]
    schema = f"id {kind}, file string, row long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return small_batches(docs).select("id", F.col("locator.file").alias("file"), F.col("locator.row").alias("row"), "text").mapInPandas(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best fit over counts. A row of the plan: ``slots`` ranks of ``length`` from ``first`` on, ``per`` to a sequence, from sequence ``base`` on at ``offset``.

    Longest first; each count goes to the fullest sequences that it still fits in. Sequences with the same content are one group, and a
    length splits one group at most for each room it meets, so the plan is bounded by the number of lengths.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(room: int, items: tuple[tuple[int, int], ...], count: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((items, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                if left >= per:
                    put(capacity - per * length, ((length, per),), left // per)
                if left % per:
                    put(capacity - left % per * length, ((length, left % per),), 1)
                break
            room = rooms[at]
            items, count = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            used = min(count, left)
            (last, per), grown = items[-1], items
            grown = (*items[:-1], (last, per + 1)) if last == length else (*items, (length, 1))
            if count > used:
                put(room, items, count - used)
            put(room - length, grown, used)
            left -= used

    rows, base, ranks = [], 0, dict.fromkeys(histogram, 0)
    for room in rooms:
        for items, count in groups[room]:
            offset = 0
            for length, per in items:
                rows.append((length, ranks[length], count * per, per, base, offset))
                ranks[length] += count * per
                offset += length * per
            base += count
    return pd.DataFrame(rows, columns=["length", "first", "slots", "per", "base", "offset"]).sort_values(["length", "first"], ignore_index=True)


def ranked(pieces: DataFrame, counts: dict[int, int], rows: int) -> DataFrame:
    """Add ``rank``, the number of the row among those of its length; ``counts`` has the number of rows of each length."""
    parts = {n: -(-k // rows) for n, k in counts.items()}
    groups = F.broadcast(pieces.sparkSession.createDataFrame(sorted(parts.items()), "length long, parts long"))  # a row per length
    dealt = pieces.join(groups, "length").withColumn("sub", F.pmod(F.xxhash64("id", "file", "row", "piece"), F.col("parts")).cast("int")).drop("parts")
    sizes = dealt.groupBy("length", "sub").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "sub", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "sub").orderBy("id", "file", "row", "piece")
    own = dealt.withColumn("__own", F.row_number().over(inside) - 1)
    side = F.broadcast(offsets) if sum(parts.values()) <= BROADCAST_ROWS else offsets
    return own.join(side, ["length", "sub"]).withColumn("rank", F.col("before") + F.col("__own")).drop("sub", "before", "__own")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = 0, path: str | None = None, ranks: str | None = None, ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    ``path`` is the tokenizers file, ``ranks`` the rank file of the same vocabulary (by default those of the public byte-level one; see :class:`Checked`). A null or empty text is its end id alone; texts are read whole;
    repeated rows are packed once each, rows with a null key too. Other columns aren't read. An empty table gives no sequence.
    """
    rows = located(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    pieces = staged(token_pieces(rows, capacity, end, path, ranks, ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    counts.pop(capacity, None)
    slots = plan(counts, capacity)
    starts = (slots["length"].to_numpy(np.int64) << 44) + slots["first"].to_numpy(np.int64)
    table = slots[["first", "per", "base", "offset", "length"]].to_numpy(np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        first, per, base, offset, size = table[np.searchsorted(starts, (n << 44) + r, "right") - 1].T
        return pd.DataFrame({"sequence_id": base + (r - first) // per, "offset": offset + (r - first) % per * size})

    # a full piece is a sequence of its own, numbered downwards from -1; the others take their slots by rank
    full = pieces.where(F.col("length") == capacity).withColumn("slot", F.struct((-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    part = pieces.where(F.col("length") < capacity)
    placed = full
    if counts:
        placed = full.unionByName(ranked(part, counts, RANKED_ROWS).withColumn("slot", slot("length", "rank")).drop("rank"))
    return placed.select(F.col("id").alias(key), "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), "slot.sequence_id", "slot.offset")
