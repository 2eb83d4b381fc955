"""Best-fit packing by a grouping genetic algorithm on islands.

Every document is encoded once; pieces of a full sequence are sequences of their own. The others are
dealt at random over islands of about ``island`` pieces. An island breeds packings as lists of bins: a
child inherits whole well-filled bins of one parent, loses the other parent's bins that hold the same
pieces, and places what is left over by best fit, longest first. An island has two populations that
exchange their best packing every few generations, and ends early once the count of bins reaches the
lower bound, which proves it the least.

Then bins migrate: an island keeps its elite bins, and the pieces of its emptiest tenth move on to the
next, smaller round of islands, until one island is left. So the waste does not grow with the
number of islands.

Defined results: NULL and empty texts are one piece, the closing id alone; repeated rows are packed
each; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import os
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.bpe import byte_alphabet
from tidebars.llm.common import slices, texts
from tidebars.session import materialize

CAPACITY = 2048
ISLAND = 8192
WELL_FILLED = 0.98


END = "</w>"
WORD_END = b"\x01"  # in no word of letters
#: A stop that does not follow a letter or digit; with what stands before it, it may be one token.
OTHER_STOP = re.compile(rb"(?<![a-z0-9])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,][ \n]")


def plain_latin(word: str) -> bool:
    """Letters of the Latin blocks in composed form, whose classes and lower case all libraries agree on."""
    return word.isalpha() and word.lower().isalpha() and max(word) < "\u0250" and unicodedata.is_normalized("NFC", word)


class WordEncoder:
    """Ids of texts as little-endian 32-bit numbers, for vocabularies that drop white space.

    No token of such a vocabulary crosses white space, so the words between are encoded once and
    remembered, up to ``limit`` of them. Words of Latin letters alone go through a faster library, which
    gets each word with a mark behind it in place of the vocabulary's end-of-word suffix. It merges any
    two neighbours that form a token, not only the listed pair; both agree if every token is the encoding
    of its own characters (``tests/llm`` checks the vocabulary for that). All else goes through
    ``tokenizers``.
    """

    def __init__(self, path: str, limit: int = 1_200_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(special.items()))
        vocab = {t: i for t, i in self.tok.get_vocab().items() if t not in special}
        alphabet = byte_alphabet()
        ranks = {(bytes(alphabet[c] for c in t.removesuffix(END)) + (WORD_END if t.endswith(END) else b"")): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x01]*\x01", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END)]] = True
        self.words: dict[bytes, bytes] = {}
        self.limit = limit

    def alone(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, words: set[bytes]) -> None:
        """Add words. Beyond ``limit`` the later half goes: what came first is mostly what comes often."""
        if len(self.words) + len(words) > self.limit:
            for w in list(itertools.islice(reversed(self.words), len(self.words) // 2)):
                del self.words[w]
        latin, rest = [], []
        for w in words:
            if w not in self.words:
                (latin if w.isalpha() or plain_latin(w.decode()) else rest).append(w)
        for k in range(0, len(latin), 4096):
            some = latin[k : k + 4096]
            ids = np.array(self.fast.encode_ordinary((b"\x01".join(some) + b"\x01").decode().lower()), "<u4")
            data, at = ids.tobytes(), 0
            for w, end in zip(some, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                self.words[w] = data[at:end]
                at = end
        for w in [w for w in rest if b"<|" in w]:
            self.words[w] = self.alone(w.decode()).tobytes()
        rest = [w for w in rest if b"<|" not in w]
        for k in range(0, len(rest), 512):
            some = rest[k : k + 512]
            ids = self.alone(self.mark.join(w.decode() for w in some))
            at = 0
            for w, end in zip(some, [*np.flatnonzero(ids == self.mark_id), len(ids)], strict=True):
                self.words[w] = ids[at:end].tobytes()
                at = end + 1

    @staticmethod
    def prepared(text: bytes) -> bytes:
        """Without capitals, and stops apart from the words before them, where that changes no token."""
        if b"<|" in text:
            return text  # names of special tokens are looked for before case is folded
        text = text.lower()
        if OTHER_STOP.search(text):
            return text
        return text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")

    def encode(self, docs: list[bytes]) -> list[bytes]:
        split = [self.prepared(d).split() for d in docs]
        self.learn(set().union(*split))
        return [b"".join(map(self.words.__getitem__, s)) for s in split]


_ENCODERS: dict[str, WordEncoder] = {}
PIECES = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """The pieces of every document; uid is unique, the same after a lost task."""
    end = int(closing).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        uid = TaskContext.get().partitionId() << 34
        for batch in slices(batches, 512):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), _ENCODERS[path].encode(texts(batch)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, v in zip(rows, (uid, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
                    uid += 1
            yield pa.RecordBatch.from_pydict(dict(zip(PIECES.names, rows, strict=True)), schema=PIECES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "uid long, doc_id long, piece int, start long, length int, ids_crc32 long")


# -- one island ---------------------------------------------------------------------------------------


class Bins:
    """A packing: bins as lists of items, and the bins of each free space as a bit set over spaces."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def fit(self, order: list[int], length: list[int]) -> Bins:
        """Put items in the fullest bin that takes them, a new one if none does."""
        at: dict[int, list[int]] = {}
        mask = 0
        for k, f in enumerate(self.free):
            at.setdefault(f, []).append(k)
            mask |= 1 << f
        for item in order:
            n = length[item]
            high = mask >> n
            if high:
                space = n + (high & -high).bit_length() - 1
                here = at[space]
                k = here.pop()
                if not here:
                    mask ^= 1 << space
                self.bins[k].append(item)
            else:
                k, space = len(self.bins), self.capacity
                self.bins.append([item])
                self.free.append(space)
            left = self.free[k] = space - n
            here = at.setdefault(left, [])
            if not here:
                mask |= 1 << left
            here.append(k)
        return self

    def fitness(self) -> tuple[int, float]:
        return -len(self.bins), sum(((self.capacity - f) / self.capacity) ** 2 for f in self.free)

    def without(self, drop: set[int]) -> Bins:
        """These bins but for some."""
        out = Bins(self.capacity)
        for k, b in enumerate(self.bins):
            if k not in drop:
                out.bins.append(list(b))
                out.free.append(self.free[k])
        return out


def cross(a: Bins, b: Bins, length: list[int], rng: random.Random) -> Bins:
    """Whole well-filled bins of ``b`` go into ``a``; bins of ``a`` that share an item go; best fit for the rest."""
    good = [k for k, f in enumerate(b.free) if f <= b.capacity * (1 - WELL_FILLED)] or range(len(b.bins))
    chosen = set(rng.sample(list(good), max(1, len(good) // 3)))
    taken = {i for k in chosen for i in b.bins[k]}
    hit = {k for k, items in enumerate(a.bins) if not taken.isdisjoint(items)}
    loose = [i for k in hit for i in a.bins[k] if i not in taken]
    child = a.without(hit)
    for k in chosen:
        child.bins.append(list(b.bins[k]))
        child.free.append(b.free[k])
    return mutate(child, length, rng, loose)


def mutate(p: Bins, length: list[int], rng: random.Random, loose: list[int]) -> Bins:
    """Open the emptiest bins and a few others, and place their items by best fit."""
    order = sorted(range(len(p.bins)), key=lambda k: -p.free[k])[: max(2, len(p.bins) // 50)]
    opened = set(order) | set(rng.sample(range(len(p.bins)), min(3, len(p.bins))))
    loose = loose + [i for k in opened for i in p.bins[k]]
    loose.sort(key=lambda i: -length[i])
    return p.without(opened).fit(loose, length)


def least(length: list[int], capacity: int) -> int:
    """No packing has fewer bins."""
    return max(-(-sum(length) // capacity), sum(2 * n > capacity for n in length))


def evolve(length: list[int], capacity: int = CAPACITY, seed: int = 0, population: int = 4, generations: int = 24, migrate: int = 6) -> Bins:
    """The best packing that two populations found."""
    rng = random.Random(seed)
    order = sorted(range(len(length)), key=lambda i: -length[i])
    best = Bins(capacity).fit(order, length)
    bound = least(length, capacity)
    if len(best.bins) <= bound:
        return best
    isles = []
    for isle in range(2):
        group = [best]
        for _ in range(population - 1):
            noisy = sorted(order, key=lambda i: -length[i] * (1 + 0.2 * (isle + 1) * (rng.random() - 0.5)))
            group.append(Bins(capacity).fit(noisy, length))
        isles.append(group)
    for g in range(generations):
        for group in isles:
            a, b = rng.sample(group, 2)
            group.append(cross(a, b, length, rng))
            group.sort(key=Bins.fitness, reverse=True)
            group.pop()
        if g % migrate == migrate - 1:
            isles[0][-1], isles[1][-1] = isles[1][0], isles[0][0]
        best = max((group[0] for group in isles), key=Bins.fitness)
        if len(best.bins) <= bound:
            break
    return max((p for group in isles for p in group), key=Bins.fitness)


PLACED = "uid long, length int, sequence_id long, offset long, stays boolean"


def _round(items: DataFrame, islands: int, level: int, capacity: int) -> DataFrame:
    last = islands == 1

    def island(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        packing = evolve(rows["length"].tolist(), capacity, seed=int(key[0]))
        n = len(rows)
        seq, off, stays = np.empty(n, "int64"), np.empty(n, "int64"), np.empty(n, bool)
        length = rows["length"].to_numpy()
        # At most a tenth of the bins moves on, so that rounds shrink whatever the lengths are.
        emptiest = sorted(range(len(packing.bins)), key=lambda k: -packing.free[k])[: -(-len(packing.bins) // 10)]
        moving = {k for k in emptiest if packing.free[k] > capacity * (1 - WELL_FILLED)} if not last else set()
        for k, bin_ in enumerate(packing.bins):
            seq[bin_] = (level << 56) | (int(key[0]) << 24) | k
            off[bin_] = np.cumsum(length[bin_]) - length[bin_]
            stays[bin_] = k not in moving
        return pd.DataFrame({"uid": rows["uid"], "length": rows["length"], "sequence_id": seq, "offset": off, "stays": stays})

    dealt = items.withColumn("island", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(islands)))
    return dealt.groupBy("island").applyInPandas(island, PLACED)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, island: int = ISLAND, closing: int = 0) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    cut = materialize(pieces(docs, path, capacity, closing))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = cut.where(F.col("length") == capacity).select(*columns, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items, level, placed = cut.where(F.col("length") < capacity).select("uid", "length"), 1, None
    count = items.count()
    while True:
        islands = max(1, count // island)
        done = materialize(_round(items, islands, level, capacity))
        here = done.where("stays").select("uid", "sequence_id", "offset")
        placed = here if placed is None else placed.unionByName(here)
        if islands == 1:
            break
        items, level = done.where("not stays").select("uid", "length"), level + 1
        count = items.count()
    rest = cut.where(F.col("length") < capacity).join(placed, "uid").select(*columns, "sequence_id", "offset")
    return full.unionByName(rest)
