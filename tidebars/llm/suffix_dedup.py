"""Removal of repeated passages with merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller
id. Which strings repeat is read from the suffix order: suffixes are sorted shard by shard, each
shard's Burrows-Wheeler transform is formed, and the transforms are merged by refining their
interleave: pass k moves every entry, in the order of pass k - 1, behind those of its bucket of
preceding characters, so after k passes suffixes stand in the order of their first k characters (Holt
and McMillan 2014; here a pass takes two characters). Block borders that appear in a pass mark a
common prefix shorter than it; the blocks left at the end are the repeated strings, with no suffix
sorted again.

What is sorted is little. Copies of a text are told from its digest; of them the first alone goes on.
Every string of ``LENGTH`` bytes has an anchor, one of its ``ANCHOR``-byte parts that depends on the
string alone (sampling as in mod-minimizers). Anchors that occur once cannot be in a repeated string.
Their hashes are sent, counted for each part of the documents, to owners of hash ranges, which answer
with those that occur again; only text around these goes on, as segments: the maximal runs of strings
with one anchor. Segments of one anchor meet in one group, so each group finds all repeats of its
strings; of equal segments in a part, one is sent and the others are known to go. Segments of anchors
with very many places (the edges of a passage that a third of all documents share) are split into
single strings, which are dealt by content.

Defined results: NULL counts as empty; texts shorter than ``LENGTH`` lose nothing; repeated rows have
the same id and so do not remove each other; rows with a NULL id come after all others; an empty table
gives an empty table.
"""

from __future__ import annotations

import collections
import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import slices, texts
from tidebars.session import materialize

LENGTH = 50
ANCHOR = 16
HOT = 2000  # places of one anchor
PART = 4 << 20  # bytes of text in a part; there are as many groups, so a task holds as much in a table of any size
SHARD = 1 << 18  # characters sorted at once
HELD = 64 << 20  # bytes of different texts that a task folds at once
FLUSH = 4 << 20  # anchors that a task folds at once
LAST = 2**63 - 1
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    two = data[:-1].astype("u2") | data[1:].astype("u2") << np.uint16(8)
    four = two[:-2].astype("u4") | two[2:].astype("u4") << np.uint32(16)
    return four[:-4].astype("u8") | four[4:].astype("u8") << np.uint64(32)


def anchors(docs: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """For each segment: document index, start of its first and last string, hash of its anchor."""
    return anchored(docs, length, anchor)[:4]


def anchored(docs: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """As ``anchors``, and where each anchor starts."""
    lengths = np.array([len(d) for d in docs], "i8")
    ends = np.cumsum(lengths)
    n = int(ends[-1]) if len(ends) else 0
    none = np.empty(0, "i8")
    if n < length:
        return none, none, none, none.astype("u8"), none
    wide = length - anchor + 1  # anchors to choose from
    tiny = 8 + (anchor - 8) % wide  # bytes that are hashed for the choice: 8 to 8 + wide - 1
    data = np.frombuffer(b"".join(docs) + bytes(32), "u1")
    words = _words(data)
    h = (words[: n - tiny + 1] * M1) ^ (words[tiny - 8 : n - 7] * M2)
    h = (h ^ (h >> np.uint64(31))) * M3
    bits = np.uint64(max(1, n.bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype="u8")  # ties: the first
    span, step = length - tiny + 1, 1
    low = key
    while step < span:
        shift = min(step, span - step)
        low = np.minimum(low[:-shift], low[shift:])
        step += shift
    first = np.arange(n - length + 1)
    at = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype("i8")
    at = first + (at - first) % wide  # where the anchor of each string starts
    owner = np.repeat(np.arange(len(docs)), lengths)[: len(first)]
    inside = first + length <= ends[owner]
    new = np.ones(len(first), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    place, who = at[inside], owner[inside]
    starts = np.flatnonzero(new & inside)
    if not len(starts):
        return none, none, none, none.astype("u8"), none
    run = np.cumsum(new)[inside]
    count = np.diff(np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run)))
    begin = first[starts] - (ends - lengths)[owner[starts]]
    where = at[starts]
    mixed = words[where] * M1
    for k in range(8, anchor, 8):
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ words[where + min(k, anchor - 8)]) * M2
    return owner[starts], begin, begin + count - 1, (mixed ^ (mixed >> np.uint64(32))) * M3, where - (ends - lengths)[owner[starts]]


# -- Burrows-Wheeler transforms -----------------------------------------------------------------------


def shard_order(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Suffixes of a shard in the order of at least their first ``length`` characters."""
    n = len(text)
    used = np.flatnonzero(np.bincount(text))
    # As many characters as fit in one number first, then twice as many with every sort.
    wide = (len(used) - 1).bit_length() or 1
    step = min(62 // wide, length)
    dense = np.append(np.searchsorted(used, text), np.zeros(step, "i8"))
    key = np.zeros(n, "i8")
    for k in range(step):
        key = key << wide | dense[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        if step >= length:
            break
        ranked = key[order]
        rank = np.empty(n, "i8")
        rank[order] = np.cumsum(np.append(0, ranked[1:] != ranked[:-1]))
        key = rank * (n + 2)
        key[: max(0, n - step)] += rank[step:] + 1
        step *= 2
    return order


def merge(transforms: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of shards by their first ``length`` characters, and the block (equal ones) of each entry.

    A transform has two columns, the character before each suffix and the one before that: a pass moves
    entries by both at once, so half as many passes do.
    """
    every = np.concatenate(transforms).astype("i8")
    used = np.flatnonzero(np.bincount(every.ravel()))
    every = np.searchsorted(used, every)
    z = np.repeat(np.arange(len(transforms), dtype="u1" if len(transforms) <= 256 else "u2"), [len(t) for t in transforms])
    block = np.zeros(len(z), "i4")
    both = every[:, 1] * len(used) + every[:, 0]
    for keys, passes in ((both, length // 2), (every[:, 0], length % 2)):
        keys = keys.astype(np.min_scalar_type(len(used) ** 2))  # short keys sort in one or two passes
        for _ in range(passes):
            # The k-th entry of a shard in the interleave has the shard's k-th preceding characters.
            symbols = np.empty_like(keys)
            symbols[np.argsort(z, kind="stable")] = keys
            order = np.argsort(symbols, kind="stable")
            z, moved, s = z[order], block[order], symbols[order]
            border = np.empty(len(keys), bool)
            border[:1] = False
            border[1:] = (s[1:] != s[:-1]) | (moved[1:] != moved[:-1])
            block = np.cumsum(border, dtype="i4")
    return z, block


def least_owner(segments: list[bytes], owners: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> list[np.ndarray]:
    """For each segment and each string in it: the least owner of a segment that has this string."""
    shards, held, size = [], [], 0
    for k, s in enumerate(segments):
        held.append(k)
        size += len(s) + 1
        if size >= shard:
            shards.append(held)
            held, size = [], 0
    if held:
        shards.append(held)
    transforms, suffix_segment, suffix_offset = [], [], []
    for members in shards:
        lengths = np.array([len(segments[k]) + 1 for k in members])
        text = np.zeros(lengths.sum(), "u2")  # 0 ends a segment
        ends = np.cumsum(lengths)
        body = np.ones(len(text), bool)
        body[ends - 1] = False
        text[body] = np.frombuffer(b"".join(segments[k] for k in members), "u1").astype("u2") + 1
        order = shard_order(text, length)
        transforms.append(np.stack([text[order - 1], text[order - 2]], 1))  # the first has the last before it
        begin = np.repeat(ends - lengths, lengths)
        suffix_segment.append(np.repeat(np.array(members), lengths)[order])
        suffix_offset.append((np.arange(len(text)) - begin)[order])
    z, block = merge(transforms, length)
    back = np.argsort(z, kind="stable")
    which, offset = np.empty(len(z), "i8"), np.empty(len(z), "i8")
    which[back], offset[back] = np.concatenate(suffix_segment), np.concatenate(suffix_offset)
    strings = np.array([len(s) - length + 1 for s in segments])
    valid = offset < strings[which]
    least = np.full(int(block[-1]) + 1, LAST)
    np.minimum.at(least, block[valid], owners[which[valid]])
    place = np.cumsum(strings) - strings
    out = np.empty(strings.sum(), "i8")
    out[place[which[valid]] + offset[valid]] = least[block[valid]]
    return np.split(out, place[1:])


# -- the job ------------------------------------------------------------------------------------------


def unique_texts(docs: DataFrame, parts: int) -> DataFrame:
    """(part, doc_id, text), dealt by part. A text's part follows from the text, so all its copies meet;
    copies within a task are folded before, under their least id."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            for at in range(0, len(items), 256):
                some = items[at : at + 256]
                yield pa.RecordBatch.from_pydict({"part": [xxhash.xxh3_64_intdigest(t) % parts for t, _ in some], "doc_id": [d for _, d in some], "text": [t for t, _ in some]}, schema=TEXTS)

        for batch in slices(batches, 1024):
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                if text not in held:
                    held[text] = doc
                    size += len(text) + 100
                elif doc < held[text]:
                    held[text] = doc
            if size > HELD:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    TEXTS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.binary())])
    return docs.select("doc_id", "text").mapInArrow(fold, "part int, doc_id long, text binary").repartition(max(1, parts // 4), "part")


def _ordered(rows: pd.DataFrame) -> list[tuple[bytes, bytes, int]]:
    """(digest, text, least id) of the different texts of a part, in the order of their digests."""
    found: dict[bytes, int] = {}
    for doc, text in zip(rows["doc_id"].tolist(), rows["text"], strict=True):
        found[text] = min(doc, found.get(text, LAST))
    return sorted((hashlib.sha256(t).digest(), t, d) for t, d in found.items())


def repeated_anchors(texts_: DataFrame, owners: int) -> DataFrame:
    """(part, hashes): for each part those of its anchors that occur again somewhere, 48 bits of hash and,
    below, whether there are more than HOT."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = collections.defaultdict(list)
        seen, size = set(), 0

        def flush() -> pa.RecordBatch:
            rows = []
            for part, arrays in held.items():
                h, n = np.unique(np.concatenate(arrays), return_counts=True)
                packed = np.empty((len(h), 7), "u1")
                packed[:, :6] = h.view("u1").reshape(-1, 8)[:, :6]
                packed[:, 6] = np.minimum(n, 255)
                cut = np.searchsorted(h, np.arange(owners + 1, dtype="u8") * np.uint64((1 << 48) // owners))
                cut[-1] = len(h)
                rows += [(k, part, packed[cut[k] : cut[k + 1]].tobytes()) for k in range(owners) if cut[k] < cut[k + 1]]
            return pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(("owner", "part", "body"))}, schema=SENT)

        for batch in slices(batches, 128):
            new = []
            for part, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                digest = xxhash.xxh3_128_digest(text)
                if digest not in seen:
                    seen.add(digest)
                    new.append((part, text))
            who, _, _, h = anchors([t for _, t in new])
            part = np.array([p for p, _ in new])[who] if len(new) else who
            for p in np.unique(part).tolist():
                held[p].append(h[part == p] >> np.uint64(16))
            size += len(h)
            if size >= FLUSH:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        bodies = [np.frombuffer(b, "u1").reshape(-1, 7) for b in rows["body"]]
        part = np.repeat(rows["part"].to_numpy(), [len(b) for b in bodies])
        every = np.concatenate(bodies)
        wide = np.zeros((len(every), 8), "u1")
        wide[:, :6] = every[:, :6]
        h = wide.view("u8").ravel()
        order = np.argsort(h, kind="stable")
        h, part, n = h[order], part[order], every[order, 6].astype("i8")
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(h))))
        keep = total > 1
        h, part = h[keep] << np.uint64(1) | (total[keep] > HOT), part[keep]
        order = np.argsort(part, kind="stable")
        h, part = h[order], part[order]
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, "i8")
        return pd.DataFrame({"part": part[cut].astype("i4"), "hashes": [x.tobytes() for x in np.split(h, cut[1:])] if len(cut) else []})

    SENT = pa.schema([("owner", pa.int32()), ("part", pa.int32()), ("body", pa.binary())])
    sent = texts_.mapInArrow(send, "owner int, part int, body binary")
    return sent.groupBy("owner").applyInPandas(answer, "part int, hashes binary")


def _packed(*columns) -> bytes:
    """Arrays (or lists of byte strings) as one compressed value: rows of the shuffles between the steps."""
    return zstandard.compress(pickle.dumps(columns, 5), 1)


def _unpacked(blob: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(blob))


def segments(texts_: DataFrame, hashes: DataFrame, groups: int) -> DataFrame:
    """(g, part, body): text around repeated anchors, packed for each group.

    Columns in a body: number of the text in its part, least document id, start, segment, whether its
    anchor is hot; then the spans that are known to go (text, from, to): of equal segments in a part only those
    of the least document are still open.
    """

    def find(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(rows):
            return pd.DataFrame({"g": [], "part": [], "body": []})
        part = int(rows["part"].iloc[0])
        known = np.sort(np.concatenate([np.frombuffer(b, "u8") for b in found["hashes"]]))
        sent: list[tuple] = []
        gone: list[tuple] = []
        open_: dict[bytes, list] = {}
        ordered = _ordered(rows)
        for at in range(0, len(ordered), 64):
            some = ordered[at : at + 64]
            who, begin, last, h = anchors([t for _, t, _ in some])
            key = h >> np.uint64(16)
            spot = np.minimum(np.searchsorted(known, key << np.uint64(1)), len(known) - 1)
            hit = known[spot] >> np.uint64(1) == key
            is_hot = (known[spot] & np.uint64(1)).astype(bool)
            for i, a, b, x, hot in zip(*(v[hit].tolist() for v in (who, begin, last, key, is_hot)), strict=True):
                _, text, doc = some[i]
                k = at + i
                for start, end in [(s, s + LENGTH) for s in range(a, b + 1)] if hot else [(a, b + LENGTH)]:
                    body = text[start:end]
                    entry = open_.get(body)
                    if entry is None:
                        open_[body] = [doc, k, start, x, hot]
                    elif doc > entry[0]:
                        gone.append((k, start, end))
                    elif doc == entry[0]:
                        sent.append((xxhash.xxh3_64_intdigest(body) % groups if hot else x % groups, k, doc, start, body, hot))
                    else:
                        gone.append((entry[1], entry[2], entry[2] + len(body)))
                        # The same text may hold the segment more than once; those places are in ``sent``.
                        open_[body] = [doc, k, start, x, hot]
        sent += [(xxhash.xxh3_64_intdigest(body) % groups if hot else x % groups, k, doc, start, body, hot) for body, (doc, k, start, x, hot) in open_.items()]
        sent.sort(key=lambda r: (r[0], r[4]))
        g = np.array([r[0] for r in sent], "i8")
        spans = np.array(gone, "u4").reshape(-1, 3)
        out = []
        cut = np.searchsorted(g, np.arange(groups + 1))
        for n in range(groups):
            some, sure = sent[cut[n] : cut[n + 1]], spans[n::groups]
            if some or len(sure):
                columns = [np.array([r[c] for r in some], kind) for c, kind in ((1, "u4"), (2, "i8"), (3, "u4"), (5, "?"))]
                out.append((n, part, _packed(*columns, [r[4] for r in some], sure)))
        return pd.DataFrame(out, columns=["g", "part", "body"])

    return texts_.groupBy("part").cogroup(hashes.groupBy("part")).applyInPandas(find, "g int, part int, body binary")


def _alike(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each segment's anchor, and whether another of these different segments may share a string with it.

    Two strings around one anchor are equal only if half of what surrounds the anchor is, to its left or to
    its right.
    """
    _, _, _, h, at = anchored(bodies)  # a segment has one anchor
    half = (LENGTH - ANCHOR + 1) // 2
    lengths = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies) + bytes(64), "u1")
    words, base = _words(data), np.cumsum(lengths) - lengths
    maybe = np.zeros(len(bodies), bool)
    for side in (-1, 1):
        fits = at >= half if side < 0 else lengths - at - ANCHOR >= half
        where = base + at + (-half if side < 0 else ANCHOR)
        mixed = h.copy()
        for k in (*range(0, half - 8, 8), half - 8):
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ words[np.where(fits, where + k, 0)]) * M2
        _, place, count = np.unique(mixed[fits], return_inverse=True, return_counts=True)
        maybe[fits] |= count[place] > 1
    return h, maybe


def marks(cut: DataFrame) -> DataFrame:
    """(part, body): spans that go, packed: text, from, to."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(part, *_unpacked(body)) for part, body in zip(rows["part"].tolist(), rows["body"], strict=True)]
        least: dict[bytes, int] = {}
        single: dict[bytes, bool] = {}
        for _, _, docs, _, hot, bodies, _ in found:
            for body, doc, one in zip(bodies, docs.tolist(), hot.tolist(), strict=True):
                least[body] = min(doc, least.get(body, LAST))
                single[body] = one
        # Single strings that differ share nothing, and most segments differ from all others around their anchor.
        rest, inner = [b for b, one in single.items() if not one], {}
        if rest:
            h, alike = _alike(rest)
            # Segments of different anchors share nothing either, so a few shards at a time will do.
            turns = 1 + sum(len(b) for b, yes in zip(rest, alike.tolist(), strict=True) if yes) // (2 * SHARD)
            turn = np.where(alike, ((h >> np.uint64(40)) % np.uint64(turns)).astype("i8"), -1)
            for t in range(turns):
                some = [rest[k] for k in np.flatnonzero(turn == t)]
                if some:
                    inner.update(zip(some, least_owner(some, np.array([least[b] for b in some], "i8")), strict=True))
        out: dict[int, list] = collections.defaultdict(list)
        for part, ks, docs, starts, _, bodies, sure in found:
            spans = []
            for k, doc, start, body in zip(ks.tolist(), docs.tolist(), starts.tolist(), bodies, strict=True):
                if body not in inner:
                    if least[body] < doc:
                        spans.append((k, start, start + len(body)))
                    continue
                on = np.flatnonzero(inner[body] < doc)
                if len(on) == len(inner[body]):
                    spans.append((k, start, start + len(body)))
                else:
                    spans += [(k, start + o, start + o + LENGTH) for o in on.tolist()]
            out[part] += [sure, np.array(spans, "u4").reshape(-1, 3)]
        packed = [(part, _packed(np.concatenate(arrays))) for part, arrays in out.items()]
        return pd.DataFrame(packed, columns=["part", "body"])

    return cut.groupBy("g").applyInPandas(group, "part int, body binary")


def cut_out(texts_: DataFrame, gone: DataFrame) -> DataFrame:
    """For each different text: digest, least id, and what is removed from that document."""

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        spans = np.concatenate([np.empty((0, 3), "u4"), *[_unpacked(b)[0] for b in found["body"]]]).astype("i8")
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        ordered = _ordered(rows) if len(rows) else []
        cut = np.searchsorted(spans[:, 0], np.arange(len(ordered) + 1))
        for i, (digest, text, doc) in enumerate(ordered):
            mine = spans[cut[i] : cut[i + 1]]
            if not len(mine):
                out.append((digest, doc, len(text), 0, 0, digest.hex()))
                continue
            size = len(text) + 1
            off = np.cumsum(np.bincount(mine[:, 1], minlength=size) - np.bincount(mine[:, 2], minlength=size))[:-1] > 0
            runs = int(off[0]) + int((off[1:] & ~off[:-1]).sum())
            rest = np.frombuffer(text, "u1")[~off].tobytes()
            out.append((digest, doc, len(text), int(off.sum()), runs, hashlib.sha256(rest).hexdigest()))
        return pd.DataFrame(out, columns=["digest", "first_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "digest binary, first_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return texts_.groupBy("part").cogroup(gone.groupBy("part")).applyInPandas(run, schema)


def removed(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    The texts are shuffled once: the three steps that need them read the same exchange.
    """
    data = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not parts:
        size = data.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(4, size // PART)
    once = unique_texts(data, parts)
    groups = parts
    found = marks(segments(once, repeated_anchors(once, groups), groups))
    result = materialize(cut_out(once, found))
    # Copies of one text are one key: the adaptive join splits their side.
    rows = data.select("doc_id", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    all_ = rows.join(result, "digest", "left")
    whole = F.col("n") >= LENGTH  # a later copy goes, unless it is too short to hold a string
    later = F.col("doc_id") != F.col("first_id")
    pick = lambda copy, own: F.when(later & whole, copy).when(later, F.lit(0).cast("long")).otherwise(F.col(own))
    sha = F.when(later & whole, F.sha2(F.lit("").cast("binary"), 256)).when(later, F.lower(F.hex("digest"))).otherwise(F.col("kept_sha256"))
    return all_.select(
        F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), F.col("n").alias("n_bytes"),
        pick(F.col("n"), "n_removed").alias("n_removed"), pick(F.lit(1).cast("long"), "n_spans").alias("n_spans"), sha.alias("kept_sha256"),
    )
