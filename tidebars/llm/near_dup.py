"""Near-duplicates by an inverted join over signature coordinates.

A document is the set of its distinct word shingles; two are linked if 100 * intersection is at least
``percent`` * union. Documents with equal sets are one class. Each class is posted under its
``COORDINATES`` pairs of coordinate and minimum hash. Linked classes agree in at least ``matches``
coordinates, but for a chance under 1e-6 that the binomial law gives; so

* pairs that occur once are left out, and with them every class that has too few left (skip merging);
* a class with m pairs left is read under its m - matches + 1 rarest pairs only (prefix merging): two
  classes that agree in ``matches`` pairs meet in one of these.

Lists are not expanded into pairs. First every member is compared with the least of its list. Then
lists whose members are connected are done; in the others, members of different components are
compared, in blocks, by finer signatures, and those that agree often enough by their full sets. So a
large group of copies costs a number of rows in proportion to its members, and no link that the
signatures show between two components is left out.

Defined results: NULL and empty texts have an empty set and are linked with nothing; a row with a NULL
id has no component and is kept (``thinned`` gives it a number first, so that it takes part); repeated
rows fall in one class, and ``thinned`` keeps one of them; an empty table gives an empty table.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import one_of_each, row_id, slices, texts
from tidebars.session import materialize, tidy

COORDINATES = 32
FINE = 512  # coordinates of one byte that are compared before full sets are
BLOCK = 512
ROUNDS = 2
_RNG = np.random.default_rng(20)
MULTIPLIERS = _RNG.integers(1, 2**63, COORDINATES, dtype="u8") * 2 + 1
FINE_MULTIPLIERS = _RNG.integers(1, 2**63, FINE, dtype="u8") * 2 + 1
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def least_matches(percent: int, chance: float = 1e-6, n: int = COORDINATES) -> int:
    """The largest number of agreeing coordinates that a link misses with less than ``chance``."""
    p, below = percent / 100, 0.0
    for t in range(n + 1):
        below += math.comb(n, t) * p**t * (1 - p) ** (n - t)
        if below >= chance:
            return max(1, t)
    return n


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, "u8")
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = len(h) - width + 1
    out = np.zeros(n, "u8")
    for k in range(width):
        out = (out ^ h[k : k + n]) * MIX[k % 3]
        out ^= out >> np.uint64(29)
    return np.unique(out * MIX[0])


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to tell the shingles of two documents apart."""
    return (s >> np.uint64(16)).view("u1").reshape(-1, 8)[:, :6].tobytes()


def unpacked(body: bytes) -> np.ndarray:
    wide = np.zeros((len(body) // 6, 8), "u1")
    wide[:, :6] = np.frombuffer(body, "u1").reshape(-1, 6)
    return wide.view("u8").ravel()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Least hash of each set in each coordinate; sets must not be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat((every * a) >> np.uint64(32), starts) for a in MULTIPLIERS], 1).astype("u4").view("i4")


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, size of the set, its 128-bit digest, and its signature (NULL for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [shingles(t, width) for t in texts(batch)]
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full).tolist() if full else [])
            marks = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "i8") for s in sets]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n": [len(s) for s in sets], "hi": [int(m[0]) for m in marks], "lo": [int(m[1]) for m in marks], "sig": [next(sigs) if len(s) else None for s in sets]}, schema=SETS
            )

    SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sig", pa.list_(pa.int32()))])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, sig array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The full sets of some documents, their sizes, and for each a fine signature: a byte of the least hash in
    ``FINE`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [shingles(t, width) for t in texts(batch)]
            fine = [bytes(FINE)] * len(sets)
            full = [k for k, s in enumerate(sets) if len(s)]
            if full:
                every, starts = np.concatenate([sets[k] for k in full]), np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
                least = np.stack([np.minimum.reduceat(every * a, starts) >> np.uint64(8) for a in FINE_MULTIPLIERS], 1).astype("u1")
                for k, row in zip(full, least, strict=True):
                    fine[k] = row.tobytes()
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n": [len(s) for s in sets], "body": [packed(s) for s in sets], "fine": fine}, schema=SETS)

    SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("body", pa.binary()), ("fine", pa.binary())])
    some = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")
    return some.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, n long, body binary, fine binary").dropDuplicates(["id"])


def prefixes(classes: DataFrame, matches: int) -> DataFrame:
    """(id, token) of the rarest coordinate pairs of every class that can have a link."""
    posted = classes.select("id", F.posexplode("sig").alias("k", "v")).select("id", F.expr("shiftleft(cast(k AS bigint), 32) | (v & 4294967295L)").alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    left = posted.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))  # at most COORDINATES each
    return left.where(F.size("t") >= matches).select("id", F.explode(F.expr(f"slice(t, 1, size(t) - {matches - 1})")).alias("x")).select("id", "x.token")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets fulfil the condition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for k, (s, t) in enumerate(zip(x, y, strict=True)):
                s, t = unpacked(s), unpacked(t)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_pydict({"a": [a[k] for k in keep], "b": [b[k] for k in keep]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    # A document in very many pairs makes one side of a join hot; the adaptive join splits it.
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("body").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id, by alternating large and small stars."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
        tidy(links.sparkSession)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return materialize(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))


def compared(members: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs of different components in one list whose fine signatures and sizes allow a link.

    ``members``: token, id, comp, n, fine, prefix (all tokens of the member, ascending). Every member meets,
    in blocks, all members outside the list's largest component. A pair comes from the first token that
    it shares only. With ``best``, only so many pairs of the same two components in a block.
    """
    matches = least_matches(percent, n=FINE)
    sizes = members.groupBy("token", "comp").count()
    largest = sizes.groupBy("token").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("size"), F.max("count").alias("top"), F.count("*").alias("parts")).where("parts > 1")
    open_lists = members.join(largest, "token")
    lefts, rights = F.expr(f"cast(ceil(size / {BLOCK}) AS bigint)"), F.expr(f"cast(ceil((size - top) / {BLOCK}) AS bigint)")
    here = open_lists.withColumn("i", F.pmod(F.xxhash64("id"), lefts)).withColumn("j", F.pmod(F.xxhash64("id"), rights))
    kept = ["id", "comp", "n", "fine", "prefix"]
    left = here.select("token", "i", F.explode(F.sequence(F.lit(0).cast("long"), rights - 1)).alias("j"), F.lit(False).alias("minor"), *kept)
    right = here.where("comp <> main").select("token", F.explode(F.sequence(F.lit(0).cast("long"), lefts - 1)).alias("i"), "j", F.lit(True).alias("minor"), *kept)

    def block(x: dict[str, np.ndarray]) -> list[tuple]:
        """(component, component, -agreeing, id, id) of one block's pairs."""
        a, b = np.flatnonzero(~x["minor"]), np.flatnonzero(x["minor"])
        if not len(a) or not len(b):
            return []
        na, nb = x["n"][a][None], x["n"][b][:, None]
        agree = np.stack([np.count_nonzero(x["fine"][a] == s, axis=1) for s in x["fine"][b]])
        r, k = np.nonzero((agree >= matches) & (x["comp"][b][:, None] != x["comp"][a][None]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)))
        token = x["token"][0]
        first = [min(set(x["prefix"][b[i]]).intersection(x["prefix"][a[j]])) == token for i, j in zip(r, k, strict=True)]
        r, k = r[first], k[first]
        low, high = np.minimum(x["id"][b[r]], x["id"][a[k]]), np.maximum(x["id"][b[r]], x["id"][a[k]])
        p, q = np.minimum(x["comp"][b[r]], x["comp"][a[k]]), np.maximum(x["comp"][b[r]], x["comp"][a[k]])
        out = sorted(set(zip(p.tolist(), q.tolist(), (-agree[r, k]).tolist(), low.tolist(), high.tolist(), strict=True)))
        seen: collections.Counter = collections.Counter()
        kept = []
        for row in out:
            seen[row[:2]] += 1
            if not best or seen[row[:2]] <= best:
                kept.append(row)
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def done(x: dict[str, np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
            found, at = set(), 0
            for end in ends.tolist():
                found.update((r[3], r[4]) for r in block({k: v[at:end] for k, v in x.items()}))
                at = end
            return pa.RecordBatch.from_pydict({"a": [f[0] for f in found], "b": [f[1] for f in found]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        for batch in slices(batches, 8192):
            new = {n: batch.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(batch.schema.names) if n != "fine"}
            new["fine"] = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("fine")).to_pylist()), "u1").reshape(-1, FINE)
            held = {n: np.concatenate([held[n], v]) for n, v in new.items()} if held else new
            borders = np.flatnonzero((np.diff(held["token"]) != 0) | (np.diff(held["i"]) != 0) | (np.diff(held["j"]) != 0)) + 1
            if len(borders):
                yield done(held, borders)
                held = {n: v[borders[-1] :] for n, v in held.items()}
        if held:
            yield done(held, np.array([len(held["token"])]))

    # Rows come block by block; only one block is held.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.unionByName(right).repartition(tasks, "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    matches = least_matches(percent)
    all_sets = materialize(described(docs, width))
    classes = materialize(all_sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    lists = materialize(prefixes(classes.select("id", "sig"), matches))
    sets = materialize(full_sets(docs, lists.select("id").distinct(), width))
    sigs = classes.select("id", "sig")
    # Every member with the least of its list, if their signatures agree.
    least = lists.groupBy("token").agg(F.min("id").alias("a"))
    stars = lists.join(least, "token").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    signed = stars.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    agreeing = signed.where(F.expr(f"aggregate(zip_with(x, y, (p, q) -> if(p = q, 1, 0)), 0, (s, n) -> s + n) >= {matches}"))
    links = materialize(linked(agreeing.select("a", "b"), sets, percent))
    tidy(docs.sparkSession)
    tokens = lists.groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("prefix"))  # at most COORDINATES each
    known = materialize(sets.select("id", "n", "fine").join(tokens, "id"))
    # Then what the stars leave apart: a few pairs of each two components, at last all of them.
    for turn in range(ROUNDS):
        comps = components(links)
        tidy(docs.sparkSession)
        members = lists.join(comps, "id", "left").select("token", "id", F.coalesce("component", "id").alias("comp"))
        parts = members.groupBy("token").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select("token")
        members = members.join(parts, "token").join(known, "id")
        more = materialize(linked(compared(members, percent, 4 if turn < ROUNDS - 1 else None), sets, percent))
        if not more.head(1):
            # Nothing joined; what was left out by ``best`` is looked at once, then it is over.
            if turn < ROUNDS - 1:
                more = materialize(linked(compared(members, percent, None), sets, percent))
            if not more.head(1):
                break
        links = links.unionByName(more)
    else:
        comps = components(links)
    by_set = classes.join(comps, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("comp"))
    out = all_sets.select("doc_id", "n", "hi", "lo").join(by_set, ["hi", "lo"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("comp"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def thinned(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with all columns: that of the smallest id. Rows with a NULL id take part
    behind all others; of rows that repeat an id and text one stays."""
    text = F.coalesce(docs["text"], F.lit(""))
    named = docs.select(row_id(docs["doc_id"], text).alias("doc_id"), docs["text"].alias("text"))
    stay = near_duplicates(named, width, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    keys = {"_id": row_id(docs["doc_id"], text), "_text": F.xxhash64(F.lit(1), text)}
    return one_of_each(docs, keys, stay)
