"""Byte-level BPE encoding and decoding by tree concatenation.

A text falls apart at every change from other characters to white space, and no token crosses such a
place; the parts (units) are encoded on their own and remembered while a worker lives. What the
vocabulary's pattern cannot split is the hard case: such a run is cut into halves that are encoded in
parallel, and the halves are joined by encoding a window of tokens around the join anew, growing it
until its outer tokens agree with their neighbours on both sides.

Agreement is exact: in BPE with merges in a fixed order a token sequence is the encoding of its text
if, and only if, every two neighbours encode to themselves.

Defined results: NULL and empty texts have no tokens (the digest of nothing, for ids and for text);
repeated rows are encoded each; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import slices, texts
from tidebars.session import materialize

UNIT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space that is not ASCII, and separators that libraries class differently: no cut next to them.
ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
LEAF = 2048  # bytes of a run that are encoded at once
LONG_UNIT = 4096  # bytes from which a unit is looked at for long runs
LONG_TEXT = 65_536  # bytes from which a text is spread over tasks
PIECE = 16_384  # bytes of such a text in one row


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with one vocabulary file; remembers units up to ``limit``."""

    def __init__(self, path: str, limit: int = 700_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        alphabet = byte_alphabet()
        self.chars = {v: k for k, v in alphabet.items()}
        self.special = {t.content.encode(): i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")")
        self.sentinel, self.sentinel_id = next((s.decode(), i) for s, i in self.special.items())
        self.names = {i: t for t, i in self.tok.get_vocab().items()}
        self.bytes_of = {i: t.encode() if t.encode() in self.special else bytes(alphabet[c] for c in t) for i, t in self.names.items()}
        self.units: dict[bytes, tuple[bytes, bytes]] = {}
        self.limit = limit

    # -- runs that nothing splits -------------------------------------------------------------------

    def merge(self, run: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(run)]

    def agree(self, a: int, b: int) -> bool:
        return self.merge(self.names[a] + self.names[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' text from their encodings."""
        if not left or not right:
            return left or right
        w = 2
        while True:
            tail, head = left[-w:], right[:w]
            mid = self.merge("".join(self.names[i] for i in tail + head))
            rest, more = left[: -len(tail)], right[len(head) :]
            if (not rest or self.agree(rest[-1], mid[0])) and (not more or self.agree(mid[-1], more[0])):
                return rest + mid + more
            w *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def runs(self, text: bytes) -> list[str]:
        """What the vocabulary's pattern makes of a text, in its byte alphabet."""
        return [r for r, _ in self.tok.pre_tokenizer.pre_tokenize_str(text.decode())]

    def encode_run(self, run: str) -> list[int]:
        return self.join_all([self.merge(run[k : k + LEAF]) for k in range(0, len(run), LEAF)])

    # -- texts --------------------------------------------------------------------------------------

    def encode_plain(self, text: bytes) -> list[int]:
        """A text without special tokens."""
        if len(text) <= LONG_UNIT:
            return self.tok.encode(text.decode(), add_special_tokens=False).ids
        return [i for run in self.runs(text) for i in self.encode_run(run)]

    def said(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as decimals that each end in a comma, and what they decode to."""
        return "".join([f"{i}," for i in ids]).encode(), b"".join([self.bytes_of[i] for i in ids])

    def learn(self, units: set[bytes]) -> None:
        new = [u for u in units if u not in self.units]
        if len(self.units) + len(new) > self.limit:
            self.units = dict(itertools.islice(self.units.items(), self.limit // 2))  # what came first comes often
            new = [u for u in units if u not in self.units]
        for k in range(0, len(new), 256):
            some = new[k : k + 256]
            ids = self.tok.encode_batch_fast([self.sentinel.join(u.decode() for u in some)], add_special_tokens=False)[0].ids
            at = 0
            for u in some:
                try:
                    end = ids.index(self.sentinel_id, at)
                except ValueError:
                    end = len(ids)
                self.units[u] = self.said(ids[at:end])
                at = end + 1

    def parts(self, text: bytes) -> list[bytes | int]:
        """Units, and the ids of special tokens."""
        out: list[bytes | int] = []
        for k, part in enumerate(self.split_special.split(text) if any(s in text for s in self.special) else (text,)):
            if k % 2:
                out.append(self.special[part])
            elif part:
                out += [part] if ODD_SPACE.search(part) else UNIT.findall(part)
        return out

    def encode_parts(self, docs: list[list[bytes | int]]) -> list[tuple[bytes, bytes]]:
        self.learn({u for d in docs for u in d if not isinstance(u, int) and len(u) <= LONG_UNIT})
        out = []
        for d in docs:
            got = [self.units.get(u) or self.said([u] if isinstance(u, int) else self.encode_plain(u)) for u in d]
            out.append((b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return out

    def encode(self, text: bytes) -> list[int]:
        ids, _ = self.encode_parts([self.parts(text)])[0]
        return [int(i) for i in ids.split(b",")[:-1]]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _row(ids: bytes, text: bytes) -> tuple[int, str, str]:
    clean = text.decode("utf-8", "replace").encode()
    return ids.count(b","), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(clean).hexdigest()


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str, long_text: int = LONG_TEXT, piece: int = PIECE, leaf: int = LEAF) -> DataFrame:
    """Ids and round trip of every text, as counts and digests.

    Texts of up to ``long_text`` bytes are encoded where they are read. A longer one is cut between units,
    and inside runs longer than ``leaf``, into rows that other tasks encode; its group joins them.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, 256):
            rows = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "row": [], "seq": [], "run": [], "part": []}

            def add(*values) -> None:
                for column, v in zip(rows.values(), values, strict=True):
                    column.append(v)

            short = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                if len(text) <= long_text:
                    short.append((doc, c.parts(text)))
                else:
                    key = uuid.uuid4().hex
                    for seq, (run, part) in enumerate(_cut(c, text, piece, leaf)):
                        add(doc, None, None, None, key, seq, run, part)
            for (doc, _), got in zip(short, c.encode_parts([p for _, p in short]), strict=True):
                add(doc, *_row(*got), None, None, None, None)
            yield pa.RecordBatch.from_pydict(rows, schema=FIRST)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in slices(batches, 64):
            d = batch.to_pydict()
            ids = [c.encode(p) if r < 0 else c.merge(p.decode()) for r, p in zip(d["run"], d["part"], strict=True)]
            d["part"] = [b"".join(i.to_bytes(4, "little") for i in x) for x in ids]
            yield pa.RecordBatch.from_pydict(d, schema=batch.schema)

    def whole(key, rows: pd.DataFrame) -> pd.DataFrame:
        c = codec(path)
        rows = rows.sort_values("seq")
        ids: list[int] = []
        open_run, halves = -1, []
        for run, part in zip(rows["run"], rows["part"], strict=True):
            here = [int.from_bytes(part[k : k + 4], "little") for k in range(0, len(part), 4)]
            if run != open_run:
                ids += c.join_all(halves)
                halves = []
            open_run = run
            if run < 0:
                ids += here
            else:
                halves.append(here)
        ids += c.join_all(halves)
        doc = rows["doc_id"].iloc[0]
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(doc) else int(doc)], "Int64")} | {k: [v] for k, v in zip(("n_tokens", "ids_sha256", "decoded_sha256"), _row(*c.said(ids)), strict=True)})

    FIRST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("row", pa.string()), ("seq", pa.int32()), ("run", pa.int32()), ("part", pa.binary())])
    made = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, RESULT + ", row string, seq int, run int, part binary"))
    columns = [c.split()[0] for c in RESULT.split(", ")]
    long = made.where("row is not null").select("doc_id", "row", "seq", "run", "part")
    joined = long.repartition("row", "seq").mapInArrow(encode, long.schema).groupBy("row").applyInPandas(whole, RESULT)
    return made.where("row is null").select(columns).unionByName(joined)


def _cut(c: Codec, text: bytes, piece: int, leaf: int) -> Iterator[tuple[int, bytes]]:
    """Rows of a long text: (-1, whole units), or (run, a part of that run in the byte alphabet)."""
    run, held, size = 0, [], 0
    for part in c.parts(text):
        unit = part if isinstance(part, bytes) else next(s for s, i in c.special.items() if i == part)
        if len(unit) <= leaf or isinstance(part, int):
            held.append(unit)
            size += len(unit)
            if size >= piece:
                yield -1, b"".join(held)
                held, size = [], 0
            continue
        if held:
            yield -1, b"".join(held)
            held, size = [], 0
        for r in c.runs(unit):
            for k in range(0, len(r), leaf):
                yield run, r[k : k + leaf].encode()
            run += 1
    if held:
        yield -1, b"".join(held)


def decode(ids: list[int], path: str) -> str:
    """The text of ids, special tokens included; broken UTF-8 becomes the replacement character."""
    return b"".join(codec(path).bytes_of[i] for i in ids).decode("utf-8", "replace")


