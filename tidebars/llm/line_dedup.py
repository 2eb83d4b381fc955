"""Lines that several documents hold are kept in the first document only.

A line's key is the line without white space at its ends, A to Z in lower case. Every document's lines
are exploded with their position, and a key stands as 128 bits of hash. Different documents are counted
by hash in two steps, pairs of hash and document first: a line that a third of all rows hold is spread
by document there, and one partial row per task and hash goes on to the count. Hashes in at least
``least_docs`` documents meet the exploded positions again; the adaptive join splits a frequent hash, the
other side is one row. A document with lines to drop gets the set of their positions, and its other
lines are joined in order; text itself moves once, towards those sets.

All steps are Spark expressions. Positions are taken away as a set, in time that is linear in the lines.

Defined results: a NULL or empty text is one empty line; rows of one id are one document, whatever
their texts, and get their verdicts line by line; rows with a NULL id are one document that comes after
all ids; an empty table gives an empty table; other columns stay as they are, whatever their names
(``thinned``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = 2**63 - 1  # stands for a NULL id, which comes after all others
ENDS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """Stripped, A to Z in lower case; the quick way where all characters are ASCII."""
    bare = F.btrim(line, F.lit(ENDS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def exploded(rows: DataFrame, least_chars: int) -> DataFrame:
    """(doc, row, at, h1, h2) for each line whose key is long enough, from rows of (doc, row, text)."""
    at = rows.select("doc", "row", F.posexplode(lines(F.col("text"))).alias("at", "line"))
    keys = at.select("doc", "row", "at", key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keys.select("doc", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped(rows: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """(doc, row, gone): the positions of the lines to drop, for rows that have any."""
    held = exploded(rows, least_chars)
    pairs = held.select("h1", "h2", "doc").distinct()
    common = pairs.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where(F.col("n") >= least_docs).drop("n")
    again = held.join(common, ["h1", "h2"]).where(F.col("doc") != F.col("first"))
    return again.groupBy("doc", "row").agg(F.collect_set("at").alias("gone"))


def without(text: Column, gone: Column) -> Column:
    """The lines at all other positions, in order."""
    # The outer transform holds the lines of a text once, for all positions.
    return F.transform(
        F.array(lines(text)),
        lambda of: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(of) - 1), gone), lambda at: F.get(of, at)), "\n"),
    )[0]


def marked(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """``docs`` as a struct ``doc``, with ``gone``: the positions of lines to drop (NULL: none)."""
    id_, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    # Rows of one id that differ in text are told apart by a hash of it; equal rows get equal verdicts.
    whole = docs.select(F.coalesce(id_, F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    rows = docs.select(F.coalesce(id_, F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), text.alias("text"))
    return whole.join(dropped(rows, least_chars, least_docs), ["doc", "row"], "left").select("whole", "gone")


def thinned(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """All rows and columns of ``docs``, the texts without the lines that an earlier document holds."""
    out = marked(docs, least_chars, least_docs)
    text = F.when(F.col("gone").isNull(), F.col("whole.text")).otherwise(without(F.col("whole.text"), F.col("gone")))
    return out.select(*[text.alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """For every row: lines before dropping, lines dropped, and the digest of the text that is left."""
    out = marked(docs.select("doc_id", "text"), least_chars, least_docs)
    text, gone = F.coalesce(F.col("whole.text").cast("string"), F.lit("")), F.col("gone")
    return out.select(
        F.col("whole.doc_id").cast("long").alias("doc_id"),
        F.size(lines(text)).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        F.sha2(F.when(gone.isNull(), text).otherwise(without(text, gone)), 256).alias("kept_sha256"),
    )
