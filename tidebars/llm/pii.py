"""Personal data: candidate spans, judged by boosted trees.

Base patterns (e-mail, IP address, payment card, phone) always count. High-recall generators add
overlapping candidates: numbers written in other ways, addresses spelled out, keys and passwords.
Boosted trees judge them by format (length, shares of digits and letters, separators, check sums) and
context (words before the span). Their labels come from the corpus: candidates that a base match
confirms, or that follow a naming word, are examples; numbers that fail the checks and stand in no
such context are counter-examples. A threshold for each kind is calibrated so that precision on the
examples is at least ``precision``. Of overlapping accepted spans the longest stays.

The trees are fitted on a sample of about ``most`` labelled candidates, chosen by a hash; each kind and
label has an equal part of it, or all it has. The thresholds come from all labelled candidates, and
every text is searched whole. Only DataFrame functions and Spark's own trees: no Python runs on the
executors.

Positions count code points, ends are exclusive. Defined results: NULL and empty texts have no spans
(the digest of nothing, an empty list); repeated rows are judged each; an empty table gives an empty
table; without candidates of both classes no span is added.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebars.session import materialize

# The patterns find what the plain ones find. A repeated group at the end is possessive, so that it needs no
# stack; a match starts where the class's run starts, or where the match before ended, so that long runs are
# read once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3, "key": 4, "secret": 5, "number": 6, "spelled": 7}
#: High recall: of these the trees choose. Runs are taken whole, whatever their length; a longer row of groups of figures
#: is several numbers.
CANDIDATES = {
    "key": r"(?<![A-Za-z0-9])[A-Z0-9]{16,}+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
    "number": r"(?<![A-Za-z0-9+.])(?:\(?[0-9][0-9() ./-]{5,24}[0-9]|[0-9]{28,}+)(?![A-Za-z0-9])",
    "spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++)++",
}
#: Words that name what follows.
NAMING = r"(?i)(pass(word|wd)?|secret|token|key|api|auth|ssn|iban|phone|tel|mobile|fax|call|card|account|mail|contact|user|login)"
CONTEXT = 32  # characters before a span
FEATURES = ["size", "digits", "upper", "lower", "separators", "groups", "hex", "luhn", "named", "assigned", "quoted", "plus_near", "mixed"]


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]+', '')"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the check sum."""
    doubled = "if((size(d) - i) % 2 = 0, if(2 * x > 9, 2 * x - 9, 2 * x), x)"
    figures = f"transform(split({digits}, ''), c -> coalesce(try_cast(c AS int), 0))"
    return f"transform(array({figures}), d -> aggregate(transform(d, (x, i) -> {doubled}), 0, (a, x) -> a + x))[0] % 10 = 0"


def _valid(kind: str) -> str:
    if kind == "ip":
        return "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(p AS decimal(38, 0)), 999) <= 255)"
    if kind == "card":
        return f"length({_digits('m')}) BETWEEN 12 AND 19 AND {luhn(_digits('m'))}"
    if kind == "phone":
        return f"length({_digits('m')}) BETWEEN 9 AND 15"
    return "true"


NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]", "phone": "[+][0-9]", "key": "[A-Z0-9]{16}", "secret": "[A-Za-z0-9+/_-]{16}", "number": "[0-9]", "spelled": "[(\\\\[] ?at"}


def matches(kind: str, pattern: str) -> str:
    """SQL: array of the matches in text, each with the length and the end of the gap before it."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    empty = "cast(array() AS array<struct<kind: string, k: int, m: string, g: bigint, before: string>>)"
    parts = f"array(named_struct('m', regexp_extract_all(text, '{quoted}', 0), 'g', split(text, '{quoted}', -1)))"
    each = f"named_struct('kind', '{kind}', 'k', k, 'm', m, 'g', length(x.g[k])::bigint, 'before', right(x.g[k], {CONTEXT}))"
    return f"if(text rlike '{NEEDS[kind]}', transform({parts}, x -> transform(x.m, (m, k) -> {each}))[0], {empty})"


def search(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered rows (row, doc_id, text_key), and all matches: row, kind, start, end, text and context.

    Gaps and matches laid end to end give the places: a running sum over the matches of a row and kind.
    """
    every = ", ".join(matches(k, p) for k, p in {**BASE, **CANDIDATES}.items())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hits = materialize(texts.selectExpr("doc_id", "monotonically_increasing_id() AS row", "xxhash64(text) AS text_key", f"concat({every}) AS hits"))
    placed = hits.selectExpr("row", "inline(hits)").withColumn("e", F.expr("sum(g + length(m)) OVER (PARTITION BY row, kind ORDER BY k)"))
    return hits.select("row", "doc_id", "text_key"), placed.select("row", "kind", (F.col("e") - F.length("m")).alias("s"), "e", "m", "before")


def features(c: DataFrame) -> DataFrame:
    """Format and context of candidates (columns kind, m, before)."""
    count = lambda cls: F.expr(f"cast(length(regexp_replace(m, '[^{cls}]+', '')) AS double)")
    return (
        c.withColumn("size", F.length("m").cast("double"))
        .withColumn("digits", count("0-9") / F.col("size"))
        .withColumn("upper", count("A-Z") / F.col("size"))
        .withColumn("lower", count("a-z") / F.col("size"))
        .withColumn("separators", count(" ()./-") / F.col("size"))
        .withColumn("groups", F.expr("cast(size(regexp_extract_all(m, '[0-9]+', 0)) AS double)"))
        .withColumn("hex", F.expr("if(m rlike '^[0-9a-f]+$' AND m rlike '[a-f]', 1.0D, 0.0D)"))
        .withColumn("luhn", F.expr(f"if({_digits('m')} <> '' AND {luhn(_digits('m'))}, 1.0D, 0.0D)"))
        .withColumn("named", F.col("before").rlike(NAMING + r"\W{0,4}$").cast("double"))
        .withColumn("assigned", F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"))
        .withColumn("quoted", F.col("before").rlike("[\"']$").cast("double"))
        .withColumn("plus_near", F.col("before").rlike(r"\+[0-9 ()-]*$").cast("double"))
        .withColumn("mixed", F.expr("if(m rlike '[0-9]' AND m rlike '[A-Za-z]', 1.0D, 0.0D)"))
    )


def labelled(c: DataFrame) -> DataFrame:
    """Distant labels: 1 for what stands in a naming context or is confirmed by a base match, 0 for what has
    the form of plain words or a bare number; others carry none."""
    sure = (
        (F.col("confirmed") & F.col("kind").isin("number"))
        | (F.col("kind").isin("secret", "key") & (F.col("named") + F.col("assigned") >= 1) & (F.col("digits") >= 0.1))
        | ((F.col("kind") == "key") & (F.col("mixed") == 1) & F.col("m").rlike("^[A-Z]{2,6}[A-Z0-9]{12,}$"))
        | (F.col("kind") == "spelled")
        | ((F.col("kind") == "number") & (F.col("named") == 1))
    )
    plain = (~F.col("confirmed")) & (F.col("named") == 0) & (((F.col("kind") == "number") & (F.col("groups") != 3)) | (F.col("kind").isin("secret", "key") & ((F.col("digits") < 0.05) | (F.col("digits") == 1))))
    return c.withColumn("label", F.when(sure, 1.0).when(plain, 0.0))


def thresholds(scored: DataFrame, precision: float) -> dict[str, float]:
    """For each kind the lowest score, of 20 steps, from which on precision holds; 1.01 if none does."""
    steps = scored.groupBy("kind", F.floor(F.col("p") * 20).alias("step")).agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()  # kinds x 21
    out = {}
    for kind in CANDIDATES:
        here = sorted(((r["step"], r["right"], r["n"]) for r in steps if r["kind"] == kind), reverse=True)
        right = n = 0
        best = 1.01
        for step, r, k in here:
            right, n = right + r, n + k
            if right >= precision * n and step >= 10:
                best = step / 20
        out[kind] = best
    return out


def shares(n: dict[tuple[str, float], int], most: int) -> dict[tuple[str, float], float]:
    """The share of each kind and label that the trees are fitted on: the small ones whole, the others in
    equal numbers, about ``most`` in all."""
    out, left = {}, most
    for k, group in enumerate(sorted(n, key=lambda g: (n[g], g))):
        out[group] = min(1.0, left / (len(n) - k) / n[group])
        left -= out[group] * n[group]
    return out


def judged(candidates: DataFrame, most: int, precision: float) -> DataFrame:
    """Candidates that the trees accept: doc row key, s, e, kind."""
    rated = materialize(labelled(features(candidates)))
    known = rated.where("label IS NOT NULL")
    n = {(r["kind"], r["label"]): r["count"] for r in known.groupBy("kind", "label").count().collect()}  # kinds x 2
    if len({label for _, label in n}) < 2:
        return rated.where("false").select("row", "s", "e", "kind", "confirmed")
    draw = F.pmod(F.xxhash64("row", "s", "kind"), F.lit(1 << 50))
    part = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("label") == v), F.lit(int(share * (1 << 50)))) for (k, v), share in shares(n, most).items()])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    learn = vectors.transform(known.where(draw < part)).select("features", "label").coalesce(4)
    model = GBTClassifier(maxIter=8, maxDepth=3, seed=1).fit(learn)
    p = vector_to_array("probability")[1].alias("p")
    scored = materialize(model.transform(vectors.transform(rated)).select("row", "s", "e", "kind", "confirmed", "label", p))
    limits = thresholds(scored.where("label IS NOT NULL"), precision)
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in limits.items()])
    return scored.where(F.col("p") >= limit).select("row", "s", "e", "kind", "confirmed")


RANK = "element_at(map({}), kind)".format(", ".join(f"'{k}', {v}" for k, v in ORDER.items()))
LIST = "array<struct<s: bigint, rank: int, e: bigint, kind: string>>"


def _gathered(spans: DataFrame, name: str) -> DataFrame:
    return spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", F.expr(RANK).alias("rank"), "e", "kind"))).alias(name))


def _listed(array: str) -> str:
    """SQL: spans in order of start, then kind, as kind:start:end joined by commas."""
    return f"array_join(transform({array}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"


def overlapping(placed: DataFrame) -> DataFrame:
    """Adds ``confirmed``: whether a base match overlaps the row. One ordered pass in either direction over the matches of a text."""
    own = F.col("kind").isin(*BASE)
    span = lambda order: Window.partitionBy("row").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(own, F.col("e"))).over(span(F.col("s")))  # of base matches that start here or before
    ahead = F.min(F.when(own, F.col("s"))).over(span(F.col("s").desc()))  # of those that start here or behind
    return placed.withColumn("confirmed", F.coalesce(reach > F.col("s"), F.lit(False)) | F.coalesce(ahead < F.col("e"), F.lit(False)))


def disjoint(spans: DataFrame) -> DataFrame:
    """Of overlapping spans of a text the longest stays (ties: the earlier, then the kind); a span goes if it overlaps one
    that was taken. Runs of spans that touch each other are told apart first, so a text with many spans takes no longer."""
    order = Window.partitionBy("row").orderBy("s", "e", "kind")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.when(F.col("s") < before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = F.struct((F.col("s") - F.col("e")).alias("n"), "s", F.expr(RANK).alias("rank"), "e", "kind", "confirmed")
    taken = "aggregate(c, slice(c, 1, 0), (a, x) -> if(exists(a, y -> y.s < x.e AND x.s < y.e), a, concat(a, array(x))))"
    chosen = runs.groupBy("row", "run").agg(F.sort_array(F.collect_list(each)).alias("c"))
    return chosen.selectExpr("row", f"inline(if(size(c) = 1, c, {taken}))").select("row", "s", "e", "kind", "confirmed")


def detect(docs: DataFrame, most: int = 20_000, precision: float = 0.9) -> DataFrame:
    """row, doc_id, key of the text, base and all spans of every document. ``row`` numbers rows."""
    rows, placed = search(docs)
    valid = "CASE kind " + " ".join(f"WHEN '{k}' THEN {_valid(k)}" for k in BASE) + " ELSE true END"
    placed = materialize(overlapping(placed.where(valid)))
    own = F.col("kind").isin(*BASE)
    base = _gathered(placed.where(own), "base")
    added = _gathered(disjoint(judged(placed.where(~own), most, precision)).where(~F.col("confirmed")), "added")
    none = f"cast(array() AS {LIST})"
    both = rows.join(base, "row", "left").join(added, "row", "left").selectExpr("row", "doc_id", "text_key", f"coalesce(base, {none}) AS base", f"coalesce(added, {none}) AS added")
    return both.selectExpr("row", "doc_id", "text_key", "base", "sort_array(concat(base, added)) AS spans")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of base spans, and the list of all."""
    counts = [f"size(filter(base, x -> x.kind = '{k}'))::long AS n_{k}" for k in BASE]
    return detect(docs).selectExpr("doc_id", *counts, f"sha2({_listed('base')}, 256) AS base_sha256", f"{_listed('spans')} AS spans")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with ``[KIND]`` in place of every span; overlapping spans become one. All columns stay,
    n_chars follows the new text if it is there."""
    named = {"doc_id": "id", "text_key": "key", "spans": "spans"}
    spans = detect(docs).where("size(spans) > 0").selectExpr(*(f"{a} AS {b}" for a, b in named.items())).dropDuplicates(["id", "key"])
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("whole"), docs["doc_id"].cast("long").alias("own_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("own_key"))
    joined = whole.join(spans, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left")
    step = """if(x.s < a.at, named_struct('out', a.out, 'at', greatest(a.at, x.e)), named_struct(
        'out', concat(a.out, substring(whole.text, int(a.at) + 1, int(x.s - a.at)), '[', upper(x.kind), ']'), 'at', x.e))"""
    text = f"if(spans IS NULL, whole.text, aggregate(spans, named_struct('out', '', 'at', 0L), (a, x) -> {step}, a -> concat(a.out, substring(whole.text, int(a.at) + 1))))"
    out = joined.select("whole", "spans", F.expr(text).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("whole.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns])
