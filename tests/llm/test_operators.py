"""Every operator against a plain computation over the smallest tables, and on odd tables."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidebars.llm import bpe, exact_dedup, fill_middle, language, line_dedup, near_dup, packing, pii, quality, runs, suffix_dedup, toxicity, urls
from tidebars.llm.queries import ORACLES, QUERIES, tokenizer

WORD = r"[^\x20\x09-\x0D]+"
ODD = [(None, None), (None, "some text here"), (1, ""), (1, ""), (2, " \t\n"), (3, "Ein wort"), (4, "ein  Wort"), (5, "long " * 3000), (6, "x" * 20_000), (7, "some text here"), (8, "été à la 漢字 mail: a@b.co, +49 30 1234567")]
DOCS = "doc_id long, text string, lang string, kept boolean, n long, h long, row long, score double"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and long texts, ties, repeated rows, and columns whose names clash."""
    return spark.createDataFrame([(i, t, "de", True, 1, 1, 1, 0.5) for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# -- exact copies


def test_directory_splits_until_no_bucket_is_full():
    counts = np.array([9, 0, 0, 0, 1, 1, 1, 1])
    d = exact_dedup.Directory.grown(counts, 2)
    assert d.depth == 3 and len(d.slots) == 8
    assert d.slots[4] == d.slots[5] and d.slots[6] == d.slots[7] and d.slots[0] != d.slots[1]
    keys = np.array([0, 1 << 61, -1], "i8")
    assert d.bucket(keys).tolist() == [d.slots[0], d.slots[1], d.slots[7]]


def test_exact_groups(spark, sf_dir, docs):
    groups = collections.defaultdict(list)
    for i, t in docs.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = by_id(exact_dedup.groups(source, capacity=8))
    for text, ids in groups.items():
        for i in ids:
            assert tuple(got[i]) == (i, min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.deduplicated(source).count() == len(groups)


def test_exact_groups_of_odd_rows(odd, nothing):
    rows = exact_dedup.groups(odd).collect()
    assert len(rows) == len(ODD) and exact_dedup.groups(nothing).count() == 0
    assert {r.keep_id for r in rows if r.doc_id is None} == {1, 7}
    assert not any(r.kept for r in rows if r.doc_id is None)
    assert exact_dedup.deduplicated(odd).columns == odd.columns


# -- URL rules


def test_rules_by_array_and_by_join(spark):
    pages = spark.createDataFrame([(1, "http://A.example.com/en/7x?q"), (2, "http://example.com/en/"), (3, "https://b.net/de/8"), (4, "ftp://example.net/de/8#x"), (5, None), (6, "no scheme"), (6, "no scheme"), (7, "x://com/en/"), (8, "x://acom/en/")], "page_id long, url string")
    rules = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "block"))
    want = [(1, "example.com/en/7", "allow"), (2, "com/en/", "block"), (3, "net/de/", "block"), (4, "example.net/de/8", "block"), (5, None, "allow"), (6, None, "allow"), (6, None, "allow"), (7, "com/en/", "block"), (8, None, "allow")]
    for most in (1 << 20, 0):
        got = urls.judge(pages, rules, most_bytes=most).select("page_id", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=lambda r: (r[0], r[1] or "")) == want
    assert urls.judge(pages, ()).where("rule IS NOT NULL").count() == 0
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_rules_fit_odd_characters(spark):
    """NUL in host or path, and a rule whose path is not ASCII, by array and by join."""
    pages = spark.createDataFrame([(1, "http://a.com/en/\0x"), (2, "http://\0.a.com/en/"), (3, "http://b.net/é/x"), (4, "http://b.net?/é/")], "page_id long, url string")
    rules = (("a.com/en/", "block"), ("b.net/é/", "block"))
    for most in (urls.MOST_BYTES, 0):
        assert {r.page_id: r.verdict for r in urls.judge(pages, rules, most_bytes=most).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_registered_rules_are_those_of_the_contract(spark, tmp_path):
    """Each rule alone and against the others: in the query and in its SQL twin."""
    urls_of = ["http://x.com/en/a", "http://example.com/en/71", "http://example.com/en/8", "http://net/de/", "http://a.net/de/1", "http://www.example.net/de/81", "http://example.net/de/7", "http://b.org/es/x", "http://b.org/en/", "no host", None]
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: (r.rule, r.verdict) for r in QUERIES["op2_url_rules"](spark, str(tmp_path)).collect()}
    assert rows == dict(enumerate(want))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {r[0]: r[3:5] for r in con.execute(ORACLES["op2_url_rules"]).fetchall()} == dict(enumerate(want))


def test_equal_keys_are_told_apart_by_their_strings(monkeypatch):
    monkeypatch.setattr(urls, "key", lambda text: 7)
    array = urls.DigestArray(*urls.pack([("com/a", "block"), ("org/b", "allow")]))
    assert array.find([b"org/b", b"net/c", b"com/a"]) == [(0, b"org/b", b"allow"), (2, b"com/a", b"block")]


# -- near copies


def brute_components(docs, width, percent):
    sets = {}
    for i, t in docs.items():
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, sf_dir, docs):
    got = by_id(near_dup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(docs, 3, 85)


def test_chains_of_near_copies_need_more_than_stars(spark, monkeypatch):
    """Texts that slide along, so that only neighbours are linked; small blocks, so that lists are split."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    words = [f"w{k}" for k in range(130)]
    rows = {i: " ".join(words[i : i + 60]) for i in range(0, 40, 2)} | {99: "w1", 98: ""}
    got = by_id(near_dup.near_duplicates(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), 3, 85))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(rows, 3, 85)


def test_near_duplicates_of_odd_rows(odd, nothing):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and near_dup.near_duplicates(nothing).count() == 0
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (1, 2)} == {1: 1, 2: 2}
    assert near_dup.thinned(odd).columns == odd.columns


# -- packing


def test_packing(spark, sf_dir, docs):
    rows = QUERIES["op4_best_fit_packing"](spark, sf_dir).collect()
    check_packing(rows, docs.items(), 2048)


def check_packing(rows, docs, capacity):
    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = collections.Counter()
    total = 0
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want[(i, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for place in places.values():
        place.sort()
        assert [a for a, _ in place] == np.cumsum([0] + [n for _, n in place[:-1]]).tolist() and sum(n for _, n in place) <= capacity
    assert len(places) <= 1.02 * total / capacity + 1


def test_packing_of_odd_rows_and_many_islands(odd, nothing, spark, sf_dir, docs):
    path = tokenizer("word_bpe_49k.json")
    check_packing(packing.pack(odd, path).collect(), ODD, 2048)
    assert packing.pack(nothing, path).count() == 0
    check_packing(packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, island=40).collect(), docs.items(), 2048)


def test_breeding_beats_or_equals_best_fit():
    rng = np.random.default_rng(3)
    length = rng.integers(300, 900, 300).tolist()
    order = sorted(range(300), key=lambda i: -length[i])
    p = packing.evolve(length, 2048, seed=1)
    assert sorted(i for b in p.bins for i in b) == list(range(300))
    assert all(sum(length[i] for i in b) + f == 2048 for b, f in zip(p.bins, p.free, strict=True))
    assert packing.least(length, 2048) <= len(p.bins) <= len(packing.Bins(2048).fit(order, length).bins)


# -- language, quality, toxicity


def test_language(spark, odd, nothing):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in source.select("doc_id", "lang").collect()}
    rows = language.identify(source).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    model = language.fit(source)
    assert sorted(k for f in model.families for k in f) == list(range(len(model.languages))) and len(model.families) == 2
    got = language.predict(odd, model).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"}
    assert language.identify(nothing).count() == 0
    assert language.predict(odd, language.Hierarchy()).where("lang_pred <> 'und'").count() == 0
    assert language.accepted(odd).columns == odd.columns


def brute_quality(t):
    w = re.findall(WORD, t)
    count = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, sf_dir, docs, odd, nothing):
    got = by_id(QUERIES["op6_quality_votes"](spark, sf_dir))
    assert {i: tuple(r)[1:7] for i, r in got.items()} == {i: brute_quality(t) for i, t in docs.items()}
    assert not any(r.kept and r.base_failed for r in got.values())
    for r in quality.judge(odd).collect():
        assert tuple(r)[1:7] in {brute_quality(t or "") for i, t in ODD if i == r.doc_id}
    assert quality.judge(nothing).count() == 0


def test_votes_find_the_accuracies_of_rules():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.9
    miss = rng.random((20_000, 4)) < np.where(good[:, None], 0.003, [0.3, 0.5, 0.7, 0.9])
    votes = np.where(rng.random(miss.shape) < 0.1, 0, np.where(good[:, None], np.where(miss, -1, 1), np.where(miss, 1, -1)))
    patterns = list(collections.Counter(map(tuple, votes.tolist())).items())
    prior, rates = quality.fit(patterns, 4)
    assert abs(prior - 0.9) < 0.02
    assert all(abs(bad - want) < 0.05 for (_, bad), want in zip(rates, (0.7, 0.5, 0.3, 0.1), strict=True))
    assert quality.posterior((-1, -1, 1, 1), prior, rates) < 0.1 < 0.9 < quality.posterior((1, 1, 1, 1), prior, rates)


def test_toxicity(spark, odd, nothing):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = QUERIES["op7_toxicity_pu"](spark, d).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted for r in rows if r.toxic]) > 0.85
    assert np.mean([r.predicted for r in rows if not r.toxic]) < 0.03
    few = labels.where("toxic IS NULL")
    assert toxicity.classify(odd, few).where("score > 1e-300").count() == 0
    assert toxicity.classify(odd, spark.createDataFrame([(3, 1), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")).count() == len(ODD)
    assert toxicity.classify(nothing, labels).count() == 0


def test_verdicts_of_quality_by_hand(spark, sf_dir, docs):
    """Votes from plain counts, accuracies fitted on them, and the posterior of every text."""
    votes = {}
    for i, t in docs.items():
        words = re.findall(WORD, t)
        n, chars, symbols, dup, repeat, _ = brute_quality(t)
        lines = sum(bool(re.search(WORD, x)) for x in t.split("\n"))
        value = {
            "symbols": symbols / max(1, chars), "capitals": sum("A" <= c <= "Z" for c in t) / max(1, chars), "word_length": chars / max(1, n),
            "bare_words": sum(not any(c.isalpha() for c in w) for w in words) / max(1, n), "repeated_lines": dup / max(1, lines),
            "repeated_words": repeat / max(1, n), "exclamations": t.count("!") / max(1, n),
        }
        votes[i] = tuple(0 if not n else 1 if good[0] <= value[k] <= good[1] else -1 if not bad[0] <= value[k] <= bad[1] else 0 for k, (good, bad) in quality.RULES.items())
    patterns = collections.Counter(votes[i] for i, t in docs.items() if re.search(WORD, t))
    prior, rates = quality.fit(sorted(patterns.items()), len(quality.RULES))
    for i, r in by_id(quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))).items():
        z = prior / (1 - prior)
        for v, (a, b) in zip(votes[i], rates, strict=True):
            z *= a / (1 - b) if v == 1 else (1 - a) / b if v == -1 else 1
        assert r.p_good == pytest.approx(z / (1 + z), rel=1e-6, abs=1e-12)
        assert r.kept == (not brute_quality(docs[i])[5] and z >= 1)


def test_language_sample_travels_short(spark, docs):
    """The driver gets a profile's places that are not zero, and learns the same from them as from whole profiles."""
    x = language.profiles([t.encode() for t in docs.values()] + [b""]).astype("f2")
    short = [language.sparse(r) for r in x]
    assert [language.dense(b) for b in short] == [r.tobytes() for r in x]
    assert 2 * sum(map(len, short)) < x.nbytes
    rows = [(i, t, "ab"[i % 2]) for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5]
    got = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10**6)
    plain = sorted((lang, language.profiles([t.encode()]).astype("f2")[0].tobytes()) for _, t, lang in rows)
    want = language.Hierarchy.fitted(np.stack([np.frombuffer(b, "f2") for _, b in plain]).astype("f4"), [lang for lang, _ in plain])
    assert (got.languages, got.families, got.pairs) == (want.languages, want.families, want.pairs)
    assert np.array_equal(got.family_w, want.family_w) and np.array_equal(got.pair_w, want.pair_w)


def test_language_by_hand(spark, sf_dir, docs):
    """Every prediction from the fitted weights, trigram by trigram."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(source)
    got = by_id(language.predict(source, model))
    for i, t in list(docs.items()):
        if not re.search(r"[^\W\d_]", t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        data = [32, 32, *(b if b >= 128 else b | 32 if chr(b).isalpha() else 32 for b in t.encode()), 32, 32]
        counts = collections.Counter()
        for a, b, c in zip(data[1:], data[2:], data[3:], strict=False):
            if b != 32:
                code = (a * 2654435761 ^ b * 2246822519 ^ c * 3266489917) % 2**32
                counts[code >> 9 & language.DIMS - 1] += 1
        total = sum(counts.values())
        dot = lambda w: sum((n / total) ** 0.5 * float(w[k]) for k, n in counts.items()) + float(w[-1])  # noqa: B023, E731
        family = [dot(w) for w in model.family_w]
        best = max(range(len(family)), key=lambda f: family[f])  # noqa: B023
        wins, least = collections.Counter(), collections.defaultdict(lambda: 4.0)
        for (a, b), w in zip(model.pairs, model.pair_w, strict=True):
            m = dot(w)
            wins[a if m >= 0 else b] += 1
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        pick = max(model.families[best], key=lambda k: wins[k] + 1 / (1 + np.exp(-least[k])) / 2)  # noqa: B023
        score = 1 / (1 + np.exp(-2 * family[best])) / (1 + np.exp(-2 * least[pick]))
        assert got[i].lang_pred == model.languages[pick] and got[i].score == pytest.approx(score, abs=1e-4)


def test_toxicity_by_hand(spark, docs):
    """Every score from the fitted weights, word by word."""
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert np.count_nonzero(model.weight)
    rows = toxicity.score(source, model).join(source.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        found = set(re.findall(rb"[a-z\x80-\xff]+", (r.text or "").encode().lower()))
        found |= {w[:4] + b"-" for w in found if len(w) > 4}
        z = model.bias + sum(float(model.weight[k]) for k in {zlib.crc32(w) % toxicity.DIMS for w in found})
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6, abs=1e-12)


# -- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
            ok = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    out.sort()
    n = collections.Counter(x[3] for x in out)
    return *(n[k] for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in out).encode()).hexdigest()


def test_personal_data(spark, sf_dir, docs, odd, nothing):
    got = by_id(QUERIES["op8_personal_data"](spark, sf_dir))
    assert {i: tuple(r)[1:6] for i, r in got.items()} == {i: brute_spans(t) for i, t in docs.items()}
    texts = ["a@b.c_d@e.f x@y a.b@c-d.e.f. a@b.c.@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1111x 41111111111111111 12 -3", "+1 (947) 555-7668 +12345678 ++49 30 1234567..", "é@x.y ü+49 (0)30 123456 7 😀 a@b.co", "x@" + "a." * 5000 + "b", "1" * 30_000, ""]
    rows = by_id(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {i: tuple(r)[1:6] for i, r in rows.items()} == {i: brute_spans(t) for i, t in enumerate(texts)}
    assert pii.report(odd).count() == len(ODD) and pii.report(nothing).count() == 0
    clean = by_id(pii.redacted(odd))
    assert clean[8].text == "été à la 漢字 mail: [EMAIL], [PHONE]" and clean[3].text == "Ein wort" and pii.redacted(odd).columns == odd.columns


def test_rare_kinds_are_calibrated(spark):
    """More labelled candidates than the trees are fitted on, nearly all of them plain numbers."""
    texts = [f"there were {1_000_000 + 7 * k} of them" for k in range(400)] + [f"write to ann{k} [at] example [dot] org" for k in range(5)]
    rows = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most=40).collect()
    assert {r.doc_id for r in rows if any(x.kind == "spelled" for x in r.spans)} == set(range(400, 405))
    assert not any(r.spans for r in rows if r.doc_id < 400)
    n = {("number", 0.0): 20_000_000, ("number", 1.0): 4000, ("spelled", 1.0): 1000}
    assert {g: round(s * n[g]) for g, s in pii.shares(n, 20_000).items()} == {("number", 0.0): 15_000, ("number", 1.0): 4000, ("spelled", 1.0): 1000}


def test_long_keys_and_secrets(spark):
    """Unbroken runs of any length are candidates: a signature of 342 characters, a key of 60."""
    run = lambda k: base64.urlsafe_b64encode(hashlib.sha512(str(k).encode()).digest() * 5).decode().strip("=")
    secrets = [run(k)[:342] for k in range(10)]
    keys = [re.sub("[^A-Z0-9]", "", run(k).upper())[:60] for k in range(10)]
    texts = [f"token: {x} end" for x in secrets] + [f"key = {x} end" for x in keys] + [f"about internationalization{'abcdef'[k % 6] * (k % 9)} here" for k in range(80)]
    rows = by_id(pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for k in range(10):
        assert [(x.kind, x.s, x.e) for x in rows[k].spans] == [("secret", 7, 349)]
        assert [(x.kind, x.s, x.e) for x in rows[10 + k].spans] == [("key", 6, 66)]
    assert not any(rows[k].spans for k in range(20, 100))


def test_long_numbers_and_spelled_addresses(spark):
    """Runs of figures, and addresses of many parts, of any length are candidates whole."""
    texts = {0: f"account: {'4071' * 9} end", 1: f"write {'a' * 90} [at] {'b' * 80} [dot] c [dot] d [dot] e [dot] f [dot] org now", 2: "1 " * 20_000 + "a"}
    found = pii.search(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    hits = found[0].join(found[1], "row").where("kind IN ('number', 'spelled')").collect()
    assert {(r.doc_id, r.kind, r.s, r.e) for r in hits if r.doc_id < 2} == {(0, "number", 9, 45), (1, "spelled", 6, len(texts[1]) - 4)}


def test_overlaps_by_one_ordered_pass(spark):
    """Which spans a base match touches, and which of overlapping ones stay, against plain loops."""
    rng = np.random.default_rng(8)
    kinds = ["email", "phone", "key", "secret", "number"]
    rows = sorted({(int(r), kinds[k], int(s), int(s + n)) for r, k, s, n in zip(rng.integers(0, 6, 300), rng.integers(0, 5, 300), rng.integers(0, 300, 300), rng.integers(1, 12, 300), strict=True)})
    df = spark.createDataFrame(rows, "row long, kind string, s long, e long")
    got = {tuple(r)[:4]: r.confirmed for r in pii.overlapping(df).collect()}
    base = [x for x in rows if x[1] in pii.BASE]
    assert got == {x: any(b[0] == x[0] and b[2] < x[3] and x[2] < b[3] for b in base) for x in rows}
    taken = []
    for x in sorted(rows, key=lambda x: (x[2] - x[3], x[2], pii.ORDER[x[1]])):
        if not any(y[0] == x[0] and y[2] < x[3] and x[2] < y[3] for y in taken):
            taken.append(x)
    kept = pii.disjoint(pii.overlapping(df)).collect()
    assert sorted((r.row, r.kind, r.s, r.e) for r in kept) == sorted(taken)


def test_many_spans_in_one_text(spark):
    text = "; ".join(f"10.{k % 250}.{k // 250}.7; +49 30 {1_000_000 + k}" for k in range(20_000))
    got = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (got.n_ip, got.n_phone) == (20_000, 20_000) and got.spans.count(",") >= 39_999


# -- repeated passages


def brute_removed(docs):
    first, out = {}, {}
    for i, t in sorted(docs.items()):
        t = t.encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first.setdefault(t[k : k + 50], i) < i:
                gone[k : k + 50] = True
        out[i] = (len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeated_passages(spark, sf_dir, docs, monkeypatch):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_removed(docs)
    assert {i: tuple(r)[1:] for i, r in by_id(suffix_dedup.removed(source)).items()} == want
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert {i: tuple(r)[1:] for i, r in by_id(suffix_dedup.removed(source, parts=3)).items()} == want


def test_repeated_passages_of_odd_rows(odd, nothing):
    rows = suffix_dedup.removed(odd).collect()
    assert len(rows) == len(ODD) and suffix_dedup.removed(nothing).count() == 0
    assert {r.n_removed for r in rows if r.doc_id in (1, None)} == {0}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=14), min_size=1, max_size=12), st.integers(8, 60))
def test_merged_transforms(strings, shard):
    bodies, owners = [s.encode() for s in strings], np.arange(len(strings))[::-1].copy()
    best = {}
    for s, o in zip(bodies, owners, strict=True):
        for k in range(len(s) - 5):
            best[s[k : k + 6]] = min(best.get(s[k : k + 6], 99), o)
    got = suffix_dedup.least_owner(bodies, owners, 6, shard)
    assert [g.tolist() for g in got] == [[best[s[k : k + 6]] for k in range(len(s) - 5)] for s in bodies]


# -- encoding


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\xa0", "\u3000", "'s", "'", "!", "é", "漢", "1", "<|endoftext|>", "<|", "\x1c", "\x85", "ing", "\u200b", "😀", "e\u0301"]), max_size=40))
def test_units_encode_like_whole_texts(parts):
    path, text = tokenizer("byte_bpe_50k.json"), "".join(parts)
    lib = Tokenizer.from_file(path) if not hasattr(test_units_encode_like_whole_texts, "lib") else test_units_encode_like_whole_texts.lib
    test_units_encode_like_whole_texts.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert bpe.codec(path).encode(text.encode()) == ids and bpe.decode(ids, path) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", [["a", "b"], ["the", "ing", "tion"], ["x"], ["é", "漢"], ["0", "1"], ["!", "?", "=", "-"]])
def test_halves_of_unsplit_runs_join_exactly(letters, library):
    rng = np.random.default_rng(len(letters))
    text = "".join(rng.choice(letters, 9000))
    assert bpe.codec(tokenizer("byte_bpe_50k.json")).encode(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, sf_dir, docs, odd, nothing, library):
    def want(t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    path = tokenizer("byte_bpe_50k.json")
    got = by_id(QUERIES["op10_bpe_round_trip"](spark, sf_dir))
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: want(t) for i, t in docs.items()}
    rows = bpe.encode_documents(odd, path, long_text=100, piece=50, leaf=16).collect()
    assert collections.Counter((r.doc_id, *tuple(r)[1:]) for r in rows) == collections.Counter((i, *want(t)) for i, t in ODD)
    assert bpe.encode_documents(nothing, path).count() == 0


def test_every_token_encodes_to_itself():
    """What makes the two libraries of the packing encoder agree on words of letters."""
    import json

    model = json.load(open(tokenizer("word_bpe_49k.json")))["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank, vocab = {m: k for k, m in enumerate(merges)}, model["vocab"]
    assert all(vocab["".join(m)] == 512 + k for k, m in enumerate(merges))
    for token in vocab:
        if token.startswith("<|"):
            continue
        parts = [*token.removesuffix("</w>")]
        if token.endswith("</w>"):
            parts[-1] += "</w>"
        while len(parts) > 1:
            best, k = min((rank.get(pair, len(merges)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(merges):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [token]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", "ing", " ", "\n", ".", ",", "..", "é", "É", "»", "Σ", "İ", "ß", "'s", "'", "5", "漢", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x1c", "\xa0", "é", "ª", "tionhe", "x\x01"]), max_size=30))
def test_words_encode_like_whole_texts(parts):
    text = "".join(parts)
    lib = packing._ENCODERS.setdefault("test", packing.WordEncoder(tokenizer("word_bpe_49k.json")))
    ids = np.frombuffer(lib.encode([text.encode()])[0], "<u4").tolist()
    assert ids == lib.tok.encode(text, add_special_tokens=False).ids


# -- periodic runs


def brute_runs(words):
    """Every period from the definition: stretches of equal words one period on, the smallest period of each kept."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items() if n >= max(6, 4 * q))


def brute_report(i, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    got = brute_runs(words)
    gone = {k for a, m, q in got for k in range(a + q, a + m)}
    best = min(got, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = 1000 * best[1] // best[2] if got else None
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(got), *best, exponent, digest("".join(f"{a},{m},{q}\n" for a, m, q in got)), digest(" ".join(w for k, w in enumerate(words) if k not in gone))


def test_periodic_runs(spark, sf_dir, docs, odd, nothing, monkeypatch):
    monkeypatch.setattr(runs, "HELD", 10_000)
    got = by_id(QUERIES["op11_periodic_runs"](spark, sf_dir))
    want = {i: brute_report(i, t) for i, t in docs.items()}
    assert {i: tuple(r)[1:] for i, r in got.items()} == want and sum(w[0] > 0 for w in want.values()) > 5
    rows = runs.report(odd).collect()
    assert collections.Counter((r.doc_id, *tuple(r)[1:]) for r in rows) == collections.Counter((i, *brute_report(i, t)) for i, t in ODD)
    assert runs.report(nothing).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_runs_of_repeated_pieces(parts):
    words = [c.encode() for piece, n in parts for c in piece * n]
    word, _ = runs.names([words])
    assert runs.find(word) == brute_runs(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=6))
def test_runs_end_with_their_document(texts):
    words = [[c.encode() for c in t] for t in texts]
    word, first = runs.names(words)
    assert runs.find(word) == [(a + int(f), n, q) for w, f in zip(words, first, strict=False) for a, n, q in brute_runs(w)]


def test_runs_of_long_periods():
    """Fibonacci words hold no run of four periods; a period of thousands of words, found whole; one word a hundred thousand times."""
    a, b = "a", "ab"
    for _ in range(15):
        a, b = b, b + a
    assert runs.find(runs.names([[c.encode() for c in b]])[0]) == []
    rng = np.random.default_rng(1)
    piece = rng.integers(0, 50, 3000)
    word = np.concatenate([rng.integers(50, 90, 777), np.tile(piece, 7), piece[:55], [99], np.full(100_000, 7)])
    assert runs.find(word) == [(777, 7 * 3000 + 55, 3000), (777 + 7 * 3000 + 56, 100_000, 1)]


# -- fill in the middle


def brute_fill(i, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark, sf_dir, docs, odd, nothing, monkeypatch):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    monkeypatch.setattr(fill_middle, "HELD", 20_000)
    got = by_id(QUERIES["op12_fill_in_middle"](spark, sf_dir))
    want = {i: brute_fill(i, t) for i, t in docs.items()}
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: (*w[:4], sha(w[4]), sha(docs[i])) for i, w in want.items()}
    assert {w[1] for w in want.values()} == {"plain", "psm", "spm"}
    texts = ["<P>", "a <M> b", "<S", "<", "<P" * 50, "<<S>>", "漢字😀é" * 3000 + "a" * 9000, "\n\n", "é", "x<P y>", "<M> "] + [f"<P{k}<S{'é' * k}<M>"[: k + 3] for k in range(60)]
    rows = by_id(fill_middle.fill_middle(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("back", fill_middle.restored()))
    assert {i: tuple(r)[1:6] for i, r in rows.items()} == {i: brute_fill(i, t) for i, t in enumerate(texts)} and all(r.back == texts[i] for i, r in rows.items())
    found = collections.Counter(map(tuple, fill_middle.fill_middle(odd).collect()))
    assert found == collections.Counter((i, *brute_fill(i, t)) for i, t in ODD) and fill_middle.report(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "é", "漢", "😀", "ab漢", "\0"]), st.integers(1, 300)), max_size=12), st.sampled_from([1, 2, 5, 100]), st.sampled_from([16, 100, 1 << 20]))
def test_learned_ranks_are_exact(parts, error, block):
    text = "".join(p * n for p, n in parts)
    index = fill_middle.RankIndex(text.encode(), error, block)
    want = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).astype("i8")
    assert len(index) == len(text) and index.find(np.arange(len(text) + 1)).tolist() == want.tolist()
    assert np.abs(index.residual.astype(int)).max() <= error and index.rank(want).tolist() == list(range(len(text) + 1))


def test_one_segment_where_text_is_even():
    assert len(fill_middle.RankIndex(b"a" * 100_000).slopes) == 1
    mixed = fill_middle.RankIndex(("a" * 50_000 + "漢" * 50_000).encode())
    assert 2 <= len(mixed.slopes) <= 4 and np.allclose([mixed.slopes[0], mixed.slopes[-1]], [1, 3], atol=0.01)


# -- lines


def brute_lines(rows, least=2):
    """n_lines, n_dropped and the text left, for each row of (doc_id, text); rows without an id are the last document."""
    key = lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is None, i or 0)
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < 10 or len(holders[key(x)]) < least or i == min(holders[key(x)], key=order)]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark, sf_dir, docs, odd, nothing):
    got = QUERIES["op13_line_dedup"](spark, sf_dir).collect()
    want = brute_lines(list(docs.items()))
    assert sorted(map(tuple, got)) == sorted(want) and sum(w[2] for w in want) > 50
    assert collections.Counter(map(tuple, line_dedup.report(odd).collect())) == collections.Counter(brute_lines(ODD))
    assert line_dedup.report(nothing).count() == 0


def test_line_dedup_of_odd_lines(spark):
    rows = [
        (5, "Same line HERE\n\n  same LINE here\t\nshort\nonly in five"),
        (3, "short\n\x0bsame line here\r\n\nsame line here\n"),
        (7, "same line here"),
        (7, "another text\nsame line here"),
        (7, "another text\nsame line here"),
        (None, "only without an id\nSAME LINE HERE"),
        (None, "only without an id\nÉté à la plage"),
        (9, "été à la plage\nÉtÉ À LA PLAGE\nété à la PLAGE"),
        (8, "ÉtÉ À la plage\n\x85Same line here\xa0"),
        (8, None),
        (8, "\n"),
        (10, "\n".join(f"line number {k % 40}" for k in range(4000))),
        (11, "\n".join(f"LINE NUMBER {k % 41}" for k in range(4000))),
    ]
    source = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, whole string, gone int, doc int")
    for least in (2, 3):
        got = line_dedup.report(source, least_docs=least).collect()
        assert collections.Counter(map(tuple, got)) == collections.Counter(brute_lines(rows, least))
    thin = line_dedup.thinned(source)
    assert thin.columns == source.columns
    assert collections.Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in thin.collect()) == collections.Counter((i, s) for i, _, _, s in brute_lines(rows))


# -- stages of the pipeline on odd tables


def test_stages_keep_one_of_repeated_rows(spark, odd, nothing):
    """Repeated rows and rows without an id: one of each text stays, the one with an id if there is one."""
    exact = exact_dedup.deduplicated(odd)
    assert exact.columns == odd.columns and collections.Counter((r.doc_id, r.text) for r in exact.collect()) == collections.Counter([(1, ""), (2, " \t\n"), *[(i, t) for i, t in ODD if i and i > 2]])
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(None, long), (None, long), (5, long + " more"), (5, long + " more"), (5, "another text of the same id"), (None, "alone and without an id"), (None, "alone and without an id"), (None, None), (9, None), (9, "")]
    near = near_dup.thinned(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _id int"))
    got = collections.Counter((r.doc_id, r.text) for r in near.collect())
    want = {(5, long + " more"), (5, "another text of the same id"), (None, "alone and without an id")}
    assert want <= set(got) and max(got.values()) == 1 and not any(t == long for _, t in got) and all(not t for _, t in set(got) - want)
    clashing = nothing.withColumnsRenamed({"h": "_spans", "n": "_whole", "row": "_id"})
    for stage in (exact_dedup.deduplicated, near_dup.thinned, pii.redacted, language.accepted, line_dedup.thinned):
        out = stage(clashing)
        assert out.columns == clashing.columns and out.count() == 0
