"""Ranked search, collocations and archives against plain loops, SQL and odd rows."""

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from awardlens.llm import collocations, norm_buckets, warc
from awardlens.llm.queries import ORACLES, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_norm_buckets", "op12_collocations", "op13_warc"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{MIDDLE}/{table}.parquet'")
    expected = con.execute(ORACLES[name])
    names = [c[0] for c in expected.description]
    found = QUERIES[name](spark, MIDDLE)
    assert sorted(found.columns) == sorted(names)
    found = [tuple(row) for row in found.select(*names).collect()]
    assert sorted(found, key=repr) == sorted(expected.fetchall(), key=repr) and found


# ---- 11 ranked search --------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return TERM.findall(lower)


def plain_ranks(docs, items, k=50):
    counts = [(doc, Counter(terms(text))) for doc, text in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        hits = []
        for doc, c in counts:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)) & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + 50 * n * n_docs // n_terms
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                hits.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(hits)[:k], 1):
            out.append((item, rank, None if null else doc, -score))
    return out


def test_terms_of_odd_texts():
    for text in ["", "A-b_c9", "ÀB é\x7fx\x80y", "a\0b", "İI ſ K", "漢字,かな 1.5"]:
        assert [t.decode() for t in norm_buckets.terms_of(text.encode())] == terms(text)


ODD_DOCS = [
    (1, None), (2, ""), (3, "!!! ..."), (4, "alpha beta gamma"), (4, "alpha beta gamma"), (None, "alpha beta gamma"),
    (5, "alpha " * 50_000), (6, "beta"), (7, "BETA alpha Ünï"), (8, "ünï Ünï"), (None, None),
]
ODD_ITEMS = [(1, "alpha beta"), (2, None), (3, "nowhere"), (None, "Ünï beta"), (4, "alpha"), (4, "gamma")]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_of_odd_rows(spark, k):
    docs = spark.createDataFrame(
        [(*row, "x", 1, 0.5) for row in ODD_DOCS], "doc_id long, text string, score string, n long, rank double"
    ).repartition(3)
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    found = norm_buckets.rank(docs, items, k=k, item_block=2).collect()
    whole = [(1, "alpha beta"), (2, None), (3, "nowhere"), (None, "Ünï beta"), (4, "alpha gamma")]
    assert sorted(map(tuple, found), key=repr) == sorted(plain_ranks(ODD_DOCS, whole, k), key=repr)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ODD_ITEMS, "item_id long, text string")
    assert norm_buckets.rank(docs.limit(0), items).count() == 0
    none = norm_buckets.rank(docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_with_text_ids_and_many_ties(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    docs = [(f"d{k}", " ".join(rng.choices(words, k=3))) for k in range(600)]
    items = [(f"i{k}", " ".join(rng.choices(words, k=4))) for k in range(20)]
    found = norm_buckets.rank(
        spark.createDataFrame(docs, "doc_id string, text string"),
        spark.createDataFrame(items, "item_id string, text string"),
        k=7,
    )
    assert sorted(map(tuple, found.collect())) == sorted(plain_ranks(docs, items, 7))


def test_bounds_never_lose_a_document():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, v = 40, 12
        sizes = rng.integers(1, v + 1, n)
        terms_ = np.concatenate([rng.permutation(v)[:s] for s in sizes]).astype(np.int64)
        impacts = rng.integers(1, 10**9, len(terms_))
        starts = np.append(0, np.cumsum(sizes))
        norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, starts[:-1]))
        bucket = norm_buckets.Bucket(list(range(n)), starts, terms_, impacts, norms, v)
        item = rng.permutation(v)[: rng.integers(1, 7)].astype(np.int64)
        exact = np.array(
            [sum(int(i) for t, i in zip(terms_[a:b], impacts[a:b]) if t in item) for a, b in zip(starts, starts[1:])]
        )
        least = int(np.sort(exact)[-rng.integers(1, 10)])
        rows = bucket.candidates(item, max(1, least))
        assert set(np.flatnonzero(exact >= max(1, least))) <= set(rows.tolist())
        if len(rows):
            scratch = np.zeros(v, bool)
            assert bucket.scores(item, rows, scratch).tolist() == exact[rows].tolist()
            assert not scratch.any()


def test_short_vectors_are_passed_over():
    norms = np.array([5.0, 4.0])
    bucket = norm_buckets.Bucket([1, 2], np.array([0, 1, 2]), np.array([0, 1]), np.array([5, 4]), norms, 2)
    item = np.array([0, 1])
    assert bucket.candidates(item, 8).size == 0  # root of 2 times 5 is below 8
    assert bucket.candidates(item, 5).tolist() == [0]


# ---- 12 collocations ---------------------------------------------------------------------


def plain_phrases(docs, least, top):
    lower = {c: c + 32 for c in range(65, 91)}
    f = {}
    for lang, text in docs:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 6):
                counts.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for w, c in counts.items() if len(w) == 1)
        found = {w: c for w, c in counts.items() if len(w) > 1 and c >= least}
        covered = {
            w[i:j]
            for w, c in found.items()
            for i in range(len(w))
            for j in range(i + 2, len(w) + 1)
            if j - i < len(w) and c >= found[w[i:j]]
        }
        rows = []
        for w, a in found.items():
            cuts = [(1000 * a * n // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if w not in covered:
                rows.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


ODD_TEXTS = [
    None, "", " . ! ", "One two, three four five six seven", "one TWO three", "a\tb\x0bc\x0cd e  f", "é\x85x\xa0y É x",
    "go " * 3000, "same words in a row again " * 400, "x\x1cy z. x\x1cy z! x\x1cy z", "...,,,a b...", "İ i",
]


@pytest.mark.parametrize("chunk_words", [1, 3, 48, 10**6])
@pytest.mark.parametrize("least", [1, 3])
def test_phrases_equal_a_plain_count(spark, least, chunk_words):
    rng = random.Random(2)
    docs = [(lang, text) for text in ODD_TEXTS for lang in ("en", None)]
    docs += [(rng.choice(["en", "de", "und"]), " ".join(rng.choices("a b c d. e, F".split(), k=60))) for _ in range(20)]
    docs += docs[-4:] * 3
    rows = [(k % 5 or None, lang, text, 1, "x") for k, (lang, text) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, count long, phrase string").repartition(4)
    # A filter of the least size is nearly full here: results don't depend on it.
    found = collocations.collocations(df, least, 300, chunk_words=chunk_words, filter_bits=1 << 15)
    assert sorted(map(tuple, found.collect())) == sorted(plain_phrases(docs, least, 300))


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(empty).count() == 0
    blank = spark.createDataFrame([(1, "en", " .. "), (2, None, None)], "doc_id long, lang string, text string")
    assert collocations.collocations(blank, 1).count() == 0


def test_copies_are_one_entry_of_the_dictionary(spark):
    text = " ".join(f"w{k}" for k in range(2000))
    docs = spark.createDataFrame([(k, "en", text) for k in range(50)], "doc_id long, lang string, text string")
    shifted = docs.limit(1).selectExpr("doc_id", "lang", "concat('new start ', text) AS text")
    chunks = collocations.parse(docs.union(shifted), "text", "lang", 48).collect()
    assert {row.times for row in chunks} <= {1, 50, 51}
    assert sum(row.times == 51 for row in chunks) >= 0.8 * len(chunks) > 10


def test_products_beyond_64_bits(spark):
    big = spark.sql("SELECT cast(9e9 as long) a, cast(8e12 as long) n, cast(7e9 as long) l, cast(9e9 as long) r")
    row = big.selectExpr(f"{collocations.SCORE} AS score").first()
    assert row.score == 1000 * int(9e9) * int(8e12) // (int(7e9) * int(9e9))


# ---- 13 WARC -----------------------------------------------------------------------------

LONG = "<p>" + "long page " * 300_000
PAGES = [
    (3, "http://a/", "same page " * 20), (1, "http://b/", "same page " * 20), (1, "http://b/", "same page " * 20),
    (None, None, "same page " * 20), (2, None, None), (4, "", ""), (5, "x y\r\nEvil: 1", "short"), (6, "http://c/", "short"),
    (7, "http://ü/", LONG), (8, "http://d/", LONG), (None, "n", "null id " * 20), (None, "n", "null id " * 20),
    (9, "b", "x" * 99), (10, "b", "x" * 99), (11, "b", "y" * 100), (12, "b", "y" * 100), (13, "b", "é" * 50), (14, "c", "é" * 50),
]


def archived(spark, folder, pages, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", 0 * warc.F.col("page_id"))
    return warc.write_archives(df.repartition(3), str(folder), **options)


def test_pages_come_back(spark, tmp_path):
    files = archived(spark, tmp_path / "a", PAGES, file_bytes=1000)
    rows = warc.with_referred_page(warc.read_archives(files, payloads=True)).collect()
    assert all(row.error is None for row in rows)
    assert sum(row.records for row in files.collect()) == len(rows) == len(PAGES)
    expected = Counter()
    groups = {}
    for page, url, html in PAGES:
        groups.setdefault(html or "", []).append((page is None, page or 0))
    for html, pages in groups.items():
        data = html.encode()
        for k, (null, page) in enumerate(sorted(pages)):
            revisit = len(data) >= 100 and k > 0
            first = sorted(pages)[0]
            refers = str(first[1]) if revisit and not first[0] else None
            digest = hashlib.sha256(data).hexdigest()
            kind = "revisit" if revisit else "response"
            expected[None if null else str(page), len(data), digest, kind, refers, None if revisit else data] += 1
    found = Counter(
        (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page, r.payload and bytes(r.payload))
        if r.payload_bytes or r.record_type == "revisit"
        else (r.page_id, 0, r.payload_digest, r.record_type, r.refers_to_page, b"")
        for r in rows
    )
    assert found == expected
    evil = next(row for row in rows if row.page_id == "5")
    assert evil.target_uri == "x%20y%0D%0AEvil:%201"
    ids = [row.record_id for row in rows]
    assert len(set(ids)) == len(ids)
    # Another reader finds the same members.
    for row in rows[:5]:
        data = open(row.path, "rb").read()[row.offset : row.offset + row.length]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: " + row.record_type.encode())


def test_hot_repeated_pages_are_one_response(spark, tmp_path):
    pages = [(None, "u", "copy " * 40)] * 500 + [(k, "u", "copy " * 40) for k in range(300, 400)] * 2
    rows = warc.with_referred_page(warc.read_archives(archived(spark, tmp_path / "b", pages))).collect()
    kinds = Counter((row.record_type, row.refers_to_page) for row in rows)
    assert kinds == {("response", None): 1, ("revisit", "300"): 699}
    assert all(row.payload is None for row in rows)


def test_no_pages(spark, tmp_path):
    files = archived(spark, tmp_path / "c", [])
    assert files.count() == 0 and warc.read_archives(files).count() == 0


def records(data):
    return list(warc.records_of(io.BytesIO(data), True))


def sample(payload=b"hello " * 30, **changes):
    digest = hashlib.sha256(payload).hexdigest()
    row = {
        "page_id": "1", "url": "u", "digest": digest, "payload_bytes": len(payload), "payload": payload,
        "record_type": "response", "shared": False, "first_url": None,
    } | changes
    return warc.record(row, "2020-01-01T00:00:00Z", "unique")


def test_broken_files():
    good = warc.member(sample())
    assert [r["error"] for r in records(good * 3)] == [None] * 3
    assert records(b"") == []
    cut = records(good + good[:-9])
    assert cut[0]["error"] is None and "ends inside" in cut[1]["error"] and len(cut) == 2
    assert "bad gzip" in records(good + b"no gzip")[1]["error"]
    wrong = warc.member(sample(digest="0" * 64))
    assert [r["error"] for r in records(wrong + good)] == ["payload digest differs", None]
    head, http, payload, end = sample()
    assert [r["error"] for r in records(warc.member([head, http, payload.swapcase(), end]) + good)] == ["block digest differs", None]
    assert "shorter" in records(warc.member([head, http, payload[:-9]]))[0]["error"]
    assert "longer" in records(warc.member([head, http, payload, b"more", end]))[0]["error"]
    assert "longer" in records(warc.member([head, http, payload]))[0]["error"]
    two = records(warc.member([*sample(), *sample()]))
    assert "longer" in two[0]["error"]
    assert "no WARC" in records(gzip.compress(b"GET / HTTP/1.1\r\n\r\n"))[0]["error"]
    assert "Content-Length" in records(gzip.compress(b"WARC/1.1\r\nContent-Length: -1\r\n\r\n\r\n\r\n"))[0]["error"]
    assert "too long" in records(gzip.compress(b"WARC/1.1\r\n" + b"a: b\r\n" * 100_000 + b"\r\n"))[0]["error"]
    assert "without end" in records(gzip.compress(b"WARC/1.1\r\na: b\r\n"))[0]["error"]


class Trickle(io.BytesIO):
    def read(self, size=-1):
        return super().read(min(size, 7) if size and size > 0 else 7)


def test_framing_does_not_depend_on_how_bytes_arrive():
    rng = random.Random(1)
    payloads = [rng.randbytes(rng.choice([0, 1, 5, 1000, 3_000])) + b"\r\n\r\n" * rng.randint(0, 3) for _ in range(40)]
    data = b"".join(warc.member(sample(p)) for p in payloads)
    slow = list(warc.records_of(Trickle(data), True))
    assert [r["payload"] for r in slow] == payloads and not any(r["error"] for r in slow)
    spans = [(r["offset"], r["offset"] + r["length"]) for r in slow]
    assert spans[0][0] == 0 and spans[-1][1] == len(data)
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_foreign_records():
    resource = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nWARC-Target-URI: http://x/\r\n folded\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    row = records(gzip.compress(resource))[0]
    assert (row["record_type"], row["payload"], row["target_uri"], row["error"]) == ("resource", b"abcd", "http://x/ folded", None)
    empty = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert records(gzip.compress(empty))[0]["payload_bytes"] == 0
