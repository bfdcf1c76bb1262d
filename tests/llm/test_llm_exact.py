"""The operators against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from awardlens.llm import (
    byte_bpe,
    components,
    exact_dedup,
    language,
    licenses,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    token_counts,
)
from awardlens.llm.queries import ORACLES, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "  two  spaces   three ", "a \n b\n\n c", "don't WE'LL 'x", "ÀÉ straße İstanbul ΣΑΣ",
    "x² ½ Ⅷ 漢字 é   tab\tx", "<|endoftext|> a<|startoftext|>b", "a\x1cb \x85 c", "😀👍🏽 ok",
    "#$%&*!!! ...", "0123456789 3.14", "ab" * 3000,
]


@pytest.fixture(scope="module")
def texts():
    table = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{MIDDLE}/documents.parquet'")
    return dict(table.fetchall())


def odd_docs(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")


# ---- 1 packing -------------------------------------------------------------------------


def token_ids(texts):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(WORDS)
    encoded = full.encode_batch(list(texts.values()), add_special_tokens=False)
    return {doc: [*e.ids, 1] for doc, e in zip(texts, encoded, strict=True)}


@pytest.mark.parametrize("odd", [False, True])
def test_packing_has_each_token_once_without_padding(spark, texts, odd):
    expected = token_ids(dict(enumerate(ODD)) if odd else texts)
    docs = odd_docs(spark) if odd else spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = packing.pack(docs, WORDS).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row in rows:
        ids = np.frombuffer(row.token_ids, "<u4").tolist()
        assert len(ids) == row.length and row.doc_tokens == len(expected[row.doc_id])
        pieces[row.doc_id].append((row.start, ids))
        sequences[row.sequence_id].append((row.offset, row.length))
    for doc, ids in expected.items():
        at = 0
        for start, part in sorted(pieces[doc]):
            assert start == at
            at += len(part)
        assert [i for _, part in sorted(pieces[doc]) for i in part] == ids
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([length for _, length in parts])
        assert [offset for offset, _ in parts] == [0, *ends[:-1]]
        assert ends[-1] <= 2048 and ends[-1] & (ends[-1] - 1) == 0


def test_sum_of_squares_picks_the_best_level():
    rng, packer = random.Random(1), packing.SumOfSquares(40)
    for k in range(400):
        size = rng.randint(1, 39)
        counts = packer.counts.copy()

        def after(level, counts=counts, size=size):
            new = counts.copy()
            if level:
                new[level] -= 1
            if level + size < 40:
                new[level + size] += 1
            return int((new[1:40] ** 2).sum())

        choices = [h for h in range(40 - size + 1) if h == 0 or counts[h]]
        packer.place((k, 0, b"\0\0\0\0" * size, size))
        assert int((packer.counts[1:40] ** 2).sum()) == min(map(after, choices))


# ---- 2 exact dedup ---------------------------------------------------------------------


def test_exact_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{MIDDLE}/documents.parquet'")
    expected = con.execute(ORACLES["op2_exact_dedup"])
    names = [c[0] for c in expected.description]
    found = QUERIES["op2_exact_dedup"](spark, MIDDLE).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(expected.fetchall())


def test_index_outlives_its_object_and_takes_new_batches(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")

    def run(rows):
        index = exact_dedup.DigestIndex(spark, str(tmp_path), buckets=4)
        return sorted((r.doc_id, r.keep_id, r.kept) for r in index.deduplicate(rows).collect())

    first = batch((5, "a  b"), (6, "a b"), (7, "c"))
    assert run(first) == [(5, 5, True), (6, 5, False), (7, 7, True)]
    assert run(batch((1, "a\tb"), (8, "d"))) == [(1, 5, False), (8, 8, True)]
    assert run(first) == [(5, 5, True), (6, 5, False), (7, 7, True)]  # sent again
    index = exact_dedup.DigestIndex(spark, str(tmp_path), buckets=4)
    assert index.table().count() == 3
    plan = index.table().hint("merge").join(index.table(), "digest")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


# ---- 3 n-gram join ---------------------------------------------------------------------


def brute_links(texts, n=5, threshold=0.8):
    sets = {}
    for doc, text in texts.items():
        words = text.lower().split()
        sets[doc] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    up, links = {doc: doc for doc in texts}, Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for doc in sorted(texts):
        for other, common in Counter(o for gram in sets[doc] for o in holders[gram]).items():
            if common >= threshold * (len(sets[doc]) + len(sets[other]) - common) - 1e-9:
                links[doc] += 1
                links[other] += 1
                a, b = root(doc), root(other)
                up[max(a, b)] = min(a, b)
        for gram in sets[doc]:
            holders[gram].append(doc)
    return {doc: (root(doc), links[doc]) for doc in texts}


def test_near_copies_equal_brute_force(spark, texts):
    rows = QUERIES["op3_ngram_join"](spark, MIDDLE).collect()
    assert {row.doc_id: (row.class_id, row.n_links) for row in rows} == brute_links(texts)


def test_near_copies_in_many_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for doc in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"x{rng.randrange(50)}"
        texts[doc] = " ".join(words)
    texts |= {200 + k: " ".join(rng.sample(base, 60)) for k in range(20)}
    monkeypatch.setattr(ngram_join, "NODE_TEXTS", 7)
    monkeypatch.setattr(ngram_join, "GROUP_TEXTS", 10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = ngram_join.near_copies(docs).collect()
    assert {row.doc_id: (row.class_id, row.n_links) for row in rows} == brute_links(texts)


def test_recall_decides_the_depth():
    assert ngram_join.needed_depth(0.8, 0.999) == 3 and ngram_join.recall(3, 0.8) >= 0.999
    assert ngram_join.recall(4, 0.8) < 0.999


@pytest.mark.parametrize("families, few", [(60, 16), (600, 16), (60, 0), (600, 0)])
def test_recall_near_the_threshold(spark, monkeypatch, families, few):
    """Pairs of a similarity just over 0.8, beside texts that share passages, at two sizes.

    With ``few`` at 0 no prefix is shortened once more, as where every node is crowded.
    """
    monkeypatch.setattr(ngram_join, "SPARSE", few)
    rng, texts = random.Random(families), {}
    passage = [f"p{k}" for k in range(40)]
    for family in range(families):
        words = [f"w{rng.randrange(3000)}" for _ in range(97)]
        if family % 3 == 0:
            words[30:70] = passage
        for copy in range(3):
            changed = list(words)
            for at in rng.sample(range(10, len(words) - 10), copy):
                changed[at] = f"c{family}-{copy}-{at}"
            texts[len(texts)] = " ".join(changed)
    expected = brute_links(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    rows = ngram_join.near_copies(docs).collect()
    wanted, found = sum(n for _, n in expected.values()), sum(r.n_links for r in rows)
    assert wanted > families and all(r.n_links <= expected[r.doc_id][1] for r in rows)
    assert found >= 0.99 * wanted


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(400, 440)]
    up = {x: x for edge in edges for x in edge}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {x: root(x) for x in up if root(x) != x}


# ---- 4 and 7 quality -------------------------------------------------------------------


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(inside),
    )


def test_statistics_equal_brute_force(texts):
    for text in [*texts.values(), *ODD, "a b c d e f g h " * 2, "a b c d e f g h i", "x " * 9]:
        assert quality_rules.text_statistics(text)[:5] == brute_statistics(text)


def test_rules_keep_the_clean_and_drop_the_bad(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = QUERIES["op7_quality_rules"](spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id"
    )
    good = rows.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.99 * good.count()
    bad = rows.where("quality = 0")
    assert bad.where("kept").count() <= 0.05 * bad.count()


def test_posterior_expression_equals_the_model(spark):
    names = ["a", "b", "c"]
    rows = [(x, y, z) for x in (0, 1, None) for y in (0, 1, None) for z in (0, 1, None)] * 3
    rows += [(1, 1, 1)] * 50 + [(0, 0, 1)] * 10
    votes = spark.createDataFrame(rows, "a int, b int, c int")
    model = quality_rules.fit_votes(votes, names)
    assert (model.accuracy() > 0.5).all()
    found = votes.select("*", quality_rules.posterior_column(model, names).alias("p")).collect()
    patterns = np.array([[-1 if v is None else v for v in row[:3]] for row in found])
    assert np.allclose(model.posterior(patterns), [row.p for row in found])


def test_word_features_equal_their_definition_and_are_hashed_once(monkeypatch):
    def plain(word):
        text = word.decode("utf-8", "replace")
        kind = lambda c: ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        shape = re.sub(r"(.)\1+", r"\1\1", "".join(map(kind, text)))[:24]
        keys = "s" + shape, "e" + text[-2:], "w" + text.lower(), f"l{min(len(text), 20)}"
        return np.array([zlib.crc32(key.encode()) % quality_classifier.COLUMNS for key in keys], "<u2").tobytes()

    odd = ["Abc", "x", "aAaAA00--", "\u01c5\u0660\u2460", "\u0130STANBUL", "\u00df\ufb01\u02b0", "\x1c\x1c\x1c\x85\x85\x85y", "a" * 70]
    words = [word.encode() for word in odd] + [b"\xed\xa0\x80x", b"\xff"]
    assert [quality_classifier.word_features(word) for word in words] == [plain(word) for word in words]
    hashed, crc = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda *given: hashed.append(given) or crc(*given))
    for k in range(260):
        quality_classifier.word_features(f"z{chr(97 + k % 26)}{k // 26 * 'q'}ish".encode())
    assert len(hashed) < 300  # four each before


def test_classifier_agrees_with_labels_it_never_saw(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = QUERIES["op4_quality_classifier"](spark, sf_dir).join(
        spark.read.parquet(f"{sf_dir}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id"
    )
    good, bad = rows.where("quality = 1"), rows.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("kept").count() <= 0.1 * bad.count()


def test_features_count_all_of_a_text():
    columns, counts = quality_classifier.text_features("Abc, abc abc\nx\nx\n", 2)
    assert len(columns) // 2 == len(counts) // 4 and np.frombuffer(counts, "<u4").sum() == 5 * 4 + 1 + 2
    assert quality_classifier.text_features("", 0) == (b"", b"")


def test_votes_are_weighed_as_by_a_loop_over_documents():
    rng = random.Random(5)
    docs = [[rng.choice([0, 1, 1, 1, -1]) for _ in range(4)] for _ in range(300)]
    patterns, counts = np.unique(np.array(docs), axis=0, return_counts=True)
    model = quality_rules.VoteModel(4, rounds=30).fit(patterns, counts.astype(float))
    prior, right = 0.9, [[0.3] * 4, [0.98] * 4]

    def chance_good(votes):
        good, bad = prior, 1 - prior
        for rule, vote in enumerate(votes):
            if vote >= 0:
                good *= right[1][rule] if vote else 1 - right[1][rule]
                bad *= right[0][rule] if not vote else 1 - right[0][rule]
        return good / (good + bad)

    for _ in range(30):
        chances = [chance_good(votes) for votes in docs]
        found = [[0.0] * 4, [0.0] * 4]
        for rule in range(4):
            for quality, start in ((0, 0.3), (1, 0.98)):
                agreed, cast = 10 * start, 10.0
                for votes, good in zip(docs, chances, strict=True):
                    weight = good if quality else 1 - good
                    agreed += weight * (votes[rule] == quality)
                    cast += weight * (votes[rule] >= 0)
                found[quality][rule] = agreed / cast
        right, prior = found, min(max((sum(chances) + 9) / (len(docs) + 10), 0.5), 0.999)
    assert np.allclose(model.right, right) and np.isclose(model.prior, prior)
    assert np.allclose(model.posterior(np.array(docs)), [chance_good(votes) for votes in docs])


# The first articles of a public declaration.
MARKED = {
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "ar": "يُولَدُ جَمِيعُ النَّاسِ أَحْرَارًا مُتَسَاوِينَ فِي الْكَرَامَةِ وَالْحُقُوقِ وَقَدْ وُهِبُوا عَقْلًا وَضَمِيرًا",
    "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神互相对待",
}


def test_marks_are_letters_and_not_all_words_are_spaced(spark):
    docs = spark.createDataFrame(list(enumerate(MARKED.values())), "doc_id long, text string")
    for row in quality_rules.judge(docs).collect():
        assert row.n_letters >= 0.97 * row.word_chars and row.vote_letters == 1
        assert row.vote_word_length != 0
    by_hand = "a\u0301b c1 \u0e01\u0e31"
    assert quality_rules.text_statistics(by_hand)[list(quality_rules.STATISTICS).index("n_letters")] == 6


# ---- 5 toxicity and 9 language: held-out accuracy ----------------------------------------


def remainder(doc, n):
    return zlib.crc32(str(doc).encode()) % n


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"SELECT DISTINCT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    rows = [r for r in QUERIES["op5_toxicity"](spark, sf_dir).collect()]
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    toxic = [r.predicted for r in held if labels[r.doc_id] == 1]
    clean = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_language_on_held_out_rows(spark):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{MIDDLE}/documents.parquet'").fetchall())
    rows = QUERIES["op9_language"](spark, MIDDLE).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.96 * len(held)
    assert sum(r.accepted for r in rows) >= 0.98 * len(rows)


# The first articles of a public declaration.
FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem"
    " i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności"
    " i bezpieczeństwa swojej osoby.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью"
    " и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу"
    " и на личную неприкосновенность.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを"
    "授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、生命、自由及び身体の安全に対する権利を有する。",
    "code": "def f(x):\n    for i in range(len(x)):\n        if x[i] is None: continue\n        yield x[i] ** 2\n\nclass"
    " Foo(Bar):\n    def __init__(self, *args, **kwargs):\n        super().__init__(*args, **kwargs)\n        self.names"
    " = sorted(kwargs)\n\n    def __repr__(self):\n        return f'{type(self).__name__}({self.names!r})'\n",
}


def test_texts_of_other_languages_are_rejected(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = language.fit(docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"))
    rng = random.Random(9)
    texts = [text * n for text in FOREIGN.values() for n in (1, 4)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (300, 2000)]
    texts += [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300))]
    foreign = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in language.identify(foreign, model).where("accepted").collect()] == []
    clean = docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 AND length(text) >= 200")
    found = language.identify(clean, model)
    assert found.where("accepted").count() >= 0.98 * found.count() > 0


def test_sizes_are_those_of_a_call_per_block_and_language():
    import zstandard

    words = {"en": "the and of that is with plain words ", "de": "der die und das nicht ist mit einfachen "}
    contents = {name: (text * 30).encode() for name, text in words.items()}
    judge = language.CompressionClassifier(contents)
    rng = random.Random(2)
    for size in (1, 40, 1999, 2000, 2001, 9000):
        text = " ".join(rng.choices((words["en"] + words["de"] + "quite other stuff").split(), k=size))[:size]
        data = language.letters(text).encode()
        sizes, plain = {}, 0
        for at in range(0, len(data), language.BLOCK):
            block = data[at : at + language.BLOCK]
            options = {"level": language.LEVEL, "write_content_size": False, "write_checksum": False}
            plain += len(zstandard.ZstdCompressor(**options, write_dict_id=False).compress(block))
            for name, content in contents.items():
                raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                coder = zstandard.ZstdCompressor(**options, write_dict_id=False, dict_data=raw)
                packed = coder.compress(block)
                assert zstandard.ZstdDecompressor(dict_data=raw).decompress(packed, 10_000) == block
                sizes[name] = sizes.get(name, 0) + len(packed)
        found = judge.measure(data)
        assert found[1] == plain
        assert all(abs(a - sizes[name]) <= 0.05 * sizes[name] + 2 for name, a in zip(judge.languages, found[0], strict=True))
        assert judge.classify(text)[0] == judge.languages[found[0].index(min(found[0]))]


# ---- 6 byte-level BPE --------------------------------------------------------------------


def tiktoken_encoding():
    import tiktoken

    lines = open(BYTES, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_comes_back(spark, texts):
    encoding = tiktoken_encoding()
    for row in QUERIES["op6_byte_bpe"](spark, MIDDLE).collect():
        ids = encoding.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_bpe_of_odd_texts(spark):
    encoding = tiktoken_encoding()
    rows = byte_bpe.encode(odd_docs(spark), BYTES, public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in rows.collect()} == {k: encoding.encode_ordinary(t) for k, t in enumerate(ODD)}
    back = byte_bpe.decode(rows, BYTES).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {k: t.encode() for k, t in enumerate(ODD)}


def test_bpe_of_mixed_white_space_equals_tiktoken(spark):
    encoding, rng = tiktoken_encoding(), random.Random(8)
    mixed = ["a \xa0 \xa0 b", " \xa0 \xa0 ", "a\xa0 b", "a \u2003 b", "a \n \n b", "\t a \r\n "]
    mixed += ["".join(rng.choices("ab1.  \xa0\xa0\n\t\u3000\x1c", k=12)) for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    rows = byte_bpe.encode(docs, BYTES, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.ids for r in rows} == {k: encoding.encode_ordinary(t) for k, t in enumerate(mixed)}


def test_replay_of_random_bytes_equals_tiktoken():
    rng, encoding = random.Random(6), tiktoken_encoding()
    replay = byte_bpe.MergeReplay(byte_bpe.read_ranks(open(BYTES, "rb").read()))
    words = ["".join(rng.choices("abcdeinrst", k=rng.randint(1, 30))) for _ in range(3000)]
    found = [np.frombuffer(ids, "<i4").tolist() for ids in replay.encode([w.encode() for w in words])]
    assert found == [encoding.encode_ordinary(w) for w in words]


def test_bpe_keeps_each_word_once_and_decodes_in_runs(monkeypatch):
    encoding, data = tiktoken_encoding(), open(BYTES, "rb").read()
    encoder = byte_bpe.CorpusEncoder(data, public_tokenizers.PATTERN)
    texts = [" ".join(f"zq{chr(97 + k % 26)}xv{chr(97 + k // 26)}" for k in range(200)), "zqaxva, zqbxva.", "", " zqaxva"]
    for _ in range(2):
        found = [np.frombuffer(ids, "<i4").tolist() for ids in encoder.encode(texts)]
        assert found == [encoding.encode_ordinary(text) for text in texts]
    assert len(encoder.pieces.young) >= 200
    assert len(encoder.words.young) < 10  # words that stand alone are in the pieces
    monkeypatch.setattr(byte_bpe, "DECODED_IDS", 5)
    ids = pa.array([[1, 2, 3], None, [], [4, 5], [6] * 20, [7]], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([ids.slice(1), pa.array(range(5))], ["ids", "doc_id"])
    parts = list(byte_bpe._runs_of_ids([pa.RecordBatch.from_arrays([ids], ["ids"]), batch], "ids"))
    assert [part.num_rows for part in parts] == [4, 1, 1, 4, 1]
    assert [row for part in parts[:3] for row in part.column(0).to_pylist()] == ids.to_pylist()


# ---- 8 licences --------------------------------------------------------------------------


def brute_notices(text, threshold=0.8):
    templates = [(name, licenses.bigrams(t)) for name, ts in licenses.TEMPLATES.items() for t in ts]
    found = []

    def best(part):
        values = [(licenses.dice(licenses.bigrams(part), grams), -k) for k, (_, grams) in enumerate(templates)]
        value, k = max(values)
        return (templates[-k][0], round(value, 9)) if value >= threshold else None

    at = 0
    for line in text.split("\n"):
        if line and (hit := best(line)):
            found.append((at, at + len(line), *hit))
        elif line:
            for part in licenses._SENTENCES.finditer(line):
                if hit := best(part.group()):
                    found.append((at + part.start(), at + part.end(), *hit))
        at += len(line) + 1
    return found


def test_licences_equal_comparing_with_every_template(spark, texts):
    some = {d: t for d, t in texts.items() if d % 5 == 0 or "icense" in t}
    some[10**6] = "Plain. Released under the  mit license!\nLicensed under apache license version 2.0\nGNU"
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    rows = licenses.scan_licenses(docs).collect()
    found = {r.doc_id: [(n.start, n.end, n.license, round(n.score, 9)) for n in r.licenses] for r in rows}
    assert found == {doc: brute_notices(text) for doc, text in some.items()}
    assert [n[2] for n in found[10**6]] == ["MIT", "Apache-2.0"]


def brute_windows(words, threshold=0.8):
    every = []
    for k, (name, text) in enumerate((n, t) for n, ts in licenses.TEMPLATES.items() for t in ts):
        grams, own = licenses.bigrams(text), licenses._WORDS.findall(text.lower())
        versions = {w.removesuffix(".0") for w in own if w[0].isdigit()}
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + 2 * len(own) + 2) + 1):
                part = words[i:j]
                pairs = list(zip(["", *part], [*part, ""], strict=True))
                value = licenses.dice(Counter(pairs), grams)
                if (
                    value >= threshold
                    and (pairs[0] in grams or pairs[1] in grams)
                    and (pairs[-1] in grams or pairs[-2] in grams)
                    and versions <= {w.removesuffix(".0") for w in part}
                    and not licenses.NAMES.difference(own) & set(part)
                ):
                    every.append((-sum((Counter(pairs) & grams).values()), -value, i - j, i, k, name))
    taken = []
    for _, value, n, i, _, name in sorted(every):
        if all(i - n <= a or i >= b for a, b, *_ in taken):
            taken.append((i, i - n, name, -value))
    return sorted(taken)


def test_windows_of_words_equal_comparing_every_window():
    rng = random.Random(9)
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, 0.8)
    every = [licenses._WORDS.findall(t.lower()) for ts in licenses.TEMPLATES.values() for t in ts]
    every = [words for words in every if len(words) < 30]
    some = 0
    for _ in range(8):
        words = []
        for part in rng.sample(every, 3):
            part = [w for w in part if rng.random() > 0.04]
            words += [*part, *rng.choices(["the", "license", "version", "x", "2.0", "3"], k=rng.randint(0, 4))]
        found = scanner.windows(scanner._numbers(" ".join(words)))
        found = [(a, b, scanner.templates[t].license, v) for a, b, t, v in found]
        assert found == brute_windows(words)
        some += len(found)
    assert some > 12


def test_wrapped_and_embedded_notices():
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, 0.8)
    for name in ("GPL-3.0", "Apache-2.0", "MPL-2.0", "MIT"):
        for notice in licenses.TEMPLATES[name]:
            text = "int x;\n\n# " + "\n# ".join(textwrap.wrap(notice, 60)) + "\n\nint y;"
            (hit,) = scanner.scan(text)
            assert hit[2:] == (name, 1.0) and text[: hit[1]].split()[-1] == notice.split()[-1]
            line = f"here are {'many plain words ' * 20}: {notice.rstrip('.')}, and {'yet more of them ' * 20}"
            assert [hit[2:] for hit in scanner.scan(line)] == [(name, 1.0)]


MIT_GRANT = """MIT License

Copyright (c) 2021 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
GPL_2 = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = """3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


@pytest.mark.parametrize(
    "name, text",
    [
        ("MIT", MIT_GRANT),
        ("MIT", " ".join(MIT_GRANT.split())),
        ("GPL-2.0", GPL_2),
        ("GPL-2.0", " ".join(GPL_2.replace("*", "").split())),
        ("GPL-3.0", GPL_2.replace("version 2", "version 3")),
        ("LGPL-2.1", GPL_2.replace("program", "library").replace("GNU", "GNU Lesser").replace("version 2", "version 2.1")),
        ("AGPL-3.0", GPL_2.replace("GNU", "GNU Affero").replace("version 2", "version 3")),
        ("BSD-2-Clause", BSD_2),
        ("BSD-3-Clause", BSD_2 + BSD_3),
        ("ISC", ISC),
        ("BSD-2-Clause", "# SPDX-License-Identifier: BSD-2-Clause"),
        ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
        ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later"),
        ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ],
)
def test_usual_notices_name_their_licence_and_version(name, text):
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, 0.8)
    assert {hit[2] for hit in scanner.scan(f"/*\n{text}\n*/\nint x;")} == {name}


def test_a_version_without_template_is_not_named():
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, 0.8)
    assert scanner.scan(GPL_2.replace("version 2", "version 1")) == []
    assert scanner.scan("Licensed under the Apache License, Version 1.1.") == []


def names(text):
    return [hit[2] for hit in licenses.LicenseScanner(licenses.TEMPLATES, 0.8).scan(text)]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("(MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]),
        ("Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]),
        ("MIT AND (BSD-3-Clause OR ISC)", ["MIT", "BSD-3-Clause", "ISC"]),
        ("GPL-2.0-or-later WITH Classpath-exception-2.0", ["GPL-2.0"]),
        ("GPL-2.0-only WITH Linux-syscall-note OR MIT", ["GPL-2.0", "MIT"]),
        ("LicenseRef-own OR MPL-2.0", ["MPL-2.0"]),
        ("mit or cc0-1.0", ["MIT", "CC0-1.0"]),
        ("MIT OR MIT", ["MIT", "MIT"]),
        ("MIT", ["MIT"]),
        ("MIT OR", ["MIT"]),
        ("()", []),
    ],
)
def test_spdx_expressions_name_every_licence(expression, expected):
    text = f"// SPDX-License-Identifier: {expression}\nint x;\nReleased under the ISC License."
    found = licenses.LicenseScanner(licenses.TEMPLATES, 0.8).scan(text)
    assert [hit[2] for hit in found] == [*expected, "ISC"]
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    if len(expected) > 1:
        assert [text[a:b] for a, b, *_ in found][0].lower().startswith(expected[0].lower())


@pytest.mark.parametrize(
    "text",
    [
        "Not licensed under the MIT License.",
        "This file is not\n# licensed under the Apache License, Version 2.0.",
        "This code isn't released under the MIT License",
        "It is no longer licensed under the GNU General Public License v3.",
        "This work is not licensed under the GNU General Public License, version 3.",
        "It was never licensed or released under the ISC License.",
    ],
)
def test_denied_notices_are_none(text):
    assert names(text) == []
    assert names(f"{text} Released under the BSD 2-Clause License.") == ["BSD-2-Clause"]


def test_a_denial_of_something_else_leaves_a_notice():
    assert names("Do not copy this. Licensed under the MIT License.") == ["MIT"]
    assert names("Why not? Released under the MIT License.") == ["MIT"]
    assert names(
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file"
        " except in compliance with the License."
    ) == ["Apache-2.0"]


def wrapped(text, lead):
    out, line = [], lead
    for word in text.split():
        if len(line) + len(word) > 70:
            out, line = [*out, line], lead
        line += " " + word
    return "\n".join([*out, line])


@pytest.mark.parametrize("lead", ["", " *"])
@pytest.mark.parametrize(
    ("name", "body"),
    [
        ("MIT", licenses._MIT_GRANT + licenses._MIT_DISCLAIMER),
        ("ISC", licenses._ISC_GRANT + licenses._ISC_DISCLAIMER),
        ("BSD-2-Clause", licenses._BSD_CLAUSES + licenses._BSD_DISCLAIMER),
        ("BSD-3-Clause", licenses._BSD_CLAUSES + licenses._BSD_NAMES + licenses._BSD_DISCLAIMER),
    ],
)
def test_a_licence_is_one_notice_from_start_to_end(name, body, lead):
    text = "Copyright (c) 2020 Somebody\n\n" + wrapped(body, lead) + "\n\nimport x\n"
    text = text.replace("AS IS", '"AS IS"').replace("HOLDER OR", "OWNER OR")
    (found,) = licenses.LicenseScanner(licenses.TEMPLATES, 0.8).scan(text)
    words = body.split()
    assert found[2] == name and found[3] > 0.9
    covered = text[found[0] : found[1]].split()
    assert words[1] in covered[:4] and words[-1] in covered[-2:]


# ---- 10 token counts ---------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_go_to_sections_by_the_rule(spark, texts, rule):
    encoding = tiktoken_encoding()
    some = {d: t for d, t in texts.items() if d % 20 == 0} | dict(enumerate(ODD, 10**6))
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    rows = token_counts.count_tokens(docs, BYTES, public_tokenizers.PATTERN, rule=rule).collect()
    found = defaultdict(list)
    for row in sorted(rows):
        found[row.doc_id].append((row.start, row.end, row.n_tokens, row.n_crossing))
    for doc, text in some.items():
        bounds = [m.span() for m in re.finditer(token_counts.LINES, text)] or [(0, 0)]
        section = [k for k, (a, b) in enumerate(bounds) for _ in range(a, b)]
        character = [k for k, c in enumerate(text) for _ in c.encode()]
        counts, crossing, at = Counter(), Counter(), 0
        for token in map(encoding.decode_single_token_bytes, encoding.encode_ordinary(text)):
            own = [section[c] for c in dict.fromkeys(character[at : at + len(token)])]
            at += len(token)
            pick = {"first": own[0], "last": own[-1], "most": max(own, key=lambda s: (own.count(s), -s))}[rule]
            counts[pick] += 1
            crossing[pick] += len(set(own)) > 1
        assert found[doc] == [(a, b, counts[k], crossing[k]) for k, (a, b) in enumerate(bounds)]


# ---- pipeline ----------------------------------------------------------------------------


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    names, before = docs.columns, docs
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").dropDuplicates(["doc_id"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, MIDDLE).cache()
        assert after.columns == names and 0 < after.count() <= before.count()
        lost = before.join(after, "doc_id", "left_anti")
        if name == "language":
            assert lost.count() <= 0.02 * before.count()
        if name == "toxicity":
            assert lost.join(labels.where("toxic = 0"), "doc_id").count() <= 0.05 * before.count()
        if name == "exact dedup":
            texts = dict(before.select("doc_id", "text").collect())
            first = {}
            for doc in sorted(texts):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[doc]), doc)
            assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(first.values())
        if name == "near copies":
            groups = brute_links(dict(before.select("doc_id", "text").collect()))
            assert {r.doc_id for r in after.select("doc_id").collect()} == {g for g, _ in groups.values()}
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, MIDDLE).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in before.select("doc_id").collect()}


def test_pipeline_query(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


# The others return ranks, phrases and records of pages (test_llm_search).
PER_DOCUMENT = [name for name in QUERIES if name.split("_")[0] not in ("op11", "op12", "op13")]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_queries_answer_for_every_document(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id")
    assert QUERIES[name](spark, SMALL).select("doc_id").distinct().exceptAll(docs).count() == 0
    assert docs.join(QUERIES[name](spark, SMALL), "doc_id", "left_anti").count() == 0
