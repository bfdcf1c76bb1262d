"""How toxicity hashes words, what it remembers of them, and what its rounds read."""

import re
import zlib

import numpy as np

from awardlens.llm import toxicity
from awardlens.session import scratch_scope


def places_of(word, known):
    keys = [word, *(f"{n}{word[:n]}" for n in toxicity.PREFIXES if n < len(word))]
    found = [zlib.crc32(key.encode()) & (toxicity.BUCKETS - 1) for key in keys]
    return [known[bucket] for bucket in found if bucket in known]


class Every(dict):
    """Any bucket, at its own place."""

    def __contains__(self, bucket):
        return True

    def __missing__(self, bucket):
        return bucket


def network(words):
    found = sorted({b for word in words for b in places_of(word, Every())})
    rng = np.random.default_rng(3)
    normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    net = toxicity.Network(
        {bucket: at for at, bucket in enumerate(found)},
        normal(len(found) + 1, toxicity.DIM),
        [normal(w, toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS],
        [normal(toxicity.FILTERS) for _ in toxicity.WIDTHS],
        normal(len(toxicity.WIDTHS) * toxicity.FILTERS),
        0.0,
    )
    net.embedding[-1] = 0
    return net


def test_words_by_table_are_those_of_the_pattern():
    texts = [f"a{chr(k)}B{chr(k)}" for k in range(0x2100) if not 0xD800 <= k < 0xE000]
    texts += ["", "Straße µ ª x²½y", "ÀÉ_ß 12ab\u0085c d", "İstanbul ΣΑΣ naïve"]
    for text in texts:
        assert toxicity.words_of(text) == re.findall(r"[^\W\d_]+", text.lower())


def test_words_have_the_places_of_their_buckets():
    words = ["insulting", "insult", "insulted", "ab", "abcd", "the", "unknownword", "insultingly", "abcdxyz"]
    known = {b: at for at, b in enumerate(network(words[:3]).rows)}
    told = toxicity._Words(known.get)
    numbers = told.numbers(words)
    rows = np.concatenate([np.full((1, 6), -1, np.int32), told.news()])
    for word, number in zip(words, numbers, strict=True):
        assert [at for at in rows[number][:-1] if at >= 0] == places_of(word, known)
    assert numbers[3] == numbers[6] == 0  # nothing is known of them
    assert rows[numbers[5]][-1] == toxicity.LANGUAGES.index("en")


def test_a_network_remembers_a_bounded_number_of_words(monkeypatch):
    net = network(["calm", "vile"])
    monkeypatch.setattr(toxicity._Words, "WORDS", 500)
    texts = [" ".join(f"calm{chr(97 + a)}{chr(97 + b)}x{chr(97 + c)}" for c in range(20)) for a in range(26) for b in range(26)]
    first = net.read(texts)
    assert len(net.words) <= 520 and len(net.words.old) <= 520 and len(net.words.stems) <= 600
    assert net.read(texts) == first
    rare = [f"zq{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    net.read(rare)  # words of which nothing is known are words too
    assert len(net.words) <= 520


def test_the_thresholds_are_part_of_what_a_worker_keeps_a_network_by():
    net = network(["calm", "vile"])
    before = net.fingerprint()
    net.thresholds = [0.7] * len(toxicity.LANGUAGES)
    assert net.fingerprint() != before


def test_the_rounds_read_numbers_of_every_word(spark):
    texts = {k: f"a calm note, number {'x' * (k % 5)}, on gardens" for k in range(40)} | {50: "", 51: "vile"}
    net = network(["calm", "gardens", "vile"])
    docs = spark.createDataFrame([(k, t, int(k > 50)) for k, t in texts.items()], "doc_id long, text string, toxic int")
    with scratch_scope(spark):
        rows = toxicity._prepared(docs, net, 3).collect()
        learnt = toxicity._learnt(toxicity._prepared(docs, net, 3), net, 1, 5)
    assert sorted(row.part for row in rows) == [0, 1, 2] and sum(row.docs for row in rows) == len(texts)
    assert "text" not in rows[0].asDict()
    found = []
    for row in rows:
        places = np.frombuffer(row.places, np.int32).reshape(-1, 5)
        sizes = np.frombuffer(row.sizes, np.int64)
        words = np.split(np.frombuffer(row.words, np.int32), np.cumsum(sizes)[:-1])
        found += [[[p for p in places[w] if p >= 0] for w in doc] for doc in words]
    wanted = [[places_of(word, net.rows) for word in toxicity.words_of(t)] for t in texts.values()]
    assert sorted(found) == sorted(wanted)
    assert len(learnt) == len(toxicity._flat(net)) and np.isfinite(learnt).all()


def test_documents_are_counted_once_by_bucket(monkeypatch):
    docs = [{"calm", "calmly", "vile", "insulting"}, {"calmly", "note"}, {"insult", "insulting", "vile"}, set()]
    for number in (toxicity.BUCKETS, 7, 1):  # with few buckets, words of a document share some
        monkeypatch.setattr(toxicity, "BUCKETS", number)
        wanted = {}
        for doc in docs:
            for bucket in {bucket for word in doc for bucket in places_of(word, Every())}:
                wanted[bucket] = wanted.get(bucket, 0) + 1
        found, times = toxicity._documents_by_bucket(docs)
        assert dict(zip(found.tolist(), times.tolist(), strict=True)) == wanted
