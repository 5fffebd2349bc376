"""Token counts, byte-level BPE, packing, language model and classifier against their libraries or brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from footpath.llm import byte_bpe, elias_fano, importance, ngram_lm, packing, token_counts
from footpath.llm.common import tokenizer_file, write_file

ODD = ["", " ", "\n", "a", "<|endoftext|> x <|endoftext|>y<|endoftext|>", "  two  spaces ", "line\n\n  next\tx\x1cy", "don't we'll 'sx  's", "naïve Ünï ΑΣ İ ǅ é", "日本語 テキスト。 ok", "12,345.6 7", "x" * 5000, "ab " * 3000, "　wide space", "͸͹ z", "<|startoftext|>a<|endoftext|>"]


def frame(spark, texts):
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "null id", 0), (1, None, 1), (3, "a", 2), (3, "a", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").withColumn("chunk", F.lit("x"))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ODD)


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path, limit=100).collect()
    expected = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()]
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted((e[0] is None, *e) for e in expected)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_whole_tokens_are_proved():
    c = token_counts.Counter(tokenizer_file("byte_bpe_50k.json"))
    some = sorted(c.whole)[::997]
    assert all(len(c.tokenizer.encode(s, add_special_tokens=False)) == 1 for s in some)


def test_byte_bpe_splits_every_character_as_the_library_does():
    import public_tokenizers
    import tiktoken

    c = byte_bpe.codec(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 50_000):
        texts = [f"{x}'s {x}{x}'re 1{x} a{x}" for x in points[at : at + 50_000]]
        got = [np.frombuffer(p, "<u4").tolist() for p in c.encode(texts)]
        expected = e.encode_ordinary_batch(texts, num_threads=4)
        assert [t for t, a, b in zip(texts, got, expected) if a != b] == []


def test_byte_bpe(spark, docs):
    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    c = byte_bpe.codec(path)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    docs = frame(spark, ODD)
    ids = byte_bpe.encode(docs, path)
    expected = sorted(e.encode_ordinary(r.text or "") for r in docs.collect())
    assert sorted(r.ids for r in ids.collect()) == expected
    assert sorted(bytes(r.bytes) for r in byte_bpe.decode(ids, path).collect()) == sorted((r.text or "").encode() for r in docs.collect())
    for r in byte_bpe.round_trip(docs, path).where("doc_id is not null and doc_id <> 1").collect():
        text = ODD[r.doc_id]
        own = np.array(e.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own) // 4, hashlib.sha256(own).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.round_trip(docs.limit(0), path).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    keys = {f"key{i}".encode(): i for i in range(3000)}
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.value) == list(range(3000)) and all(h.get(k) == v for k, v in keys.items())
    assert h.get(b"other") == -1 and byte_bpe.PerfectHash({}).get(b"") == -1


def test_pieces_and_packing(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    got = packing.pack_documents(docs, path, capacity=64).collect()
    by = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id].append(r)
    for i, text in enumerate(ODD):
        if i in (1, 3):
            continue
        whole = [x for r in sorted(by[i], key=lambda r: r.piece) for x in r.ids]
        assert whole == t.encode(text, add_special_tokens=False).ids + [0]
        assert all(r.start == 64 * r.piece and (r.length == 64 or r.piece == len(by[i]) - 1) for r in by[i])
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack_documents(docs.limit(0), path).count() == 0


@pytest.mark.parametrize(("counts", "most"), [({1100: 500, 700: 300, 450: 401}, 505), ({2048: 5}, 5), ({1: 3}, 1), ({}, 0), ({1025: 10}, 10), ({1000: 7, 1048: 7, 300: 3}, 8)])
def test_plan(counts, most):
    h = np.zeros(2049, np.int64)
    for k, v in counts.items():
        h[k] = v
    plan = packing.Plan(h, 2048)
    assert plan.lower_bound <= plan.sequences <= most
    length = np.repeat(np.arange(2049), h)
    rank = np.concatenate([np.arange(v) for _, v in sorted(counts.items())] or [np.zeros(0, int)]).astype(np.int64)
    sequence, offset = packing.place(length, rank, plan.tables())
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    for i in range(len(s)):
        assert o[i] == (o[i - 1] + n[i - 1] if i and s[i] == s[i - 1] else 0) and o[i] + n[i] <= 2048


def test_knapsack_prices():
    values = np.zeros(41)
    values[[7, 11, 13]] = [0.9, 1.6, 1.7]
    best = packing.knapsack(values, 40)
    brute = [max((0.9 * a + 1.6 * b + 1.7 * c for a in range(6) for b in range(4) for c in range(4) if 7 * a + 11 * b + 13 * c <= room), default=0) for room in range(41)]
    assert np.allclose(best, brute)


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 1000), (900, 901), (3000, 10**12), (2000, 1 << 63)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    s = elias_fano.Sequence(np.frombuffer(elias_fano.encode(v, universe), np.uint8))
    assert s.n == len(v) and (s.access(np.arange(len(v))) == v).all()
    assert (s.find(v) == np.arange(len(v))).all()
    x = rng.integers(0, universe, 500, dtype=np.uint64)
    assert ((s.find(x) >= 0) == np.isin(x, v)).all()


@pytest.mark.parametrize("mapped", [None, False])
@pytest.mark.parametrize("hot", [False, True])
def test_language_model(spark, docs, mapped, hot, monkeypatch):
    """Against sums over all tokens; also where the store can't be mapped, and with a word and a pair in most places of most texts."""
    texts = ["the cat sat on the mat", "The dog sat", "a cat", "unknown words here", None, "", "the the the the", "cat cat\tdog"] * 3
    if hot:
        texts += [f"in fact w{i} in fact x{i % 5}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = {r.doc_id: r for r in ngram_lm.score(rows, held, mapped=mapped).collect()}
    tok = {i: [*(t or "").lower().split(), None] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    assert any(out.values())
    train = [i for i in tok if not out[i]]
    c = collections.Counter(w for i in train for w in tok[i])
    grams = {i: list(zip([0, 0, *t[:-1]], [0, *t[:-1]], t)) for i, t in tok.items()}
    pair = collections.Counter(g[1:] for i in train for g in grams[i])
    triple = collections.Counter(g for i in train for g in grams[i])
    n, v, start = sum(c.values()), len(c), len(train)
    unknown = (sum(x == 1 for x in c.values()) + 0.5) / (n + 1)
    one = lambda w: (1 - unknown) * c[w] / n if c[w] else unknown
    two = lambda b, w: (pair[b, w] + ngram_lm.MU2 * one(w)) / ((start if b == 0 else c[b]) + ngram_lm.MU2)
    three = lambda a, b, w: (triple[a, b, w] + ngram_lm.MU3 * two(b, w)) / ((start if b == 0 else pair[a, b]) + ngram_lm.MU3)
    if hot:
        shards = ngram_lm.Shards(n)
        assert min(c["in"], c["fact"]) > shards.hot  # so that its triples are spread
    for i, t in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(sum(math.log10(three(*g)) for g in grams[i]), abs=0.03 * len(t))
    assert sum(one(w) for w in c) + unknown == pytest.approx(1)
    assert sum(three("the", "cat", w) for w in c) + unknown * ngram_lm.MU2 / (c["cat"] + ngram_lm.MU2) * ngram_lm.MU3 / (pair["the", "cat"] + ngram_lm.MU3) == pytest.approx(1)
    if not hot:
        assert ngram_lm.score(docs, F.lit(False), mapped=mapped).count() == docs.count()
        assert ngram_lm.score(docs, F.lit(True), mapped=mapped).agg(F.max("n_known")).first()[0] == 0
        assert ngram_lm.score(docs.limit(0), F.lit(False), mapped=mapped).count() == 0


def test_elias_fano_in_clusters():
    """Many values that share their high bits beside few that don't."""
    rng = np.random.default_rng(3)
    v = np.unique(np.concatenate((rng.integers(0, 3000, 2000), 10**6 + rng.integers(0, 2**40, 50), 2**41 + rng.integers(0, 5000, 3000)))).astype(np.uint64)
    s = elias_fano.Sequence(np.frombuffer(elias_fano.encode(v, 2**42), np.uint8))
    assert (s.find(v) == np.arange(len(v))).all()
    x = np.concatenate((rng.integers(0, 3100, 4000), 2**41 + rng.integers(0, 5100, 4000), rng.integers(0, 2**42, 2000))).astype(np.uint64)
    assert (s.find(x) == np.where(np.isin(x, v), np.searchsorted(v, x), -1)).all()


def test_language_model_in_parts():
    """Many shards, vocabulary parts and steps give the same logs as few."""
    rng = np.random.default_rng(7)
    word = np.minimum(rng.zipf(1.3, 3000), 400).astype(np.int64)
    begin = np.array([0, 700, 701, 2500])
    steps = list(ngram_lm._steps(word, begin, 1000))
    assert (steps[0][1][[0, 700, 701, 2500]] == 1000).all() and (steps[0][0][[0, 1, 700, 701, 702]] == 1000).all()
    u, v, w = (x[np.lexsort((steps[0][2], steps[0][1], steps[0][0]))] for x in steps[0])
    one, two, three = ngram_lm.grouped(u, v, w)
    u, v, w = u[three], v[three], w[three]
    data = np.frombuffer(b"".join(x + b"\0" * (-len(x) % 8) for x in ngram_lm.Level.encode(u, v, w, 1001)), np.uint8)
    level = ngram_lm.Level(data, 0, 1001)
    at = level.triples(level.pairs(u, v), w)
    assert (at == np.arange(len(u))).all()
    known = set(zip(u.tolist(), v.tolist(), w.tolist()))
    a, b, c = (rng.integers(0, 401, 2000) for _ in range(3))
    assert ((level.triples(level.pairs(a, b), c) >= 0) == [x in known for x in zip(a.tolist(), b.tolist(), c.tolist())]).all()


def test_language_model_sorts_single_numbers(tmp_path, monkeypatch):
    """N-grams aren't sorted by several keys, which took several times as long; vocabularies too wide for single numbers give the same."""
    rng = np.random.default_rng(11)
    word, begin = np.minimum(rng.zipf(1.2, 5000), 899).astype(np.int64) - 1, np.array([0, 1, 2000, 4999])
    word[begin - 1] = 899  # ends
    u, v, w = steps = next(ngram_lm._steps(word, begin, 900))
    by = np.lexsort((w, v, u))
    for width in (902, 1 << 22, 1 << 31):
        order = ngram_lm.ordered(u, v, w, width)
        assert all((x[order] == x[by]).all() for x in steps)

    class Words:
        size, none, number = 900, 901, np.bincount(np.append(word, [900] * len(begin)), minlength=901)

        def look(self, ids):
            n = np.where((ids < 0) | (ids > 900), 0, self.number[np.clip(ids, 0, 900)])
            return n, np.log10((n + 1) / 6000)

    class Folder:
        def local(self, name):
            return str(tmp_path / name)

    def logs():
        shards, packed = ngram_lm.Shards(5000), collections.defaultdict(list)
        for s, x in ngram_lm._counted(u, v, w, Words(), shards, "<u4", 899):
            packed[s].append(x)
        for s, x in packed.items():
            write_file(Folder().local(f"grams-{s}"), ngram_lm.Trie.build(*ngram_lm._merged(x, "<u4", 902), Words(), shards.hot))
        other = np.where(rng.random(5000) < 0.1, -1, np.roll(word, 7))
        return [ngram_lm._logs(*x, Words(), shards, Folder()) for x in (steps, next(ngram_lm._steps(other, begin, 900)), [x[:0] for x in steps])]

    state = rng.bit_generator.state
    monkeypatch.setattr(ngram_lm, "WIDE", 2)
    wide = logs()
    monkeypatch.undo()
    rng.bit_generator.state = state
    monkeypatch.setattr(np, "lexsort", None)
    narrow = logs()
    assert all((a == b).all() for a, b in zip(narrow, wide))
    pair, triple = collections.Counter(zip(v.tolist(), w.tolist())), collections.Counter(zip(u.tolist(), v.tolist(), w.tolist()))
    n = Words.number
    two = lambda b, c: (pair[b, c] + ngram_lm.MU2 * (n[c] + 1) / 6000) / (n[b] + ngram_lm.MU2)
    three = lambda a, b, c: (triple[a, b, c] + ngram_lm.MU3 * two(b, c)) / ((n[900] if b == 900 else pair[a, b]) + ngram_lm.MU3)
    assert np.abs(narrow[0] - [math.log10(three(*x)) for x in zip(u.tolist(), v.tolist(), w.tolist())]).max() < 0.03


def test_classifier(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("aeioubdklm"), rng.integers(2, 7)))
    rows, labels = [], []
    for i in range(400):
        n = int(rng.integers(3, 200))
        good = i % 5 != 0
        rows.append((i, " ".join(word() for _ in range(n)) if good else " ".join(word() + "$$$" for _ in range(n))))
        if i % 2:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (None, "null id", ), (500, None), (500, "")], "doc_id long, text string").withColumn("keep", F.lit("clash"))
    label = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = importance.classify(docs, label)
    assert got.count() == 403 and got.schema["keep"].dataType.simpleString() == "boolean"
    found = {r.doc_id: r for r in got.where("doc_id < 400").collect()}
    wrong = [i for i in found if found[i].keep != (i % 5 != 0)]
    assert len(wrong) <= 4
    model = importance.fit(docs, label)
    for i in (1, 2, 5):
        assert found[i].log_weight == model.log_weight(i, rows[i][1])
    assert got.where("text = '' or text is null").where("log_weight <> 0").count() == 0
    assert importance.classify(docs, label.limit(0)).where("log_weight <> 0").count() == 0
    assert importance.classify(docs.limit(0), label).count() == 0


def test_kth_largest(spark):
    values = [float(x) for x in np.random.default_rng(1).integers(-50, 50, 500)] + [1e9, -1e-9]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 17, 250, 502):
        assert importance.kth_largest(keys, k, bins=16) == sorted(values)[-k]


def test_feature_pairs():
    assert len(importance.features("a b c")) == 5 and len(importance.features("")) == 0
    assert importance.features("go go go go")[2] == importance.features("x x x x")[2]  # a repeated word's mark
    assert re.findall(importance.TOKEN, "ab, c$$ d") == ["ab", ",", "c", "$$", "d"]
