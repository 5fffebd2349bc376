"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import collections
import hashlib
import math
import os
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")

from footpath.llm import common, registry, simhash  # noqa: E402
from footpath.llm.common import tokenizer_file  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}


def rows(spark, name):
    df = registry.queries()[name](spark, DIR)
    return df.columns, df.collect()


def packed_well(pieces, lengths):
    """Whether pieces of documents of these lengths, in tokens, fill sequences without gaps, and few of them."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, n in lengths.items():
        assert sorted(by_doc[i]) == [(k, 2048 * k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048))]
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert by_doc.keys() == lengths.keys() and len(by_sequence) <= 1.03 * sum(lengths.values()) / 2048 + 1


def word_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts.items()}


def test_op1(spark, texts):
    columns, found = rows(spark, "op1_best_fit_packing")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(columns)
    ids = word_ids(texts)
    packed_well(found, {i: len(x) for i, x in ids.items()})
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_op3(spark, texts):
    columns, found = rows(spark, "op3_elias_fano_lm")
    assert columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    tokens = {i: [*plain.WORD.findall(plain.lowered(t)), None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = collections.Counter(w for i in texts if not out[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    assert any(out.values()) and len(found) == len(texts)
    for r in found:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own))
    mean = lambda which, c: sum(r[c] for r in found if r.held_out == which) / sum(r.n_tokens for r in found if r.held_out == which)
    assert mean(True, "score") > mean(True, "base_score") and mean(False, "score") > mean(False, "base_score") + 1


def test_op5(spark):
    columns, found = rows(spark, "op5_vantage_point")
    assert {"query_id", "rank", "vec_id", "score"} <= set(columns)
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)}
    ids = sorted(vectors)
    x, got, hits, asked = np.array([vectors[i] for i in ids]), {}, 0, 0
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in (i for i in ids if i % 20 == 0):
        best = sorted(((-s, i) for s, i in zip((x @ vectors[q]).tolist(), ids) if i != q))[:20]
        assert sorted(got[q]) == list(range(1, len(best) + 1))
        assert all(s == pytest.approx(vectors[i] @ vectors[q], abs=1e-12) for i, s in got[q].values())
        hits += len({i for i, _ in got[q].values()} & {i for _, i in best})
        asked += len(best)
    assert hits >= 0.95 * asked


def test_op6(spark, texts):
    columns, found = rows(spark, "op6_simhash")
    assert {"doc_id", "fingerprint", "component_id"} <= set(columns)
    ids = sorted(texts)
    h = [plain.simhash(texts[i], 3) for i in ids]
    own = plain.components(len(ids), lambda a, b: (h[a] ^ h[b]).bit_count() <= 3)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == [(i, f"{x:016x}", ids[c]) for i, x, c in zip(ids, h, own)]


def test_op7(spark, texts):
    from tokenizers import Tokenizer

    _, found = rows(spark, "op7_token_counts")
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    n = {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in texts.items()}
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == [(i, len((texts[i] or "").encode()), n[i], n[i] > 1024) for i in sorted(texts)]


def test_op8(spark, texts):
    _, found = rows(spark, "op8_substring_dedup")
    want = plain.repeats(texts.items(), 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == {i: (n, gone, plain.digest(words)) for i, (n, gone, words) in want.items()}


def test_op9(spark, texts):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    _, found = rows(spark, "op9_byte_bpe")
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(tokenizer_file("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in found:
        ids, text = e.encode_ordinary(texts[r.doc_id] or ""), (texts[r.doc_id] or "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
    assert len(found) == len(texts)


def test_op10(spark, texts, labels):
    _, found = rows(spark, "op10_importance_resampling")
    want = plain.importance(texts, labels)
    assert len(found) == len(texts)
    for r in found:
        weight, key, keep = want[r.doc_id]
        assert (r.log_weight, r.key) == (pytest.approx(weight, abs=1e-6), pytest.approx(key, abs=1e-6)) and r.keep == keep
    good, bad = ([r.keep for r in found if labels.get(r.doc_id, (None,))[0] == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_pipeline_stage_by_stage(spark, texts, labels):
    """Each stage against its plain form, on all that the one before kept."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, texts
    judged = plain.importance(texts, labels)
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(got)
        if name == "quality":
            want = {i: t for i, t in kept.items() if judged[i][2]}
        elif name == "lines":
            want = plain.deduplicated(kept.items())
        elif name == "near_duplicates":
            ids = sorted(kept)
            wide = [simhash.wide_fingerprint((kept[i] or "").encode()) for i in ids]
            own = plain.components(len(ids), lambda a, b: plain.wide_distance(wide[a], wide[b]) <= simhash.WIDE_BITS)
            want = {i: kept[i] for k, i in enumerate(ids) if own[k] == k}
            sets = {i: set(plain.shingles(kept[i], 5)) for i in ids}
            alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            missed = [(a, b) for a in got for b in got if a < b and sets[a] and alike(a, b)]
            assert len(missed) <= 0.1 * max(1, len(ids) - len(got))
        else:
            want = {i: " ".join(words) if gone else kept[i] for i, (_, gone, words) in plain.repeats(kept.items(), p.PASSAGE_WORDS).items()}
        assert got == want, name
        kept = got
    packed_well(p.STAGES[-1][1](spark, docs, DIR).collect(), {i: len(x) for i, x in word_ids(kept).items()})


@pytest.mark.parametrize("special", ["rows", "empty"])
def test_pipeline_stages_take_special_rows(spark, special):
    """Nulls, empty and repeated rows, a very long text, and an empty table."""
    import corpus_pipeline as p

    line = "a line that is long enough to be told from others"
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    raw = [(1, line, "en", "a", 9), (2, None, None, None, None), (3, "", "en", "a", 0), (None, line, "en", "a", 9), (4, long, "en", "b", 1), (5, long, "en", "b", 1), (6, "x y", "en", "c", 3), (6, "x y", "en", "c", 3)]
    docs = spark.createDataFrame(raw if special == "rows" else [], "doc_id long, text string, lang string, source string, n_chars long")
    label = f"{common.scratch_dir(spark)}/special"
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{label}/labels.parquet")
    for name, stage in p.STAGES:
        docs = p.materialize(stage(spark, docs, label), name)
        if special == "empty":
            assert docs.count() == 0
    if special == "rows":
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {1, 2, 4, 6, None} <= got and 5 not in got


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    seen = [ids]
    for name, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, DIR), name)
        assert docs.columns == columns
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.count() == len(seen[-1]) and seen[-1] <= seen[-2]
    assert {i for i in ids - seen[1] if labels.get(i) == 1} == set() and {i for i in seen[1] if labels.get(i) == 0} == set()
    assert seen[2] == seen[1] and len(seen[3]) < len(seen[2]) and seen[4] == seen[3]
    packed = p.STAGES[-1][1](spark, docs, DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == seen[4]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
