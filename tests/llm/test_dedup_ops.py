"""Near-duplicate operators against brute force, and their special cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from footpath.llm import common, line_dedup, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, words):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, close):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if close(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for text in ("", "one", "one two", "A b c d E f g", "x y z " * 400, "é ü ß\x0bz tail"):
        for words in (3, 5):
            assert simhash.fingerprint(text.encode(), words) == fingerprint(text, words)


@pytest.mark.parametrize("bucket", [4096, 1])
def test_links_are_complete(spark, bucket):
    rnd = random.Random(4)
    values = [rnd.getrandbits(64) for _ in range(60)]
    for v in values[:40]:
        for _ in range(4):
            for b in rnd.sample(range(64), rnd.randrange(1, 5)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    distinct = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    got = common.connected_components(simhash.fingerprint_links(distinct, 3, 6, bucket))
    found = {r.node: r.component for r in got.collect()}
    own = classes(values, lambda a, b: (a ^ b).bit_count() <= 3)
    by = {}
    for v, c in zip(values, own):
        by.setdefault(c, set()).add(simhash._signed(v))
    for group in by.values():
        assert {found.get(v, v) for v in group} == {min(group)}


def test_near_duplicates_special_rows(spark):
    rnd = random.Random(1)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(3000))
    rows = [(5, long), (3, long), (9, long + " x"), (1, None), (2, ""), (7, "other words here"), (None, long), (7, "other words here"), (8, "quite different text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs, words=3).collect()
    assert len(got) == 9
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 3), (3, 3), (9, 3), (None, 3), (1, 1), (2, 1), (7, 7), (8, 8)}
    kept = simhash.drop_near_duplicates(docs, words=3)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 7, 7, 8] and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    edges = [(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (7, 7), (None, 3)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {**{i: 0 for i in range(300)}, 1000: 1000, 1001: 1000}


def one_edit(a, b):
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    q = 0
    while q < min(len(a), len(b)) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    return max(len(a), len(b)) - p - q <= 1


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_lines(spark, broadcast):
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abc d") for _ in range(rnd.choice([16, 17, 33, 70, 150, 400]))) for _ in range(25)]

    def edited(s):
        for _ in range(rnd.choice([0, 1, 1, 2])):
            i, k = rnd.randrange(len(s) + 1), rnd.random()
            s = s[:i] + ("" if k < 0.3 else rnd.choice("abcé")) + s[i + (k < 0.6) :]
        return s

    rows = [(i, "\n".join(edited(rnd.choice(base)) for _ in range(5))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs, broadcast_rows=broadcast).collect()}
    seen, removed = [], 0
    for i, text in rows:
        keep = []
        for line in text.split("\n"):
            if line.strip():
                gone = line in seen or len(line.strip(" ")) >= 16 and any(one_edit(line, s) for s in seen if len(s.strip(" ")) >= 16)
                seen.append(line)
                removed += gone
                if gone:
                    continue
            keep.append(line)
        assert got[i].text == "\n".join(keep) and got[i].n_removed == 5 - len(keep)
    assert removed > 100


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("bound, edit_chars", [(0, 16), (1, 0), (2, 16), (2, 6), (3, 8)])
def test_edit_bounds(spark, bound, edit_chars):
    rnd = random.Random(bound)
    line = lambda: "".join(rnd.choice("ab?") for _ in range(rnd.choice([1, 5, 9, 12] if bound == 3 else [1, 5, 9, 14, 18])))
    rows = [(i, line() + "\n" + line()) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), bound, edit_chars).collect()}
    seen = []
    for i, text in rows:
        keep = []
        for x in text.split("\n"):
            if not (x in seen or len(x) >= edit_chars and any(len(s) >= edit_chars and levenshtein(x, s) <= bound for s in seen)):
                keep.append(x)
            seen.append(x)
        assert got[i] == "\n".join(keep)


def test_one_edit_at_every_place(spark):
    """Lines of 60 to 140 characters, each without one of its characters or with one replaced, at every place."""
    rnd = random.Random(3)
    rows = []
    for n in range(60, 141):
        for i in range(n):
            line = "".join(rnd.choice("abcdefgh") for _ in range(n))
            new = "#" if i % 2 else ""
            rows += [(len(rows), line), (len(rows) + 1, line[:i] + line[i + 1 :]), (len(rows) + 2, line[:i] + new + line[i + 1 :])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dedup_lines(docs).where("n_removed = 0").collect()}
    assert got == set(range(0, len(rows), 3))


def test_short_repeats(spark):
    line = "a line that is long enough"
    docs = spark.createDataFrame([(1, f"menu\n\n{line}\n\r\nmenu"), (2, f"menu\n\n{line}s\n\r\nmenus"), (3, " menu")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (f"menu\n\n{line}\n\r", 1), 2: ("\n\r\nmenus", 2), 3: (" menu", 0)}
    stage = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs.withColumn("lang", F.lit("")).withColumn("source", F.lit("")), "").collect()}
    assert stage == {i: text for i, (text, _) in got.items()}


def test_lines_special_rows(spark):
    line = "a line that is long enough"
    rows = [(None, line), (1, None), (2, ""), (3, f"{line}\n{line}\nshort\nshort\n"), (4, line + "!"), (4, line + "!"), (5, "z" * 5000), (6, "z" * 5001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("n_lines", F.lit("clash"))
    docs = docs.withColumns({c: F.lit(c) for c in ("lines", "Gone", "kept_doc", "_lines", "_kept")})
    assert line_dedup.dedup_lines(docs).columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    got = {(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {(None, line, 1, 0), (1, None, 0, 0), (2, "", 1, 0), (3, f"{line}\nshort\n", 5, 2), (4, "", 1, 1), (5, "z" * 5000, 1, 0), (6, "", 1, 1)}
    assert {r.text for r in line_dedup.dedup_lines(docs, max_edits=0).where("doc_id = 4").collect()} == {line + "!"}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("window", [20, 50])
def test_substrings(spark, window):
    rnd = random.Random(1)
    base = [[rnd.choice("abcdefghij") for _ in range(300)] for _ in range(5)]
    rows = []
    for i in range(150):
        words = []
        while len(words) < rnd.choice([5, 60, 200]):
            b, s = rnd.choice(base), rnd.randrange(280)
            words += b[s : s + rnd.randrange(1, 90)]
            if rnd.random() < 0.3:
                words += [rnd.choice("abcdefghij") for _ in range(rnd.randrange(9))]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_repeats(rows, window)
    got = substring_dedup.remove_repeats(docs, window, digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: e[:3] for i, e in expected.items()}
    for r in substring_dedup.without_repeats(docs, window).collect():
        assert r.text == (expected[r.doc_id][3] if expected[r.doc_id][1] else rows[r.doc_id][1])
    spans = substring_dedup.repeats(docs, window).collect()
    assert all(r.n_words >= window for r in spans)
    sums = {}
    for r in spans:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_words
    assert sums == {i: e[1] for i, e in expected.items() if e[1]}


def test_substrings_special_rows(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(None, passage), (1, None), (2, ""), (3, passage), (4, f"x {passage} y"), (5, passage + " " + passage), (6, "q " * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("spans", F.lit("clash"))
    docs = docs.withColumns({c: F.lit(c) for c in ("copy", "Span_doc", "_spans", "other_copy")})
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got[None] == (25, 0, passage) and got[1] == (0, 0, "") and got[2] == (0, 0, "") and got[3] == (25, 0, passage)
    assert got[4] == (27, 25, "x y") and got[5] == (50, 50, "") and got[6] == (100, 99, "q")
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.where("doc_id = 1").collect()} == {None}
    # rows that share an id are documents of their own
    other = " ".join(f"v{i}" for i in range(30))
    twice = spark.createDataFrame([(3, passage), (7, f"{other} end"), (7, f"{passage} end"), (7, f"{other} end"), (9, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in substring_dedup.remove_repeats(twice).collect()) == [(3, passage), (7, "end"), (7, f"{other} end"), (7, f"{other} end"), (9, "")]
    assert sorted((r.doc_id, r.text) for r in substring_dedup.without_repeats(twice).collect()) == [(3, passage), (7, "end"), (7, f"{other} end"), (7, f"{other} end"), (9, "")]
    long = " ".join(str(i) for i in range(200_000))
    got = substring_dedup.remove_repeats(spark.createDataFrame([(1, long), (2, "x " + long)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 200_000, 0), (2, 200_001, 200_000)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0 and substring_dedup.without_repeats(docs.limit(0)).count() == 0


def test_runs_have_equal_hashes():
    a, b = substring_dedup.Words(b"x y z a b c"), substring_dedup.Words(b"a b c")
    at = np.array
    assert a.run(at([3]), at([6])) == b.run(at([0]), at([3])) and a.run(at([0]), at([3])) != b.run(at([0]), at([3]))


@pytest.mark.parametrize("bucket", [4096, 4])
def test_similar_documents(spark, bucket):
    rnd = random.Random(6)
    rows, family = [], {}
    for f in range(25):
        words = [str(rnd.randrange(10**6)) for _ in range(rnd.choice([60, 200, 800]))]
        for k in range(6):
            own = list(words)
            for i in rnd.sample(range(len(own)), max(1, len(own) // 80)) if k else []:
                own[i] = "edit" + str(rnd.randrange(10**6))
            family[len(rows)] = f
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, bucket=bucket).collect()}
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    close = [(a, b) for a in family for b in range(a) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    assert len(close) > 150
    assert sum(got[a] == got[b] for a, b in close) >= 0.97 * len(close)
    assert all(family[i] == family[got[i]] for i in got)  # nothing joins what isn't alike


def wide(bits):
    return np.frombuffer(np.packbits(bits).tobytes(), ">i8").tolist()


def test_recall_just_above_the_bound(spark):
    """Pairs whose five-word shingles have a similarity of 0.80 to 0.85, among texts that share a third of their words."""
    rnd = random.Random(8)
    common_part = [str(rnd.randrange(10**6)) for _ in range(60)]
    rows, pairs, least = [], [], 1.0
    while len(pairs) < 300:
        words = [str(rnd.randrange(10**6)) for _ in range(rnd.choice([120, 200, 500]))] + common_part
        rnd.shuffle(words)
        own = list(words)
        while True:
            own[rnd.randrange(len(own))] = "edit" + str(rnd.randrange(10**6))
            a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (words, own))
            j = len(a & b) / len(a | b)
            if j < 0.85:
                break
        if j >= 0.8:
            pairs.append((len(rows), len(rows) + 1))
            rows += [" ".join(words), " ".join(own)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[a] in (a, a - 1) for a in got)  # nothing else is joined


def test_wide_choices_grow_slowly():
    few, many = simhash.wide_choices(1000), simhash.wide_choices(10**9)
    assert len(few[0]) == 24 and len(many[0]) == 34 and len(few) < len(many) < 1500


@pytest.mark.parametrize("others", [0, 3000])
def test_pairs_at_the_bound_are_proposed(spark, others):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(500):
        a = rng.integers(0, 2, 512)
        b = a.copy()
        b[rng.choice(512, simhash.WIDE_BITS, replace=False)] ^= 1
        rows += [a, b]
    rows += list(rng.integers(0, 2, (others, 512)))
    classes = common.materialize(spark.createDataFrame([(i, wide(x)) for i, x in enumerate(rows)], "node long, wide array<long>"), "classes")
    got = {r.node: r.component for r in simhash.wide_components(classes).collect()}
    assert all(c == n // 2 * 2 for n, c in got.items()) and max(got) < 1000 and len(got) >= 0.97 * 1000


@pytest.mark.parametrize("bucket", [4096, 4])
def test_chains_in_hot_buckets(spark, bucket, monkeypatch):
    """Neighbours of a chain are 60 bits apart, all others over the bound; each chain has one key."""
    monkeypatch.setattr(simhash, "wide_choices", lambda *a: [np.arange(24)])
    rng = np.random.default_rng(5)
    rows = []
    for c in range(20):
        x = rng.integers(0, 2, 512)
        for k in range(9):
            x[24 + 60 * (k - 1) : 24 + 60 * k if k else 24] ^= 1
            rows.append((len(rows), wide(x), c))
    order = rng.permutation(len(rows)).tolist()
    classes = common.materialize(spark.createDataFrame([(i, rows[j][1]) for i, j in enumerate(order)], "node long, wide array<long>"), "classes")
    found = {r.node: r.component for r in simhash.wide_components(classes, bucket=bucket).collect()}
    chain = {i: rows[j][2] for i, j in enumerate(order)}
    assert found == {i: min(x for x in chain if chain[x] == c) for i, c in chain.items()}


def test_rows_of_a_large_group_grow_with_its_nodes(spark, monkeypatch):
    """Each node of the group has another leader at nearly each of its keys; no table but the keys' own has a row for each of them."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2, 512)
    rows = []
    for i in range(500):
        own = base.copy()
        own[rng.choice(512, 44, replace=False)] ^= 1
        rows.append((i, wide(own)))
    classes = common.materialize(spark.createDataFrame(rows, "node long, wide array<long>"), "classes")
    written, write = {}, simhash.materialize

    def counted(df, name):
        out = write(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    found = {r.node: r.component for r in simhash.wide_components(classes).collect()}
    assert found == dict.fromkeys(range(500), 0)
    keys = written.pop("wide-keys")
    assert keys > 20 * 500 and max(written.values()) <= 5 * 500, (keys, written)


def test_looked_up_longs(spark):
    rows = spark.createDataFrame([(i, [i - 3, -i]) for i in (-61, -5, 0, 7, 61, 122, 2**62)], "node long, longs array<long>")
    table = simhash.Lookup(rows, "longs", 2)
    known, got = table.of(np.array([7, 8, 122, -61, 7, -5, 2**62, 0]))
    assert known.tolist() == [True, False, True, True, True, True, True, True]
    assert got.tolist() == [[i - 3, -i] if k else [0, 0] for i, k in zip([7, 8, 122, -61, 7, -5, 2**62, 0], known)]
