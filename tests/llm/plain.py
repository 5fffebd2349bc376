"""Plain forms of the operators' rules, which share no code with them."""

import collections
import hashlib
import math
import re
import struct

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M = 2**64


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def components(n, linked):
    """Smallest number of each of n things' components, for pairs ``linked(i, j)``."""
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j in range(n):
        for i in range(j):
            a, b = top(i), top(j)
            if a != b and linked(i, j):
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def shingles(text, words):
    found = WORD.findall(lowered(text))
    if not found:
        return []
    return [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]


def simhash(text, words):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, words)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def repeats(rows, window):
    """Words, removed words and kept words of (id, text) rows, whose ids differ."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(words), sum(gone), [w for w, g in zip(words, gone) if not g])
    return out


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def deduplicated(rows):
    """Texts of (id, text) rows, by id, without lines that repeat an earlier one: equal, or from 16 characters on one edit apart."""
    seen, long, out = set(), collections.defaultdict(list), {}
    for i, text in sorted(rows):
        keep = []
        for line in (text or "").split("\n"):
            if not line.strip(" \t\n\x0b\x0c\r"):
                keep.append(line)
                continue
            n = len(line)
            far = len(line.strip(" ")) >= 16
            if line in seen or far and any(within_one(line, s) for k in (n - 1, n, n + 1) for s in long[k]):
                pass
            else:
                keep.append(line)
            if line not in seen:
                seen.add(line)
                if far:
                    long[n].append(line)
        out[i] = "\n".join(keep)
    return out


# --- importance resampling ------------------------------------------------------------------------


def bucket_counts(text, buckets=10_000):
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    one = [xxhash.xxh64_intdigest("\0same", 42) if i and h[i] == h[i - 1] else x for i, x in enumerate(h)]
    out = collections.Counter(x % buckets for x in map(final, one, [False] * len(one)))
    out.update(final((a * 0x9E3779B97F4A7C15 % M) ^ ((b + 0x7F4A7C15) % M), True) % buckets for a, b in zip(one, one[1:]))
    return out


def final(x, mixed):
    if not mixed:
        return x
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % M
    return x ^ (x >> 32)


def gumbel(one):
    h = xxhash.xxh64_intdigest(struct.pack("<i", 42), xxhash.xxh64_intdigest(struct.pack("<q", one), 42))
    return -math.log(-math.log(((h >> 11) + 0.5) / 2**53))


def importance(docs, labels, prior=1000.0, odds=100.0, buckets=10_000):
    """``id: (log weight, key, keep)`` of {id: text} and {id: (quality, toxic)}; fewer labels than the sample's bound."""
    counts = {i: bucket_counts(t, buckets) for i, t in docs.items()}
    good = {i for i, (q, x) in labels.items() if q == 1 and not x}
    every, target = collections.Counter(), collections.Counter()
    for i, c in counts.items():
        every.update(c)
        if i in good:
            target.update(c)
    all_n, target_n = sum(every.values()), sum(target.values())
    weight = {}
    for i, c in counts.items():
        n, total = sum(c.values()), 0.0
        for b, k in c.items():
            share = (every[b] - k + 1) / (all_n - n + buckets)
            e = (target_n - (n if i in good else 0)) * share
            found = target[b] - (k if i in good else 0) + prior + 0.5 * e / (e + prior)
            total += k * math.log(found / (e + prior))
        weight[i] = total if target_n else 0.0
    key = {i: w + gumbel(i) for i, w in weight.items()}
    share = sum(q == 1 for q, _ in labels.values()) / len(labels)
    k = sum(w >= -math.log(odds * share) for w in weight.values())
    least = sorted(key.values())[-k] if k else math.inf
    return {i: (weight[i], key[i], key[i] >= least) for i in docs}


def wide_distance(a, b):
    return int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
