"""Exact dedup, mixing and fingerprints against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from corpus_helpers import make
from pyspark.sql import functions as F

from tabgauge.llm import exact, mixing, simhash


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(odd, odd_rows, nothing):
    groups = defaultdict(list)
    for i, text, *_ in odd_rows:
        groups[normal(text)].append(i)
    got = rows_of(exact.exact_groups(odd.repartition(5), fan=2))
    assert len(got) == len(odd_rows)
    by_digest = defaultdict(list)
    for r in got:
        by_digest[r["text_sha256"]].append(r)
    assert len(by_digest) == len(groups)
    for text, ids in groups.items():
        found = by_digest[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert {r["keep_id"] for r in found} == {min(known) if known else None}
        assert {r["group_size"] for r in found} == {len(ids)}
        assert sum(r["kept"] for r in found) == 1
    assert exact.exact_groups(nothing).count() == 0


def test_drop_copies(odd, odd_rows, nothing):
    got = exact.drop_copies(odd)
    assert got.columns == odd.columns
    kept = rows_of(got)
    assert sorted(normal(r["text"]) for r in kept) == sorted({normal(r[1]) for r in odd_rows})
    assert next(r for r in kept if normal(r["text"]) == "a b c")["doc_id"] == 1
    assert exact.drop_copies(nothing).count() == 0


def test_many_runs_one_hot_text(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("text"),
    )
    got = exact.exact_groups(docs.repartition(40), fan=3)
    same = got.where("keep_id = 1")
    assert same.count() == 2000 and same.where("kept").count() == 1
    assert got.where("kept").count() == 1001


def water_level(sizes, weights, total, most):
    full = set()
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / sum(weights[s] for s in open_) if open_ else 0
        new = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= new


def test_mixing_targets_and_totals(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(4000):
        source = rnd.choice(["s0"] * 6 + ["s1", "s2", "s3", "é", "Z", None])
        rows.append((i, "w " * int(rnd.paretovariate(1.2) * 10), "en", source))
    docs = make(spark, rows)
    got = rows_of(mixing.mix(docs))
    assert len(got) == len(rows)
    size, source_of = defaultdict(int), {r[0]: r[3] for r in rows}
    for i, text, _, source in rows:
        size[source] += len(text.split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water_level(size, weights, 1.5 * sum(size.values()), 2)
    taken = defaultdict(int)
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["source_size"] == size[source]
        assert math.isclose(r["target"], want[source], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(0.01 * target, 5)
    again = {r["doc_id"]: r["taken"] for r in rows_of(mixing.mix(docs.repartition(7)))}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mixing_odd(odd, odd_rows, nothing):
    got = rows_of(mixing.mix(odd))
    assert len(got) == len(odd_rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(nothing).count() == 0
    taken = mixing.take_copies(odd)
    assert taken.columns == odd.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows_of(taken))
    assert words == sum(r["taken"] for r in got)
    assert mixing.take_copies(nothing).count() == 0


def edited(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1] or ""
        text = text or ""
        k = len(text) // 2
        out[doc] = text[: len(text) - k] + after[:k]
    return out


@pytest.mark.parametrize("ranges", [2, 5])
def test_edited_texts(spark, ranges):
    rnd = random.Random(1)
    rows = [
        (i * 3, " ".join(rnd.choice(["äb", "cd", "\U0001f600", "fgh"]) for _ in range(rnd.randint(0, 30))))
        for i in range(60)
    ]
    rows[7] = (21, None)
    got = rows_of(simhash.edited_fingerprints(make(spark, rows), ranges=ranges))
    want = edited(rows)
    assert {r["doc_id"] for r in got} == set(want)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    order = sorted(want, reverse=True)
    for r in got:
        doc = r["doc_id"]
        assert r["edited_sha256"] == hashlib.sha256(want[doc].encode()).hexdigest()
        assert r["n_chars"] == len(dict(rows)[doc] or "")
        after = order[(order.index(doc) + 1) % len(order)]
        bits = bin(int(r["fingerprint"], 16) ^ int(prints[after], 16)).count("1")
        assert math.isclose(r["near_next"], max(0, math.cos(math.pi * bits / 128)), abs_tol=1e-9)
    by_text = defaultdict(set)
    for doc, text in rows:
        by_text[text or ""].add(prints[doc])
    assert all(len(p) == 1 for p in by_text.values())


def test_fingerprint_votes(spark):
    text = "b a b a b c"
    got = simhash.fingerprints(spark.createDataFrame([(1, text)], "k int, text string"), ["k"])
    words = text.split(" ")
    pairs = spark.createDataFrame(
        [(w, words[i + 1] if i + 1 < len(words) else None) for i, w in enumerate(words)],
        "a string, b string",
    )
    hashes = pairs.select(
        F.xxhash64("a", "b").alias("h1"), F.xxhash64(F.lit(7), "a", "b").alias("h2")
    ).collect()
    row = got.first()
    for f, h in (("f1", "h1"), ("f2", "h2")):
        for j in range(64):
            votes = sum((x[h] >> j) & 1 for x in hashes)
            assert ((row[f] >> j) & 1) == (votes * 2 > len(hashes)), (f, j)


def test_near_counts_find_all(spark):
    rnd = random.Random(2)
    base = [(rnd.getrandbits(64) - 2**63, rnd.getrandbits(64) - 2**63) for _ in range(20)]

    def flip(p, n):
        bits = (p[0] & (2**64 - 1)) | (p[1] & (2**64 - 1)) << 64
        for b in rnd.sample(range(128), n):
            bits ^= 1 << b
        halves = (bits & (2**64 - 1), bits >> 64)
        return tuple(h - 2**64 if h >= 2**63 else h for h in halves)

    prints = [flip(rnd.choice(base), rnd.randint(0, 5)) for _ in range(400)] + base * 2
    df = spark.createDataFrame(prints, "f1 bigint, f2 bigint")
    got = {(r.f1, r.f2): r.n_within for r in simhash.near_counts(df, df).collect()}

    def far(p, q):
        return sum(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in zip(p, q))

    for p in set(prints):
        assert got[p] == sum(far(p, q) <= 3 for q in prints)


def test_simhash_odd(odd, odd_rows, nothing):
    got = rows_of(simhash.simhash(odd))
    assert len(got) == len(odd_rows)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert simhash.simhash(nothing).count() == 0
    assert simhash.simhash(odd.where("doc_id = 9")).first().near_next == 1.0


def terms(text):
    words = re.split(r"[\x20\x09-\x0D]+", text)
    return Counter(zip(words, words[1:] + [None]))


def cosine(a, b):
    length = lambda t: math.sqrt(sum(n * n for n in t.values()))
    return sum(n * b[t] for t, n in a.items()) / (length(a) * length(b))


def test_simhash_finds_near_copies(spark):
    """Of the pairs of a cosine of 0.95 or more, nine of ten are within the radius."""
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(100)]
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 2):
            own = list(base)
            for k in rnd.sample(range(100), changes):
                own[k] = rnd.choice(vocabulary)
            texts.append(" ".join(own))
    docs = make(spark, [(i, t) for i, t in enumerate(texts)])
    got = rows_of(simhash.simhash(docs, every=1))
    bits = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    far = lambda i, j: (bits[i] ^ bits[j]).bit_count()
    for r in got:
        assert r["n_within"] == sum(far(r["doc_id"], j) <= simhash.NEAR_RADIUS for j in bits)
    sets = [terms(t) for t in texts]
    near = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if cosine(sets[i], sets[j]) >= simhash.NEAR_COSINE
    ]
    found = (sum(r["n_within"] for r in got) - len(texts)) / 2
    within = sum(far(i, j) <= simhash.NEAR_RADIUS for i, j in near)
    assert len(near) > 200 and within >= 0.9 * len(near) and found >= within
