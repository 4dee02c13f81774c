"""SimHash components by distance tables against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from corpus_helpers import make
from pyspark.sql import functions as F

from tabgauge.llm import pivots as p


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if not shingles and words:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def plain_components(ids, prints):
    """The smallest id of each row's component, by comparing all pairs of fingerprints."""
    distinct = sorted(set(prints))
    own = {f: f for f in distinct}

    def root(f):
        while own[f] != f:
            f = own[f]
        return f

    array = np.array(distinct, np.uint64)
    for f in distinct:
        for g in array[np.bitwise_count(array ^ np.uint64(f)) <= 2].tolist():
            a, b = sorted((root(f), root(g)))
            own[b] = a
    lowest = {}
    for i, f in zip(ids, prints):
        r = root(f)
        if i is not None:
            lowest[r] = min(i, lowest.get(r, i))
    return [lowest.get(root(f)) for f in prints]


def texts(seed, n=150):
    rnd = random.Random(seed)
    vocabulary = ["Hello", "WORLD", "é", " x", "\x1cy", "b,", "c\U0001f600", *"defghijk"]
    gaps = [" ", "  ", "\t", "\n", "\x0b\x0c", "\r\n"]
    made = [
        "".join(rnd.choice(vocabulary) + rnd.choice(gaps) for _ in range(rnd.choice([1, 2, 3, 8, 90])))
        for _ in range(n)
    ]
    return made + [t.upper() for t in made[:20]] + ["a " * 500 + w for w in vocabulary]


@pytest.mark.parametrize("limit", [1, 7, 1 << 22])
def test_fingerprints(limit):
    for t in [*texts(1), "", "  ", "one", "one two", "A b C"]:
        assert p.fingerprint(t.encode(), limit=limit) == plain_fingerprint(t)


def around(rnd, base, bits):
    for b in rnd.sample(range(64), bits):
        base ^= 1 << b
    return base


def crafted(seed):
    """Fingerprints at 0 to 5 bits from each other, in groups, chains and at random."""
    rnd = random.Random(seed)
    found = [rnd.getrandbits(64) for _ in range(300)]
    for f in found[:60]:
        found += [around(rnd, f, rnd.randint(0, 5)) for _ in range(rnd.randint(1, 4))]
    for _ in range(5):
        f = rnd.getrandbits(64)
        for _ in range(30):
            f = around(rnd, f, rnd.randint(1, 3))
            found.append(f)
    base = rnd.getrandbits(64)
    found += [around(rnd, base, rnd.randint(0, 6)) for _ in range(400)]
    return [*found, 0, 0, 3, 2**64 - 1, 2**63]


@pytest.mark.parametrize("seed,bucket", [(1, 64), (2, 64), (3, 4), (4, 0)])
def test_components(spark, seed, bucket):
    prints = crafted(seed)
    ids = random.Random(seed).sample(range(10_000), len(prints))
    rows = spark.createDataFrame(list(zip(ids, map(p.signed, prints))), "id bigint, f bigint")
    got = {r.f: r.component_id for r in p.near_components(rows, bucket=bucket).collect()}
    assert [got[p.signed(f)] for f in prints] == plain_components(ids, prints)


def test_distances_are_those_to_the_references(spark):
    prints = crafted(9)[:50]
    classes = spark.createDataFrame([(p.signed(f),) for f in prints], "f bigint")
    table = p.distance_table(classes, p.BLOCKS).alias("a")
    own = [p.coordinate("a", i, p.BLOCKS).alias(f"d{i}") for i in range(p.REFERENCES)]
    for r in table.select("f", *own).collect():
        wanted = [((r.f % 2**64) ^ reference).bit_count() for reference in p.references()]
        assert list(r)[1:] == wanted


def test_a_large_group_makes_no_pairs(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    prints = [around(rnd, base, 4) for _ in range(3000)]
    rows = spark.createDataFrame([(i, p.signed(f)) for i, f in enumerate(prints)], "id bigint, f bigint")
    classes = rows.select("f").distinct()
    assert p.links(classes, 2, p.BLOCKS, 64).count() < 40 * len(prints)
    got = {r.f: r.component_id for r in p.near_components(rows).collect()}
    assert [got[p.signed(f)] for f in prints] == plain_components(range(3000), prints)


def test_documents(spark):
    rnd = random.Random(2)
    rows = [(i, t) for i, t in enumerate(texts(3))]
    for i in range(40):
        words = [rnd.choice("abcdefghij") + str(rnd.randint(0, 900)) for _ in range(400)]
        rows.append((1000 + i, " ".join(words)))
        words[rnd.randrange(400)] = "changed"
        rows.append((500 + i, " ".join(words)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in p.simhash_components(make(spark, rows)).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    wanted = plain_components([i for i, _ in rows], prints)
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, prints, wanted)}


def test_odd_rows(spark, odd, odd_rows, nothing):
    got = p.simhash_components(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    wanted = plain_components([r[0] for r in odd_rows], prints)
    found = sorted(map(repr, (tuple(r) for r in got.collect())))
    assert found == sorted(
        repr((r[0], f"{f:016x}", c)) for r, f, c in zip(odd_rows, prints, wanted)
    )
    assert p.simhash_components(nothing).collect() == []
    alone = p.simhash_components(make(spark, [(None, "a b c"), (2**63 - 1, "d")]))
    assert sorted((r.doc_id is None, r.component_id is None) for r in alone.collect()) == [
        (False, False),
        (True, True),
    ]
    clash = make(spark, [(1, "x")]).withColumns({"f": F.lit("x"), "key": F.lit(1), "id": F.lit(2)})
    assert p.simhash_components(clash).count() == 1
