"""Repeated strings, near copies and archives against brute force; the pipeline."""

import base64
import gzip
import hashlib
import random
import re
import shutil
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_helpers import make
from pyspark.sql import functions as F

from tabgauge.llm import exact, jaccard, langid, mixing, suffix, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(docs, length):
    seen = Counter(d[i : i + length] for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


def random_texts(seed, length, n=60):
    rnd = random.Random(seed)
    letters = rnd.choice(["ab", "abcdefgh", "abcdé\U0001f600"])
    word = lambda size: "".join(rnd.choice(letters) for _ in range(size))
    pool = [word(rnd.randint(1, 3 * length)) for _ in range(8)]
    return [
        "".join(
            rnd.choice(pool) if rnd.random() < 0.5 else word(rnd.randint(0, length))
            for _ in range(rnd.randint(0, 5))
        )
        for _ in range(n)
    ]


@pytest.mark.parametrize("seed,together", [(1, 100_000), (2, 100_000), (3, 5), (4, 0)])
def test_repeats(spark, seed, together):
    texts = random_texts(seed, 20) + [None, "", "a" * 300, "a" * 300]
    docs = make(spark, [(i, t) for i, t in enumerate(texts)])
    raw = [(t or "").encode() for t in texts]
    got = {
        r.doc_id: r
        for r in suffix.remove_repeats(docs, length=20, gram=6, together=together).collect()
    }
    for i, (data, mask) in enumerate(zip(raw, covered(raw, 20))):
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), int(mask.sum()), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and bytes(r.kept) == kept


@pytest.mark.parametrize("seed", range(20))
def test_covered_core(seed):
    """Anchors, sorting and rolling hashes without Spark, in short streams."""
    rnd = random.Random(seed)
    length = rnd.choice([10, 20, 40])
    raw = [t.encode() for t in random_texts(seed, length, 12)]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in raw])]).astype(np.int64)
    scales = (suffix.Scale(0), suffix.Scale(1))
    gram = rnd.choice([3, length // 4 + 1])
    whole = suffix.anchors(data, bounds, scales, length, gram, 1 << 20)
    short = suffix.anchors(data, bounds, scales, length, gram, rnd.choice([7, 50]))
    assert all((whole[k] == short[k]).all() for k in whole)


def test_suffix_order():
    rnd = random.Random(9)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(400)), np.uint8)
    start = np.array([rnd.randint(0, 380) for _ in range(90)])
    size = np.minimum(len(data) - start, rnd.randint(5, 60))
    group = np.sort(np.array([rnd.randint(0, 9) for _ in range(90)]))
    own = suffix.Suffixes(data, start, size, suffix.Scale(0))
    order = own.sort(group)
    text = lambda i: bytes(data[start[i] : start[i] + size[i]])
    assert [(group[i], text(i)) for i in order] == sorted((group[i], text(i)) for i in range(90))
    best = own.longest(group)
    for i in range(90):
        common = [
            next((k for k, (x, y) in enumerate(zip(text(i), text(j))) if x != y),
                 min(size[i], size[j]))
            for j in range(90)
            if j != i and group[i] == group[j]
        ]
        assert best[i] == max(common, default=0)


def test_repeats_odd(odd, odd_rows, nothing):
    got = suffix.remove_repeats(odd).collect()
    assert len(got) == len(odd_rows)
    assert next(r for r in got if r.doc_id == 8).n_removed == 5000
    assert suffix.remove_repeats(nothing).count() == 0


def sets_of(texts, words):
    out = []
    for t in texts:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = WORD.findall(lower)
        if len(w) >= words:
            out.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)))
        else:
            out.append(frozenset([tuple(w)] if w else []))
    return out


def linked(texts, words, percent):
    sets = sets_of(texts, words)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], sets


def near_texts(seed):
    rnd = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(40)]
    common = " ".join(rnd.choice(vocabulary) for _ in range(25))
    texts = [None, "", " \n", "w1", "W1", "w1 w2 w3", "w1\tw2  w3"]
    for _ in range(14):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 60))]
        for _ in range(rnd.choice([1, 2, 8])):
            own = list(base)
            for _ in range(rnd.randint(0, 2)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                own.append(common)
            texts.append(" ".join(own))
    # A chain, in which only neighbours link.
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):
        texts.append(" ".join(chain[2 * i : 2 * i + 34]))
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,bucket", [(1, 32), (2, 32), (3, 3), (4, 1), (5, 2)])
def test_components(spark, seed, bucket):
    texts = near_texts(seed)
    docs = make(spark, [(i, t) for i, t in enumerate(texts)])
    want, sets = linked(texts, 4, 85)
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs, bucket=bucket).collect()}
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id) == (len(sets[i]), want[i]), texts[i]


@pytest.mark.parametrize("bucket", [32, 1])
def test_components_of_repeated_rows(spark, bucket):
    """Near documents that do not link, given as repeated rows and as copies without an id."""
    rnd = random.Random(6)
    rows = []
    for i in range(12):
        base = [f"v{i}x{k}" for k in range(60)]
        other = list(base)
        for k in rnd.sample(range(60), 1 + i % 3):
            other[k] = f"z{i}x{k}"
        rows += [(2 * i, " ".join(base))] * 2 + [(2 * i + 1, " ".join(other))] * (1 + i % 2)
    rows += [(None, " ".join(f"v0x{k}" for k in range(8, 60)))] * 3
    want, _ = linked([t for _, t in rows], 4, 85)
    lowest = [rows[w][0] for w in want]
    assert len(set(lowest)) > 13
    got = jaccard.jaccard_join(make(spark, rows), bucket=bucket).collect()
    # A component is named by its smallest id, a null one by none but itself.
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        (i, c) for (i, _), c in zip(rows, lowest)
    )


def test_dissimilar_documents_that_share_a_passage(spark):
    """Hundreds of classes in the buckets of one passage, few of which link, and a large
    group of near copies; all as by brute force."""
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(48)]
    texts = [
        " ".join([f"u{i}x{k}" for k in range(rnd.choice([2, 5, 8, 9, 10, 30]))] + passage)
        for i in range(500)
    ]
    base = [f"b{i}" for i in range(120)]
    for i in range(200):
        own = list(base)
        for k in rnd.sample(range(120), rnd.randint(1, 6)):
            own[k] = f"e{i}x{k}"
        texts.append(" ".join(own))
    rnd.shuffle(texts)
    want, _ = linked(texts, 4, 85)
    docs = make(spark, [(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_join(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert 100 < len(set(want)) < 650


def test_drop_near_copies(spark):
    texts = near_texts(8)
    docs = make(spark, [(i, t) for i, t in enumerate(texts)])
    want, _ = linked(texts, 5, 80)
    got = jaccard.drop_near_copies(docs, words=5, percent=80)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_near_copies_odd(odd, odd_rows, nothing):
    assert jaccard.jaccard_join(odd).count() == len(odd_rows)
    assert jaccard.jaccard_join(nothing).count() == 0
    kept = jaccard.drop_near_copies(odd)
    # Three blank or null texts with ids, one without; the others one per component.
    assert kept.where("trim(coalesce(text, '')) = '' or doc_id = 3").count() == 4
    texts = sorted(r.text for r in kept.where("doc_id = 7").collect())
    assert texts == ["one", "two other words"]
    assert jaccard.drop_near_copies(nothing).count() == 0


@pytest.mark.parametrize(
    "stage", [exact.drop_copies, jaccard.drop_near_copies, mixing.take_copies, langid.keep_known]
)
def test_columns_with_clashing_names_stay(spark, stage):
    """A document's own columns may have any of the names used inside."""
    names = ["id", "mark", "order", "row", "place", "copies", "copy", "key", "size", "lang_pred",
             "score", "rejected", "n", "digest", "check", "__id", "__copies", "__text", "held_out"]
    words = {"en": "the cat and the dog of this house were there", "de": "der hund und die katze sind nicht im haus"}
    rows = [
        (i, f"{words[lang]} {words[lang]} number {'abcdefgh'[i % 8]}", lang, "s", *[f"{n}{i}" for n in names])
        for i, lang in enumerate(["en", "de"] * 20)
    ]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    got = stage(docs)
    assert got.columns == docs.columns
    made = got.collect()
    assert made and set(map(tuple, made)) <= set(rows)


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = jaccard.components(links.orderBy(F.rand(3)))
    assert got.count() == 301 and got.where("component <> 0").count() == 0


PAGES = "page_id bigint, url string, html string, extra int"


@pytest.fixture
def folder():
    path = tempfile.mkdtemp(prefix="archives-")
    yield f"{path}/warc"
    shutil.rmtree(path)


def test_archives(spark, folder):
    rows = [
        (3, "http://a.example/x y", "<p>é</p>", 1),
        (1, "http://a.example/", "<p>é</p>", 1),
        (2, None, None, 1),
        (4, "https://b.example", "", None),
        (None, "http://c.example/\r\nEvil: 1", "WARC/1.1\r\n\r\n" * 3, 1),
        (9, "http://d.example/q", "same", 1),
        (9, "http://d.example/q", "same", 1),
        (8, "http://d.example/r", "x" * 200_000, 1),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    warc.write_archives(pages, folder)
    records = warc.read_records(spark, folder)
    assert dict(records.groupBy("type").count().collect()) == {
        "request": 8, "metadata": 8, "response": 5, "revisit": 3,
    }
    nested = warc.assemble(records)
    assert nested.where("request is null or metadata is null").count() == 0
    assert {r.response.uri for r in nested.collect()} >= {"http://a.example/", None}
    got = sorted(
        (tuple(r) for r in warc.captures(nested).collect()), key=lambda r: (r[0] or 99, r[3])
    )
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert got == [
        (1, 9, digest("<p>é</p>"), "response", None),
        (2, 0, digest(""), "response", None),
        (3, 9, digest("<p>é</p>"), "revisit", 1),
        (4, 0, digest(""), "revisit", 2),
        (8, 200_000, digest("x" * 200_000), "response", None),
        (9, 4, digest("same"), "response", None),
        (9, 4, digest("same"), "revisit", 9),
        (None, 36, digest("WARC/1.1\r\n\r\n" * 3), "response", None),
    ]
    payloads = {bytes(r.response.payload) for r in nested.where("response.type = 'response'").collect()}
    assert payloads == {(r[2] or "").encode() for r in rows}


def test_archives_least(spark, folder):
    pages = spark.createDataFrame([(1, "u", "ab", 1), (2, "u", "ab", 1)], PAGES)
    warc.write_archives(pages, folder, least=3)
    got = warc.captures(warc.assemble(warc.read_records(spark, folder)))
    assert got.where("record_type = 'response' and refers_to is null").count() == 2


def test_archives_empty(spark, folder):
    warc.write_archives(spark.createDataFrame([], PAGES), folder)
    assert warc.captures(warc.assemble(warc.read_records(spark, folder))).count() == 0


def test_records_compressed_one_by_one():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    content = gzip.compress(one) + gzip.compress(one)
    assert [b for _, b in warc.parse(warc.plain(content))] == [b"abcd", b"abcd"]


def test_pipeline(spark, odd):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    counts = defaultdict(int)
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.saved(stage(spark, frame, sf_dir))
        counts[name] = frame.count()
        if name != "bpe_tokens":
            assert frame.columns == columns
        if name == "exact_dedup":
            normal = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
            assert counts[name] == docs.select(normal).distinct().count()
        if name == "ngram_jaccard":
            texts = [r.text for r in frame.orderBy("doc_id").collect()]
            assert len(set(linked(texts, 5, 80)[0])) == len(texts)
    assert counts["language_id"] == docs.count()
    assert frame.where("size(token_ids) = 0").count() == 0
    frame = odd
    for _, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.saved(stage(spark, frame, sf_dir))
