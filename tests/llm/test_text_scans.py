"""Personal data, token counts, BPE and language against plain rules and libraries."""

import hashlib
import random
import re
import resource
import shutil
import tempfile
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from corpus_helpers import make
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabgauge.llm import bpe, langid, pii, tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and pii.luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, rule in RULES
        for m in re.finditer(rule, text)
        if passes(kind, m[0])
    ]


def test_seeds_are_the_rules():
    rnd = random.Random(3)
    for letters, size in (("ab1.2@+ -()0@.9%é", 40), ("0123456789 -", 60), ("a@.b-", 30)):
        for _ in range(4000):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, size)))
            got = [(pii.KINDS[k], a, b) for k, a, b in pii.seeds(text)]
            assert got == brute_spans(text), text


def test_seeds_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 200_000, "+1((" * 100_000, "a@" * 200_000):
        pii.candidates(text, pii.seeds(text))


def test_any_number_of_zeros_in_an_ip(spark):
    zeros = "0" * 5000
    texts = [f"{zeros}.1.1.1", f"x {zeros}255.0.{zeros}.{zeros}7 y", f"{zeros}256.1.1.1", "9" * 5000 + ".1.1.1"]
    got = {r.doc_id: r for r in pii.find_personal_data(make(spark, spread(texts))).collect()}
    assert [got[i].n_ip for i in range(4)] == [1, 1, 0, 0]
    for i, start in ((0, 0), (1, 2)):
        line = f"ip:{start}:{len(texts[i]) - start}"
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_counts_of_every_kind(spark):
    mail, ip, card, phone = "me@x.org", "10.0.0.1", "4532015112830366", "+49 30 123456"
    texts = ["", mail, ip, card, phone, f"{ip} {ip} {ip}", f"{card} | {card}", f"{phone} {mail} {mail}",
             f"{phone}, {card}, {ip}, {mail}", f"{mail} {ip} {ip} {mail} {phone} {mail}"]
    got = {r.doc_id: r for r in pii.find_personal_data(make(spark, spread(texts))).collect()}
    for i, text in enumerate(texts):
        kinds = [kind for kind, _, _ in brute_spans(text)]
        row = got[i]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [kinds.count(k) for k in pii.KINDS], text
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(text))
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_long_matches_take_no_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for text in ("1" * 4_000_000, "1 " * 2_000_000, "a@b" + ".c" * 2_000_000):
        pii.seeds(text)
    # In kB.
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_luhn():
    assert pii.luhn("4532015112830366") and not pii.luhn("4532015112830367")


def spread(rows):
    return [(i, t, "en", "s") for i, t in enumerate(rows)]


def test_patterns_find_unseen_identifiers(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rnd = random.Random(7)
    rows = []
    for i in range(40):
        noise = " ".join(rnd.choice(words) for _ in range(8))
        rows.append(f"{noise} write to me at user{i}@mail{i}.example.com or call {noise}")
    hidden = "words write to me at secret.person (at) example (dot) org or call"
    lone = "words about meals secret.person (at) example (dot) com are had daily"
    rows += [hidden, lone, "nothing here"]
    got = {r.doc_id: r for r in pii.find_personal_data(make(spark, spread(rows))).collect()}
    a = hidden.index("secret")
    b = hidden.index(" or call")
    assert got[40].spans == f"email:{a}:{b}" and got[40].n_added == 1 and got[40].n_email == 0
    assert got[41].spans == "" and got[42].spans == ""
    for i in range(40):
        want = ",".join(f"{k}:{x}:{y}" for k, x, y in brute_spans(rows[i]))
        assert got[i].spans == want and got[i].n_email == 1
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_personal_data_odd(odd, odd_rows, nothing):
    assert pii.find_personal_data(odd).count() == len(odd_rows)
    assert pii.find_personal_data(nothing).count() == 0


ODD_TEXTS = [
    "", " ", "  a", "it's I'll 'RE", "a" * 3000, "ab" * 2000,
    "<|endoftext|>x<|endoftext|><|endoftext|>", "日本語 テスト", "՘֋ a", "\U0001f389a",
    "naïve—“q” … \x85\xa0\x1c\x1d", "   \n\n \t x", "1234567890" * 200, "\x00\x01 é\r\n\r\n",
]


def odd_texts():
    rnd = random.Random(1)
    letters = "abc  '\n\r\t.,sdtl1²é\x1c\x85\xa0ʼß日"
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    long = ["".join(rnd.choice("abcdeinrst") for _ in range(rnd.randint(900, 2500))) for _ in range(9)]
    return ODD_TEXTS + made + long


def test_bpe_is_the_library(spark):
    texts = odd_texts()
    library = Tokenizer.from_file(FILE)
    got = {r.doc_id: r for r in bpe.encode(make(spark, spread(texts)), FILE).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].ids == ids, text[:60]
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()


def test_bpe_trees_agree():
    own = bpe.Bpe(bpe.read_file(FILE))
    rnd = random.Random(5)
    for _ in range(200):
        raw = bytes(rnd.choice(b"aeinrst ") for _ in range(rnd.randint(2, 64)))
        width = 1 << max(1, (len(raw) - 1).bit_length())
        assert own.merge_rows([raw], width)[0] == own.merge_long(raw)


def test_bpe_odd(odd, odd_rows, nothing):
    assert bpe.encode(odd, FILE).count() == len(odd_rows)
    assert bpe.encode(nothing, FILE).count() == 0
    kept = bpe.encode_documents(odd.withColumn("token_ids", F.lit(1)), FILE)
    assert kept.columns == [*odd.columns, "token_ids"]
    assert kept.where("doc_id = 5").first().token_ids == []


def test_pipeline_decodes(spark, odd):
    import corpus_pipeline

    docs = odd.union(make(spark, spread(odd_texts()[:40])))
    got = corpus_pipeline.bpe_tokens(spark, docs, "")
    assert got.columns == [*docs.columns, "token_ids", "decoded_sha256"]
    library = Tokenizer.from_file(FILE)
    for r in got.collect():
        text = library.decode(r.token_ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert text == (r.text or "")


@pytest.fixture
def cache():
    path = tempfile.mkdtemp(prefix="token-cache-")
    yield f"{path}/cache"
    shutil.rmtree(path)


def test_counts_and_cache(spark, cache):
    texts = odd_texts()
    library = Tokenizer.from_file(FILE)
    docs = make(spark, spread(texts + texts[:5]))
    for round_ in range(2):
        got = {r.doc_id: r for r in tokens.count_tokens(docs, FILE, cache).collect()}
        for i, text in enumerate(texts + texts[:5]):
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (got[i].n_tokens, got[i].n_bytes) == (n, len(text.encode())), text[:60]
            assert got[i].over_limit == (n > 512)
        # The second run finds every count stored.
        assert tokens.read_cache(spark, cache).count() == len(set(texts))
    more = make(spark, [(1, "a new text"), (2, texts[3])])
    tokens.count_tokens(more, FILE, cache)
    assert tokens.read_cache(spark, cache).count() == len(set(texts)) + 1


def test_counts_odd(odd, odd_rows, nothing, cache):
    assert tokens.count_tokens(nothing, FILE, cache).count() == 0
    got = tokens.count_tokens(odd, FILE, cache)
    assert got.count() == len(odd_rows)
    assert got.where("doc_id = 5").first().n_tokens == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs)
    assert got.count() == docs.count()
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))
    )
    assert right.first()[0] >= 0.95
    assert got.where("score < 0 or score > 1").count() == 0
    assert got.where("not held_out").count() > 0


def test_language_ignores_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    a = langid.predict(docs, model).select("doc_id", "lang_pred", "score")
    b = langid.predict(docs.withColumns({"lang": F.lit("xx"), "source": F.lit("")}), model)
    assert a.exceptAll(b.select("doc_id", "lang_pred", "score")).count() == 0


def test_language_odd(odd, odd_rows, nothing):
    got = {}
    rows = langid.identify(odd).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        got.setdefault(r.doc_id, r)
    for i in (5, 4, 3):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[9].lang_pred != "und"
    assert langid.identify(nothing).count() == 0
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (3, 4, 5)").count() == 0
    assert kept.where("doc_id = 8").count() == 1
    assert langid.keep_known(nothing).count() == 0


def test_only_letters_make_a_language():
    texts = ["\u00b2", "\u00bd \u2460", "\u2163 \u2167", "3\u0969", "_ .", "x\u00b2", "\u3007"]
    _, letters = langid.grams(texts)
    wanted = [any(unicodedata.category(c)[0] == "L" for c in t) for t in texts]
    assert letters.tolist() == wanted and sum(wanted) == 1


def unseen(seed, letters, words):
    """Words made up of letters, as an unknown language or as junk."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9)))
    known = [word() for _ in range(300)]
    return " ".join(rnd.choice(known) for _ in range(words))


def test_language_rejects_the_unseen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    clean = langid.predict(docs.where(langid.held_out()), model).where("lang_pred <> 'und'")
    assert clean.where("rejected").count() <= 0.01 * clean.count()
    polish, cyrillic = "abcdefghijklmnoprstuwyząęłśćżź", "абвгдежзийклмнопрстуфхцчшщыэюя"
    texts = [
        unseen(seed, letters, words)
        for letters in (polish, cyrillic, "abcdefghijklmnopqrstuvwxyz", "qwrtpsdfghjklzxcvbnm")
        for words in (150, 1500)
        for seed in range(10)
    ]
    strange = make(spark, [(i, t) for i, t in enumerate(texts)]).select(docs.columns)
    kept = langid.keep_known(docs.union(strange))
    assert kept.where(F.col("text").isin(texts)).count() == 0
    assert kept.count() >= 0.99 * docs.count()


def test_language_weights_from_all_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.repartition(5), size=40)
    counts, letters = langid.grams([r.text for r in docs.where("text is not null").collect()])
    seen = (counts[letters] > 0).sum(0)
    want = np.log((1 + letters.sum()) / (1 + seen)) + 0.1
    assert np.allclose(model.idf, want, atol=1e-5)
