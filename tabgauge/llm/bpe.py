"""Byte-level BPE encoding and decoding with a segment tree.

A text is cut at special strings and then into pieces by the tokenizer's own rule.
Each distinct piece of a batch is merged once. A piece's neighbouring pairs are the
leaves of a segment tree, each with its merge rank and place; the root then names the
leftmost pair of lowest rank. Merging it changes three leaves, whose paths to the root
are computed anew, and so on until the root is empty. Trees of many pieces are held as
rows of one array and advance together; very long pieces have a tree of their own.

Token ids are decoded through the vocabulary's bytes; bytes that are not UTF-8 become
U+FFFD, as the library has it.

Defined results: null text is empty and has no tokens; repeated rows repeat; an empty
table gives an empty result. Memory is bounded by a batch, its longest text and
``CACHE_PIECES`` remembered pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.expr import col
from tabgauge.llm.common import whole_text

# Pickled with the functions, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 1 << 20
CACHE_PIECES = 700_000
ROWS_TOGETHER = 8192
LONG_PIECE = 1024
NONE = np.iinfo(np.int64).max

# The cutting rule for texts below U+0250; others are cut by the library itself.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
WIDE = re.compile("[^\x00-ɏ]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary, as the format has it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    extra = (b for b in range(256) if b not in set(plain))
    letters.update({chr(256 + i): b for i, b in enumerate(extra)})
    return letters


class Bpe:
    """Vocabulary, merge ranks and special strings of a tokenizer file."""

    def __init__(self, content: bytes):
        self.content = content
        model = json.loads(content)
        if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")
        vocab = model["model"]["vocab"]
        letter = byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letter[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letter.items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.new_id = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.ranks = {k: (r, n) for r, (k, n) in enumerate(zip(keys.tolist(), self.new_id.tolist()))}
        cut = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, cut)) + ")") if cut else None
        self.cache: dict[str, bytes] = {}
        self.library = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NONE where it does not merge."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NONE)

    def pieces(self, text: str) -> list[str]:
        if WIDE.search(text) is None:
            return LATIN.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.content.decode()).pre_tokenizer
        spans = self.library.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]

    def parts(self, text: str) -> list[tuple[list[str], bytes]]:
        """Pieces between special strings, each followed by the special token's id."""
        if self.cut is None or not any(s in text for s in self.special):
            return [(self.pieces(text), b"")]
        found = self.cut.split(text)
        return [
            (
                self.pieces(found[i]) if found[i] else [],
                np.uint32(self.special[found[i + 1]]).tobytes() if i + 1 < len(found) else b"",
            )
            for i in range(0, len(found), 2)
        ]

    def learn(self, pieces: set[str]) -> None:
        """Merge pieces that are not in the cache."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = [p for p in pieces if p not in self.cache]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        by_size: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            width = 1 << max(1, (len(b) - 1).bit_length())
            by_size.setdefault(width, []).append(i)
        for width, members in by_size.items():
            if width > LONG_PIECE:
                for i in members:
                    self.cache[new[i]] = self.merge_long(raw[i])
                continue
            step = max(1, ROWS_TOGETHER * 8 // width)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                for i, ids in zip(some, self.merge_rows([raw[i] for i in some], width)):
                    self.cache[new[i]] = ids

    def merge_rows(self, raw: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of up to ``width`` bytes, one segment tree per row."""
        n, depth = len(raw), width.bit_length() - 1
        size = np.array([len(b) for b in raw])
        flat = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in raw), np.uint8)
        ids = self.byte_id[flat].reshape(n, width)
        place = np.arange(width)
        inside = place[None, :] < size[:, None]
        after = np.where(place[None, :] + 1 < size[:, None], place[None, :] + 1, -1)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        leaf = tree[:, width : 2 * width - 1]
        leaf[:] = self.rank(ids[:, :-1], ids[:, 1:])
        ok = (leaf != NONE) & inside[:, 1:]
        leaf[:] = np.where(ok, (leaf << depth) + place[:-1], NONE)
        level = width
        while level > 1:
            np.minimum(
                tree[:, level : 2 * level : 2],
                tree[:, level + 1 : 2 * level : 2],
                out=tree[:, level // 2 : level],
            )
            level //= 2
        tree, ids, after, before = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()
        row = np.flatnonzero(tree[1 :: 2 * width] != NONE)
        while len(row):
            top, base, at = row * 2 * width, row * width, None
            best = tree[top + 1]
            at = best & (width - 1)
            new = self.new_id[best >> depth]
            gone = after[base + at]
            right = after[base + gone]
            left = before[base + at]
            ids[base + at] = new
            ids[base + gone] = -1
            after[base + at] = right
            has_r, has_l = right >= 0, left >= 0
            before[(base + right)[has_r]] = at[has_r]
            with_r = self.rank(new, ids[base + np.where(has_r, right, at)])
            with_l = self.rank(ids[base + np.where(has_l, left, at)], new)
            here = top + width
            tree[here + gone] = NONE
            tree[here + at] = np.where(has_r & (with_r != NONE), (with_r << depth) + at, NONE)
            lt, ll = here[has_l] + left[has_l], with_l[has_l]
            tree[lt] = np.where(ll != NONE, (ll << depth) + left[has_l], NONE)
            paths = [(top, width + gone), (top, width + at), (top[has_l], width + left[has_l])]
            for _ in range(depth):
                paths = [(t, node >> 1) for t, node in paths]
                for t, node in paths:
                    tree[t + node] = np.minimum(tree[t + 2 * node], tree[t + 2 * node + 1])
            row = row[tree[top + 1] != NONE]
        kept = ids.reshape(n, width).copy()
        kept[~inside] = -1
        keep = kept >= 0
        out = kept[keep].astype("<u4").tobytes()
        ends = np.cumsum(keep.sum(1)) * 4
        starts = np.concatenate([[0], ends[:-1]])
        return [out[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def merge_long(self, raw: bytes) -> bytes:
        """Ids of one long piece; the same tree, step by step."""
        n = len(raw)
        width = 1 << max(1, (n - 1).bit_length())
        none, ranks = (1 << 62), self.ranks
        ids = [int(self.byte_id[b]) for b in raw]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]

        def leaf(i: int) -> int:
            j = after[i]
            found = ranks.get(ids[i] << 32 | ids[j]) if j >= 0 else None
            return found[0] * width + i if found else none

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            i = tree[1] % width
            j = after[i]
            ids[i] = ranks[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (j, i, before[i]):
                if k < 0:
                    continue
                node = width + k
                tree[node] = none if k == j else leaf(k)
                while node > 1:
                    node >>= 1
                    value = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == value:
                        break
                    tree[node] = value
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        parts = [self.parts(t) for t in texts]
        self.learn({p for text in parts for pieces, _ in text for p in pieces})
        ids = self.cache
        return [
            b"".join([b"".join([ids[p] for p in pieces]) + end for pieces, end in text])
            for text in parts
        ]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        found = [of[i] for i in np.frombuffer(ids, "<u4").tolist()]
        return b"".join(found).decode("utf-8", "replace")


def batches(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[slice]:
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def read_file(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    real: bool = True,
) -> DataFrame:
    """One row per document: id, ids (array<int>), n_tokens, ids_sha256, decoded,
    decoded_sha256. ``real=False`` leaves out the ids and the decoded text.

    The tokenizer file is read where the job is built and broadcast; such a file has a
    few megabytes at any size of the corpus.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(held.value)
        for part in parts:
            texts = part.column(1).to_pylist()
            for some in batches(texts):
                ids = bpe.encode_batch(texts[some])
                decoded = [bpe.decode(i) for i in ids]
                raw = [d.encode("utf-8", "replace") for d in decoded]
                out = [
                    part.column(0)[some.start : some.stop],
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    pa.array([hashlib.sha256(d).hexdigest() for d in raw]),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if real:
                    lists = [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]
                    out += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if real:
        schema += ", ids array<int>, decoded string"
    narrow = docs.select(col(id_col).cast("bigint").alias("id"), whole_text(text_col).alias("text"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode_documents(
    docs: DataFrame, tokenizer: str, text_col: str = "text", decode: bool = False
) -> DataFrame:
    """The documents with their own columns and one more, ``token_ids``.

    ``decode=True`` also decodes the ids and adds the decoded text's ``decoded_sha256``."""
    held = docs.sparkSession.sparkContext.broadcast(read_file(tokenizer))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(held.value)
        for part in parts:
            texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
            for some in batches(texts):
                ids = bpe.encode_batch(texts[some])
                lists = [np.frombuffer(i, "<u4").astype(np.int32) for i in ids]
                out = [pa.array(lists, pa.list_(pa.int32()))]
                if decode:
                    raw = [bpe.decode(i).encode("utf-8", "replace") for i in ids]
                    out.append(pa.array([hashlib.sha256(d).hexdigest() for d in raw]))
                rows = part.slice(some.start, some.stop - some.start)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *out], [*part.schema.names, *added]
                )

    added = ["token_ids", "decoded_sha256"] if decode else ["token_ids"]
    kept = docs.drop(*added)
    typed = {"token_ids": F.array().cast("array<int>"), "decoded_sha256": F.lit("").cast("string")}
    schema = kept.withColumns({name: typed[name] for name in added}).schema
    return kept.mapInArrow(run, schema)
