"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a vocabulary file become a tokenizers model: bytes are written as the printable
characters of the byte-level alphabet, and the merges are those whose result is in the ranks.
Decoding reverses the alphabet. A token may begin or end within a character; offsets are
therefore worked out from bytes, and the text is decoded from the joined bytes, not token by token.
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, slices
from .pretokens import OTHER, PATTERN, PIECE, Memory

#: Texts are encoded in groups of at most this many characters, which bounds what the library holds.
GROUP = 200_000
#: Encoded pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 300_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """In order of rank, the two parts that the lower ranks leave of each token of several bytes."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def model_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers model of the ranks: each match of ``pattern`` separately, no special tokens."""
    letters = byte_alphabet()
    say = lambda t: "".join(letters[b] for b in t)
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {say(t): r for t, r in ranks.items()}, "merges": [[say(a), say(b)] for a, b in merges(ranks)]},
    })


class Codec:
    """Encodes and decodes on a worker; built from ``model_json``."""

    def __init__(self, model: str, pattern: str = PATTERN):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.memory = Memory(lambda x: [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(x, add_special_tokens=False)], REMEMBERED)
        self.plain = pattern == PATTERN  # its pre-tokens are known here
        back = {c: b for b, c in enumerate(byte_alphabet())}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in self.library.get_vocab().items()}

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        """Ids of each text. The library encodes whole texts, or, where a text's pre-tokens are plain to
        find, each different pre-token once."""
        whole = [i for i, d in enumerate(docs) if not self.plain or OTHER.search(d)]
        split = [PIECE.findall(d) for d in docs]
        for i in whole:
            split[i] = []
        known = self.memory.of(split).__getitem__
        out = [np.frombuffer(b"".join(map(known, s)), dtype="<u4") for s in split]
        for group in _groups([docs[i] for i in whole]):
            for e in self.library.encode_batch_fast(group, add_special_tokens=False):
                out[whole.pop(0)] = np.array(e.ids, dtype="<u4")
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def starts(self, ids: np.ndarray, raw: bytes) -> np.ndarray:
        """The character in which each token begins (a split character: for each of its tokens)."""
        sizes = np.fromiter((len(self.bytes_of[i]) for i in ids.tolist()), dtype=np.int64, count=len(ids))
        lead = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        return (np.cumsum(lead) - 1)[np.cumsum(sizes) - sizes] if len(ids) else sizes


def _groups(docs: list[str]):
    at = size = 0
    for i, d in enumerate(docs):
        if i > at and size + len(d) > GROUP:
            yield docs[at:i]
            at, size = i, 0
        size += len(d)
    if at < len(docs):
        yield docs[at:]


def _mapped(docs: DataFrame, path: str, pattern: str, doc_id: str, text: str, schema: str, row):
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        model = spark.sparkContext.broadcast(model_json(read_ranks(f.read()), pattern))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        codec = Codec(model.value, pattern)
        for b in slices(batches, "text"):
            docs = [t or "" for t in b.column(1).to_pylist()]
            out = [row(codec, ids, t) for ids, t in zip(codec.encode(docs), docs)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c)) for c in zip(*out))], ["doc_id", *(x.split()[0] for x in schema.split(", "))])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and starts (first character of each token) of every whole text.

    Null is the empty text, which has no tokens. Repeated rows are encoded each; other columns are
    not read; an empty table gives an empty result.
    """
    return _mapped(docs, path, pattern, doc_id, text, "ids array<int>, starts array<int>", lambda c, ids, t: (pa.scalar(ids.tolist(), pa.list_(pa.int32())), pa.scalar(c.starts(ids, t.encode()).tolist(), pa.list_(pa.int32()))))


def decode(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, data (bytes) and text (bytes that are no UTF-8 replaced) of every list of ids; null ids: empty.

    An id that the vocabulary lacks stops the job with a KeyError.
    """
    spark = tokens.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        table = spark.sparkContext.broadcast({r: t for t, r in read_ranks(f.read()).items()})
    rows = tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches):
        for b in batches:
            data = [b"".join(map(table.value.__getitem__, x or ())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in data], pa.string())], ["doc_id", "data", "text"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary, text string")


def _digest(codec: Codec, ids: np.ndarray, text: str) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again.

    The same encoder and byte table as ``encode`` and ``decode``, without writing the ids out.
    """
    return _mapped(docs, path, pattern, doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)
