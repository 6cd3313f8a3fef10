"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary that is one pre-token by itself is encoded; those that come
out as a single token are whole. In a text, pre-tokens that are whole count one each; only the
others are merged, by the library, and remembered in a bounded table.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import lean, ship, slices
from .pretokens import OTHER, PIECE, Memory

#: Merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 200_000


def whole_tokens(library) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and, by trial, one token."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    found = []
    for token in library.get_vocab(with_added_tokens=False):
        try:
            found.append(bytes(back[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):  # part of a character: no pre-token
            continue
    found = [t for t in found if len(library.pre_tokenizer.pre_tokenize_str(t)) == 1]
    return frozenset(t for t, e in zip(found, library.encode_batch_fast(found, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    """Counts on a worker. special: the strings that the library finds in a text before all else."""

    def __init__(self, model: str, whole: frozenset[str]):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memory = Memory(lambda x: [len(e.ids) for e in self.library.encode_batch_fast(x, add_special_tokens=False)], REMEMBERED, dict.fromkeys(whole, 1))

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings; where Python can't tell them, the library does."""
        if not OTHER.search(text):
            return PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, docs: list[str]) -> list[int]:
        parts = [self.special.split(d) if self.special else [d] for d in docs]
        split = [self.pieces(p[0]) if len(p) == 1 else list(chain.from_iterable(map(self.pieces, p))) for p in parts]
        known = self.memory.of(split).__getitem__
        return [len(p) - 1 + sum(map(known, s)) for p, s in zip(parts, split)]


def count(docs: DataFrame, path: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text, as the library counts it.

    ``path`` names a byte-level tokenizers file with the usual pre-tokens. Null is the empty text:
    0 bytes, 0 tokens. Special strings in a text count one token, the library's default. Repeated
    rows are counted each; other columns are not read; an empty table gives an empty result.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    with open(path, encoding="utf-8") as f:
        model = f.read()
    library = Tokenizer.from_str(model)
    assert library.normalizer is None and "ByteLevel" in str(library.pre_tokenizer), "not a byte-level file"
    sent = spark.sparkContext.broadcast((model, whole_tokens(library)))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        counter = Counter(*sent.value)
        for b in slices(batches, "text"):
            docs = [t or "" for t in b.column(1).to_pylist()]
            tokens = counter.count(docs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(d.encode()) for d in docs], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
