"""Language identification by prediction by partial matching.

Each language has a byte context tree (orders 0 to 3, escape method C with exclusions) whose
statistics are frozen after training. A text's exact code length under every tree decides: the
shortest wins, and the score is its share of probability among the languages. Texts are read with
case, digits and ASCII signs folded (``contexts.folded``); code lengths are those of the folded bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, evenly, fold, lean, ship, slices, text_of, texts
from .contexts import ContextModel, Scorer, training

ORDER = 3
UNKNOWN = "und"
#: Training: rows of a language at most; characters of one (a longer text is there by evenly spread parts).
ROWS, LONGEST = 400, 20_000
#: Bytes that all languages share evenly, and what each may have in any case; they bound the trees.
BYTES, LEAST = 16_000_000, 40_000
#: Languages whose rows one scan gathers; languages of one table of statistics.
SCAN, GROUP = 64, 16
#: Texts of fewer bytes are not judged by their code length.
SHORT = 64
_LETTER = re.compile(r"[^\W\d_]")


class Trees:
    """The trees of any number of languages, in groups, so that a table has few columns."""

    def __init__(self, data: list[list[bytes]]):
        models = [ContextModel(training(x, ORDER), ORDER, "ppm") for x in data]
        self.groups = [Scorer(models[at : at + GROUP]) for at in range(0, len(models), GROUP)]

    def score(self, docs: list[bytes]) -> np.ndarray:
        """One row a text, one column a language; a few texts at a time, so that values stay few."""
        most = 4 * SLICE_BYTES // max(len(s.models) for s in self.groups)
        part = np.cumsum([len(d) for d in docs]) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(docs)]
        rows = [np.concatenate([s.score(docs[a:b]) for s in self.groups], axis=1) for a, b in zip(cuts, cuts[1:])]
        return np.concatenate(rows)


def learn(docs: DataFrame, rows: int = ROWS) -> tuple[list[str], Trees, float] | None:
    """Every language with training rows, their trees, and a bound on the code length (bits a byte) of texts in them.

    The bound is halfway from the longest of any training text to the 8 bits of noise.

    Only rows with a language and a crc32 fold other than 2 count; None if there are none.
    """
    ship(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 2))
    h = F.xxhash64("text")
    sizes = sorted(usable.groupBy("lang").agg(F.approx_count_distinct(h, 0.01)).collect())
    own: dict[str, list[bytes]] = {}
    for at in range(0, len(sizes), SCAN):
        some = sizes[at : at + SCAN]
        # one scan: the hash of a text is below its language's share; a tenth of the rows is left for chance.
        # Copies of a text count once, so few more than ``rows`` of a language pass.
        share = F.create_map(*(F.lit(x) for lang, n in some for x in (lang, int(min(1.0, 0.9 * rows / max(1, n)) * (1 << 40)) + 1)))
        chance = F.pmod(h, F.lit(1 << 40))
        part = usable.filter(chance < share[F.col("lang")]).select("lang", evenly("text", LONGEST).alias("text"), chance.alias("h"))
        for r in sorted(part.groupBy("lang", "h").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], r["h"])):
            found = own.setdefault(r["lang"], [])
            if len(found) < rows and sum(map(len, found)) < max(LEAST, BYTES // len(sizes)) and _LETTER.search(r["text"]):
                found.append(r["text"].encode())
    own = {lang: found for lang, found in own.items() if found}
    if not own:
        return None
    names = sorted(own)
    scorer = Trees([own[x] for x in names])
    every = [d for x in names for d in own[x] if len(d) >= SHORT] or [b"x" * SHORT]
    bits = -scorer.score(every).max(axis=1) / np.log(2) / np.array([len(d) for d in every])
    return names, scorer, float((bits.max() + 8) / 2)


def identify(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """doc_id (with ``keep`` the whole ``row``), lang_pred, score and bits (a byte) of every whole text.

    Null texts and texts without a letter are ``und`` with score 0 and null bits, as is every text
    if ``model`` (from ``learn``) is None. Ties go to the first language by name. Repeated rows are
    judged alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row")) if keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    text = text if keep else "text"

    def run(batches):
        names, scorer, _ = sent.value or ([UNKNOWN], None, 0)
        for b in slices(batches, text):
            raw = texts(text_of(b, text))
            spoken = np.array([bool(_LETTER.search(t.decode())) for t in raw]) & (scorer is not None)
            logs = scorer.score(raw) if scorer else np.zeros((len(raw), 1))
            best = logs.argmax(axis=1)
            top = logs[np.arange(len(raw)), best]
            share = 1 / np.exp(logs - top[:, None]).sum(axis=1)
            bits = -top / np.log(2) / np.maximum(1, [len(t) for t in raw])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[i] if s else UNKNOWN for i, s in zip(best, spoken)]), pa.array(np.where(spoken, share, 0.0)), pa.array(bits, mask=~spoken)], [b.schema.names[0], "lang_pred", "score", "bits"])

    first = rows.schema[0]
    return rows.mapInArrow(lean(run), f"{first.name} {first.dataType.simpleString()}, lang_pred string, score double, bits double")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for documents, learned from their training folds.

    Null texts and those without a letter are ``und`` with score 0; without training rows all are.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    found = identify(docs, learn(docs))
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", "bits")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose text is in a known language.

    Rejected are texts that are ``und``, and longer ones whose code length a byte is nearer to noise
    than to any training text: no language's statistics describe them. Without training rows all stay.
    """
    model = learn(docs)
    if model is None:
        return docs
    judged = identify(docs, model, keep=True)
    known = (F.col("bits") <= model[2]) | (F.octet_length("row.text") < SHORT)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & known).select("row.*")
