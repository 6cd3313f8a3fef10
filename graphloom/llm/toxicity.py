"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of two of its prefixes, beside a channel that
carries the log-odds of its hash in labelled texts. Filters of several widths slide over the words;
their maxima over the text and over its four quarters feed a logistic layer. Thresholds are
calibrated by language, which hashed words tell, so that a score of 0.3 is the decision everywhere.
A score is made of the text alone: the lang of training rows names the languages whose words are
learned and whose thresholds are set, and no lang is looked at when a text is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, evenly, fold, lean, sampled, settle, ship, slices, text_of, texts

#: Labelled rows of a class at most; characters of one (a longer text is there by evenly spread parts).
ROWS, LONGEST = 2500, 20_000
WIDTHS, FILTERS, DIM, QUARTERS, PAD = (1, 2, 3), 8, 8, 4, 4
BUCKETS, PREFIXES = 1 << 16, (5, 7)
CUT = 0.3
#: Training rows from which a language has a threshold of its own; the sample bounds their number.
SPOKEN = 40


@dataclass
class Batch:
    """Padded word ids of several texts. ids: one column for the word and for each prefix."""

    ids: np.ndarray
    start: np.ndarray  # of each text; one more at the end

    @staticmethod
    def of(docs: list[bytes]) -> Batch:
        w = Words(docs)
        columns = [w.hashes(), *(w.hashes(n) ^ np.uint64(n) for n in PREFIXES)]
        n = np.diff(w.first)
        text = np.repeat(np.arange(len(docs)), n)
        ids = np.full((len(w.start) + PAD * len(docs), len(columns)), BUCKETS, dtype=np.int32)  # the last row of a table is the pad's
        ids[np.arange(len(w.start)) + PAD * text] = np.stack([(c >> np.uint64(40)).astype(np.int64) % BUCKETS for c in columns], axis=1)
        return Batch(ids, np.concatenate(([0], np.cumsum(n + PAD))))


class Network:
    def __init__(self, log_odds: np.ndarray, speech: np.ndarray, seed: int = 7):
        """log_odds: of each bucket, by column. speech: log-probability of each word bucket by language."""
        rng = np.random.default_rng(seed)
        self.odds, self.speech = log_odds.astype(np.float32), speech.astype(np.float32)
        self.table = rng.normal(0, 0.05, (1 + len(PREFIXES), BUCKETS + 1, DIM)).astype(np.float32)
        self.table[:, BUCKETS] = 0
        width = 1 + len(PREFIXES) + DIM
        self.filters = [rng.normal(0, 0.1, (w, width, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:  # the first filters of each width begin as sums of log-odds
            f[:, :3, :2] += 0.3 / len(f)
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.top = np.full(2 * len(WIDTHS) * FILTERS, 0.05, dtype=np.float32)
        self.offset = np.float32(-2)
        self.cuts: np.ndarray | None = None
        self.slope, self.shift = 1.0, 0.0

    def words(self, ids: np.ndarray, odds: np.ndarray | None = None) -> np.ndarray:
        """log-odds of each column, and the summed embeddings."""
        known = odds if odds is not None else np.stack([self.odds[c][ids[:, c]] for c in range(ids.shape[1])], axis=1)
        return np.concatenate((known, sum(self.table[c][ids[:, c]] for c in range(ids.shape[1]))), axis=1)

    def convolved(self, x: np.ndarray) -> np.ndarray:
        out = []
        for f in self.filters:
            y = x @ f[0]
            for k in range(1, len(f)):
                y[:-k] += x[k:] @ f[k]
            out.append(y)
        return np.concatenate(out, axis=1)

    def quarters(self, start: np.ndarray) -> np.ndarray:
        n = np.diff(start)
        return (start[:-1, None] + n[:, None] * np.arange(QUARTERS) // QUARTERS).ravel()

    def logits(self, batch: Batch) -> np.ndarray:
        best = np.maximum.reduceat(self.convolved(self.words(batch.ids)), self.quarters(batch.start), axis=0).reshape(-1, QUARTERS, len(self.bias))
        h = np.maximum(best + self.bias, 0)
        return np.concatenate((h.mean(axis=1), h.max(axis=1)), axis=1) @ self.top + self.offset

    def language(self, batch: Batch) -> np.ndarray:
        return np.add.reduceat(self.speech[batch.ids[:, 0]], batch.start[:-1], axis=0).argmax(axis=1)

    def train(self, docs: list[Batch], odds: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rounds: int, rate: float = 0.03) -> None:
        """Adagrad, one text at a time; only the words under a maximum get a gradient."""
        rng = np.random.default_rng(11)
        slack = {n: np.full_like(v, 1e-2) for n, v in (("table", self.table), ("bias", self.bias), ("top", self.top))}
        slack_f = [np.full_like(f, 1e-2) for f in self.filters]
        slack_o = np.float32(1e-2)
        owner = np.repeat(np.arange(len(WIDTHS)), FILTERS)
        for _ in range(rounds):
            for i in rng.permutation(len(docs)):
                b = docs[i]
                x = self.words(b.ids, odds[i])
                y = self.convolved(x)
                edges = [*self.quarters(b.start).tolist(), len(x)]
                at = np.stack([edges[q] + y[edges[q] : edges[q + 1]].argmax(axis=0) for q in range(QUARTERS)])
                v = np.take_along_axis(y, at, axis=0) + self.bias
                h = np.maximum(v, 0)
                which = h.argmax(axis=0)
                feature = np.concatenate((h.mean(axis=0), h.max(axis=0)))
                g = weight[i] * (1 / (1 + np.exp(-np.clip(feature @ self.top + self.offset, -30, 30))) - labels[i])
                gh = np.repeat((g * self.top[: len(which)] / QUARTERS)[None], QUARTERS, axis=0)
                gh[which, np.arange(len(which))] += g * self.top[len(which) :]
                gh *= v > 0
                for name, grad in (("top", g * feature), ("bias", gh.sum(axis=0))):
                    slack[name] += grad**2
                    getattr(self, name)[...] -= rate * grad / np.sqrt(slack[name])
                slack_o += g**2
                self.offset -= rate * g / np.sqrt(slack_o)
                rows, grads = [], []
                for w, f in enumerate(self.filters):
                    own = owner == w
                    p, gw = at[:, own], gh[:, own]
                    for k in range(len(f)):
                        pos = p + k
                        ok = pos < len(x)
                        pos, gk = np.where(ok, pos, 0), np.where(ok, gw, 0)
                        rows.append(pos.ravel())
                        grads.append((gk[:, :, None] * f[k].T[None, :, 3:]).reshape(-1, DIM))
                        gf = np.einsum("qfd,qf->df", x[pos], gk)
                        slack_f[w][k] += gf**2
                        f[k] -= rate * gf / np.sqrt(slack_f[w][k])
                pos, where = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(pos), DIM), dtype=np.float32)
                np.add.at(total, where, np.concatenate(grads))
                for c in range(b.ids.shape[1]):
                    ids = b.ids[pos, c]
                    real = ids < BUCKETS
                    slack["table"][c][ids[real]] += total[real] ** 2
                    self.table[c][ids[real]] -= rate * total[real] / np.sqrt(slack["table"][c][ids[real]])

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, language: np.ndarray) -> None:
        """A logistic fit of the label to the logit, then for each language the probability that makes
        F1 largest (languages of few labels: that of all)."""
        a, c = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * logits + c)))
            s = weight * p * (1 - p) + 1e-6
            ga, gc = (weight * (p - labels) * logits).sum() + 0.01 * (a - 1), (weight * (p - labels)).sum()
            haa, hac, hcc = (s * logits**2).sum() + 0.01, (s * logits).sum(), s.sum() + 1e-6
            det = haa * hcc - hac**2
            step = np.array([hcc * ga - hac * gc, haa * gc - hac * ga]) / max(det, 1e-9)
            a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -3, 3)
        self.slope, self.shift = float(max(a, 1e-3)), float(c)
        p = 1 / (1 + np.exp(-(self.slope * logits + self.shift)))
        whole = _best_cut(p, labels, weight)
        self.cuts = np.full(self.speech.shape[1], whole)
        for lang in range(len(self.cuts)):
            own = language == lang
            if labels[own].sum() >= 20 and (1 - labels[own]).sum() >= 20:
                self.cuts[lang] = _best_cut(p[own], labels[own], weight[own])

    def score(self, docs: list[bytes]) -> np.ndarray:
        batch = Batch.of(docs)
        p = 1 / (1 + np.exp(-np.clip(self.slope * self.logits(batch).astype(np.float64) + self.shift, -500, 500)))
        cut = self.cuts[self.language(batch)]
        return np.where(p < cut, p / cut * CUT, CUT + (p - cut) / (1 - cut) * (1 - CUT))


def _best_cut(p: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    p, y, w = p[order], labels[order], weight[order]
    hit, named = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (named + (w * y).sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal scores
    best = int(f1.argmax())
    below = p[best + 1] if best + 1 < len(p) else 0.0
    return float(np.clip((p[best] + below) / 2, 0.02, 0.98))


def _log_odds(batches: list[Batch], labels: np.ndarray, weight: np.ndarray, prior: float = 3.0):
    """Buckets' log-odds by presence, shrunk to the base rate, and each text's own with itself left out."""
    base = float(np.average(labels, weights=weight))
    columns = 1 + len(PREFIXES)
    toxic, every = np.zeros((columns, BUCKETS + 1)), np.zeros((columns, BUCKETS + 1))
    present = [[np.unique(b.ids[:, c]) for c in range(columns)] for b in batches]
    for found, y, w in zip(present, labels, weight):
        for c, ids in enumerate(found):
            every[c][ids] += w
            toxic[c][ids] += w * y

    def value(t, n):
        share = (t + prior * base) / (n + prior)
        return np.log(share / (1 - share)) - np.log(base / (1 - base))

    whole = value(toxic, every)
    whole[:, BUCKETS] = 0
    own = []
    for b, y, w in zip(batches, labels, weight):
        t = np.stack([value(toxic[c][b.ids[:, c]] - w * y, every[c][b.ids[:, c]] - w) for c in range(columns)], axis=1)
        t[b.ids == BUCKETS] = 0
        own.append(t.astype(np.float32))
    return whole, own


def _speech(batches: list[Batch], langs: list[str | None]) -> np.ndarray:
    """log-probability of word buckets by language; one column at least."""
    names = sorted(x for x in {x for x in langs if x is not None} if langs.count(x) >= SPOKEN)
    count = np.full((BUCKETS + 1, max(1, len(names))), 0.1)
    for b, lang in zip(batches, langs):
        if lang in names:
            np.add.at(count[:, names.index(lang)], b.ids[:, 0], 1.0)
    out = np.log(count / count.sum(axis=0))
    out[BUCKETS] = 0
    return out


def fit(docs: list[bytes], labels: np.ndarray, weight: np.ndarray, langs: list[str | None], rounds: int = 3) -> Network | None:
    """Three quarters train the network, a quarter calibrates it. None without both labels."""
    labels, weight = np.asarray(labels, dtype=np.float64), np.asarray(weight, dtype=np.float64)
    if not 0 < labels.sum() < len(labels):
        return None
    batches = [Batch.of([d]) for d in docs]
    order = np.argsort(labels, kind="stable")
    held = np.zeros(len(docs), dtype=bool)
    held[order[::4]] = True
    if not 0 < labels[~held].sum() < (~held).sum() or not labels[held].any():
        held[:] = False
    learn = np.flatnonzero(~held)
    tune = np.flatnonzero(held) if held.any() else learn
    odds, own = _log_odds([batches[i] for i in learn], labels[learn], weight[learn])
    net = Network(odds, _speech([batches[i] for i in learn], [langs[i] for i in learn]))
    balance = np.where(labels[learn] > 0, 0.5 / labels[learn].mean(), 0.5 / (1 - labels[learn].mean())) ** 0.5
    net.train([batches[i] for i in learn], own, labels[learn], balance, rounds)
    logits = np.concatenate([net.logits(batches[i]) for i in tune]).astype(np.float64)
    language = np.concatenate([net.language(batches[i]) for i in tune])
    net.calibrate(logits, labels[tune], weight[tune], language)
    return net


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Network | None:
    """Train on at most ``rows`` labelled documents of each class, of crc32 folds other than 2.

    Null labels and null texts do not count, a repeated id counts once; None unless both classes occur. Each sampled row is
    weighted so that the classes keep their shares.
    """
    ship(docs.sparkSession)
    marked = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter((fold() != 2) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    sizes = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    chosen = None
    for toxic, n in sorted(sizes.items()):
        part = sampled(marked.filter(F.col("toxic") == toxic), rows, n, "doc_id")
        chosen = part if chosen is None else chosen.unionByName(part)
    spark = docs.sparkSession
    local = spark.createDataFrame(chosen.toArrow())  # 2 * rows ids and labels at most
    usable = docs.select("doc_id", "lang", "text").filter(F.col("text").isNotNull())
    # of an id that several texts bear, the first by hash; so there are no more rows than ids
    one = usable.join(F.broadcast(local), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by(F.struct("lang", evenly("text", LONGEST).alias("text")), F.struct(F.xxhash64("text"), "text")).alias("x"))
    got = one.select("doc_id", "toxic", "x.*").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    if not got:
        return None
    found = {t: sum(r["toxic"] == t for r in got) for t in (0, 1)}
    weight = np.array([sizes[r["toxic"]] / found[r["toxic"]] for r in got])
    net = fit([r["text"].encode() for r in got], np.array([r["toxic"] for r in got]), weight / weight.mean(), [r["lang"] for r in got])
    del got
    settle(spark)
    return net


def score(docs: DataFrame, model: Network | None, keep: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id (with ``keep`` the whole ``row``), score and predicted of every whole text.

    Null is the empty text, which gets a score as any other. Without a model every score is 0.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row")) if keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    text = text if keep else "text"

    def run(batches):
        net = sent.value
        for b in slices(batches, text, 500_000):
            s = net.score(texts(text_of(b, text))) if net else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], [b.schema.names[0], "score", "predicted"])

    first = rows.schema[0]
    return rows.mapInArrow(lean(run), f"{first.name} {first.dataType.simpleString()}, score double, predicted int")


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null and empty texts are scored as the empty text; without labels of both kinds every score is 0.
    Repeated rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", (fold() == 2).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, that the classifier does not call toxic."""
    return score(docs, learn(docs, labels), keep=True).filter(F.col("predicted") == 0).select("row.*")
