"""URL filter: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models (Witten-Bell) learn the URLs that rules accept and
reject, all of them: the counts of their strings are added up over the whole table. A URL without a
rule is blocked if its length-normalised log-likelihood difference (reject minus accept, a character)
exceeds a threshold calibrated on a part of the labelled URLs that the models did not see.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, lean, sampled, ship, slices, table
from .contexts import ContextModel, Scorer, counted, training

#: rule (host and path as one string) -> verdict. Fixed values of the task.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
ORDER = 5
_END = re.compile(r"[/?#]")
_STOP = re.compile(r"[?#]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host_end = m.start() if (m := _END.search(rest)) else len(rest)
    tail = rest[host_end:]
    return rest[:host_end].translate(_LOWER), tail[: m.start() if (m := _STOP.search(tail)) else len(tail)]


class Rules:
    """Longest rule whose host is the URL's or a parent of it, and whose path begins the URL's."""

    def __init__(self, rules: dict[str, str]):
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for rule, verdict in rules.items():
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((-len(rule), rule, "/" + path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = None
        name = host
        while name:
            for rule in self.by_host.get(name, ()):
                if path.startswith(rule[2]) and (best is None or rule[:2] < best[:2]):
                    best = rule
            name = name.partition(".")[2]
        return (best[1], best[3]) if best else (None, None)


def _plain(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).copy()


def fit(urls: list[str | None], rules: Rules, order: int = ORDER) -> tuple[Scorer, float] | None:
    """Models and threshold; None unless rules both accept and reject some of ``urls``."""
    sides: dict[str, list[bytes]] = {"allow": [], "block": []}
    for host, path in map(parts, urls):
        if verdict := rules.find(host, path)[1]:
            sides[verdict].append((host + path).encode("utf-8", "surrogatepass"))
    if not all(sides.values()):
        return None
    held = {k: v[::4] for k, v in sides.items()}
    learn = {k: [x for i, x in enumerate(v) if i % 4] or v for k, v in sides.items()}
    scorer = Scorer([ContextModel(training(learn[k], order, _plain), order, "interpolated") for k in ("allow", "block")])
    good, bad = (ratio(scorer, held[k]) for k in ("allow", "block"))
    cuts = np.unique(np.concatenate((good, bad)))
    cuts = np.concatenate(((cuts[:-1] + cuts[1:]) / 2, cuts[-1:]))
    right = np.searchsorted(np.sort(good), cuts, side="right") / len(good) + 1 - np.searchsorted(np.sort(bad), cuts, side="right") / len(bad)
    return scorer, float(cuts[np.argmax(right)])


def ratio(scorer: Scorer, keys: list[bytes]) -> np.ndarray:
    """Log-likelihood of reject minus accept, a byte; 0 for an empty URL."""
    s = scorer.score(keys, _plain)
    return (s[:, 1] - s[:, 0]) / np.maximum(1, np.fromiter((len(k) for k in keys), dtype=np.int64, count=len(keys)))


def threshold(scored: DataFrame) -> float:
    """Of the (verdict, score) rows, the cut that tells most of both verdicts apart, as ``fit`` chooses it; exact.

    Sums up to a score are those of lower bins (few, on the driver) and those within its bin.
    """
    sums = scored.groupBy("score").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    sums = table(sums.withColumn("bin", F.floor(F.col("score") * 1024)))
    bins = sorted((r.bin, r.good, r.bad) for r in sums.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect())
    good, bad = (sum(b[k] for b in bins) for k in (1, 2))
    before = [(b[0], sum(x[1] * bad - x[2] * good for x in bins[:i])) for i, b in enumerate(bins)]
    up = Window.partitionBy("bin").orderBy("score")
    right = F.sum(F.col("good") * bad - F.col("bad") * good).over(up) + F.col("before")
    best = sums.join(sums.sparkSession.createDataFrame(before, "bin long, before long"), "bin").select("score", right.alias("right")).orderBy(F.desc("right"), "score").first().score
    above = sums.filter(F.col("score") > best).agg(F.min("score")).first()[0]
    drop(sums)
    return best if above is None else (best + above) / 2


def learned(ruled: DataFrame, order: int) -> tuple[Scorer, float] | None:
    """Models and threshold of all (url, verdict) rows; None unless there are both verdicts.

    A hash of the URL holds a fourth of them out for the threshold; a verdict that has none there, or none elsewhere, gives all of its rows.
    """
    held = F.pmod(F.xxhash64("url"), F.lit(4)) == 0
    found = {r.verdict: (r.held, r.n) for r in ruled.groupBy("verdict").agg(F.count_if(held).alias("held"), F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return None
    kinds = ("allow", "block")

    def of(side: Column, none: list[str]) -> DataFrame:
        return ruled.filter(side | F.col("verdict").isin(none)).select("url", "verdict")

    def keys(b) -> list[bytes]:
        return ["".join(parts(u)).encode("utf-8", "surrogatepass") for u in b.column(0).to_pylist()]

    def grams(batches):
        for b in slices(batches, "url"):
            k, verdict = keys(b), b.column(1).to_pylist()
            for kind in kinds:
                if own := [x for x, v in zip(k, verdict) if v == kind]:
                    gram, n = counted(own, order, _plain)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(n)), pa.array(gram.view(np.int64)), pa.array(n)], ["verdict", "gram", "n"])

    learn = of(~held, [v for v, (h, n) in found.items() if h == n])
    sums = learn.mapInArrow(lean(grams), "verdict string, gram long, n long").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))
    models = []
    sums = table(sums)
    for kind in kinds:
        got = sums.filter(F.col("verdict") == kind).select("gram", "n").toArrow()
        gram, n = (np.asarray(got[c].combine_chunks(), dtype=np.int64) for c in ("gram", "n"))
        models.append(ContextModel(None, order, "interpolated", (gram.view(np.uint64), n)))
    drop(sums)
    scorer = Scorer(models)
    sent = ruled.sparkSession.sparkContext.broadcast(scorer)

    def scores(batches):
        for b in slices(batches, "url"):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(ratio(sent.value, keys(b)))], ["verdict", "score"])

    return scorer, threshold(of(held, [v for v, (h, _) in found.items() if not h]).mapInArrow(lean(scores), "verdict string, score double"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: dict[str, str] | None = None, order: int = ORDER, sample: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``.

    The models learn from all rows that rules decide; only if ``sample`` is given, from at most so many, half for each verdict, chosen by a hash. Null URLs and URLs without
    ``://`` have empty host and path, no rule, score 0 and pass, as does every ruleless URL while
    rules give examples of one verdict only. Repeated rows are judged alike; an empty table gives
    an empty result; other columns of ``pages`` are not read.
    """
    ship(pages.sparkSession)
    book = Rules(RULES if rules is None else rules)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def decided(batches):
        for b in slices(batches, "url"):
            found = pa.array([book.find(*parts(u))[1] for u in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], ["page_id", "url", "verdict"]).filter(found.is_valid())

    ruled = rows.mapInArrow(lean(decided), f"page_id {kind}, url string, verdict string")
    if sample is not None:
        verdicts = [ruled.filter(F.col("verdict") == v) for v in ("allow", "block")]
        few = [sampled(x, sample // 2, x.count(), "page_id", "url") for x in verdicts]
        ruled = few[0].unionByName(few[1])
    model = pages.sparkSession.sparkContext.broadcast(learned(ruled, order))

    def run(batches):
        scorer, cut = model.value or (None, 0.0)
        for b in slices(batches, "url"):
            split = [parts(u) for u in b.column(1).to_pylist()]
            ruled = [book.find(*x) for x in split]
            score = ratio(scorer, [(h + p).encode("utf-8", "surrogatepass") for h, p in split]) if scorer else np.zeros(len(split))
            verdict = [v or ("block" if s > cut and (h or p) and scorer else "allow") for (_, v), s, (h, p) in zip(ruled, score, split)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in split]), pa.array([x[1] for x in split]), pa.array([r for r, _ in ruled], pa.string()), pa.array(verdict), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(lean(run), f"page_id {kind}, host string, path string, rule string, verdict string, score double")
