"""URL filter, byte-level BPE, language ID, toxicity, token counts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import WORDS, awkward, frame, prose

from graphloom.llm import bpe, contexts, langid, token_counts, toxicity, url_filter

P = pytest.importorskip("public_tokenizers")
RANKS, JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 4 == 2


# --- context models


def brute_ppm(data, order, text):
    """Escape method C with exclusions, symbol by symbol."""
    counts = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        for i in range(k, len(data)):
            counts[k].setdefault(data[i - k : i], {}).setdefault(data[i], 0)
            counts[k][data[i - k : i]][data[i]] += 1
    total = 0.0
    padded = b" " * (order + 1) + text
    for i in range(order + 1, len(padded)):
        out, p = set(), 0.0
        for k in range(order, -1, -1):
            seen = counts[k].get(padded[i - k : i], {})
            left = {s: n for s, n in seen.items() if s not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if padded[i] in left:
                p += math.log(left[padded[i]] / whole)
                break
            p += math.log(len(left) / whole)
            out |= set(left)
        else:
            p += -math.log(256 - len(out))
        total += p
    return total


def brute_mixed(data, order, text):
    total = 0.0
    padded = b" " * (order + 1) + text
    for i in range(order + 1, len(padded)):
        p = 1 / 256
        for k in range(order + 1):
            ctx = padded[i - k : i]
            after = [data[j] for j in range(k, len(data)) if data[j - k : j] == ctx]
            if after:
                p = (after.count(padded[i]) + len(set(after)) * p) / (len(after) + len(set(after)))
        total += math.log(p)
    return total


@pytest.mark.parametrize("kind,brute", [("ppm", brute_ppm), ("interpolated", brute_mixed)])
def test_context_models_equal_their_definition(kind, brute):
    plain = lambda d: np.frombuffer(d, dtype=np.uint8).copy()
    train = [[b"abracadabra", b"bar"], [b"hello world", b"abba"]]
    models = [contexts.ContextModel(contexts.training(t, 2, plain), 2, kind) for t in train]
    scorer = contexts.Scorer(models)
    texts = [b"abra", b"", b"hello", b"zq\xff", b"a"]
    got = scorer.score(texts, plain)
    for m, t in enumerate(train):
        data = contexts.training(t, 2, plain).tobytes()
        assert got[:, m] == pytest.approx([brute(data, 2, x) for x in texts], rel=1e-4, abs=1e-4)


# --- URL filter


@pytest.mark.parametrize("url,host,path", [
    (None, "", ""), ("no scheme", "", ""), ("HTTP://A.Example.COM/X?y#z", "a.example.com", "/X"), ("x://h?q", "h", ""), ("x://h#f", "h", ""),
    ("x://", "", ""), ("a://b://c/d", "b:", "//c/d"), ("x://É.com/É", "É.com", "/É"),
])
def test_url_parts(url, host, path):
    assert url_filter.parts(url) == (host, path)


@pytest.mark.parametrize("host,path,rule", [
    ("a.example.com", "/en/7", "example.com/en/7"), ("a.example.com", "/en/8", "com/en/"), ("com", "/en/", "com/en/"), ("xcom", "/en/", None), ("a.com", "/de/", None),
    ("example.net", "/de/81", "example.net/de/8"), ("notexample.net", "/de/81", "net/de/"), ("x.org", "/es/", "org/es/"), ("x.org", "/es", None), ("", "", None),
])
def test_url_rules(host, path, rule):
    assert url_filter.Rules(url_filter.RULES).find(host, path)[0] == rule


@pytest.mark.parametrize("url,rule,verdict", [
    ("x://a.com/en/1", "com/en/", "block"), ("x://b.example.com/en/71", "example.com/en/7", "allow"), ("x://a.net/de/1", "net/de/", "allow"),
    ("x://example.net/de/8", "example.net/de/8", "block"), ("x://example.net/de/7", "net/de/", "allow"), ("x://a.b.org/es/", "org/es/", "block"),
])
def test_url_rules_have_the_words_of_the_contract(url, rule, verdict):
    assert url_filter.Rules(url_filter.RULES).find(*url_filter.parts(url)) == (rule, verdict)


def test_url_verdicts(spark):
    rng = random.Random(1)
    good = [(i, f"https://{rng.choice(['library', 'garden', 'museum'])}{i}.ok/{rng.choice(['book', 'tree'])}/{i}", "h") for i in range(300)]
    bad = [(1000 + i, f"http://{rng.choice(['casino', 'pills', 'bets'])}{i}.no/{rng.choice(['win', 'cheap'])}/{i}", "h") for i in range(300)]
    new = [(5000, "https://library-museum.zz/book/tree", "h"), (5001, "http://casino-pills.zz/win/cheap", "h"), (None, None, None), (5002, "", "h"), (5002, "", "h")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in good + bad + new], "page_id long, url string, html string, host string, score int")
    rows = url_filter.judge(pages, rules={"ok/": "allow", "no/": "block"}).collect()
    assert len(rows) == len(good + bad + new)
    by = {r.page_id: r for r in rows}
    assert all(by[i].verdict == "allow" and by[i].rule == "ok/" for i, *_ in good) and all(by[i].verdict == "block" and by[i].rule == "no/" for i, *_ in bad)
    assert (by[5000].verdict, by[5001].verdict) == ("allow", "block") and by[5000].rule is None
    assert (by[None].verdict, by[None].host, by[5002].path, by[5002].verdict) == ("allow", "", "", "allow")
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules={"ok/": "allow"}).collect()} == {"allow"}  # one side only


def test_thresholds_and_verdicts_are_those_of_all_cuts_tried():
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['library', 'garden', 'casino'])}{i}.ok/{rng.choice(['book', 'win'])}" for i in range(60)] + [f"http://{rng.choice(['casino', 'pills', 'library'])}{i}.no/{rng.choice(['win', 'book'])}" for i in range(60)]
    book = url_filter.Rules({"ok/": "allow", "no/": "block"})
    scorer, cut = url_filter.fit(urls, book, 2)
    keys = ["".join(url_filter.parts(u)).encode() for u in urls]
    plain = lambda d: np.frombuffer(d, dtype=np.uint8).copy()
    good, bad = (url_filter.ratio(scorer, side[::4]) for side in (keys[:60], keys[60:]))
    right = lambda c: (good <= c).mean() + (bad > c).mean()
    every = sorted({*good.tolist(), *bad.tolist()})
    assert right(cut) == pytest.approx(max(right(c) for c in [*every, *((a + b) / 2 for a, b in zip(every, every[1:]))]))
    sides = [contexts.training([k for i, k in enumerate(x) if i % 4], 2, plain).tobytes() for x in (keys[:60], keys[60:])]
    for k in keys[:3]:
        want = (brute_mixed(sides[1], 2, k) - brute_mixed(sides[0], 2, k)) / len(k)
        assert url_filter.ratio(scorer, [k])[0] == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_every_ruled_url_trains_the_models(spark):
    """Scores are those of the counts of all ruled URLs that no hash holds out, however many they are."""
    rules = {"ok/": "allow", "no/": "block"}
    rows = [(i, f"x://{i % 997}.{'ok' if i % 2 else 'no'}/{i * i % 1009}") for i in range(24_000)] + [(-1, "x://zebra.zz/quux"), (-2, "x://12.34/567")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    held = {i for i, in pages.filter("pmod(xxhash64(url), 4) = 0").select("page_id").collect()}
    models = []
    for end in (".ok/", ".no/"):
        texts = [b" " * 4 + u[4:].encode() + b" " * 4 for i, u in rows if end in u and i not in held]
        times = Counter(int.from_bytes(t[k : k + 4], "big") for t in texts for k in range(1, len(t) - 3))
        grams = np.array(sorted(times), dtype=np.uint64)
        models.append(contexts.ContextModel(None, 3, "interpolated", (grams, np.array([times[g] for g in grams.tolist()]))))
    want = url_filter.ratio(contexts.Scorer(models), [b"zebra.zz/quux", b"12.34/567"])
    got = {r.page_id: r.score for r in url_filter.judge(pages, rules=rules, order=3).filter("page_id < 0").collect()}
    assert [got[-1], got[-2]] == pytest.approx(want.tolist(), abs=1e-6)


def test_the_threshold_of_many_bins_is_that_of_all_cuts(spark):
    rng = random.Random(8)
    rows = [("allow", rng.choice([rng.gauss(-1, 1), 0.25])) for _ in range(400)] + [("block", rng.gauss(1, 1)) for _ in range(300)]
    cut = url_filter.threshold(spark.createDataFrame(rows, "verdict string, score double"))
    good, bad = ([s for v, s in rows if v == kind] for kind in ("allow", "block"))
    right = lambda c: sum(s <= c for s in good) * len(bad) + sum(s > c for s in bad) * len(good)
    assert right(cut) == max(right(c) for _, c in rows) and cut not in {s for _, s in rows}


def test_rare_ruled_urls_train_the_models(spark):
    rows = [(i, f"http://plain{i}.info/page") for i in range(3000)]
    rows += [(4000 + i, f"http://example.com/en/7{i}") for i in range(3)] + [(5000 + i, f"http://b.org/es/{i}") for i in range(3)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), sample=20).collect()
    assert len(got) == len(rows) and any(r.score for r in got)


# --- byte-level BPE and token counts


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(P.path(RANKS), "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def test_bpe_equals_the_other_library_and_comes_back(spark, tiktoken_encoding):
    rows = awkward()
    df = frame(spark, rows)
    got = bpe.round_trip(df, P.path(RANKS), P.PATTERN).collect()
    expected = []
    for i, t, *_ in rows:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    encoded = bpe.encode(df, P.path(RANKS), P.PATTERN)
    texts = sorted((r.doc_id or -1, r.text) for r in bpe.decode(encoded, P.path(RANKS)).collect())
    assert texts == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert bpe.round_trip(df.limit(0), P.path(RANKS), P.PATTERN).count() == 0


def test_bpe_offsets_and_split_characters(spark):
    text = "aé\U0001f600 日本"
    r = bpe.encode(frame(spark, [(1, text)]), P.path(RANKS), P.PATTERN).collect()[0]
    codec = bpe.Codec(bpe.model_json(bpe.read_ranks(open(P.path(RANKS), "rb").read()), P.PATTERN))
    at = 0
    for i, start in zip(r.ids, r.starts):
        piece = codec.bytes_of[i]
        assert len(text.encode()[: at + 1].decode(errors="ignore").encode()) <= at + 1
        assert start == len(text.encode()[:at].decode(errors="ignore")) if text.encode()[at] & 0xC0 != 0x80 else start == len(text.encode()[:at].decode(errors="ignore"))
        at += len(piece)
    assert at == len(text.encode()) and len(r.ids) > len(set(r.starts))  # some character is split


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(JSON))
    rng = random.Random(4)
    rows = awkward() + [(2000 + i, "".join(rng.choice(["a", "B", " ", "  ", "\n", "7", "²", "é", "_", "'s", "'", "$", "%%", "Ω", "ж", "\u2019", "\u00a0", "<|endoftext|>", "ª", "þ", "\t"]) for _ in range(60))) for i in range(200)]
    got = token_counts.count(frame(spark, rows), P.path(JSON), limit=50).collect()
    expected = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_the_shortcut_counts_other_scripts_too():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(JSON))
    whole = token_counts.whole_tokens(library)
    counter = token_counts.Counter(open(P.path(JSON), encoding="utf-8").read(), whole)
    rng = random.Random(8)
    docs = ["".join(rng.choice(["日本", "語", "🙂", "€", " the", "the", "  ", "\n", "é", "ا", "क", "<|endoftext|>", "'s", " 12", "\u200d", "\u3000", "Ａ", "x\x00"]) for _ in range(50)) for _ in range(150)]
    assert counter.count(docs) == [len(library.encode(d, add_special_tokens=False).ids) for d in docs]
    assert any(token_counts.OTHER.search(t) for t in whole)


def test_long_pre_tokens_are_not_remembered():
    from graphloom.llm.pretokens import Memory

    memory = Memory(lambda x: [len(t) for t in x], 10)
    assert memory.of([["a", "b" * 100]])["b" * 100] == 100
    assert memory.of([["a", "c" * 70]])["c" * 70] == 70 and set(memory.known) == {"a", "c" * 70}
    memory.of([["d"]])
    assert set(memory.known) == {"a", "d"}


def test_fast_pieces_are_the_librarys_pieces():
    import tiktoken

    from graphloom.llm.pretokens import OTHER as _OTHER, PATTERN, PIECE as _PIECE

    one = {bytes([b]): b for b in range(256)}
    kinds = {k: tiktoken.Encoding("k", pat_str=k, mergeable_ranks=one, special_tokens={}) for k in (r"\p{L}", r"\p{N}", r"\s")}
    import re

    plain = {r"\p{L}": re.compile(r"[^\W_0-9²³¹¼-¾]"), r"\p{N}": re.compile("[0-9²³¹¼-¾]"), r"\s": re.compile(r"\s")}
    for cp in range(0x3000):
        c = chr(cp)
        if not _OTHER.search(c):
            for k, e in kinds.items():
                assert bool(e.encode_ordinary(c)) == bool(plain[k].fullmatch(c)), hex(cp)
    assert PATTERN == P.PATTERN
    assert _PIECE.findall("don't  x\n\n y") == ["don", "'t", " ", " x", "\n\n", " y"]


# --- language ID


def test_language_id(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60), lang), lang) for i, lang in ((i, rng.choice(list(WORDS))) for i in range(400))]
    rows += [(5000, None, "en"), (5001, "", "de"), (5002, "123 ?!", "fr"), (None, rows[0][1], None), rows[1]]
    df = frame(spark, rows)
    got = langid.predict(df).collect()
    assert len(got) == len(rows)
    true = {i: lang for i, _, lang in rows}
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert all(r.held_out == held(r.doc_id) for r in got)
    assert sum(r.lang_pred == true[r.doc_id] for r in tested) >= 0.95 * len(tested) and len(tested) > 50
    assert all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (5000, 5001, 5002)} == {("und", 0.0)}
    kept = langid.accepted(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids).isdisjoint({5000, 5001, 5002}) and len(ids) == len(rows) - 3


def test_predictions_are_the_shortest_codes_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(2, 9), lang), lang) for i, lang in ((i, list(WORDS)[i % 3]) for i in range(60))]
    got = {r.doc_id: r for r in langid.predict(frame(spark, rows)).collect()}
    trained = {}
    for lang in WORDS:
        own = sorted({t for i, t, x in rows if x == lang and not held(i)})
        names, trees, _ = langid.learn(frame(spark, [r for r in rows if r[2] == lang]))
        assert names == [lang]
        trained[lang] = own
    order = {}
    for lang, own in trained.items():  # texts stand in the order of their hashes, which only the spaces between them see
        order[lang] = contexts.training([t.encode() for t in own], langid.ORDER).tobytes()
    for i, t, _ in rows[:20]:
        text = contexts.folded(t.encode()).tobytes()
        logs = {lang: brute_ppm(data, langid.ORDER, text) for lang, data in order.items()}
        best = max(logs.values())
        assert logs[got[i].lang_pred] == pytest.approx(best, abs=0.2)
        assert got[i].score == pytest.approx(1 / sum(math.exp(x - best) for x in logs.values()), abs=0.05)
        assert got[i].bits == pytest.approx(-best / math.log(2) / len(t.encode()), abs=0.05)


def test_language_id_without_training(spark):
    df = frame(spark, [(1, "some text", None), (2, None, "en")])
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert langid.accepted(df).count() == 2
    assert langid.predict(df.limit(0)).count() == 0


def test_language_statistics_come_from_the_training_folds_alone(spark):
    rows = [(i, "alpha beta gamma" if not held(i) else "zzz qqq", "en" if not held(i) else "xx") for i in range(40)]
    assert {r.lang_pred for r in langid.predict(frame(spark, rows)).collect()} == {"en"}


def test_awkward_texts_get_a_language_row_each(spark):
    assert langid.predict(frame(spark, awkward())).count() == len(awkward())


def test_every_language_is_learned(spark):
    rng = random.Random(12)
    rows = []
    for k in range(80):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)]
        rows += [(100 * k + i, " ".join(rng.choices(own, k=12)), f"l{k:02}") for i in range(12)]
    got = langid.predict(frame(spark, rows)).filter("held_out").collect()
    assert {r.lang_pred for r in got} == {f"l{r.doc_id // 100:02}" for r in got}
    assert sum(r.lang_pred == f"l{r.doc_id // 100:02}" for r in got) >= 0.95 * len(got)


def test_copies_of_a_text_leave_no_language_without_training(spark):
    rng = random.Random(13)
    own = [prose(rng, 15) for _ in range(40)]
    copied = next(t for t in iter(lambda: prose(rng, 15), None) if xxhash.xxh64_intdigest(t.encode(), 42) % (1 << 40) < (1 << 40) // 100)
    ids = [i for i in range(900) if not held(i)]
    rows = [(i, copied, "en") for i in ids[:400]] + [(i, t, "en") for i, t in zip(ids[400:], own)] + [(i, prose(rng, 15, "fr"), "fr") for i in ids[450:500]]
    assert langid.learn(frame(spark, rows), rows=20)[0] == ["en", "fr"]


# --- toxicity


def labelled(spark, n=500, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = prose(rng, rng.randrange(20, 80), lang).split()
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiotxx", "scumyy", "trashzz"])
        rows.append((i, " ".join(words), lang))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    extra = [(9000, None, None), (9001, "", None), (None, "words", None), rows[0]]
    marks = spark.createDataFrame([*labels, (9000, 1, 1), (77777, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows + extra)
    got = toxicity.predict(df, marks).collect()
    assert len(got) == len(rows) + len(extra)
    true = {i: t for i, _, t in labels}
    tested = [r for r in got if r.held_out and r.doc_id in true]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id) for r in got)
    assert sum(r.predicted == true[r.doc_id] for r in tested) >= 0.95 * len(tested)
    kept = toxicity.accepted(df, marks)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)


def test_the_network_equals_its_definition():
    """Embedding sums, filters of each width, maxima over quarters and text, logistic layer: by loops."""
    rng = np.random.default_rng(5)
    net = toxicity.Network(rng.normal(size=(3, toxicity.BUCKETS + 1)), np.zeros((toxicity.BUCKETS + 1, 1)))
    net.bias, net.top = rng.normal(size=net.bias.shape).astype(np.float32), rng.normal(size=net.top.shape).astype(np.float32)
    docs = [b"one two three four five six seven", b"alpha", b"", b"x y z " * 9]
    batch = toxicity.Batch.of(docs)
    got = net.logits(batch)
    for d in range(len(docs)):
        ids = batch.ids[batch.start[d] : batch.start[d + 1]]
        x = [[float(net.odds[c][r[c]]) for c in range(3)] + [sum(float(net.table[c][r[c]][k]) for c in range(3)) for k in range(toxicity.DIM)] for r in ids]
        following = batch.ids[batch.start[d + 1] : batch.start[d + 1] + 2]
        tail = [[float(net.odds[c][r[c]]) for c in range(3)] + [sum(float(net.table[c][r[c]][k]) for c in range(3)) for k in range(toxicity.DIM)] for r in following]
        n = len(x)
        features = []
        for w, f in enumerate(net.filters):
            for j in range(toxicity.FILTERS):
                at = [sum(float(np.dot((x + tail)[p + k], f[k][:, j])) for k in range(len(f)) if p + k < len(x + tail)) for p in range(n)]
                quarters = [max(at[n * q // 4 : n * (q + 1) // 4]) for q in range(4)]
                features.append([max(v + float(net.bias[w * toxicity.FILTERS + j]), 0) for v in quarters])
        h = [sum(q) / 4 for q in features] + [max(q) for q in features]
        assert got[d] == pytest.approx(float(np.dot(h, net.top)) + float(net.offset), rel=1e-3, abs=1e-3)


def test_the_network_learns_without_the_log_odds_channel(spark, monkeypatch):
    keep = toxicity._log_odds

    def none(*a):
        whole, own = keep(*a)
        return whole * 0, [x * 0 for x in own]

    monkeypatch.setattr(toxicity, "_log_odds", none)
    rows, labels = labelled(spark, 400)
    learn = [i for i in range(400) if not held(i)]
    net = toxicity.fit([rows[i][1].encode() for i in learn], np.array([labels[i][2] for i in learn]), np.ones(len(learn)), [rows[i][2] for i in learn], rounds=6)
    tested = [i for i in range(400) if held(i)]
    score = net.score([rows[i][1].encode() for i in tested])
    assert np.mean([(s >= 0.3) == labels[i][2] for s, i in zip(score, tested)]) >= 0.9


def test_repeated_labels_and_long_texts_train_once(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 30) + (" vilewordx" * 2 if i % 2 else ""), "en", None) for i in range(120)]
    rows += [(2, "another text of this id", "en", None)] * 3 + [(500, prose(rng, 9000) + " vilewordx " + prose(rng, 9000), "en", None)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)] * 2 + [(500, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.predict(frame(spark, rows), labels).collect()}
    assert sum(got[i] == i % 2 for i in range(3, 120)) >= 110


def test_toxicity_without_both_labels(spark):
    df = frame(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.predict(df, none).collect()} == {(0.0, 0)}
    assert toxicity.predict(df.limit(0), none.limit(0)).count() == 0


def test_word_hashes_equal_for_equal_words():
    from graphloom.llm.common import Words

    w = Words([b"Foo, bar-FOO", b"", b"x foo", "Éa bar".encode()])
    h = w.hashes()
    assert w.first.tolist() == [0, 3, 3, 5, 7]
    assert h[0] == h[2] == h[4] and h[1] == h[6] and len(set(h.tolist())) == 4
    assert w.hashes(2)[0] == w.hashes(2)[4]
