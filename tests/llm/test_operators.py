"""Every operator on awkward rows, against brute force, and on empty tables."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidelog.llm import attention_lm, bpe, components, embedding_dedup, html_text, labelled, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, shared, stats, suffix_dedup, toxicity
from tidelog.llm.text import SYMBOLS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, n string, key string, spots string, n_words string, word string, score string"


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared_passage, base = prose(60), prose(200)
    rows = [(i, prose(rng.randint(5, 120)), f"s{i % 4}" if i % 7 else None) for i in range(40)]
    rows += [(40 + i, base, "s0") for i in range(5)]  # copies
    for i in range(8):  # near copies, each a word off
        w = base.split(" ")
        w[10 + i * 20] = f"edit{i}"
        rows.append((50 + i, " ".join(w), "s1"))
    rows += [(60 + i, prose(30) + "\n" + shared_passage + "\n" + prose(30), "s2") for i in range(6)]
    rows += [(70, None, "s0"), (71, "", None), (72, " \t\n", "s1"), (73, "one", "s1"), (74, "one", "s2"), (75, "ha " * 400, "s3"), (76, "é" * 300, "s3")]
    rows += [(77, prose(20_000), "s0"), (78, "x" * 150_000, "s1"), (79, "a#b $c 100% & <p> |" * 20, "s1")]
    rows += [(80, "same line here\nsame line here\nother\n\nsame line here", "s2"), (None, prose(50), "s2"), (None, base, None), (3, rows[3][1], rows[3][2]), (4, shared_passage + prose(9), "s0")]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, *("clash",) * 7) for i, t, s in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i, _, _ in ROWS if i is not None and i % 2 == 0] + [(2, None, None), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(i):
    return (i is None, i or 0)


# -- 1 ---------------------------------------------------------------------------------------------


def targets_by_hand(size):
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, out, left = 1.5 * sum(size.values()), {}, set(names)
    while left:
        share = {s: (total - sum(out.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * size[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * size[s] for s in over}
        left -= over
    return out


@pytest.mark.parametrize("bucket_rows", [1, 50_000])
def test_mix(docs, empty, bucket_rows):
    got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    size = Counter()
    for _, t, s in ROWS:
        size[s] += len(WORD.findall(t or ""))
    want = targets_by_hand(size)
    assert Counter(r.size for r in got) == Counter(len(WORD.findall(t or "")) for _, t, _ in ROWS)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    assert sorted(map(str, mixing.mix(docs, bucket_rows=bucket_rows).collect())) == sorted(map(str, got))
    assert mixing.mix(empty).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_mix_equals_its_sql_on_repeated_rows(spark, seed):
    """Rows alike, ids that are null or shared by different texts, texts without words."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(["a", "bc", "d#$"], k=rng.randint(0, 40))) for _ in range(12)] + [None, ""]
    some = [(rng.choice([None, 1, 2, 3, rng.randrange(100)]), rng.choice(texts), rng.choice([None, "x", "y", "z"])) for _ in range(24)]
    rows = [r for r in some for _ in range(rng.choice([1, 2, 2, 7, 30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = Counter(con.execute(mixing.SQL).fetchall())
    for bucket_rows in (1, 50_000):
        got = mixing.mix(docs, bucket_rows=bucket_rows).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
        assert Counter(tuple(r)[:5] for r in got) == want
    largest, taken, target = Counter(), Counter(), {}
    for r in got:
        largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in target)


# -- 2 ---------------------------------------------------------------------------------------------


def test_lm_score(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = lm_scoring.score(docs, path).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in ROWS)
    lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    tokens = lambda t: [*(t or "").encode().translate(lower).split(), b" "]
    count = Counter()
    for i, t, _ in ROWS:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t, _ in ROWS:
        ws = tokens(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(count[w] > 0 for w in ws), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.score(empty, path).collect() == []


def chain(rng, n):
    """Prose in which each word leaves two choices for the next."""
    words, at = ["river", "stone", "window", "letter", "garden", "market", "silver", "winter", "paper", "bottle"], rng.randrange(10)
    out = []
    for _ in range(n):
        out.append(words[at])
        at = (at * 3 + rng.choice((1, 2))) % 10
    return " ".join(out)


def test_lm_learns_from_every_text(spark, monkeypatch):
    path, rng, learn, learnt = public_tokenizers.path("byte_bpe_50k.json"), random.Random(12), lm_scoring.train, []
    first = spark.range(400).where(labelled.fold("id", 7) != 2).orderBy(F.xxhash64("id"), "id").first().id
    junk = " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=5)) for _ in range(180_000))
    rows = [(i, junk if i == first else chain(rng, 150)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_scoring, "PASSES", 1, raising=False)
    monkeypatch.setattr(lm_scoring, "train", lambda *a: learnt.append(learn(*a)))
    assert lm_scoring.score(docs, path).count() == 400
    sub = lm_scoring.Subwords(path)
    every = [len(sub.ids([t.encode()])[1][0]) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    assert max(every) > 500_000 and sum(learnt) == sum(every)


def test_lm_learns_from_every_id_once_whatever_the_size(spark, monkeypatch):
    path, rng, learn, learnt = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5), lm_scoring.train, []
    rows = [(i, chain(rng, 40)) for i in range(60)]
    monkeypatch.setattr(lm_scoring, "train", lambda *a: learnt.append(learn(*a)))
    assert lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path).count() == 60
    sub = lm_scoring.Subwords(path)
    assert sum(learnt) == sum(len(sub.ids([t.encode()])[1][0]) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)


def test_lm_words_are_encoded_in_lines_and_kept_while_met(monkeypatch):
    class Counted:
        def __init__(self, library):
            self.library, self.texts = library, 0

        def encode_batch_fast(self, texts, **more):
            self.texts += len(texts)
            return self.library.encode_batch_fast(texts, **more)

    monkeypatch.setattr(lm_scoring, "CACHE_WORDS", 1000)
    rng, sub = random.Random(6), lm_scoring.Subwords(public_tokenizers.path("byte_bpe_50k.json"))
    alone, sub.library = sub.library, Counted(sub.library)
    odd = ["a", "b\u00a0", "\u00a0c", "\u3000", "it's", "'s", "<|endoftext|>", "e\u0301", "\u2009", "\x85", "\x1c", "日本", "12", "#*", "\ufffd", "\U0001f600"]
    hot = [f"kept{i}".encode() for i in range(400)]
    for k in range(40):
        words = [*hot, *("".join(rng.choices(odd, k=rng.randint(1, 3))).encode() for _ in range(20 if k < 10 else 0)), *(b"%d" % rng.randrange(10**9) for _ in range(400)), b"\xff\xc3"]
        words = [w for w in words if len(w.split()) == 1]
        found, ids, length = sub.ids([b" ".join(words)])
        want = [alone.encode(" " + w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words]
        assert found == [words] and ids[0].tolist() == [*itertools.chain(*want), sub.end] and length.tolist() == [*map(len, want), 1]
    assert sub.library.texts < 40 * 400 / 2  # 400 new words a text; lines with white space beyond ASCII go word by word


def test_lm_texts_are_tokenised_once(spark, monkeypatch, tmp_path):
    """Rounds and scoring read the ids that were made first: the tokenizer's file is gone by then, and so is their table at the end."""
    path, learn = tmp_path / "byte_bpe.json", lm_scoring.train
    path.write_bytes(Path(public_tokenizers.path("byte_bpe_50k.json")).read_bytes())
    monkeypatch.setattr(lm_scoring, "train", lambda *a: path.unlink(missing_ok=True) or learn(*a))
    rng, odd = random.Random(9), "b\u00a0 \u00a0c \u3000 it's <|endoftext|> e\u0301 \u2009 \x85 \x1c 日本 12 \ufffd"
    rows = [(i, chain(rng, 30)) for i in range(40)] + [(40, odd), (41, None), (42, ""), (None, odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert lm_scoring.score(docs, str(path)).count() == len(rows) and not path.exists()
    at = str(tmp_path / "ids")
    sub = lm_scoring.Subwords(public_tokenizers.path("byte_bpe_50k.json"))
    kept = {(r.doc_id, bytes(r.text)): r.ids for r in lm_scoring.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), at).collect()}
    assert len(kept) == len(rows) and not [f for f in os.listdir(shared.folder(spark).removeprefix("file:")) if f.startswith("ids-")]
    starts = sub.starts.copy()
    starts[sub.end] = True
    for i, t in rows:
        _, ids, length = sub.ids([(t or "").encode()])
        found = np.frombuffer(kept[i, (t or "").encode()], np.uint16)
        assert found.tolist() == ids[0].tolist() and lm_scoring.lengths([found], starts).tolist() == length.tolist()


def test_lm_knows_more_than_counts(spark):
    rng = random.Random(21)
    docs = spark.createDataFrame([(i, chain(rng, 150)) for i in range(400)], "doc_id long, text string").repartition(3)
    held = [r for r in lm_scoring.score(docs, public_tokenizers.path("byte_bpe_50k.json")).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score - r.base_score for r in held) > 0.3 * tokens  # log10(10 / 2) = 0.7 is what there is to know


def test_lm_score_by_hand(spark, monkeypatch):
    """Every text's score from the fitted model, exact counts and the mixture's formula; long words, unseen words, rare words."""
    path, rng, made, share = public_tokenizers.path("byte_bpe_50k.json"), random.Random(31), [], []
    fitted, settled = lm_scoring.fit, lm_scoring.fit_share
    monkeypatch.setattr(lm_scoring, "fit", lambda *a: made.append(fitted(*a)) or made[-1])
    monkeypatch.setattr(lm_scoring, "fit_share", lambda *a: share.append(settled(*a)) or share[-1])
    monkeypatch.setattr(lm_scoring, "HEAD_SHARE", 1e-2)  # most words meet their counts in the shuffle
    rows = [(i, chain(rng, rng.randint(0, 90)) + f" only{i} Only{i} rare{i % 20}") for i in range(120)] + [(500, "z" * 3000), (501, None), (502, chain(rng, 4000)), (None, "none of it")]
    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()}
    s, sub, lower = made[0], lm_scoring.Subwords(path), bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    count = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for w in [*(t or "").encode().translate(lower).split(), b" "])
    unit = 1 / (sum(count.values()) + len(count) + 1)
    for i, t in rows:
        words, ids, length = sub.ids([(t or "").encode()])
        logs = lm_scoring.token_logs(s.model, ids, length)
        one = lambda w, log: s.share * (count[w] + 1) * unit + (1 - s.share) * math.exp(log)
        want = sum(math.log(one(w, x)) if count[w] else x + math.log(s.share * unit + 1 - s.share) for w, x in zip([*words[0], b" "], logs, strict=True))
        assert math.isclose(got[i].score, want / math.log(10), rel_tol=1e-4)
    held = [(t, i) for i, t in rows if i is not None and got[i].held_out]
    alone = sum(lm_scoring.token_logs(s.model, *sub.ids([(t or "").encode()])[1:]).sum() for t, _ in held) / math.log(10)
    assert s.share == share[0] and alone > sum(got[i].base_score for _, i in held) - 4 * 3000  # zzz


def test_lm_probabilities_add_up():
    """Over all next ids, whatever came before; and the probability that a word starts is that of the ids that start one."""
    counts = np.arange(300)[::-1] % 7
    v = attention_lm.Vocabulary.build(counts, np.arange(300) % 3 == 0, 0, most=200)
    model = attention_lm.Model(v, counts=counts)
    rng = np.random.default_rng(8)
    before = rng.choice(np.unique(v.to_model), 9)
    log = starts = None
    total, begins = 0.0, 0.0
    model_ids = np.unique(v.to_model)
    for i in model_ids:
        log, starts = attention_lm.score(model, [np.append(before, i)])
        total += math.exp(log[-1])
        begins += math.exp(log[-1]) if i < v.starts * attention_lm.CLASS_SIZE else 0.0
    assert math.isclose(total, 1.0, rel_tol=1e-4) and math.isclose(begins, math.exp(starts[-1]), rel_tol=1e-4)
    other = np.bincount(v.to_model, np.exp(v.rest))  # external ids behind a model id share its probability
    assert np.allclose(other[np.unique(v.to_model)], 1.0)


def test_lm_gradients():
    v = attention_lm.Vocabulary.build(np.arange(200) % 5 + 1, np.arange(200) % 2 == 0, 0, most=150)
    model = attention_lm.Model(v, width=8, hidden=6, counts=np.arange(200) % 5 + 1)
    rng = np.random.default_rng(2)
    real = np.unique(v.to_model)
    ids, target, _ = attention_lm.windows([rng.choice(real, 70), rng.choice(real, 5)], v.end)
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    _, g = model.step(ids, target)
    for name, x in model.p.items():
        usable = np.argwhere(x > -1e8)
        for at in usable[rng.choice(len(usable), min(6, len(usable)), replace=False)]:
            at, h = tuple(at), 1e-5
            kept = x[at]
            x[at] = kept + h
            up = model.step(ids, target)[0]
            x[at] = kept - h
            down = model.step(ids, target)[0]
            x[at] = kept
            assert math.isclose((up - down) / (2 * h), float(g[name][at]), rel_tol=2e-3, abs_tol=2e-5), name


def test_lm_windows_overlap_by_half():
    ids = np.arange(1, 101)
    cells, target, first = attention_lm.windows([ids], 0)
    scored = [(t, c) for row, first_column in zip(target, first, strict=True) for c, t in enumerate(row) if c >= first_column and t >= 0]
    assert [t for t, _ in scored] == list(ids)
    half = attention_lm.WINDOW // 2
    assert all(c >= min(half, k) for k, (_, c) in enumerate(scored))  # the ids before it that its window holds
    v = attention_lm.Vocabulary.build(np.arange(6000), np.arange(6000) % 2 == 0, 0)
    assert len(set(v.to_model[2000:])) > 3900
    model = attention_lm.Model(v)
    log, _ = attention_lm.score(model, [v.to_model[ids]])
    z, _ = model._hidden(cells)
    assert model.p["A"].shape == (32, 48) and np.isfinite(log).all()
    model.ready()
    assert np.allclose(model._infer(cells, half), z[:, half:], atol=1e-4)


# -- 3, 10 -----------------------------------------------------------------------------------------


def test_quality_classifier(docs, labels, empty):
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = quality_classifier.train(docs, labels.where("false"))
    assert {r.score for r in quality_classifier.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality_classifier.score(empty, model, ["doc_id"]).collect() == []


def test_rules_learn_and_compile_alike(spark):
    rng = np.random.default_rng(1)
    x = {k: rng.random(600) for k in ("log_words", "symbol_share", "upper_share")}
    y = ((x["symbol_share"] < 0.3) & (x["upper_share"] < 0.8)).astype(int)
    model = quality_classifier.fit(x, y.astype(float))
    assert ((model.predict(x) > 0.5) == y).mean() > 0.97 and len(model.rules) < 100
    rows = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values(), strict=True)], list(x))
    assert np.allclose([r[0] for r in rows.select(model.column()).collect()], model.predict(x))
    rules = quality_rules.learn(x, y)
    kept = np.array([r[0] for r in rows.select(quality_rules.verdict(rules)).collect()])
    assert rules and (kept == y).mean() > 0.95


def test_quality_rules(docs, labels, empty):
    def by_hand(t):
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c.encode() in [bytes([b]) for b in SYMBOLS] for c in t), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)

    rules = quality_rules.train(docs, labels)
    got = quality_rules.apply(docs, rules, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *by_hand(t)) for i, t, _ in ROWS)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.apply(empty, [], ["doc_id"]).collect() == []


# -- 4 ---------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a="<p>x</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies on this site to give you the best of it and the rest of that is for you.</div><nav><ul><li><a href=/>Home</a></ul></nav>
<article><h1>Title</h1><p>First &amp; only&nbsp;para <a href=x>linked</a> of\n the text.<p>Second<div class="ad">Buy</div><!-- no --><ul><li>one<li>two</ul>
<form><input><label>Mail</label></form><section id=comments><p>I like the text that you have written on this page.</p></section></article>
<aside>Related</aside><footer>&copy; x</footer>"""


def test_html(spark):
    long = "the of and to in is it was for on are as with his they at be this from have or by one had not " * 8
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain <b>text"), (5, "u", f"<div><a href=1>menu</a> <a href=2>items</a></div><div>{long}</div><p>short</p><div>{long}</div><div><a href=3>links and links</a></div>"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.main_text(pages, ["page_id", "url"]).collect()), key=lambda r: (key(r[0]), r[1]))
    main, plain = "Title\nFirst & only para linked of the text.\nSecond\none\ntwo", "plain text"
    whole = f"{long.strip()}\nshort\n{long.strip()}"
    assert got == [(1, main, len(main)), (1, main, len(main)), (2, "", 0), (3, "", 0), (5, whole, len(whole)), (None, plain, len(plain))]
    assert html_text.main_text(pages.where("false"), ["page_id"]).collect() == []


def test_html_container_is_no_verdict():
    prose = "The river that runs by the town is as old as the hills and it was here before any of us were. " * 3
    sale = "Mega Bargain Sofa Lamp Chair Table Discount Voucher Order Today Call Now Free Delivery Cheap Cheap Cheap"
    assert html_text.extract(f"<article><p>{prose}</p><p>{sale}</p><p>{prose}</p></article>") == f"{prose.strip()}\n{prose.strip()}"
    finnish = "Joki virtaa kaupungin halki hitaasti kohti merta ja sen rannoilla kasvaa vanhoja koivuja joiden alla lapset leikkivat " * 3
    assert html_text.extract(f"<div><a href=1>Etusivu</a></div><div>{finnish}</div><div>Haku</div>").startswith(finnish.strip())


def test_html_is_read_in_linear_time(spark):
    quoted = " ".join(f'x{i}="{i}"' for i in range(1000))
    broken = ["<a " + quoted, "<a " + '"' * 1_000_000, "<a " + "\"'" * 500_000, "<!" * 500_000, "</" * 500_000, "<script>" + "</script" * 100_000, '<a "' * 200_000]
    for rest in broken:
        began = time.perf_counter()
        assert html_text.extract("<p>What stands before</p>" + rest) == "What stands before"
        assert time.perf_counter() - began < 3
    began = time.perf_counter()
    assert html_text.extract("<div>" * 50_000 + "</p>" * 50_000 + "<p>deep") == "deep"
    assert time.perf_counter() - began < 5
    prose = "the river that runs by the town is as old as the hills and it was here before any of us were. " * 20_000
    pages = spark.createDataFrame([(1, "u", f"<article><p>{prose}</p></article>", "clash", 7), (1, "v", "<p>x</p>", None, 7)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.url: (r.text, r.n_chars) for r in html_text.main_text(pages, ["page_id", "url"]).collect()}
    assert got == {"u": (prose.strip(), len(prose) - 1), "v": ("x", 1)}


# -- 5 ---------------------------------------------------------------------------------------------


def test_bpe_digests(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    lexicon = bpe.compile_lexicon(docs, path, 1e-4)
    want = Counter()
    for i, t, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs, path, lexicon, ["doc_id"]).collect())) == want
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, path, lexicon, ["doc_id"]).where("doc_id = 5").collect()}
    assert bpe.load(path).decode(ids[5]) == library.decode(ids[5], skip_special_tokens=False)
    assert bpe.digests(empty, path, bpe.compile_lexicon(empty, path), ["doc_id"]).collect() == []


# -- 6 ---------------------------------------------------------------------------------------------


def removed_by_hand(rows, length, made=lambda kept: hashlib.sha256(kept).hexdigest()):
    """Rows in order of id, null last, then of their text's tag; only a strictly smaller place is earlier."""
    order = lambda r: (*key(r[0]), suffix_dedup.text_tag(r[1]))
    rows = sorted(rows, key=order)
    first, out = {}, []
    for r in rows:
        for s in range(len(r[1]) - length + 1):
            first.setdefault(r[1][s : s + length], (order(r), s))
    for i, t in rows:
        cut = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (order((i, t)), s):
                cut[s : s + length] = b"\1" * length
        kept = bytes(c for c, x in zip(t, cut, strict=True) if not x)
        runs = sum(x and not (k and cut[k - 1]) for k, x in enumerate(cut))
        out.append((i, len(t), sum(cut), runs, made(kept)))
    return Counter(out)


@pytest.mark.parametrize("run", [suffix_dedup.RUN, 1])
def test_suffix_dedup(docs, empty, monkeypatch, run):
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    some = docs.where("doc_id IS NULL OR doc_id <> 78")
    want = removed_by_hand([(i, (t or "").encode()) for i, t, _ in ROWS if i != 78], 100)
    assert Counter(map(tuple, suffix_dedup.dedup(some, ["doc_id"]).collect())) == want
    assert suffix_dedup.dedup(empty, ["doc_id"]).collect() == []


@pytest.mark.parametrize("run", [suffix_dedup.RUN, 5])
def test_suffix_dedup_tells_rows_under_one_id_apart(spark, monkeypatch, run):
    """Several hundred rows without an id or under shared ids: no row loses what only another repeats."""
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(150)
    rows = [(rng.choice([None, None, 1, 2, 2000]), prose(rng.randint(0, 250)) + (passage if rng.random() < 0.3 else "") + prose(60)) for _ in range(400)]
    rows += [(i, prose(90) + passage) for i in range(3, 40)] + rows[:20] + [(1, passage + prose(200)), (2**63 - 1, passage)]
    want = removed_by_hand([(i, t.encode()) for i, t in rows if i != 2**63 - 1], 100)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ["doc_id"])
    assert Counter(map(tuple, got.where("doc_id IS NULL OR doc_id < 9000").collect())) == want
    monkeypatch.setattr(suffix_dedup, "text_tag", lambda text: zlib.crc32(text) & 1)  # the test sees rows that are mixed up
    assert Counter(map(tuple, suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect())) != want


def test_suffix_dedup_compares_across_boundaries(spark, monkeypatch):
    """A run that is cut into buckets and slabs, each of which sees a part of it."""
    monkeypatch.setattr(suffix_dedup, "RUN", 10)
    monkeypatch.setattr(suffix_dedup._compare, "__defaults__", (70,))
    rng = random.Random(3)
    prose = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = prose(110)
    ends = [prose(40) for _ in range(6)]
    rows = [(i, prose(30) + rng.choice(ends) + passage + rng.choice(ends) + prose(30)) for i in range(600)]
    want = removed_by_hand([(i, t.encode()) for i, t in rows], 100)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ["doc_id"])
    assert Counter(map(tuple, got.collect())) == want


def test_suffix_dedup_small_strings(spark):
    """Heavily periodic and random texts over two letters, with short strings."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(60)] + [(100 + i, "ab" * i) for i in range(12)] + [(200, "a" * 50), (201, "a" * 31)]
    want = removed_by_hand([(i, t.encode()) for i, t in rows], 12)
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], 12, 4)
    assert Counter(map(tuple, got.collect())) == want


# -- 7 ---------------------------------------------------------------------------------------------


def grams(t, n=5):
    w = (t or "").encode().split()
    return frozenset(zip(*(w[k:] for k in range(n)))) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [768, 3])
def test_ngram_join(docs, empty, block):
    got = ngram_join.join(docs, block=block).collect()
    rows = [(i, grams(t)) for i, t, _ in ROWS]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        (i, x), (j, y) = rows[a], rows[b]
        if i is not None and j is not None and x and y and len(x & y) >= 0.8 * len(x | y) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    smallest = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            smallest[find(a)] = min(i, smallest.get(find(a), i))
    want = Counter((i, smallest.get(find(a)), links[a]) for a, (i, _) in enumerate(rows))
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    assert ngram_join.join(empty).collect() == []


def test_ngram_join_of_chains_and_clusters(spark, monkeypatch):
    """Chains of texts that are alike to their neighbours only, tight clusters and sparse ones: links equal brute force,
    and a chain costs about its band pairs."""
    rng = random.Random(11)
    rows, at = [], 0
    window = [f"w{i}" for i in range(3000)]
    for i in range(60):  # neighbours share 0.85, the next but one 0.73
        rows.append((i, " ".join(window[i * 8 : i * 8 + 104])))
    for i in range(60):  # just below: 0.78
        rows.append((100 + i, " ".join(f"v{x}" for x in range(i * 13, i * 13 + 108))))
    base = [f"u{i}" for i in range(150)]
    for i in range(40):
        at = rng.randrange(150)
        rows.append((200 + i, " ".join([*base[:at], f"edit{i}", *base[at + 1 :]])))
    rows.append((300, rows[3][1]))
    rng.shuffle(rows)
    cells, verify = spark.sparkContext.accumulator(0), ngram_join._verify

    def counted(similarity):
        inner = verify(similarity)

        def run(key, table):
            cells.add(table.num_rows**2)
            return inner(key, table)

        return run

    monkeypatch.setattr(ngram_join, "_verify", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (768, 5):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs, block=block).collect()}
        sets = {i: grams(t) for i, t in rows}
        alike = lambda x, y: len(x & y) >= 0.8 * len(x | y) - 1e-9
        links = {i: sum(alike(x, y) for j, y in sets.items() if j != i) for i, x in sets.items()}
        assert {i: n for i, (_, n) in got.items()} == links
        assert {c for i, (c, _) in got.items() if i < 60 or i == 300} == {0} and all(got[100 + i][0] == 100 + i for i in range(60))
    assert cells.value < 60_000  # a closed chain would be 60 x 60 each, all pairs 161 x 161; block by block more often


def test_ngram_join_shuffles_no_text_that_is_like_no_other(spark):
    def shuffled():
        store, spent = spark.sparkContext._jsc.sc().statusStore(), 0
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        for i in range(stages.size()):
            spent += stages.apply(i).shuffleWriteBytes()
        return spent

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9))
    rows = [(i, " ".join(word() for _ in range(2500))) for i in range(120)]
    rows += [(120 + i, rows[i][1] + " more") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    docs.count()
    before, limit = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # this table is small
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: (i - 120 if i >= 120 else i, int(i >= 120 or i < 6)) for i in range(126)}
    assert shuffled() - before < 0.4 * sum(len(t) for _, t in rows)


def test_bands_reach_their_recall():
    for similarity, recall in ((0.8, 0.9995), (0.9, 0.99), (0.5, 0.9)):
        bands, rows = ngram_join.bands_for(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= 128


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5), (None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


# -- 8 ---------------------------------------------------------------------------------------------


def test_toxicity(docs, labels, empty):
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = toxicity.train(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.5}
    assert toxicity.score(empty, model, ["doc_id"]).collect() == []


def test_disguises_are_read(spark):
    rng = random.Random(8)
    filler = ["river", "stone", "window", "letter", "garden", "market", "silver", "winter", "paper", "bottle"]
    bad = ["wretch", "villain", "idiot"]
    prose = lambda n: rng.choices(filler, k=n)
    rows = [(i, " ".join([*prose(30), rng.choice(bad), *prose(20)] if i % 4 == 0 else prose(50))) for i in range(400)]
    hidden = ["v1ll@in", "i.d.i.o.t", "wr3tch", "IDIOOOOT!!", "v i l l a i n", "1d10t"]
    rows += [(1000 + k, " ".join([*prose(25), h, *prose(25)])) for k, h in enumerate(hidden)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    score = {r.doc_id: r.predicted for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert [score[1000 + k] for k in range(len(hidden))] == [1] * len(hidden)
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(score[i] == int(i % 4 == 0) for i in held) >= 0.97 * len(held)


def test_each_doubled_letter_may_go():
    words = {w: 50 for w in "bullshit killer asshole bottle river stone letter".split()}
    reader = toxicity.Reader(toxicity.CharModel(words))
    hidden = {"bbullshit": "bullshit", "kkiller": "killer", "asshoole": "asshole", "aasshole": "asshole", "bulllshitt": "bullshit", "kkiilleerr": "killer", "aasshhoollee": "asshole"}
    assert {h: w in reader.restored(h.encode()) for h, w in hidden.items()} == dict.fromkeys(hidden, True)
    assert reader.restored(b"bottle") == ["bottle"]


def test_rare_grams_count_too(docs, monkeypatch):
    whole = toxicity.char_model(docs)
    monkeypatch.setattr(toxicity, "MOST_GRAMS", 40)
    few = toxicity.char_model(docs)
    assert len(few.counts) == 40 < len(whole.counts)
    for _ in range(2):
        asked = [("^" * (4 - len(g)) + g[:-1], g[-1]) for g in [*whole.counts, "zzzz", "^^^q"]]
        assert np.allclose([few.log(*x) for x in asked], [whole.log(*x) for x in asked], rtol=0, atol=1e-9)
        for m in (few, whole):  # words added later meet what was counted
            m.add("abcade", 2.0)


def test_spaced_letters_are_read():
    words = {w: 50 for w in "you idiot is stupid man now the river stone a and i".split()}
    reader = toxicity.Reader(toxicity.CharModel(words))
    read = lambda t: {x for w in reader.words(t.encode()) for x in reader.restored(w)}
    texts = ["you i d i o t. now", "i  d\ti\no t", "i\u00a0d\u00a0i\u00a0o\u00a0t", "you í d ì ö t, now", "you і d і о t", "(i d 1 o t)", "i. d. i. o. t.", "i d i o t !"]
    assert [t for t in texts if "idiot" not in read(t)] == []
    assert "stupid" in read("is a s t u p i d man") and "stupid" in read("a s t u p i d i d i o t") and "idiot" in read("a s t u p i d i d i o t")
    assert reader.words(b"1 2 3 4") == b"1 2 3 4".split()
    assert "idiot" in read("x q " * 500 + "i d i o t")


def every_reading(word, model, spaced=False):
    """All paths of the lattice, by hand."""
    forms = {(): 0.0}
    for k, options in enumerate(toxicity.choices(word)):
        for step in [[("", 0.0), (" ", 0.0)], options] if spaced and k else [options]:
            grown = {}
            for f, s in forms.items():
                for c, cost in step:
                    if c == " " and (not f or f[-1] == " "):
                        continue
                    t = (*f, c) if c else f
                    grown[t] = max(grown.get(t, -1e9), s + cost)
            forms = grown
    out = {}
    for f, s in forms.items():
        words = "".join(f).split(" ")
        if f and "" not in words:
            for w in words:
                whole = "^^^" + w + "$"
                s += sum(model.log(whole[i - 3 : i], whole[i]) for i in range(3, len(whole)))
            out["".join(f)] = s
    return sorted(out.items(), key=lambda x: -x[1])


def test_decoding_is_exact():
    """The best readings are those of all paths; the trie lets through every word that has a weighted reading."""
    rng = random.Random(4)
    model = toxicity.CharModel({w: 50 for w in "you idiot is stupid man now the river stone villain wretch aa".split()})
    weights = {"idiot$": 3.0, "stup": 2.0, "vill": 2.0, "aa$": 1.0}
    plain, sieved = toxicity.Reader(model, weights), toxicity.Reader(model, weights)
    plain.worth = lambda *a, **k: True
    some = ["".join(rng.choices("idotsvla10$@.*é", k=rng.randint(2, 7))) for _ in range(150)] + ["1d10t", "v1ll@in", "$tup!d", "i.d.i.o.t", "s**t", "aaa", "a.a", "iidiot"]
    for w in some:
        for spaced in (False, True):
            if spaced and len(w) > 5:
                continue
            want = every_reading(w, model, spaced)[:6]
            got = toxicity.readings(w, model, spaced=spaced)
            assert np.allclose([s for _, s in got], [s for _, s in want]) and set(t for t, s in got if s > want[-1][1] + 1e-9) <= {t for t, _ in want}
        assert plain.weight(w.encode()) == sieved.weight(w.encode())
    assert plain.weight(b"i d 1 o t") == sieved.weight(b"i d 1 o t") == 3.0


def test_long_words_are_read_in_seconds():
    rng = random.Random(4)
    model = toxicity.CharModel({w: 50 for w in "you idiot is stupid man now the river stone".split()})
    reader = toxicity.Reader(model, {"idiot$": 3.0})
    code = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    began = time.perf_counter()
    assert reader.weight(code.encode()) == 0.0 and reader.weight(b"a" * 1_000_000) == 0.0
    assert time.perf_counter() - began < 10
    times = []
    for n in (20_000, 40_000):
        began = time.perf_counter()
        assert toxicity.readings(code[:n].lower(), model)
        times.append(time.perf_counter() - began)
    assert times[1] < 3.2 * times[0] + 0.5
    assert reader.weight(b"i" + b"." * 100_000 + b"diot") == 3.0


def test_rare_words_are_in_the_channel(spark):
    rng = random.Random(5)
    common = ["river", "stone", "window", "letter", "garden"]
    rows = [(i, " ".join(rng.choices(common, k=1000))) for i in range(200)] + [(900, "Wretch, wretch")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.char_model(docs, 1e-4)
    assert model.words == set(common)
    weight = {w: 1 + math.log(n) for w, n in Counter(w.lower().strip(",") for _, t in rows for w in t.split()).items()}
    want = Counter()
    for w, x in weight.items():
        for g in toxicity.grams(w):
            want[g] += x
    assert {g: round(n, 6) for g, n in model.counts.items()} == {g: round(n, 6) for g, n in want.items()}
    assert toxicity.readings("wr3tch", model)[0][0] == "wretch"
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    rows = [(i, " ".join([*rng.choices(common, k=300), *(["villain"] if i % 4 == 0 else [])])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, learned = toxicity.char_model(docs), toxicity.train(docs, labels).chars
    assert learned.counts["vill"] > plain.counts["vill"] > 0


# -- 9 ---------------------------------------------------------------------------------------------


def near_vectors(rng, n, dim=16):
    out = []
    while len(out) < n:
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        out += [base + rng.standard_normal(dim) * s for s in rng.choice([0.0, 0.01, 0.03, 0.2], rng.integers(1, 6))]
    return [v.tolist() for v in out[:n]]


@pytest.mark.parametrize(("leaf", "exact"), [(512, True), (20, False)])
def test_embedding_dedup(spark, leaf, exact):
    rng = np.random.default_rng(3)
    rows = [(i, v, int(i % 3 > 0)) for i, v in enumerate(near_vectors(rng, 400))]
    rows += [(1000 + i, v, k) for i, (v, k) in enumerate([(None, 1), ([0.0] * 16, 1), ([1.0] * 15 + [None], 1), ([float("nan")] * 16, 1), ([float("inf")] * 16, 1), ([1.0] * 16, None), ([1.0] * 16, None), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1), (rows[5][1], rows[5][2])])]
    rows += [(None, rows[5][1], rows[5][2]), rows[7]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.dedup(vectors, leaf=leaf).collect()
    good = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    want = Counter()
    for a, b in itertools.combinations(range(len(good)), 2):
        (_, x, k), (_, y, m) = good[a], good[b]
        if k == m and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
            want[a] += 1
            want[b] += 1
    assert Counter(r.vec_id for r in got) == Counter(i for i, _, _ in rows)
    links = {r.vec_id: r.n_links for r in got}
    found, there = sum(links[good[a][0]] for a in want), sum(want.values())
    if exact:
        assert {i: n for i, n in links.items() if n} == {good[a][0]: n for a, n in want.items()}
    assert 0.9 * there <= found <= there + 1
    assert all(links[good[a][0]] <= n for a, n in want.items())
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embedding_dedup.dedup(vectors.where("false")).collect() == []


def test_embeddings_of_many_lengths_ties_and_other_columns(spark):
    """Lengths that differ from row to row make one plan; a cosine of exactly the threshold links; columns may clash."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(2 + i % 90).tolist(), 1, "clash", "clash") for i in range(180)]
    rows += [(1000 + i, v, 2, "clash", "clash") for i, v in enumerate([[1.0, 0.0], [3.0, 4.0], [3.0, 4.0], [0.0, 1.0], [3.0] + [0.0] * 4999, [5.0] + [0.0] * 4999])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string, dim string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(vectors, 0.6).collect()}
    assert [got[1000 + i] for i in range(6)] == [(2, 1000, True), (3, 1000, False), (3, 1000, False), (2, 1000, False), (1, 1004, True), (1, 1004, False)]
    for i in range(90):
        x, y = np.array(rows[i][1]), np.array(rows[i + 90][1])
        assert got[i][0] == got[i + 90][0] == int(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.6)


# -- shared ----------------------------------------------------------------------------------------


def test_folds(docs):
    for r in docs.select("doc_id", labelled.fold("doc_id", 5).alias("f"), labelled.held_out("doc_id", 5, 0).alias("h")).collect():
        if r.doc_id is None:
            assert r.f is None and r.h is False
        else:
            assert r.f == zlib.crc32(str(r.doc_id).encode()) % 5 and r.h == (r.f == 0)


def test_statistics_ignore_chunking(docs):
    texts = [(t or "").encode() for _, t, _ in ROWS]
    whole = stats.compute(texts)
    apart = [stats.compute([t]) for t in texts]
    for name in stats.COUNTS:
        assert whole[name].tolist() == [int(x[name][0]) for x in apart]
    assert stats.compute([])["n_words"].tolist() == []


def test_sample_is_bounded(docs, labels):
    picked = labelled.sample(labels, "quality", 5, 0, 3)
    assert picked.count() == 3 and picked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).count() == 0


# -- learned operators on the bundled tables ---------------------------------------------------------

BUNDLED = "/root/testdata/sf0.01"


def ratios_by_hand(t):
    t = t or ""
    w = WORD.findall(t)
    runs = sum(a == b for a, b in itertools.pairwise(w))
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + k for i in range(len(w) - 2) for k in range(3) if three[tuple(w[i : i + 3])] > 1}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    chars, n = sum(map(len, w)), len(w)
    count = lambda chars_: sum(c in chars_ for c in t)
    share = lambda a, b: a / b if b else 0.0
    return {
        "log_words": math.log1p(n), "word_length": share(chars, n), "symbol_share": share(count("#*$%&|<>"), chars), "dup_line_share": (len(lines) - len(set(lines))) / (t.count("\n") + 1),
        "repeat_share": share(len(repeated), n), "upper_share": share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), chars), "digit_share": share(count("0123456789"), chars), "mark_share": share(count("!?:;\"'()[]{}=+_/\\@~^`"), chars),
        "distinct_share": share(len(set(w)), n), "run_share": share(runs, n), "line_words": n / (t.count("\n") + 1),
    }


def auc(score, y):
    good, bad = score[y == 1], score[y == 0]
    return (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()


@pytest.fixture(scope="module")
def bundled(spark):
    docs, labels = spark.read.parquet(f"{BUNDLED}/documents.parquet"), spark.read.parquet(f"{BUNDLED}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    return docs, labels, texts, {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}


def test_quality_scores_by_hand_and_held_out(bundled):
    """The score of every bundled document from its text, the rules one by one; and how well it tells labels it never saw."""
    docs, labels, texts, marks = bundled
    model = quality_classifier.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model, ["doc_id"]).collect()}
    for i, t in texts.items():
        x = ratios_by_hand(t)
        z = model.bias + sum(w for conditions, w in model.rules if all((x[name] > at) == above for name, above, at in conditions))
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-9), i
    held = [i for i in marks if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc(np.array([got[i] for i in held]), np.array([marks[i][0] for i in held])) > 0.95


def test_kept_by_hand_and_on_a_fold(bundled):
    """The decision list evaluated rule by rule; learned on four fifths of the labels, judged on the rest."""
    docs, labels, texts, marks = bundled
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rules = quality_rules.train(docs, labels.where(fold != 0))
    judged = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply(docs, rules, ["doc_id"]).collect()}
    for i, t in texts.items():
        x, failed = ratios_by_hand(t), judged[i][0]
        verdict = next((keep for conditions, keep in rules if all((x[name] > at) == above for name, above, at in conditions)), True)
        assert judged[i][1] == (not failed and verdict)
    held = [i for i in marks if i in judged and zlib.crc32(str(i).encode()) % 5 == 0 and not judged[i][0]]
    assert np.mean([judged[i][1] == bool(marks[i][0]) for i in held]) > 0.9


def test_toxicity_by_hand_and_held_out(bundled):
    """Each score from the text's words and their weights, outside Spark; and how well it tells labels it never saw."""
    docs, labels, texts, marks = bundled
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    reader = toxicity.Reader(model.chars, model.weights)
    reader.worth = lambda *a, **k: True  # every disguised word is decoded
    for i in sorted(texts)[::4]:
        words = reader.words((texts[i] or "").encode())
        x = np.array([max((model.weights.get(f, 0.0) for r in reader.restored(w) for f in toxicity.features(r)), default=0.0) for w in words])
        hit, n = np.sort(x[x > 0])[::-1], max(1, len(words))
        strong = float((hit >= 2.5).sum())
        values = [hit[0] if len(hit) else 0.0, hit[1] if len(hit) > 1 else 0.0, strong, strong / n, len(hit), len(hit) / n, hit.sum() / n, math.log1p(len(words))]
        want = model.rules.predict({k: np.array([v]) for k, v in zip(toxicity.SHAPE, values, strict=True)})[0]
        assert math.isclose(got[i], want, rel_tol=1e-6), i
    held = [i for i in marks if i in got and zlib.crc32(str(i).encode()) % 4 == 2]
    assert auc(np.array([got[i] for i in held]), np.array([marks[i][1] for i in held])) > 0.75  # a third of these labels tell of no toxic word
