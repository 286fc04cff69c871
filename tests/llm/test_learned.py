"""Classifiers, the language model and the join."""

import itertools
import os
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from samples import ODD
from pyspark.sql import functions as F

from lodestone.llm import common, components, gru_lm, jaccard_join, quality_classifier, toxicity
from lodestone.llm.common import remainder


def texts(n, junk):
    g = np.random.default_rng(5)
    words = ["".join(g.choice(list("abcdeinorst"), g.integers(2, 8))) for _ in range(400)]
    out = []
    for k in range(n):
        w = list(g.choice(words, g.integers(30, 90)))
        out.append((k, junk(k, w), " ".join(w)))
    return out


def test_quality_learns_shape_and_keeps_order_independent(spark):
    made = [(k, " ".join(f"{x.upper()}!!" if k % 3 == 0 else f"{x}%%%" for x in w.split()) if k % 4 == 0 else w, int(k % 4 != 0)) for k, _, w in texts(400, lambda k, w: 0)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in made] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels, remainder("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    held = [k for k, _, _ in made if brute.crc(k, 3) == 1]
    assert np.mean([(got[k] >= 0.5) == made[k][2] for k in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    again = quality_classifier.fit(docs.repartition(2), labels, remainder("doc_id", 3) != 1)
    assert {r.doc_id: round(r.score, 4) for r in quality_classifier.score(docs, again).collect()} == {k: round(s, 4) for k, s in got.items()}
    kept = quality_classifier.score(docs, model, least=0.5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, s in got.items() if s >= 0.5}


def test_votes_equal_plain_loops():
    g = np.random.default_rng(11)
    x = np.abs(g.standard_normal((70, 2 * quality_classifier.TERMS))).astype(np.float32)
    model = quality_classifier.Model(g.random(2 * quality_classifier.TERMS).astype(np.float32), g.standard_normal((2 * quality_classifier.TERMS, 6)).astype(np.float32), np.zeros((0, 1)), (g.random(40) < 0.5).astype(float), 0.3)
    model.vectors = model.latent(x[:40])
    got = model.score(x[40:])
    for row, score in zip(x[40:], got, strict=True):
        t = row * model.weights
        v = (t / np.linalg.norm(t)) @ model.basis
        v /= np.linalg.norm(v)
        near = sorted(((float(sum(a * b for a, b in zip(v, w, strict=True))), y) for w, y in zip(model.vectors, model.y, strict=True)), reverse=True)[: quality_classifier.NEIGHBOURS]
        weight = [max(s, 0) ** quality_classifier.POWER for s, _ in near]
        assert score == pytest.approx(sum(a * y for a, (_, y) in zip(weight, near, strict=True)) / sum(weight), abs=1e-3)


def test_principal_directions_equal_the_decomposition():
    g = np.random.default_rng(12)
    x = (g.standard_normal((120, 90)) * (2.0 ** -np.arange(90) + 0.01)).astype(np.float32)
    ours, axes = quality_classifier.principal(x), np.linalg.svd(x.astype(np.float64), full_matrices=False)[2][:10]
    assert np.allclose(np.abs((axes @ ours[:, :10]).diagonal()), 1, atol=1e-3)
    assert quality_classifier.principal(x[:5]).shape == (90, 5)


NO_PACKAGE = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
from lodestone.llm import gru_lm, quality_classifier, toxicity

def has(batches):
    import importlib.util
    import pyarrow as pa
    yield pa.RecordBatch.from_arrays([pa.array([int(importlib.util.find_spec("lodestone") is not None)])], names=["n"])

assert spark.range(1).mapInArrow(has, "n long").first().n == 0
docs = spark.createDataFrame([(k, f"some words {{k}} idiot" if k % 2 else "other fine words here") for k in range(40)], "doc_id long, text string")
labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
for op in (quality_classifier, toxicity):
    assert op.score(docs, op.fit(docs, labels, F.lit(True))).count() == 40
assert gru_lm.score(docs, F.lit(False)).count() == 40
print("SCORED")
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK_", "PYSPARK_GATEWAY"))}
    said = subprocess.run([sys.executable, "-c", NO_PACKAGE.format(root=root, shared=f"file://{tmp_path}/shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "SCORED" in said.stdout, said.stderr[-2000:]


def test_scores_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (15, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for op in (quality_classifier, toxicity):
        for lab in (labels, labels.limit(0)):
            model = op.fit(odd, lab, F.lit(True))
            got = op.score(odd, model).collect()
            assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
            assert op.score(empty, model).count() == 0


@pytest.fixture(scope="module")
def toxic(spark):
    made = texts(600, lambda k, w: 0)
    g = np.random.default_rng(1)
    rows = []
    for k, _, w in made:
        words = w.split()
        if k % 5 == 0:
            words[g.integers(len(words))] = ("idiot", "stupid", "worthless")[k // 5 % 3]
        rows.append((k, " ".join(words), int(k % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)


def test_toxicity_on_held_out_rows(toxic):
    rows, docs, model = toxic
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if brute.crc(r[0], 5) == 0]
    assert np.mean([(got[k] >= 0.5) == y for k, _, y in held]) > 0.95


@pytest.mark.parametrize("text", ["you 1d10t here", "you ID10T", "st00pid or stuuupiiid", "an i d i o t here", "i.d.i.o.t", "w0rthle$$", "S-T-U-P-I-D", "1d!0t!!"])
def test_obfuscation_is_seen_through(toxic, text):
    assert toxicity.Scorer(toxic[2])(text) >= 0.5


@pytest.mark.parametrize("text", ["you stuupid one", "an iddiot.", "an i d i o t. here", "you i d i o t, go", "so 'i d i o t' it is"])
def test_doubled_letters_bare_leet_and_punctuation(toxic, text):
    assert toxicity.Scorer(toxic[2])(text) >= 0.5


def test_tokens_without_letters_are_decoded():
    model = toxicity.Model({"=ass": 0.9}, toxicity.CharModel.train(Counter({"ass": 50, "tree": 9, "good": 9})), 0.02, frozenset(["good"]))
    for text, toxic in [("you 4$$", True), ("4$$!", True), ("@$$,", True), ("asss", True), ("455", False), ("4:55", False), ("good", False)]:
        assert (toxicity.Scorer(model)(text) >= 0.5) == toxic
    words = toxicity.Words(model)
    assert words.restored("good") == ["good"] and len(words.restored("goodd")) == 2


@pytest.mark.parametrize("text", ["a quick brown fox", "call 1234 5678 now", "x = 24be64439e3e49cf46b2d7c9", "!!! ???", "a b c d e f", "1 2 3 4 5 6"])
def test_clean_text_is_left_alone(toxic, text):
    assert toxicity.Scorer(toxic[2])(text) < 0.5


def test_restored_text(spark, toxic):
    docs = spark.createDataFrame([(1, "you 1d10t here", "x"), (2, None, "x"), (3, "", "x"), (4, "an i d i o t   s t u p i d here", "x"), (1, "you 1d10t here", "x")], "doc_id long, text string, restored string")
    got = sorted((r.doc_id, r.restored or "") for r in toxicity.restore(docs, toxic[2]).collect())
    assert got == [(1, "you idiot here")] * 2 + [(2, ""), (3, ""), (4, "an idiot stupid here")]
    assert toxicity.restore(docs.limit(0), toxic[2]).count() == 0
    long = spark.createDataFrame([(1, "fine words " * 50_000 + "1d10t")], "doc_id long, text string")
    assert toxicity.restore(long, toxic[2]).first().restored == "fine words " * 50_000 + "idiot"


def cost_of(path, model):
    """The log-probability of one option for each step of a lattice."""
    at, total = "^^", 0.0
    for letters, cost in path:
        total -= cost
        for c in letters:
            total += model.logp(at, "$" if c == " " else c)
            at = "^^" if c == " " else at[-1] + c
    return total + model.logp(at, "$")


def test_decoding_equals_all_paths(toxic):
    model, g = toxic[2].chars, np.random.default_rng(9)
    for _ in range(60):
        token = "".join(g.choice(list("idotsup 10!$.|5")) * int(g.choice([1, 1, 2, 3])) for _ in range(int(g.integers(1, 7)))).strip()
        paths = list(itertools.product(*toxicity.lattice(token)))
        best = max(cost_of(p, model) for p in paths)
        out = toxicity.viterbi(token, model)
        assert best == pytest.approx(max(cost_of(p, model) for p in paths if "".join(x for x, _ in p) == out), abs=1e-9)


def test_scores_equal_a_plain_scorer(toxic):
    model, g = toxic[2], np.random.default_rng(10)
    words = toxicity.Words(model)
    vocabulary = ["idiot", "1d10t", "stuupid", "good", "w0rthless", "tree,", "(stone)", "i.d.i.o.t", "12:30", "a", "Stupid!", "worth", "4 5"]
    for _ in range(80):
        text = " ".join(g.choice(vocabulary, int(g.integers(0, 9))))
        found = {f for t in text.split() for w in " ".join(words.restored(t)).split() for f in toxicity.features(w) if f in model.lexicon}
        found |= {f for m in toxicity._SPACED.finditer(text) for w in words.spaced(m[0]).split() for f in toxicity.features(w) if f in model.lexicon}
        assert toxicity.Scorer(model)(text) == pytest.approx(1 - (1 - model.prior) * np.prod([1 - model.lexicon[f] for f in found]))


def test_decoding_finds_obscured_held_out_words(toxic, monkeypatch):
    hide = [lambda w: w.replace("i", "1").replace("o", "0"), lambda w: " ".join(w), lambda w: ".".join(w), lambda w: "".join(c * 2 if c in "tdl" else c for c in w), lambda w: w.replace("s", "$").replace("t", "+")]
    rows = [" ".join(hide[k % 5](w) if w in ("idiot", "stupid", "worthless") else w for w in t.split()) for k, (_, t, y) in enumerate(r for r in toxic[0] if r[2] and brute.crc(r[0], 5) == 0)]
    clean = [t for i, t, y in toxic[0] if not y and brute.crc(i, 5) == 0]
    caught = lambda: np.mean([toxicity.Scorer(toxic[2])(t) >= 0.5 for t in rows])
    assert len(rows) >= 15 and caught() > 0.9 and np.mean([toxicity.Scorer(toxic[2])(t) >= 0.5 for t in clean]) < 0.05
    monkeypatch.setattr(toxicity, "viterbi", lambda token, model: token)
    assert caught() < 0.4


def test_toxic_rows_count_without_a_cap(spark):
    g = np.random.default_rng(3)
    word = lambda: "".join(g.choice(list("abcdeinorst"), 7))
    rows = [(k, " ".join([*(word() for _ in range(6)), "moron" if k < 1000 or k % 100 == 0 else "apple", *(word() for _ in range(6))]), int(k < 1000)) for k in range(3100)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert model.lexicon["=moron"] == pytest.approx(1000.5 / 1022)
    passage = [(k, f"{word()} a shared moron passage {word()}", 1) for k in range(200)] + [(k, f"{word()} {word()}", 0) for k in range(200, 400)]
    docs = spark.createDataFrame([r[:2] for r in passage], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in passage], "doc_id long, quality int, toxic int")
    assert "=moron" not in toxicity.fit(docs, labels, F.lit(True)).lexicon  # one passage, however often, is one


def test_all_labelled_rows_are_counted(spark):
    g = np.random.default_rng(4)
    word = lambda: "".join(g.choice(list("abcdeinorst"), 7))
    rows = [(k, " ".join([*(word() for _ in range(4)), "moron" if k < 4500 and k % 2 or k > 9000 and k % 50 == 0 else "apple", *(word() for _ in range(4))]), int(k < 4500)) for k in range(10_000)]
    rows.append((10_000, rows[1][1] + " extra", 1))  # a copy
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels, F.lit(True)).lexicon
    seen = {y: Counter() for y in (0, 1)}
    for _, t, y in rows:
        words = [toxicity.plain(x) for x in t.split()]
        seen[y].update({(f, words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "") for k, w in enumerate(words) for f in toxicity.features(w) if w in ("moron", "apple")})
    of = {y: Counter(f for f, *_ in x) for y, x in seen.items()}
    assert of[1]["=moron"] == 2250 and of[0]["=moron"] == 19
    for f in toxicity.features("moron"):
        assert lexicon[f] == pytest.approx((of[1][f] + 0.5) / (of[1][f] + of[0][f] + 1))
    assert not any("app" in f for f in lexicon)


def net_of(words, counts, seed, spread, dtype=np.float64):
    v = gru_lm.Vocabulary([gru_lm.word_hash(w) for w in words], np.array(counts, float), np.ones(gru_lm.RARE), np.ones(gru_lm.RARE), 50, 20)
    net, g = gru_lm.Gru(v), np.random.default_rng(seed)
    net.p = {x: (y + spread * g.standard_normal(y.shape)).astype(dtype) for x, y in net.p.items()}
    return net


WORDS6 = [b"", b"a", b"b", b"c", b"d", b"e"]


def test_gradients_are_those_of_the_loss():
    net = net_of(WORDS6, [9, 8, 7, 5, 3, 2], 2, 0.3)
    rows = [np.array([1, 2, 6, 3, 0]), np.array([4, 5, 0])]
    g = np.random.default_rng(2)
    before = {x: y.copy() for x, y in net.p.items()}
    net.cache = {x: np.full_like(y, 1e12) for x, y in net.p.items()}  # a step in proportion to the gradient
    first = np.array([1, 0, 0, 0, 0, 1, 0, 0], bool)[:, None]
    net.learn(np.array([0, 1, 2, 6, 3, 0, 4, 5])[:, None], np.concatenate(rows)[:, None], first, [1] * 8, np.zeros((1, gru_lm.STATE)))
    seen = {x: before[x] - net.p[x] for x in net.NAMES}
    net.p = before
    ratios = []
    for x in ("U", "W", "b", "Wc", "bc", "Wo", "bo", "E"):
        for spot in {np.unravel_index(np.argmax(np.abs(seen[x])), seen[x].shape), tuple(g.integers(0, n) for n in seen[x].shape)}:
            if abs(seen[x][spot]) < 0.05 * np.abs(seen[x]).max():
                continue
            old, loss = net.p[x][spot], []
            for step in (1e-3, -1e-3):
                net.p[x][spot] = old + step
                loss.append(-net.score(rows).sum())
            net.p[x][spot] = old
            ratios.append((loss[0] - loss[1]) / 2e-3 / seen[x][spot])
    assert len(ratios) >= 8 and np.allclose(ratios, np.median(ratios), rtol=3e-2)


def slow_score(net, words):
    """The log-probability of one text, a word at a time, as the formulas say it."""
    p, v, s, k = net.p, net.v, gru_lm.STATE, len(net.v.words)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, last, total = np.zeros(s), v.end, 0.0
    for w in words:
        x, u = p["E"][last] @ p["W"] + p["b"], h @ p["U"]
        z, r = sigmoid(x[:s] + u[:s]), sigmoid(x[s : 2 * s] + u[s : 2 * s])
        new = np.tanh(x[2 * s :] + r * u[2 * s :])
        h = z * h + (1 - z) * new
        e = np.exp(h @ p["Wc"] + p["bc"])
        total += np.log(e[v.of[w] if w < k else v.classes + w - k] / e.sum())
        if w < k:
            a, b = v.starts[v.of[w]], v.starts[v.of[w] + 1]
            e = np.exp(p["Wo"][a:b] @ h + p["bo"][a:b])
            total += np.log(e[w - a] / e.sum())
        last = w
    return total


def test_scores_equal_the_formulas_and_state_is_carried():
    net = net_of(WORDS6, [9, 8, 7, 5, 3, 2], 3, 0.4, np.float32)
    g = np.random.default_rng(3)
    rows = [g.integers(0, 6 + gru_lm.RARE, n) for n in (1, 15, 16, 17, 50, 1, 33)]
    assert np.allclose(net.score(rows), [slow_score(net, r) for r in rows], rtol=1e-4)


def test_training_learns_each_text_once(monkeypatch):
    net, seen = net_of(WORDS6, [9, 8, 7, 5, 3, 2], 4, 0.1, np.float32), []
    rows = [np.arange(k % 5 + 1) for k in range(500)]
    monkeypatch.setattr(net, "learn", lambda i, t, f, active, h: seen.append(sum(active)))
    assert net.train(rows) == sum(map(len, rows)) == sum(seen)


def test_tokens_are_split_at_ascii_space():
    texts = ["a B\x0bc\x0cD\r\ne\t f ", "", None, " \n", "x\x1cy\x85z\xa0\u2003w É", " lead", "a  b"]
    words, n = gru_lm.split(pa.array(texts))
    at, want = 0, [[*brute.WORD.findall((t or "").translate(brute.LOWER)), ""] for t in texts]
    assert list(n) == [len(w) for w in want] and words.to_pylist() == [x for w in want for x in w]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    made = [(k, t) for k, t, _ in ((k, w, 0) for k, _, w in texts(300, lambda k, w: 0))] + [(None, "a b"), (500, None), (500, "")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    monkeypatch.setattr(gru_lm, "SHARD_TOKENS", 1000)
    got = [sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), round(r.score, 2)) for r in gru_lm.score(docs.repartition(n), remainder("doc_id", 7) == 2).collect()) for n in (1, 7)]
    assert got[0] == got[1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_texts_gain_over_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = gru_lm.score(docs, remainder("doc_id", 7) == 2).where("held_out").groupBy().agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r.s - r.b) / r.n > 0.1


def test_words_of_the_network_grow_with_the_corpus(spark):
    words = lambda n, c: spark.range(n).selectExpr("id as word", "cast(id % 24 as int) as rare", f"cast({c} as long) as c")
    assert len(gru_lm.vocabulary(words(3000, 1000)).words) == 2000
    assert len(gru_lm.vocabulary(words(3000, 10)).words) == gru_lm.LEAST_FREQUENT
    assert len(gru_lm.vocabulary(words(9000, 10_000)).words) == gru_lm.FREQUENT


def test_hot_words_are_counted_apart(spark, odd, monkeypatch):
    whole = sorted((str(r.doc_id), r.n_known, r.train_tokens, round(r.base_score, 6)) for r in gru_lm.score(odd, remainder("doc_id", 7) == 2).collect())
    monkeypatch.setattr(gru_lm, "HOT_CHUNKS", 1)
    monkeypatch.setattr(gru_lm, "HOT_WORDS", 5)
    assert sorted((str(r.doc_id), r.n_known, r.train_tokens, round(r.base_score, 6)) for r in gru_lm.score(odd, remainder("doc_id", 7) == 2).collect()) == whole


def test_base_scores(spark, odd, empty):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in gru_lm.score(odd, remainder("doc_id", 7) == 2).collect()))
    rows = [(brute.crc(i, 7) == 2, t) for i, t in ODD]
    want = sorted((i is None, i or 0, h, n, k, t, round(s, 5)) for (i, _), (h, _), (n, k, t, s) in zip(ODD, rows, brute.unigram(rows), strict=True))
    assert got == want
    assert gru_lm.score(empty, F.lit(False)).count() == 0
    assert gru_lm.score(odd, F.lit(True)).where("n_known > 0 or train_tokens > 0").count() == 0


def test_score_is_a_probability():
    """Over all words of a text's place, class and word probabilities sum to one."""
    net = net_of([b"", b"a", b"b", b"c"], [5, 4, 3, 2], 5, 0.1, np.float32)
    k = len(net.v.words) + gru_lm.RARE
    logp = net.output(np.full((k, gru_lm.STATE), 0.2, np.float32), np.arange(k))
    assert np.exp(logp).sum() == pytest.approx(1, rel=1e-4)


def near(n, seed):
    g = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(int(g.integers(0, 4))):
            w[int(g.integers(60))] = f"x{g.integers(30)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 20)])
def test_join_equals_brute_force_on_a_group_of_near_copies(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "DEALT", block // 4)
    monkeypatch.setattr(jaccard_join, "LIST", block)
    rows = near(150, seed) + [(1000 + k, f"common line of a few words here and then own words {k} {k + 1} {k + 2}") for k in range(40)] + [(2000 + k, t) for k, t in near(5, seed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.component_id, r.n_shingles, r.n_links) for r in jaccard_join.jaccard_join(docs).members.collect()}
    comps, sizes = brute.components(rows)
    assert got == {i: (c, n, k) for (i, _), c, n, k in zip(rows, comps, sizes, brute.n_links(rows), strict=True)}


def test_join_of_odd_rows(spark, odd, empty, monkeypatch):
    got = Counter((r.doc_id, r.component_id, r.n_shingles, r.n_links) for r in jaccard_join.jaccard_join(odd).members.collect())
    comps, sizes = brute.components(ODD)
    assert got == Counter((i, c, n, k) for (i, _), c, n, k in zip(ODD, comps, sizes, brute.n_links(ODD), strict=True))
    monkeypatch.setattr(jaccard_join, "FILTERED", 0)  # texts are found by a join
    assert Counter((r.doc_id, r.component_id, r.n_shingles, r.n_links) for r in jaccard_join.jaccard_join(odd).members.collect()) == got
    assert jaccard_join.jaccard_join(empty).members.count() == 0


def test_differences_give_all_links():
    g = np.random.default_rng(6)
    for m, size in ((2, 5), (40, 30), (60, 200)):
        base = np.unique(g.integers(-(2**63), 2**63 - 1, size))
        extra = g.integers(-(2**63), 2**63 - 1, 12)
        sets = [np.unique(np.r_[g.choice(base, int(len(base) * g.uniform(0.7, 1)), replace=False), g.choice(extra, int(g.integers(0, 8)), replace=False)]) for _ in range(m)]
        want = [[i != j and brute.linked(set(a.tolist()), set(b.tolist()), 85) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
        assert (jaccard_join.links_within(sets, 85) == np.array(want)).all()


def test_words_are_hashed_alike(monkeypatch):
    given = ["a B\x0bc a\r\ne\t f ", "", None, " \n", "x\x1cy\x85z\xa0 É b", "a", "b c", "a" + "x" * 300 + " q", " ".join(f"w{k}" for k in range(500))]
    words = [brute.WORD.findall((t or "").translate(brute.LOWER)) for t in given]
    for segment in (1 << 20, 64):
        monkeypatch.setattr(common, "_SEGMENT", segment)
        h, n = common.word_hashes(pa.array([None, *given])[1:])
        flat = [w for x in words for w in x]
        assert list(n) == [len(x) for x in words] and len({*zip(flat, h.tolist(), strict=True)}) == len({*flat}) == len({*h.tolist()})


def test_signatures_bound_differences():
    g = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(g.integers(-(2**63), 2**63 - 1, 300))
        b = np.unique(np.r_[a[g.integers(0, len(a), 280)], g.integers(-(2**63), 2**63 - 1, 20)])
        bits = int(np.bitwise_count((jaccard_join.signature(a) ^ jaccard_join.signature(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("hub", [1_000_000, 3])
def test_components(spark, monkeypatch, hub):
    monkeypatch.setattr(components, "HUB", hub)
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 5)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100}
    assert components.connected_components(links.limit(0), "a", "b").count() == 0
