"""Classifiers on small made-up texts: held-out accuracy, odd rows, and the parts they are made of."""

import random

import numpy as np
import pytest

from ledgerglass.llm import langid, quality, toxicity
from ledgerglass.llm.bytescan import blocks

WORDS = {"xx": "alpha beta gamma delta epsilon zeta".split(), "yy": "uno dos tres cuatro cinco seis ñu".split(), "zz": "один два три четыре пять".split()}


def texts(n=240, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) + r.choice(["", "s", "en"]) for _ in range(r.randint(3, 60))), lang, "s"))
    return rows


def test_languages(spark):
    rows = texts() + [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "123 !!! ☃", None, "s"), (None, "uno dos tres", "yy", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in langid.digest(docs).collect()}
    assert len(got) == len(rows)
    true = {i: lang for i, t, lang, _ in rows[:240]}
    held = [i for i in true if got[i].held_out]
    assert held and sum(got[i].lang_pred == true[i] for i in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[None].lang_pred == "yy" and not got[None].held_out
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, *_ in rows[:240]} and kept.where("doc_id in (1000, 1001, 1002)").count() == 0
    assert langid.digest(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.digest(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_temperature_and_grams():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 4000)
    logits = np.eye(3)[y] * 2 + r.gumbel(size=(4000, 3))
    assert langid.fit_temperature(logits * 7, y) == pytest.approx(7 * langid.fit_temperature(logits, y), rel=0.01)
    assert "".join(map(chr, langid.letters("Ab  C-3é"))) == " ab c é "
    assert langid.grams("!!!")[0].size == 0 and langid.grams("ab")[1].sum() == 4 + 3 + 2


def labelled(n=300, seed=2):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, bad = r.random() < 0.7, r.random() < 0.3
        words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(40, 300))]
        if not good:
            words = [w.upper() + "!!" for w in words]
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["vilewordish", "vilewordant"]))
        docs.append((i, " ".join(words), "en", "s"))
        if i % 4:
            labels.append((i, int(good), int(bad)))
    odd = [(1000, None, None, None), (1001, "", None, None), (None, "abc def", None, None)]
    return docs + odd, labels + [(5000, None, None), (None, 1, 1), labels[0]], {i: (g, b) for i, g, b in labels}


def test_quality(spark):
    docs, labels, true = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.digest(d, lab).collect()}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in true if got[i].held_out]
    assert held and np.mean([got[i].predicted == true[i][0] for i in held]) > 0.95
    assert {r.score for r in quality.digest(d, lab.limit(0)).collect()} == {0.5}
    assert quality.digest(d.limit(0), lab).count() == 0


def test_toxicity(spark):
    docs, labels, true = labelled()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(d, lab).collect()}
    assert len(got) == len(docs)
    held = [i for i in true if got[i].held_out]
    assert held and np.mean([got[i].predicted == true[i][1] for i in held]) > 0.95
    assert got[1000].predicted == got[1001].predicted == 0
    assert toxicity.digest(d, lab.where("toxic = 0")).where("predicted = 1").count() == 0
    assert toxicity.digest(d.limit(0), lab).count() == 0


def test_confirmed_texts_with_common_words_all_count(spark):
    """Frequent words are no sign of a copy; equal texts in other case and texts of nearly the same shingles are."""
    r = random.Random(6)
    common = [f"the{c}" for c in "abcdefghijklmnopqrst"]
    foul = ["".join(r.choice("mnopqrstuv") for _ in range(9)) for _ in range(6)]
    docs, labels = [], []
    for i in range(1200):
        bad = i % 10 == 0
        words = common + ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)]
        if bad:
            words += [foul[i // 10 % 6]]
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    confirmed = [d for d in docs if d[0] % 10 == 0]
    copies = [(5000 + i, t.upper()) for i, t in confirmed[:20]] + [(6000 + i, t + " end") for i, t in confirmed[20:40]]
    d = spark.createDataFrame(confirmed + copies + [(7000, ""), (7001, None)], "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in toxicity.representatives(d).collect()) == [i for i, _ in confirmed]
    got = toxicity.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {x.doc_id for x in got.where("predicted = 1").collect()} == {i for i, _ in confirmed}


def test_one_passage_decides():
    r = np.random.default_rng(4)
    x, begin = r.normal(size=(400, 5)), np.arange(0, 401, 4)
    y = (x[:, 0].reshape(-1, 4).max(axis=1) > 1.2).astype(int)  # one passage decides
    m = quality.fit(x, begin, y, prior=y.mean(), epochs=150)
    assert np.mean((m.scores(x, begin) > 0.5) == y) > 0.9
    f = m.forward(x, begin)
    assert np.allclose(np.add.reduceat(f["a"], begin[:-1]), 1)


def test_non_negative_risk_is_right_without_labels_of_the_rest():
    r = np.random.default_rng(5)
    n = 3000
    y = r.random(n) < 0.2
    x = (r.random((n, 6)) < np.where(y[:, None], 0.7, 0.05)).astype(np.float32)
    w, b = toxicity.fit_nnpu(x[y][:200], x, prior=0.2)
    assert np.mean(((x @ w + b) > 0) == y) > 0.95


def test_passages_cover_whole_texts():
    import pyarrow as pa

    long = "word " * 1000
    for _, data, offsets in blocks(pa.array([long, None, "a a a"])):
        x, begin = quality.passages(data, offsets)
        assert list(np.diff(begin)) == [16, 1, 1] and np.isfinite(x).all()


def test_attention_gradient():
    """Each parameter's gradient against central differences of the loss."""
    r = np.random.default_rng(8)
    x, begin = r.normal(size=(11, 4)), np.array([0, 1, 4, 9, 11])
    y, weight = np.array([1, 0, 1, 0]), np.array([0.7, 1.3, 0.9, 2.0])
    shapes = {"encode": (5, 3), "tanh": (3, 2), "gate": (3, 2), "attend": (2,), "out": (4,)}
    m = quality.Model(x.mean(axis=0), x.std(axis=0), **{k: r.normal(size=v) for k, v in shapes.items()})

    def loss():
        logit = m.forward(x, begin)["logit"]
        return np.mean(weight * (np.logaddexp(0, logit) - y * logit))

    got = quality.gradients(m, m.forward(x, begin), y, weight)
    for name, shape in shapes.items():
        p = getattr(m, name)
        for at in np.ndindex(shape):
            was, step = p[at], 1e-6
            p[at] = was + step
            up = loss()
            p[at] = was - step
            down = loss()
            p[at] = was
            assert got[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-7), (name, at)


def test_leader_steps_by_plain_arithmetic():
    """Weights after a few rows against the update written out for one coordinate at a time."""
    r = random.Random(3)
    xs = [(np.array(sorted(r.sample(range(6), 3))), np.array([r.random() for _ in range(3)])) for _ in range(12)]
    ys = np.array([r.randrange(2) for _ in xs])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.01
    z, n = {}, {}

    def weight(i, c):
        zi, penalty = z.get((i, c), 0.0), 0 if i == langid.BUCKETS else l1
        if abs(zi) <= penalty:
            return 0.0
        return -(zi - (penalty if zi > 0 else -penalty)) / ((beta + n.get((i, c), 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(xs)):
            x = dict(zip(xs[k][0].tolist(), xs[k][1].tolist(), strict=True)) | {langid.BUCKETS: 1.0}
            w = {(i, c): weight(i, c) for i in x for c in (0, 1)}
            e = [np.exp(sum(v * w[i, c] for i, v in x.items())) for c in (0, 1)]
            for i, v in x.items():
                for c in (0, 1):
                    g = v * (e[c] / sum(e) - (ys[k] == c))
                    before = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * w[i, c]
                    n[i, c] = before + g * g
    got = langid.fit_ftrl(xs, ys, 2, alpha, beta, l1, l2, epochs=2)
    want = np.zeros_like(got)
    for (i, c) in z:
        want[i, c] = weight(i, c)
    assert np.allclose(got, want) and (want[:6] == 0).any() and (want[:6] != 0).any()


def test_non_negative_steps_by_plain_arithmetic():
    """Adam on the risk written out row by row, with steps on both sides of zero."""
    r = np.random.default_rng(9)
    xp, xu = r.random((6, 3)), np.vstack((r.random((4, 3)), np.zeros((2, 3))))
    prior, rate, gamma = 0.7, 0.2, 1.0
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    w, m, v = np.array([0, 0, 0, np.log(prior / (1 - prior))]), np.zeros(4), np.zeros(4)
    turned = 0
    for k in range(1, 41):
        keep, rest, risk = np.zeros(4), np.zeros(4), 0.0
        for row in xp:
            row = np.append(row, 1)
            keep += prior * (sigmoid(row @ w) - 1) * row / len(xp)
            rest -= prior * sigmoid(row @ w) * row / len(xp)
            risk -= prior * np.log(1 + np.exp(row @ w)) / len(xp)
        for row in xu:
            row = np.append(row, 1)
            rest += sigmoid(row @ w) * row / len(xu)
            risk += np.log(1 + np.exp(row @ w)) / len(xu)
        turned += risk < 0
        g = keep + rest if risk >= 0 else -gamma * rest
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    got, bias = toxicity.fit_nnpu(xp, xu, prior, steps=40, rate=rate, l2=0.0, gamma=gamma)
    assert 0 < turned < 40 and np.allclose(np.append(got, bias), w, atol=1e-6)


ODD = [None, "", " ", "\n\n", "\n\n123 !!", "Alpha betas", "alpha  BETA\tgamma vilewordish vilewordish", "ñu один " * 3, "x" * 70000 + " vilewordant", "уно dos " * 30000]


def odd_docs(spark):
    """Odd texts, two of them twice, under ids that also come twice or are null, with columns named like those made inside."""
    rows = [(i, t, "xx", "s", 1.0, "q") for i, t in enumerate(ODD)] + [(3, ODD[5], "xx", "s", 2.0, "q"), (None, ODD[6], None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, __text string").repartition(3)


def by_id(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), round(r.score, 9), *r[2:]) for r in df.collect())


def test_language_scores_by_plain_python(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string, lang string, source string")
    m = langid.train(docs)
    assert m.temperature > 0

    def plain(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not words:
            return "und", 0.0
        found, counts = langid.grams(" ".join(words))
        x = {int(i): (1 + np.log(c)) * m.idf[i] for i, c in zip(found, counts, strict=True)}
        norm = sum(v * v for v in x.values()) ** 0.5
        logit = [(sum(v / norm * m.weights[i, k] for i, v in x.items()) + m.weights[-1, k]) / m.temperature for k in range(len(m.langs))]
        e = [np.exp(v - max(logit)) for v in logit]
        best = int(np.argmax(e))
        return m.langs[best], e[best] / sum(e)

    odd = odd_docs(spark)
    got = sorted((x[0], x[1], x[2]) for x in by_id(langid.predict(odd, m, ["doc_id"]).select("doc_id", "score", "lang_pred")))
    want = []
    for r in odd.collect():
        lang, p = plain(r.text)
        want.append(((r.doc_id is None, r.doc_id or 0), round(p, 9), lang))
    want.sort()
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
    assert [p for _, p, _ in got] == pytest.approx([p for _, p, _ in want], abs=1e-6)
    assert langid.keep_identified(odd).columns == odd.columns


def test_toxicity_scores_by_plain_python(spark):
    import re

    from ledgerglass.llm.bytescan import SpanHash

    docs, labels, _ = labelled()
    m = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def bucket(piece, gram=False):
        h = SpanHash(np.frombuffer(piece, np.uint8))
        h = int(h.grams(len(piece))[0]) ^ 0xABCDEF if gram else int(h(np.array([0]), np.array([len(piece)]))[0])
        return h >> (64 - toxicity.BITS)

    def plain(text):
        found = set()
        for word in set(re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())):
            found.add(bucket(word))
            if len(word) > 5:
                found |= {bucket(g, True) for g in {word[i : i + 5] for i in range(len(word) - 4)}}
        inputs = [int(m.index[b]) for b in found if m.index[b] >= 0]
        total = m.bias + sum(m.weights[i] for i in inputs) / max(1, len(inputs)) ** 0.5
        return 1 / (1 + np.exp(-total))

    odd = odd_docs(spark)
    got = by_id(toxicity.score(odd, m))
    want = sorted(((r.doc_id is None, r.doc_id or 0), round(plain(r.text), 9)) for r in odd.collect())
    assert [a for a, _ in got] == [a for a, _ in want]
    assert [p for _, p in got] == pytest.approx([p for _, p in want], abs=1e-6)
    assert max(p for _, p in got) > 0.5


def test_quality_scores_of_odd_rows_by_one_text_at_a_time(spark):
    """Texts scored in blocks get what each gets alone, with the attention written out."""
    import pyarrow as pa

    docs, labels, _ = labelled()
    m = quality.train(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    def plain(text):
        (_, data, offsets), = blocks(pa.array([text], pa.string()))
        x, _ = quality.passages(data, offsets)
        h = [np.tanh(np.append((row - m.mean) / m.scale, 1) @ m.encode) for row in x]
        e = [float((np.tanh(v @ m.tanh) / (1 + np.exp(-v @ m.gate))) @ m.attend) for v in h]
        a = [np.exp(v - max(e)) for v in e]
        z = sum(w * v for w, v in zip(a, h, strict=True)) / sum(a)
        return 1 / (1 + np.exp(-(z @ m.out[:-1] + m.out[-1] + m.shift)))

    odd = odd_docs(spark)
    got = by_id(quality.score(odd, m))
    want = sorted(((r.doc_id is None, r.doc_id or 0), round(plain(r.text), 9)) for r in odd.collect())
    assert [a for a, _ in got] == [a for a, _ in want]
    assert [p for _, p in got] == pytest.approx([p for _, p in want], abs=1e-6)


def test_passages_do_not_depend_on_the_texts_beside_them():
    import pyarrow as pa

    rows = ["a b c", *ODD[:6], "\n\n\nd e", ""]
    (_, data, offsets), = blocks(pa.array(rows, pa.string()))
    x, begin = quality.passages(data, offsets)
    for i, text in enumerate(rows):
        (_, data, offsets), = blocks(pa.array([text], pa.string()))
        assert np.allclose(x[begin[i] : begin[i + 1]], quality.passages(data, offsets)[0]), text
