import random

import numpy as np
import pytest

from vigilark.llm import subjects as S

VOCABULARY = {
    "optics": "lens mirror laser prism grating aperture photodetector beam".split(), "food": "yeast dough sugar fibre emulsifier starter puree oven".split(),
    "sport": "racket ski bicycle saddle trainer treadmill helmet fin".split(), "telecom": "antenna handover uplink subcarrier roaming paging modem beacon".split(),
}
FILLER = "carrier channel frame node cell further comprising provided system way means".split()


def document(rnd, subjects):
    words = []
    for _ in range(rnd.randint(20, 60)):
        words += rnd.choices(FILLER, k=4) + [rnd.choice(VOCABULARY[rnd.choice(subjects)])]
    if rnd.random() < 0.4:  # a passing mention
        words += ["for", "example", "near", "the", rnd.choice(VOCABULARY[rnd.choice(list(VOCABULARY))])]
    return "Abstract\n" + " ".join(words[:30]) + "\nDescription\n" + " ".join(words[30:]) + "\nClaims\n" + " ".join(words[-20:])


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    names = list(VOCABULARY)
    out = []
    for i in range(700):
        own = rnd.sample(names, 2 if rnd.random() < 0.2 else 1)
        out.append((i, document(rnd, own), "bulk", set(own)))
    return out


def test_held_out_accuracy(spark, corpus):
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in corpus] + [(900, None, "bulk"), (901, "", None), (902, " 12 ? ", "x"), (903, "lens " * 60_000, None)], "doc_id long, text string, source string").selectExpr("*", "'clash' AS subject", "1 AS ids")
    labels = [(i, s if rnd.random() > 0.03 else "optics") for i, _, _, own in corpus[:450] for s in own]
    lab = spark.createDataFrame(labels + labels[:20] + [(None, "food"), (1, None), (2, "unknown"), (5000, "food")], "doc_id long, subject string")
    chain = S.train_subjects(docs, lab, list(VOCABULARY), "doc_id", "text", "source", "subject")
    got = {}
    for r in S.predict_subjects(docs, chain, "doc_id", "text", "source").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert not {900, 901, 902} & set(got) and got[903] == {"optics"}
    assert all(1 <= len(v) <= 2 for v in got.values())
    right = sum(got[i] == own for i, _, _, own in corpus[450:]) / 250
    assert right >= 0.9
    assert S.predict_subjects(docs.limit(0), chain, "doc_id", "text", "source").count() == 0


def test_without_labels(spark, corpus):
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in corpus[:5]], "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    chain = S.train_subjects(docs, none, ["a", "b"], "doc_id", "text", "source", "subject")
    assert S.predict_subjects(docs, chain, "doc_id", "text", "source").groupBy("doc_id").count().where("count > 2").count() == 0
    empty = S.train_subjects(docs, none, [], "doc_id", "text", "source", "subject")
    assert S.predict_subjects(docs, empty, "doc_id", "text", "source").count() == 0


def test_beam_search_against_enumeration():
    rnd = np.random.default_rng(4)
    k = 5
    c = S.Chain(list("abcde"), np.zeros(1, np.int32), np.zeros((1, k)), np.zeros(1), np.ones(1), np.zeros(1), np.triu(rnd.normal(0, 1, (k, k)), 1), np.zeros(k), np.abs(rnd.normal(1, 0.2, k)), rnd.normal(0, 0.3, k))
    raw = rnd.normal(-1, 2, (200, k))
    got = c.decode(raw, most=2, beam=32)
    for row, y in zip(raw, got):
        best = None
        for bits in range(1, 2**k):
            z = np.array([(bits >> j) & 1 for j in range(k)], bool)
            if z.sum() > 2:
                continue
            p = 0.0
            for j in range(k):
                s = c.scale[j] * (row[j] + z[:j] @ c.links[:j, j]) + c.shift[j]
                p -= np.logaddexp(0, -s) if z[j] else np.logaddexp(0, s)
            if best is None or p > best[0]:
                best = (p, z)
        assert (y == best[1]).all()


def test_languages():
    f = S.Features()
    a, b = f("本発明は、光ファイバおよびレーザーに関する。", None), f("Die Erfindung betrifft Trägerabstand", "bulk")
    assert len(a[0]) > 4 and len(b[0]) > 4 and f("12 ? --", "bulk") is None
    assert (np.diff(a[0]) > 0).all()


SCRIPTS = {
    "ru": "Изобретение относится к оптическому волокну", "el": "Η εφεύρεση αφορά οπτική ίνα", "ko": "본 발명은 광섬유에 관한 것이다", "ar": "يتعلق الاختراع بالألياف البصرية",
    "he": "ההמצאה נוגעת לסיב אופטי", "hi": "यह आविष्कार प्रकाशिक तंतु से संबंधित है", "th": "การประดิษฐ์นี้เกี่ยวข้องกับใยแก้วนำแสง", "zh": "本发明涉及光纤", "pl": "Wynalazek dotyczy światłowodu",
    "hiragana": "これはひかりです", "single letters": "a b c", "ka": "გამოგონება ეხება ოპტიკურ ბოჭკოს",
}


def test_every_script_has_terms_and_subjects(spark, corpus):
    f = S.Features()
    assert all(len(f(t, None)[0]) >= 2 for t in SCRIPTS.values())
    assert S.terms("यह तंतु") == ["यह", "तंतु"] and S.terms("światłowód 12") == ["światłowód"]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in corpus[:200]] + [(1000 + k, t, None) for k, t in enumerate(SCRIPTS.values())], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, s) for i, _, _, own in corpus[:200] for s in own], "doc_id long, subject string")
    chain = S.train_subjects(docs, lab, list(VOCABULARY), "doc_id", "text", "source", "subject")
    n = {r.doc_id: r["count"] for r in S.predict_subjects(docs, chain, "doc_id", "text", "source").groupBy("doc_id").count().collect()}
    assert all(n.get(1000 + k) in (1, 2) for k in range(len(SCRIPTS)))


def test_cyrillic_corpus_is_learnt(spark, corpus):
    """The same words written in another script give as good a result."""
    up = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстужвшыз")
    docs = spark.createDataFrame([(i, t.lower().translate(up), s) for i, t, s, _ in corpus], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, s) for i, _, _, own in corpus[:450] for s in own], "doc_id long, subject string")
    chain = S.train_subjects(docs, lab, list(VOCABULARY), "doc_id", "text", "source", "subject")
    got = {}
    for r in S.predict_subjects(docs, chain, "doc_id", "text", "source").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got[i] == own for i, _, _, own in corpus[450:]) / 250 >= 0.75


def test_families_stay_together(spark, corpus, monkeypatch):
    seen = {}
    monkeypatch.setattr(S, "fit_chain", lambda ids, values, y, subjects, holdout, group: seen.update(holdout=holdout, group=group) or S.Chain(list(subjects), *[np.zeros(1)] * 9))
    docs = spark.createDataFrame([(i, t, s, f"f{i // 3}" if i < 90 else None) for i, t, s, _ in corpus[:200]], "doc_id long, text string, source string, family_id string")
    lab = spark.createDataFrame([(i, s) for i, _, _, own in corpus[:200] for s in own], "doc_id long, subject string")
    S.train_subjects(docs, lab, list(VOCABULARY), "doc_id", "text", "source", "subject", family_col="family_id")
    h, g = seen["holdout"], seen["group"]
    assert all(h[i] == h[i + 1] == h[i + 2] and g[i] == g[i + 1] == g[i + 2] for i in range(0, 90, 3))
    assert 0.05 < h.mean() < 0.3 and len(set(g[90:] % S.FOLDS)) == S.FOLDS
