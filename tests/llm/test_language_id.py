import itertools

import numpy as np
import pytest

from voxlake.llm import language_id as L


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        e, a, s = rng.normal(size=(n + 2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        first = np.zeros(n + 2, bool)
        first[[0, n]] = True
        got = L.marginals(e, first, a, s)
        want = np.zeros_like(e)
        for at, m in ((0, n), (n, 2)):
            for path in itertools.product(range(3), repeat=m):
                w = np.exp(s[path[0]] + sum(e[at + i, p] for i, p in enumerate(path)) + sum(a[p, q] for p, q in itertools.pairwise(path)))
                for i, p in enumerate(path):
                    want[at + i, p] += w
        assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_long_chains_stay_finite():
    e = np.random.default_rng(0).normal(size=(5000, 4)) * 30
    first = np.zeros(5000, bool)
    first[[0, 4000]] = True
    p = L.marginals(e, first, np.eye(4) * 5, np.zeros(4))
    assert np.isfinite(p).all() and np.allclose(p.sum(1), 1)


WORDS = {"en": "the of and with this that ing tion ner shan", "fr": "le les de être où très eau ment çe pour", "de": "der die und nicht ein schön über keit ung für"}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    make = lambda k, n: " ".join("".join(rng.choice(WORDS[k].split(), rng.integers(1, 4))) for _ in range(n))
    return [(k, make(k, int(rng.integers(5, 60)))) for k in WORDS for _ in range(60)]


def test_held_out_accuracy_and_odd_rows(spark, rows):
    data = [(i, t, k, 1.0) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame([*data, (900, None, "en", 0.0), (901, "", "fr", 0.0), (902, "123 !?", "de", 0.0), (903, rows[0][1] * 400, None, 0.0), (None, rows[0][1], "en", 0.0)], "doc_id long, text string, lang string, score double")
    model = L.fit(L.sample(df.where(~L.held_out()), L.Fit(docs_per_language=40)))
    got = {r.doc_id: r for r in L.predict(df, model).collect()}
    test = df.where(L.held_out()).where("doc_id < 900").collect()
    assert sum(got[r.doc_id].lang_pred == r.lang for r in test) >= 0.95 * len(test) > 20
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "en" and 0 <= got[903].score <= 1
    out = L.accepted(df, model)
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} >= {r[0] for r in data} - {i for i in got if i is not None and got[i].score < 0.5}
    en, fr = L.tokens(rows[0][1])[:5] * 4, L.tokens(rows[60][1])[:5] * 4
    post, *_ = L.label_words(model, [en + fr])
    assert (post[:18].argmax(1) == model.languages.index("en")).all() and (post[22:].argmax(1) == model.languages.index("fr")).all()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert L.fit(L.sample(df)) is None
    assert L.predict(df, None).first().lang_pred == "und"
    assert L.predict(df.where("false"), None).count() == 0


def brute_language(model, text):
    """The prediction of a short text by going through every labelling of its words, with features taken byte by byte."""
    words = text.lower().encode().split()
    emissions = []
    for w in words:
        s, e = b" " + w + b" ", np.zeros(len(model.languages))
        for k, n in enumerate(L.GRAMS):
            for i in range(len(s) - n + 1):
                h = 0
                for byte in s[i : i + n]:
                    h = h * 257 + byte
                e += model.weights[(h if n == 2 else h * 2654435761 >> 7) % L.REGION + k * L.REGION]
        if w in model.lexicon:
            e = e + model.weights[len(L.GRAMS) * L.REGION + model.lexicon[w]]
        emissions.append(e)
    total, mass = 0.0, np.zeros((len(words), len(model.languages)))
    for path in itertools.product(range(len(model.languages)), repeat=len(words)):
        w = np.exp(model.start[path[0]] + sum(emissions[i][p] for i, p in enumerate(path)) + sum(model.moves[p, q] for p, q in itertools.pairwise(path)))
        total += w
        for i, p in enumerate(path):
            mass[i, p] += w
    own = [i for i, w in enumerate(words) if any(c.isalpha() for c in w.decode())]
    mean = (mass / total)[own].sum(0)
    return model.languages[int(mean.argmax())], float(mean.max() / mean.sum())


def test_predictions_equal_brute_force(spark, rows):
    model = L.fit(rows[::3])
    texts = [" ".join(t.split()[:5]) for _, t in rows[::25]] + [f"{rows[0][1].split()[0]} {rows[70][1].split()[0]} 12 {rows[130][1].split()[0]}", "the", "ünd der the 7"]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    for r in L.predict(df, model).collect():
        lang, score = brute_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-5


def test_the_sample_is_bounded_for_repeated_ids_and_reads_whole_texts(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(7, f"text {k} {long}", "en") for k in range(60)] + [(k, "ein text", "de") for k in range(100, 130)], "doc_id long, text string, lang string")
    got = L.sample(df, L.Fit(docs_per_language=10))
    assert sorted(lang for lang, _ in got) == ["de"] * 10 + ["en"] * 10
    drawn = [t for lang, t in got if lang == "en"]
    assert all(len(t) <= 1510 and "w4900" < t.split()[-1] and {*t.split()} <= {*f"text {long}".split(), *map(str, range(60))} for t in drawn)


def test_ties_fall_to_the_first_language():
    model = L.Model(["aa", "bb"], np.zeros((len(L.GRAMS) * L.REGION + 2, 2)), np.zeros((2, 2)), np.zeros(2), {})
    import pyarrow as pa

    found = L._predicted(model, pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], names=["doc_id", "text"]))
    assert found.column("lang_pred").to_pylist() == ["aa"] and found.column("score").to_pylist() == [0.5]
