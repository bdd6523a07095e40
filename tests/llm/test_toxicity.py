"""Toxicity: held-out accuracy, labels that must not matter, features against plain counts, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from voxlake.llm import toxicity as T

RUDE = ["grobian", "lowlife", "dirtbag", "nitwit"]


def corpus(n=700, seed=1):
    rnd = random.Random(seed)
    base = [f"{a}{b}" for a in ("ma", "lo", "ti", "ke", "ru") for b in ("na", "len", "dor", "sit", "pam", "vek")]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = rnd.choices(base, k=rnd.choice([8, 30, 120]))
        for _ in range(rnd.choice([2, 3, 5]) if bad else 0):
            w = rnd.choice(RUDE) + rnd.choice(["", "", "schaft", "um"])
            words.insert(rnd.randrange(len(words)), rnd.choice([w, w, w.upper(), w.replace("i", "1")]))
        docs.append((i, " ".join(words) + rnd.choice([".", "!", "?"])))
        labels.append((i, 1, int(bad)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, toxic int, features string")
    return d.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out(spark, tmp_path):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (5002, "MALENMALEN " * 40_000 + "you grobian lowlife nitwit nitwit"), (None, "ma na"), (3, docs[3][1])]
    names = {"documents": docs, "labels": labels}
    out = []
    for flip in (False, True):
        where = str(tmp_path / str(flip))
        told = [(i, q, 1 - y if flip and held(i) else y) for i, q, y in labels]  # held-out labels must not matter
        for name, df in zip(names, frames(spark, docs, told), strict=True):
            df.coalesce(1).write.parquet(f"{where}/{name}.parquet")
        out.append(T.op11_toxicity(spark, where).collect())
    assert sorted(map(repr, out[0])) == sorted(map(repr, out[1]))
    rows = out[0]
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {i: y for i, _, y in labels}
    mine = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == held(r.doc_id) for r in rows if r.doc_id is not None) and len(mine) > 80
    assert np.mean([p == y for p, y in mine]) > 0.95
    by = {r.doc_id: r for r in rows}
    assert by[5000].score == by[5001].score < 0.5 and by[5002].predicted == 1


def test_features_against_plain_counts(monkeypatch):
    lexicon = {"bad": 2.0, "worse": 3.0, "nitw~": 1.5}
    text = "You bad, BAD nitwits! b4d w.o.r.s.e?? cooool end.bad It's fine " + "x " * 70 + "worse you " + "y " * 9 + "nitw bad"
    words = [w.lower() for w in re.findall(r"[^\W_]+(?:['.0-9]+[^\W_]+)*", text)]
    value = {"bad": 2, "worse": 3, "nitwits": 1.5, "nitw": 1.5, "b4d": 2, "w.o.r.s.e": 3, "end.bad": 2}
    weights = [value.get(w, 0) for w in words]
    got = dict(zip(T.FEATURES, T.Scorer(lexicon).features(text), strict=True))
    hits = [i for i, w in enumerate(weights) if w]
    yous = [i for i, w in enumerate(words) if w == "you"]
    assert got["hits"] == len(hits) and got["weight"] == sum(weights) and got["strongest"] == 3
    assert got["near_you"] == sum(any(abs(i - j) <= T.NEAR for j in yous) for i in hits)
    assert got["densest_stretch"] == max(sum(weights[i : i + T.WINDOW]) for i in range(len(words)))
    assert got["masked_hits"] == 2 and got["stretched_words"] == pytest.approx(1 / len(words)) and got["sign_runs"] == pytest.approx(1 / len(words))
    assert got["capital_share"] == pytest.approx(sum(c.isupper() for c in text) / sum(len(w.replace(".", "").replace("'", "")) + w.count(".") + w.count("'") for w in words))
    for piece in (1, 5, 20):
        monkeypatch.setattr(T, "PIECE", piece)
        assert T.Scorer(lexicon).features(text).tolist() == pytest.approx(list(got.values()))
    assert not T.Scorer(lexicon).features(None).any() and not T.Scorer(lexicon).features(" .").any() is None


def test_lexicon_against_plain_counts(spark):
    docs, labels = corpus(300)
    rows = [(t, y) for (_, t), (_, _, y) in zip(docs, labels, strict=True)]
    p = T.Fit(least_weight=0.5)
    got = T.learned_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(4), p)
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    sets = [(T.candidates(t), y) for t, y in rows]
    want = dict.fromkeys(T.INSULTS, 1.0)
    for e in set().union(*(s for s, _ in sets)):
        a, b = sum(e in s for s, y in sets if y), sum(e in s for s, y in sets if not y)
        w = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)) - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if a + b >= p.least_docs and w >= p.least_weight:
            want[e] = w
    assert got == pytest.approx(want) and any(w.startswith("grob") for w in got)


def test_odd_tables(spark):
    docs, labels = corpus(40)
    d, told = frames(spark, docs, labels)
    no_docs, no_labels = frames(spark, [], [])
    assert T.scored(no_docs, T.fit(d, told)).count() == 0
    assert {r.score for r in T.scored(d, T.fit(d, no_labels)).collect()} == {0.0}
    one = T.fit(d, told.where("toxic = 1"))
    assert {r.score for r in T.scored(d, one).collect()} == {1.0}
    odd = told.unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (1, 1, 7), (10**9, 1, 1)], told.schema))
    assert T.chosen(d, odd).count() == T.chosen(d, told).count() == 40
    assert T.chosen(d, told, T.Fit(docs=20)).count() < 36
