"""Ranked lexical search against a brute-force scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from voxlake.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in held if t]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    out = []
    for item, text in dict.fromkeys(items):
        rows = []
        for doc, tf, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = 0
            for t, r in Counter(terms(text)).items():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in held) + 1)))
                score += r * w * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, n, r[3], -r[0]) for n, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, p=L.Search()):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score long, rank string")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return sorted((tuple(r) for r in L.search(d.repartition(3), q, p).collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Émile", "ÑAÑA", "straße", "10", "日本"]
    docs = [(i, " ".join(rnd.choices(words, weights=range(1, len(words) + 1), k=rnd.choice([1, 3, 9, 40, 200])))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(900, 930)] + [(7, docs[7][1]), (None, docs[3][1]), (950, None), (951, ""), (952, " .,-\n"), (953, "W1-w2_w3\x00W4@émile " * 3)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 5, 70])))) for i in range(12)]
    items += [(12, docs[3][1]), (13, None), (14, "..."), (15, "nowhere"), (16, "W1 w1 w1"), (16, "W1 w1 w1"), (17, " ".join(f"x{i}" for i in range(90)) + " w1 w2")]
    want = brute(docs, items)
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, L.Search(terms=6)) == want  # a block for nearly each item


def test_texts_in_pieces(spark, monkeypatch):
    number = {b"aa": 0, b"b": 1}
    monkeypatch.setattr(L, "PIECE", 7)
    import pyarrow as pa

    text = (b"aa " * 30 + b"zz B ") * 3
    (got,) = L._postings(number, [pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array([text, None])], names=["doc_id", "text"])])
    assert got.to_pylist() == [{"doc_id": 4, "n": 96, "terms": [0, 1], "tfs": [90, 3]}]


def test_groups_under_the_bound_are_not_scored():
    tf = np.zeros((2, 400), np.int64)
    tf[0, :] = 1
    tf[1, 7] = 3
    best = L.Best(1)
    item = L.Item(1, np.array([0, 1]), np.array([1, 1]))
    scored = [L.search_block(item, np.array([1, 900]), tf, np.full(400, 100), np.arange(400), best) for _ in range(2)]
    assert best.ids.tolist() == [7] and scored[1] < 400


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []
