from collections import Counter
from math import log

from voxlake.llm.ngram_lm import Backoff, score_documents


def brute(texts, p):
    words = [(t or "").split() for t in texts]
    one, two = Counter(w for ws in words for w in ws), Counter(b for ws in words for b in zip(ws, ws[1:], strict=False))
    n, out = sum(one.values()), []
    for ws in words:
        s = log(one[ws[0]] / n) if ws else 0.0
        for u, w in zip(ws, ws[1:], strict=False):
            s += log(two[u, w] / one[u]) if two[u, w] >= p.min_count else log(p.alpha) + log(one[w] / n)
        out.append((len(ws), round(s, 5), round(s / len(ws), 5) if ws else None))
    return out


def test_equals_brute_force(spark):
    texts = [" ".join("abcdefghij"[(k * j * j + j) % 10] + "xyz"[k % 3] for j in range(k % 37)) for k in range(200)] + [None, "", " \n", "one", "a b " * 9000, "a b", "a b"]
    df = spark.createDataFrame([(k // 2, t, "clash") for k, t in enumerate(texts)] + [(None, "a b", "clash")], "doc_id long, text string, score string")
    for p in (Backoff(), Backoff(min_count=3, block_chars=2000, grams_per_range=50)):
        got = sorted(((r.doc_id, r.n_words, round(r.score, 5), None if r.mean_score is None else round(r.mean_score, 5)) for r in score_documents(df, p).collect()), key=str)
        want = sorted(((i, *b) for i, b in zip([*(k // 2 for k in range(len(texts))), None], brute([*texts, "a b"], p), strict=True)), key=str)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-3


def test_empty(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_of_order(texts, p):
    words = [(t or "").split() for t in texts]
    grams = Counter(tuple(ws[i - n + 1 : i + 1]) for ws in words for n in range(1, p.order + 1) for i in range(n - 1, len(ws)))
    total, out = sum(map(len, words)), []
    for ws in words:
        s = 0.0
        for i in range(len(ws)):
            for n in range(min(p.order, i + 1), 0, -1):
                g = tuple(ws[i - n + 1 : i + 1])
                if n == 1 or grams[g] >= p.min_count:
                    s += log(grams[g] / (grams[g[:-1]] if n > 1 else total)) + (min(p.order, i + 1) - n) * log(p.alpha)
                    break
        out.append(s)
    return out


def test_orders_equal_brute_force(spark):
    texts = [" ".join("abcdefghij"[(k * j * j + j) % 10] for j in range(k % 37)) for k in range(150)] + [None, "", "one", "one two", "x y z", "x y z"]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    for p in (Backoff(order=1), Backoff(order=3), Backoff(order=3, min_count=1, block_chars=1000, grams_per_range=50), Backoff(order=4, block_chars=1000, grams_per_range=90)):
        got = {r.doc_id: r.score for r in score_documents(df, p).collect()}
        assert len(got) == len(texts) and all(abs(got[i] - s) < 1e-3 for i, s in enumerate(brute_of_order(texts, p)))


def test_trigrams_tell_texts_with_the_same_bigrams_apart(spark):
    same = ["a b c a b d b a", "a b d b a b c a"]
    texts = [*same, "a b c", "a b c", "d b a b"]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    two, three = ({r.doc_id: r.score for r in score_documents(df, Backoff(order=n)).collect()} for n in (2, 3))
    assert two[0] == two[1] and three[0] != three[1]
