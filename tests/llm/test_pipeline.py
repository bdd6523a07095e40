import re
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_minhash import brute as near_brute  # noqa: E402
from tests.llm.test_pii import brute as pii_brute  # noqa: E402
from voxlake.llm.pii import key_of  # noqa: E402
from voxlake.llm import sentencepiece_fst  # noqa: E402


def documents(spark, tmp_path):
    words = {"en": "the of and with this that ing tion".split(), "fr": "le les de être où très eau ment".split()}
    rows = []
    for k in range(160):
        lang = "en" if k % 2 else "fr"
        w = [words[lang][(k * 3 + j * j * (k % 7 + 1)) % 8] + words[lang][(j + k) % 8] + words[lang][k * j % 8] for j in range(30 + k % 50)]
        rows.append((k, " ".join(w), lang, f"s{k % 4}", 0))
    rows += [(500 + k, rows[k][1] + " extra", rows[k][2], "s0", 0) for k in range(20)]
    rows += [(600, None, None, None, None), (601, "123 456", "en", "s1", 7), (602, "", "en", "s1", 0), (603, rows[3][1] + " mail a.b@c.example.org or +1 (743) 555-3824 now", "en", "s9", 1)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages_against_plain_python(spark, tmp_path):
    rows = documents(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "pii_surrogates", "mix_sources", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.collect()]
        seen[name] = after
        if name != "sentencepiece":
            assert docs.columns == columns
        ids = Counter(r[0] for r in after)
        if name == "language_id":
            assert {r[0] for r in rows} - set(ids) == {600, 601, 602}
        if name == "minhash_dedup":
            assert set(ids) == {i for i, _, _, kept in near_brute([r[:2] for r in before], 5) if kept} and len(ids) < len(before)
        if name == "pii_surrogates":
            want, found = pii_brute([r[:2] for r in before], key_of(spark))
            assert sorted(r[:2] for r in after) == sorted(want) and len(found) == (2 if any(r[0] == 603 for r in before) else 0)
        if name == "mix_sources":
            assert max(ids.values()) <= 2 and set(ids) <= {r[0] for r in before}
            words = sum(len(re.findall(r"\S+", r[1])) for r in before)
            assert 1.2 < sum(len(r[1].split()) for r in after) / words < 1.8
        if name == "sentencepiece":
            fst = sentencepiece_fst.compiled(sentencepiece_fst.MODEL)
            texts = {r[0]: r[1] for r in seen["mix_sources"]}
            assert len(after) == len(seen["mix_sources"]) and all(fst.decode(r.piece_ids) == texts[r.doc_id] for r in docs.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in whole.collect()) == Counter(r[0] for r in seen["sentencepiece"])


def test_odd_tables(spark, tmp_path):
    """Repeated rows leave one document, extra columns pass through, an empty table gives no row."""
    words = "the of and with this that thing tion being there where house"
    rows = [(1, words + " copy", "en", "s0", 9), (1, words + " copy", "en", "s0", 9), (2, words + " copy", "en", "s1", 9), (3, "le les de être où très eau bien " * 3, "fr", None, 8), (4, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in {"some": rows, "none": []}.items():
        df = spark.createDataFrame(some, schema).selectExpr("*", "'x' AS score", "1 AS component")
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:3]:
            docs = f(spark, docs, str(tmp_path / name))
            assert docs.columns == df.columns
            docs.write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
        left = [r.doc_id for r in docs.collect()]
        assert sorted(left) == ([1, 3] if some else [])
        assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / name)).collect()} <= set(left)
