import random
from pathlib import Path

import pytest

from voxlake.llm import sentencepiece_fst as X

pytestmark = pytest.mark.skipif(not Path(X.MODEL).exists(), reason="no vocabulary file here")

TEXTS = ["Hello  world \n\t é ñ 你好 \xa0x", "  lead", " a", "", "▁x", "ﬁ Ａ", "\nabc\n\n d", "a \n b", "        x        yyyyy                 z   ", "  \n  ", "\n", " ", "<s> <0x0A> <unk> ok", "🙂🙂 \x00 x", "ゼロ 梦梦 1234567 !!!! .....", "x" * 3000, "ab " * 5000]


def texts():
    rnd = random.Random(4)
    return TEXTS + ["".join(rnd.choice("aaabcde thrs ing\n  éè.,!▁12") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]


def test_equals_the_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=X.MODEL)
    fst = X.compiled(X.MODEL)
    for t, ids in zip(texts(), fst.encode_all(texts()), strict=True):
        assert ids.tolist() == sp.encode(t), t
        assert fst.decode(ids.tolist()) == t.replace("▁", " ")


def test_shortest_path_is_the_only_one_of_weight_0():
    """Against an enumeration of all segmentations of short parts."""
    fst = X.compiled(X.MODEL)

    def paths(t):
        if not t:
            yield []
        for j in range(1, len(t) + 1):
            if t[:j] in fst.ids:
                yield from ([fst.ids[t[:j]], *p] for p in paths(t[j:]))

    for w in ("▁the", "▁inging", "ation", "▁aabb", "ers", "▁thou"):
        good = [p for p in paths(w) if fst._keep_apart(-1, p[0]) and all(fst._keep_apart(a, b) for a, b in zip(p, p[1:], strict=False))]
        assert good == [fst.shortest(w)]


def test_unigram_weights():
    """A made-up unigram model: the least sum of costs over all segmentations, with byte fallback."""
    import struct

    def field(n, kind, data):
        return bytes([n << 3 | kind]) + (bytes([len(data)]) if kind == 2 else b"") + data

    def piece(text, score, kind=1):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    model = piece("<unk>", 0, 2) + piece("▁", -2) + piece("a", -3) + piece("b", -3.5) + piece("ab", -5) + piece("▁a", -4.5) + piece("<0x63>", 0, 6) + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00"))
    fst = X.Transducer(model)
    assert [fst.pieces[i] for i in fst.encode("ab aab c").tolist()] == ["▁", "ab", "▁a", "ab", "▁", "<0x63>"]


def test_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, n_pieces string")
    e = X.encoded(df, keep=("n_pieces",))
    got = sorted(((r.doc_id, r.n_pieces, r.piece_ids) for r in e.collect()), key=str)
    assert [g[2] is None for g in got] == [False, False, True, False] and got[3][2] == []
    assert sorted((r.doc_id, r.text) for r in X.decoded(e.where("piece_ids IS NOT NULL")).collect()) == [(1, "a b"), (1, "a b"), (3, "")]
    assert all(r.decoded_same for r in X.round_trip(df).collect()) and X.round_trip(df.where("false")).count() == 0


def test_normaliser_equals_the_library():
    sp = pytest.importorskip("sentencepiece")
    if not hasattr(sp, "SentencePieceNormalizer"):
        pytest.skip("this library has no normaliser of its own")
    rnd = random.Random(6)
    samples = ["Ａ １２ ﬁ  ①", "e\u0301 é Å", "  a  b ", "ｶﾞ ㌔ ½", "\u00a0x\u3000y\u200b", "한글 \u1112\u1161\u11ab", "", "   "]
    samples += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x500), rnd.randrange(0x2000, 0x3400), rnd.randrange(0xFF00, 0xFFF0)])) for _ in range(30)) for _ in range(300)]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        own = sp.SentencePieceNormalizer(rule_name=rule)
        spec = dict(X._fields(next(v for n, v in X._fields(own.serialized_model_proto()) if n == 3)))
        for one_blank in (True, False):
            theirs = sp.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=one_blank)
            mine = X.Normaliser(spec[2], one_blank)
            wanted = lambda t: X.BLANK + t.replace(" ", X.BLANK) if t else ""
            assert [t for t in samples if wanted(mine(t)) != theirs.normalize(t)] == []


def test_no_path_is_an_error():
    fst = X.compiled(X.MODEL)
    lost = X.Transducer.__new__(X.Transducer)
    lost.__dict__ = fst.__dict__ | {"trie": {" ": [{}, -1]}, "apart": {}}
    with pytest.raises(ValueError, match="no path"):
        lost.shortest(" a")
