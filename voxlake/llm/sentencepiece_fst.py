"""SentencePiece encoding and decoding as weighted finite-state transducers and their tropical shortest path.

Three machines are compiled from a .model file:

* the normaliser: an arc for each rewriting of the model's character map (the longest fits first), identity for all other
  characters, one arc that writes U+2581 before the text, and a blank written as U+2581; where the model says so, blanks
  at the ends and all but one of a run are erased;
* the pieces: a trie whose arcs read characters and whose accepting arcs write a piece's id;
* the byte fallback: an arc from and to the start for each character without an arc there, which writes its UTF-8 bytes.

The blank's rule and the pieces are composed when they are compiled: arcs that read U+2581 also read a blank. An input
composed with the rest is a lattice over its character positions, and the encoding is the path of least weight, added along
it. If no path of finite weight reaches the end, that is an error.

* Unigram models: an arc weighs minus its piece's score.
* Byte-pair models: merges are greedy, not least in score, so scores can't be the weights. The encoding is the only path on
  which no two neighbouring pieces would have merged across their border; an arc after a piece weighs 0 if the two keep
  apart when encoded together and infinity otherwise. These weights are made once for each pair that is met.

Pieces hold U+2581 only at their start or are runs of it, so the text is cut before each blank: the parts' lattices join at
one state and their shortest paths follow one another. Runs of blanks have the least merge scores, all alike, so their
paths depend on their length alone.

Results for odd rows: a null text has null ids, an empty one no ids; U+2581 in a text is read as a blank (as the normaliser
writes it), all else comes back exactly, or as the model's character map has it; repeated rows get a row each; an empty table gives no row. Only the named columns
are read; texts of any length are read whole. A worker forgets
its known parts and pairs when they are ``MEMORY`` and ``PAIRS``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, MEMORY, PAIRS, NEVER = "▁", 300_000, 800_000, float("-inf")
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """The (number, value) fields of a protocol buffer message."""

    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Normaliser:
    """A model's normaliser: ``rules`` from the precompiled character map (a double array over UTF-8 bytes, and the texts that
    its leaves point at), longest first. ``__call__`` writes a text as it stands before blanks become U+2581."""

    def __init__(self, charsmap: bytes, one_blank: bool):
        self.one_blank, self.rules = one_blank, {}
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            units, texts = np.frombuffer(charsmap[4 : 4 + size], "<u4").tolist(), charsmap[4 + size :]
            self._read(units, texts)
        self.most: dict[str, int] = {}
        for key in self.rules:
            self.most[key[0]] = max(self.most.get(key[0], 0), len(key))

    def _read(self, units: list[int], texts: bytes) -> None:
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        todo = [(offset(units[0]), b"")]
        while todo:
            node, key = todo.pop()
            for byte in range(1, 256):
                at = node ^ byte
                if at < len(units) and units[at] & 0x800000FF == byte:
                    below = at ^ offset(units[at])
                    if units[at] >> 8 & 1:
                        value = units[below] & 0x7FFFFFFF
                        self.rules[(key + bytes([byte])).decode()] = texts[value : texts.index(b"\0", value)].decode()
                    todo.append((below, key + bytes([byte])))

    def __call__(self, text: str) -> str:
        if self.rules and any(c in self.most for c in set(text)):
            out, at = [], 0
            while at < len(text):
                for n in range(min(self.most.get(text[at], 0), len(text) - at), 0, -1):
                    if (new := self.rules.get(text[at : at + n])) is not None:
                        out.append(new)
                        at += n
                        break
                else:
                    out.append(text[at])
                    at += 1
            text = "".join(out)
        return re.sub(" +", " ", text.strip(" ")) if self.one_blank else text


class Fallback(dict):
    """The arcs of the byte fallback, made as characters are met: a character leads to the ids that it writes."""

    def __init__(self, byte: dict[int, int], unknown: int):
        super().__init__()
        self.byte, self.unknown = byte, unknown

    def __missing__(self, c: str) -> list[int]:
        ids = self[c] = [self.byte.get(b, self.unknown) for b in c.encode("utf-8", "replace")] if self.byte else [self.unknown]
        return ids


class Transducer:
    """A compiled model. ``encode`` and ``decode`` are each other's inverse on normalised text."""

    def __init__(self, model: bytes):
        pieces, kind, spec = [], UNIGRAM, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
        if kind not in (UNIGRAM, BPE) or not spec.get(3, 1) or not spec.get(5, 1):
            raise ValueError("only unigram and byte-pair models with a blank before the text, and blanks written as U+2581, are compiled")
        self.kind, self.normalise = kind, Normaliser(spec.get(2, b""), bool(spec.get(4, 1)))
        self.pieces = [p for p, _, _ in pieces]
        self.score = [s for _, s, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (1, 4)}
        self.least = min(self.score)
        self.rank = {p: self.score[i] for p, i in self.ids.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == 2)
        if any(BLANK in p[1:] and p.strip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank inside")
        if any("\n" in p for p in self.ids):
            raise ValueError("a piece holds a line feed")
        self.trie: dict = {}  # a character leads to the next node and the piece that ends there, or -1
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                arc = node.setdefault(c, [{}, -1])
                node = arc[0]
            arc[1] = i
        self._compose_blank(self.trie, set())
        self.fallback = Fallback(self.byte, self.unknown)
        self.apart: dict[int, bool] = {}
        self.part: dict[str, bytes] = {}
        self.out = [p.replace(BLANK, " ").encode() if p in self.ids else b"" for p in self.pieces]
        for b, i in self.byte.items():
            self.out[i] = bytes([b])

    def _compose_blank(self, node: dict, seen: set[int]) -> None:
        """The composition with the normaliser's rule for blanks: what reads U+2581 reads a blank too."""
        if id(node) not in seen:
            seen.add(id(node))
            if BLANK in node:
                node[" "] = node[BLANK]
                self._compose_blank(node[BLANK][0], seen)

    def _merged(self, text: str) -> list[str]:
        """The greedy merges of a short text, for the weights of pairs."""
        parts, rank = list(text), self.rank.get
        scores = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != NEVER:
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del scores[k]
            if k:
                scores[k - 1] = rank(parts[k - 1] + parts[k], NEVER)
            if k < len(scores):
                scores[k] = rank(parts[k] + parts[k + 1], NEVER)
        return parts

    def _keep_apart(self, u: int, v: int) -> bool:
        """Whether v after u (at the start of a path: u is -1) is a piece of its own when both are encoded together."""
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        b = self.pieces[v]
        want = [b] if u < 0 else [self.pieces[u], b]
        known = self.apart[u << 20 | v] = self._merged("".join(want)) == want
        return known

    def shortest(self, text: str) -> list[int]:
        """The ids on the tropical shortest path of a normalised part."""
        return next(self.paths([text]))

    def paths(self, texts: list[str]):
        """The shortest path of each part. Composition goes character by character with the live places in the trie, so
        a part takes up where it leaves the one before it: give them in order."""
        if self.kind == UNIGRAM:
            for t in texts:
                yield self._lightest(t)
            return
        # of the weights 0 and infinity: at most one arc of weight 0 ends at each position
        back, last, live, before, trie, apart = [0], [-1], [[(0, self.trie)]], "", self.trie, self.apart.get
        for t in texts:
            at = 0
            for x, y in zip(before, t, strict=False):
                if x != y:
                    break
                at += 1
            del back[at + 1 :], last[at + 1 :], live[at + 1 :]
            for j in range(at, len(t)):
                c, ahead, start, piece = t[j], [], -1, -1
                for i, node in live[j]:
                    arc = node.get(c)
                    if arc is not None:
                        node, v = arc
                        if node:
                            ahead.append((i, node))
                        if v >= 0 and start < 0:
                            u = last[i]
                            known = apart(u << 20 | v)
                            if self._keep_apart(u, v) if known is None else known:
                                start, piece = i, v
                if c not in trie:  # no piece: its bytes, and nothing merges with it
                    start = j
                back.append(start)
                last.append(piece)
                if start >= 0:
                    ahead.append((j + 1, trie))
                live.append(ahead)
            before, out, j = t, [], len(t)
            while j:
                i = back[j]
                if i < 0:
                    raise ValueError(f"no path of finite weight through {t!r:.80}")
                if last[j] >= 0:
                    out.append(last[j])
                else:
                    out += reversed(self.fallback[t[i:j]])
                j = i
            out.reverse()
            yield out

    def _lightest(self, text: str) -> list[int]:
        n = len(text)
        back, last, dist = [-1] * (n + 1), [-1] * (n + 1), [0.0, *[float("inf")] * n]
        for i in range(n):
            node = self.trie
            for j in range(i, n):
                arc = node.get(text[j])
                if arc is None:
                    break
                node, v = arc
                if v >= 0 and dist[i] - self.score[v] < dist[j + 1]:
                    dist[j + 1], back[j + 1], last[j + 1] = dist[i] - self.score[v], i, v
            w = dist[i] + 10.0 - self.least  # the fallback's arc costs more than any piece
            if self.trie.get(text[i], (0, -1))[1] < 0 and w < dist[i + 1]:
                dist[i + 1], back[i + 1], last[i + 1] = w, i, -1
        out, j = [], n
        while j:
            if back[j] < 0:
                raise ValueError(f"no path of finite weight through {text!r:.80}")
            out.append([last[j]] if last[j] >= 0 else self.fallback[text[back[j] : j]])
            j = back[j]
        return [x for ids in reversed(out) for x in ids]

    @cache  # noqa: B019  one entry for each length of a run
    def blanks(self, n: int) -> bytes:
        """The path of a run of n blanks that no word takes up."""
        if self.kind == UNIGRAM:
            return np.array(self.shortest(BLANK * n), np.uint32).tobytes()
        return np.array([self.ids[p] for p in self._merged(BLANK * n)], np.uint32).tobytes()

    def _learn(self, parts: set[str]) -> None:
        """Puts the ids of new parts into memory: after a line feed as they stand, otherwise with their blank before."""
        feed = np.array(self.fallback["\n"], np.uint32).tobytes()
        todo = sorted((p[1:] if p[0] == "\n" else " " + p, p) for p in parts)
        for (_, p), ids in zip(todo, self.paths([t for t, _ in todo]), strict=True):
            self.part[p] = (feed if p[0] == "\n" else b"") + np.array(ids, np.uint32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [t.replace(BLANK, " ").replace("\n", " \n").split(" ") if t else [] for t in map(self.normalise, texts)]
        if len(self.part) >= MEMORY:
            self.part.clear()
        self._learn({p for parts in cut for p in parts if p} - self.part.keys())
        single = np.array([self.ids[BLANK]], np.uint32).tobytes() if BLANK in self.ids else b""
        return [np.frombuffer(self._joined(parts, single), np.uint32) for parts in cut]

    def _joined(self, parts: list[str], single: bytes) -> bytes:
        known, out, run = self.part, [], 0
        for p in parts:
            if not p:
                run += 1
                continue
            ids = known[p]
            if run:
                if p[0] != "\n" and ids[:4] == single:
                    out.append(self.blanks(run + 1))
                    ids = ids[4:]
                else:
                    out.append(self.blanks(run))
                run = 0
            out.append(ids)
        if run:
            out.append(self.blanks(run))
        return b"".join(out)

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@cache
def compiled(model: str | bytes) -> Transducer:
    """The transducer of a model file, or of its bytes."""
    return Transducer(model if isinstance(model, bytes) else Path(model).read_bytes())


def shipped(model: str | bytes) -> bytes:
    """The bytes of a model: they go to the workers with the function, so that only the driver needs the file."""
    return model if isinstance(model, bytes) else Path(model).read_bytes()


def encoded(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id column, ``keep``, and ``piece_ids`` of ``text``."""
    cols, model = [id_column, *keep], shipped(model)
    schema = T.StructType(docs.select(*cols).schema.fields).add("piece_ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        fst = compiled(model)
        for b in slices(batches, 64):
            texts = b.column(len(cols)).to_pylist()
            ids = [None if t is None else x for t, x in zip(texts, fst.encode_all([t or "" for t in texts]), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(cols))), pa.array(ids, pa.list_(pa.int32()))], names=[*cols, "piece_ids"])

    return in_arrow(docs.select(*cols, "text"), run, schema)


def decoded(pieces: DataFrame, model: str = MODEL, id_column: str = "doc_id") -> DataFrame:
    """The id column and the text of ``piece_ids``."""
    model = shipped(model)

    def run(batches):
        fst = compiled(model)
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else fst.decode(t) for t in b.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    return in_arrow(pieces.select(id_column, "piece_ids"), run, T.StructType(pieces.select(id_column).schema.fields).add("text", T.StringType()))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, the SHA-256 of the ids (each as 4 bytes, low first) and whether decoding gives the normalised text."""
    model = shipped(model)

    def run(batches):
        fst = compiled(model)
        fallback = np.zeros(len(fst.pieces), bool)
        fallback[list(fst.byte.values())] = True
        for b in slices(batches, 256):
            rows = []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for t, ids in zip(texts, fst.encode_all(texts), strict=True):
                same = fst.decode(ids.tolist()) == fst.normalise(t).replace(BLANK, " ")
                rows.append((len(ids), int(fallback[ids].sum()), hashlib.sha256(ids.tobytes()).hexdigest(), same))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "decoded_same"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_same boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
