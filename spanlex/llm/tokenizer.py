"""Encoding of texts with a public byte-level BPE vocabulary, exact and without replaying merges.

For every prefix of a piece the encoding ends in one definite token. It is the only token that is a suffix
of the prefix and compatible with the last token of what is left in front of it. So one pass over the
piece is enough: an automaton over the vocabulary lists the tokens that end at a position, a test on the
pair picks the right one, the token is stored for the prefix, and following the stored tokens back from
the end gives the ids.

Two tokens are compatible if the merges of their joined bytes give just these two. A merge across the
joint would have to take a piece that ends the left token and a piece that begins the right one, at a
moment when both exist: before either is absorbed by the next merge inside its own token.

Defined results: a null or empty text has no ids; strings that spell special tokens are ordinary text;
texts of any length are encoded whole. Rows come out as they come in, one per document, repeated rows too.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: white space as the pattern means it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces a worker remembers; the memory is emptied when full.
REMEMBERED = 300_000


def vocabulary_path(name: str = VOCABULARY, folder: str = FOLDER) -> str:
    return os.path.join(folder, name)


def _byte_letters() -> dict[str, int]:
    """Letter by which a byte-level vocabulary writes a byte: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and the automaton over them."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        # a byte is handled as the character of its number
        latin = {s: "".join(chr(letters[c]) for c in s) for s in model["vocab"] if all(c in letters for c in s)}
        self.ids = {latin[s]: i for s, i in model["vocab"].items() if s in latin}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole, a, b = (model["vocab"][x] for x in (left + right, left, right))
            self.pairs[a, b] = rank
            self.rank.setdefault(whole, rank)
            self.parts.setdefault(whole, (a, b))
        self.automaton = ahocorasick.Automaton()
        # only tokens that single bytes can be merged to take part
        for text, i in self.ids.items():
            if len(text) == 1 or i in self.parts:
                self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._fit: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Pieces at one edge of a token with the rank of the merge that absorbs each; the token last."""
        out = [(token, float("inf"))]
        while token in self.parts:
            absorbed = self.rank[token]
            token = self.parts[token][side]
            out.append((token, absorbed))
        return out

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._fit.get(key)
        if known is None:
            if left not in self._right:
                self._right[left] = self._spine(left, 1)
            if right not in self._left:
                self._left[right] = self._spine(right, 0)
            known = True
            for a, a_end in self._right[left]:
                for b, b_end in self._left[right]:
                    rank = self.pairs.get((a, b))
                    # of equal merges the leftmost comes first
                    if rank is not None and rank < a_end and rank <= b_end:
                        known = False
                        break
                if not known:
                    break
            if len(self._fit) > 2_000_000:
                self._fit.clear()
            self._fit[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a piece that the pattern doesn't split."""
        text = piece.decode("latin-1")
        whole = self.ids.get(text)
        if whole is not None and (len(text) == 1 or whole in self.parts):
            return [whole]
        n = len(text)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(text):
            i = end + 1
            if last[i] >= 0:
                continue
            j = i - length
            if j == 0 or self.compatible(last[j], token):
                last[i], size[i] = token, length
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]


class Encoder(dict):
    """Ids by stretch of text between spaces; a dictionary that fills itself.

    A text may be cut before a space if something else than white space follows it or precedes it: no piece
    of the pattern reaches over such a place, nor does the cut change a piece.
    """

    def __init__(self, path: str):
        import regex

        super().__init__()
        self.vocabulary = Vocabulary(path)
        self.pieces: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall
        self.odd = regex.compile(f"[{SPACE}] (?:[{SPACE}]|$)").search
        self.cut = regex.compile(f"(?<=[^{SPACE}]) |(?<=[{SPACE}]) (?=[^{SPACE}])").split

    def __missing__(self, stretch: str) -> array:
        if len(self) >= REMEMBERED:
            self.clear()
            self.pieces.clear()
        return self.remember(stretch, " " + stretch)

    def remember(self, key, stretch: str) -> array:
        ids = array("i")
        short = len(stretch) < 200
        for piece in self.split(stretch):
            known = self.pieces.get(piece)
            if known is None:
                known = self.vocabulary.encode_piece(piece.encode("utf-8"))
                if short:
                    self.pieces[piece] = known
            ids.extend(known)
        if short:
            self[key] = ids
        return ids

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        stretches = self.cut(text) if self.odd(text) else text.split(" ")
        first = stretches[0]
        if first:
            key = (first,)
            out += self[key] if key in self else self.remember(key, first)
        for stretch in stretches[1:]:
            out += self[stretch]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, built once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def shipped(docs: DataFrame, path: str | None) -> str:
    """The name under which every executor gets the vocabulary file; only the driver has to have its folder."""
    path = path or vocabulary_path()
    context = docs.sparkSession.sparkContext
    sent = context.__dict__.setdefault("_spanlex_vocabularies", set())
    if path not in sent:
        context.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of every row; no shuffle."""
    name = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = encoder(SparkFiles.get(name))
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                flat += e.encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row; no shuffle."""
    name = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = encoder(SparkFiles.get(name))
            counts = [len(e.encode(text)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")
