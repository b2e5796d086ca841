"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that open a word and pieces that go on with
one. A node that cannot be left by the next byte pops the pieces already decided and goes
on at its failure link; how many it pops is stored, so a word's length is a sum of small
integers and no piece is ever built. Each byte is looked at once, plus one step per pop.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, rows_of

UNKNOWN = 1
MEMO = 400_000


class Automaton:
    """pieces: (text, opens a word) pairs. count(word) is the number of greedy pieces, or None if no piece fits somewhere."""

    def __init__(self, pieces: Iterable[tuple[bytes, bool]]):
        self.next: list[dict[int, int]] = [{}, {}]  # 0 opens words, 1 goes on
        final = [False, False]
        for text, opens in pieces:
            if not text:
                continue
            v = 0 if opens else 1
            for c in text:
                w = self.next[v].get(c)
                if w is None:
                    w = self.next[v][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                v = w
            final[v] = True
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if final[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.next[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], popped
            level = below

    def count(self, word: bytes) -> int | None:
        v, n = 0, 0
        nxt, fail, pops = self.next, self.fail, self.pops
        for c in word:
            w = nxt[v].get(c)
            while w is None:
                if fail[v] < 0:
                    return None
                n += pops[v]
                v = fail[v]
                w = nxt[v].get(c)
            v = w
        while v != 1:
            if fail[v] < 0:
                return None
            n += pops[v]
            v = fail[v]
        return n


def sentencepiece_vocabulary(path: str) -> list[tuple[bytes, bool]]:
    """The pieces of a SentencePiece model; its word mark tells those that open a word. Control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        opens = piece.startswith("▁")
        out.append((piece.lstrip("▁").encode() if opens else piece.encode(), opens))
    return out


_automata: dict[str, Automaton] = {}
_memo: dict[str, dict[bytes, int | None]] = {}


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_words, n_pieces, n_unknown) of each row of docs(doc_id, text).

    Words are separated by ASCII white space. A word that no sequence of greedy pieces covers
    is one unknown piece. A null or empty text has no words. Null and repeated ids are
    kept; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _automata:
            _automata[vocabulary_path] = Automaton(sentencepiece_vocabulary(vocabulary_path))
        count, memo = _automata[vocabulary_path].count, _memo.setdefault(vocabulary_path, {})
        for batch in batches:
            n_words, n_pieces, n_unknown = [], [], []
            for _, text in rows_of(batch):
                words = text.split()
                if len(memo) > MEMO:
                    memo.clear()
                own = {}
                for w in set(words):
                    if w in memo:
                        own[w] = memo[w]
                    else:
                        own[w] = count(w)
                        if len(w) <= 64:
                            memo[w] = own[w]
                got = [own[w] for w in words]
                unknown = got.count(None)
                n_words.append(len(words))
                n_unknown.append(unknown)
                n_pieces.append(sum(filter(None, got)) + UNKNOWN * unknown)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_pieces, n_unknown))], names=["doc_id", "n_words", "n_pieces", "n_unknown"])

    return as_bytes(docs).mapInArrow(run, "doc_id long, n_words long, n_pieces long, n_unknown long")
