"""Whole-text encoding with the tokenizers library, each distinct stretch encoded once.

Both public tokenizers cut a text at certain white space before their merges run, whatever
stands around. Texts are cut there, many at a time: the cuts are an offsets array over their
joined bytes, and a dictionary encoding finds the distinct stretches. The library encodes those
not met before, and the ids of all stretches are gathered. The memory for stretches is bounded.
A text that holds the string of an added token goes to the library whole, which tells its id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Entries kept (about 200 bytes each), longest stretch kept, bytes of text encoded at a time.
MEMO, LONGEST, TOGETHER = 500_000, 48, 4 << 20
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_STOPS = frozenset(b".,;:!?")
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def _wide_spaces(b: np.ndarray) -> np.ndarray:
    """Where a white-space character beyond ASCII starts in UTF-8."""
    at = np.flatnonzero((b == 0xC2) | (b == 0xE1) | (b == 0xE2) | (b == 0xE3))
    one, two = b[np.minimum(at + 1, len(b) - 1)], b[np.minimum(at + 2, len(b) - 1)]
    lead = b[at]
    hit = (lead == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (lead == 0xE1) & (one == 0x9A) & (two == 0x80) | (lead == 0xE3) & (one == 0x80) & (two == 0x80)
    hit |= (lead == 0xE2) & ((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (one == 0x81) & (two == 0x9F))
    return at[hit]


def byte_level_cuts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For byte-level BPE: a lone space opens the next token, a lone line break is a token. Texts with other runs of white space stay whole."""
    cut = (b == 32) | (b == 10)
    cut[1:] |= b[:-1] == 10
    space = _SPACES[b]
    run = space[:-1] & space[1:]
    run[starts[1:] - 1] = False
    odd = np.concatenate([np.flatnonzero(run), _wide_spaces(b)])
    if len(odd):
        ends = np.append(starts[1:], len(b))
        for k in np.unique(np.searchsorted(starts, odd, "right") - 1).tolist():
            cut[starts[k] : ends[k]] = False
    return cut


def word_cuts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For BPE with word ends: ASCII white space only separates, and is dropped."""
    space = (b == 32) | ((b >= 9) & (b <= 13))
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    return cut


def together(rows: Iterator[tuple[object, bytes]], limit: int = TOGETHER) -> Iterator[tuple[list, list[bytes]]]:
    """Rows regrouped to about limit bytes of text."""
    keys, texts, held = [], [], 0
    for k, t in rows:
        keys.append(k)
        texts.append(t)
        held += len(t)
        if held >= limit:
            yield keys, texts
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts


class Encoder:
    """encode(texts) gives each text's ids as an array of little-endian `dtype`."""

    def __init__(self, path: str, cut: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = {"byte_level": byte_level_cuts, "word": word_cuts}[cut]
        self.lowers = self.strips = cut == "word"
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        #: What stands between stretches that are encoded in one go: always one token of its own.
        self.mark, self.between = (b"\x01", b" \x01 ") if cut == "word" else (b"\n", b"\n")
        self.mark_id = self.tokenizer.encode(self.mark.decode(), add_special_tokens=False).ids[0]
        self.memo: dict[bytes, bytes] = {b"": b""}

    def _learn(self, stretches: set[bytes]) -> dict[bytes, bytes]:
        """Ids of stretches that are not in the memo. A stop after a letter is a token of its own, and so is not encoded again."""
        memo, cores = self.memo, {}
        for s in stretches:
            core, stop = (s[:-1], s[-1:]) if s[-1] in _STOPS and len(s) > 1 and s[-2] in _LETTERS else (s, b"")
            # lower-casing must not spell an added token that the text doesn't have
            cores[s] = (core.lower() if self.lowers and core.isascii() and b"<|" not in core else core, stop)
        ask = {c for pair in cores.values() for c in pair if c and c not in memo}
        own: dict[bytes, bytes] = {}
        plain = [s for s in ask if self.mark not in s and s.strip()]
        alone = list(ask.difference(plain))
        if plain:
            joined = self.between.join(plain).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            raw, width = ids.tobytes(), ids.itemsize
            ends = [*(np.flatnonzero(ids == self.mark_id) * width).tolist(), len(raw)]
            if len(ends) == len(plain):
                own.update(zip(plain, [raw[i:j] for i, j in zip([0, *(e + width for e in ends)], ends, strict=False)], strict=True))
            else:
                alone += plain
        if alone:
            for s, e in zip(alone, self.tokenizer.encode_batch_fast([s.decode("utf-8", "replace") for s in alone], add_special_tokens=False), strict=True):
                own[s] = np.array(e.ids, self.dtype).tobytes()
        for s, (core, stop) in cores.items():
            if stop or core != s:
                own[s] = (own.get(core) or memo.get(core, b"")) + ((own.get(stop) or memo.get(stop, b"")) if stop else b"")
        # the memo fills once and stays: what is frequent comes early
        if len(memo) + len(own) <= MEMO:
            memo.update({k: v for k, v in own.items() if len(k) <= LONGEST})
        return own

    def _ids(self, stretches: list[bytes]) -> list[bytes]:
        if self.strips:
            stretches = [s.strip() for s in stretches]
        known = self.memo
        new = {s for s in stretches if s not in known}
        own = self._learn(new) if new else {}
        return [own[s] if s in own else known[s] for s in stretches]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them for the whole text without special tokens added."""
        whole = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self._cut_up(texts)
        held = set(whole)
        out = self._cut_up([b"" if k in held else t for k, t in enumerate(texts)])
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[k].decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype)
        return out

    def _cut_up(self, texts: list[bytes]) -> list[np.ndarray]:
        filled = [t for t in texts if t]
        if not filled:
            return [np.empty(0, self.dtype)] * len(texts)
        joined = b"".join(filled)
        if self.lowers and b"<|" not in joined:  # ASCII letters alone: the library lowers them anyway, and fewer stretches are distinct
            joined = joined.lower()
        b = np.frombuffer(joined, np.uint8)
        lengths = np.array([len(t) for t in filled])
        starts = np.cumsum(lengths) - lengths
        cut = self.cut(b, starts)
        cut[starts] = True
        offsets = np.append(np.flatnonzero(cut), len(b))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        found = self._ids(pieces.dictionary.to_pylist())
        ids = np.frombuffer(b"".join(found), self.dtype)
        size = np.array([len(f) for f in found], np.int64) // ids.itemsize
        first = np.cumsum(size) - size
        n = size[which]
        ends = np.cumsum(n)
        out = ids[np.repeat(first[which] - (ends - n), n) + np.arange(ends[-1])]
        at = np.append(0, ends)[np.searchsorted(offsets, starts)]
        own = iter(np.split(out, at[1:]))
        return [next(own) if t else out[:0] for t in texts]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str) -> Encoder:
    """One per Python worker, kept between tasks."""
    if (path, cut) not in _encoders:
        _encoders[path, cut] = Encoder(path, cut)
    return _encoders[path, cut]
