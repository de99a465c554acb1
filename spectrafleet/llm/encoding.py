"""A tokenizers file behind a bounded memo of text pieces, for use inside tasks.

Both kinds of file used here cut a text at certain places before any merge, so a text's ids are the ids of the pieces
between such places, one after another. Pieces recur, so each is encoded once per worker while the memo lasts. All
texts of a slice are cut, looked up and put together as arrays; no step works piece by piece. Pieces are looked up by
hash, and what was found is compared with the text byte by byte, so that equal hashes can't give wrong ids.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from .hashing import NON_SPACE, slices, span_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The memo begins anew when it holds so many pieces or bytes: some 100 MB.
MEMO_PIECES, MEMO_BYTES = 1_200_000, 24 << 20
#: So many words are encoded as one text.
_TOGETHER = 500
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
#: ASCII punctuation but the apostrophe: behind a letter, both kinds of file cut before it.
_MARK = np.array([33 <= b <= 126 and not chr(b).isalnum() and b != 39 for b in range(256)])
#: ASCII other than white space.
_PLAIN = np.array([b < 128 and bool(NON_SPACE[b]) for b in range(256)])
#: White space, and first bytes that other white space may begin with.
_MAY_BE_SPACE = np.array([not NON_SPACE[b] or b in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
#: A word of Latin letters, with the space before it if there is one.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LOADED: dict[str, Encoder] = {}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each range, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Memo:
    """Pieces by hash, with their bytes and ids in flat arrays."""

    def __init__(self, dtype: np.dtype):
        self.keys, self.entry = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted by key
        self.bytes, self.ids = np.empty(1 << 16, np.uint8), np.empty(1 << 16, dtype)
        self.byte_at, self.id_at = np.zeros(1, np.int64), np.zeros(1, np.int64)  # entry i: at[i] to at[i + 1]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's entry, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.entry[at], -1)

    def add(self, hashes: np.ndarray, pieces: list[bytes], ids: list[bytes]) -> None:
        for name, new in (("byte", np.frombuffer(b"".join(pieces), np.uint8)), ("id", np.frombuffer(b"".join(ids), self.ids.dtype))):
            flat, at = (self.bytes, self.byte_at) if name == "byte" else (self.ids, self.id_at)
            sizes = np.fromiter(map(len, pieces if name == "byte" else ids), np.int64, len(pieces)) // flat.itemsize
            used = int(at[-1])
            if used + len(new) > len(flat):
                flat = np.concatenate([flat, np.empty(max(len(flat), len(new)), flat.dtype)])
            flat[used : used + len(new)] = new
            at = np.concatenate([at, used + np.cumsum(sizes)])
            if name == "byte":
                self.bytes, self.byte_at = flat, at
            else:
                self.ids, self.id_at = flat, at
        order = np.argsort(hashes)
        where = np.searchsorted(self.keys, hashes[order])
        self.entry = np.insert(self.entry, where, len(self.byte_at) - 1 - len(hashes) + order)
        self.keys = np.insert(self.keys, where, hashes[order])


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: True: a piece keeps the one space before it. False: white space is dropped.
        self.keeps_space = self.tokenizer.encode(" a", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids
        table = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.size)]
        # Which ids begin (space kept) or end (space dropped) a word.
        first = table[int(self.tokenizer.encode(" a", add_special_tokens=False).ids[0])]
        self.edge = np.array([t.startswith("Ġ".encode()) if self.keeps_space else t.endswith(b"</w>") for t in table])
        self.joins = first.startswith("Ġ".encode()) if self.keeps_space else first.endswith(b"</w>")
        # Decoding without a decoder puts a space between tokens: each is kept with one behind it.
        self.spaced = np.frombuffer(b" ".join([*table, b""]), np.uint8)
        self.spaced_at = np.cumsum([0, *(len(t) + 1 for t in table)])
        self.plain_decoding = self.tokenizer.decoder is None
        self.memo = _Memo(self.dtype)

    @staticmethod
    def load(path: str) -> Encoder:
        if path not in _LOADED:
            _LOADED[path] = Encoder(path)
        return _LOADED[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words (with the space before them, if that is kept), encoded together and cut apart at word edges."""
        groups = [words[i : i + _TOGETHER] for i in range(0, len(words), _TOGETHER)]
        out = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([("" if self.keeps_space else " ").join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.edge[ids]) * self.dtype.itemsize
            if len(at) != len(group):
                out += self._whole(group)
                continue
            cuts = [*at.tolist(), len(ids) * self.dtype.itemsize] if self.keeps_space else [0, *(at + self.dtype.itemsize).tolist()]
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _spans(self, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts, each with a newline behind it at breaks, start and end; pieces' ids make up a text's ids."""
        before, after = np.empty_like(raw), np.empty_like(raw)
        before[1:], before[:1], after[:-1], after[-1:] = raw[:-1], 10, raw[1:], 10
        marked = _MARK[raw] & _LETTER[before]
        if not self.keeps_space:
            inside = NON_SPACE[raw]
            return np.flatnonzero(inside & (~NON_SPACE[before] | marked)), np.flatnonzero(inside & (~NON_SPACE[after] | _MARK[after] & _LETTER[raw])) + 1
        plain, space = _PLAIN[before], raw == 32
        # A space belongs to what follows. A run of white space is cut before its last space, if what follows is known
        # not to be white space; behind other characters it is cut off in any case.
        start = marked | space & (plain | ~_MAY_BE_SPACE[after]) | ~NON_SPACE[raw] & plain
        start[2:] |= _PLAIN[raw[2:]] & (raw[1:-1] == 10) & _PLAIN[raw[:-2]]
        start[:1] = True
        start[breaks] = True
        start[breaks[:-1] + 1] = True
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(raw))

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        words = [i for i, t in enumerate(texts) if _WORD.fullmatch(t) and self.joins and (t[0] == " ") == self.keeps_space]
        ids: list[bytes] = [b""] * len(texts)
        for i, x in zip(words, self._words([texts[i] for i in words]), strict=True):
            ids[i] = x
        plain = set(words)
        rest = [i for i in range(len(texts)) if i not in plain]
        for i, x in zip(rest, self._whole([texts[i] for i in rest]), strict=True):
            ids[i] = x
        self.memo.add(hashes, pieces, ids)

    def _slice(self, data: list[bytes], end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blob = b"\n".join([*data, b""])
        raw = np.frombuffer(blob, np.uint8)
        breaks = np.cumsum([len(d) + 1 for d in data]) - 1
        starts, ends = self._spans(raw, breaks)
        hashes = span_hashes(blob, starts, ends)
        code, distinct = pd.factorize(hashes)
        if len(self.memo.keys) > MEMO_PIECES or self.memo.byte_at[-1] > MEMO_BYTES:
            self.memo = _Memo(self.dtype)
        entry = self.memo.find(distinct)
        if (entry < 0).any():
            first = np.empty(len(distinct), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            new = np.flatnonzero(entry < 0)
            self._learn(distinct[new], [blob[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            entry = self.memo.find(distinct)
        memo, of = self.memo, entry[code]
        sizes = memo.byte_at[of + 1] - memo.byte_at[of]
        same = np.array_equal(sizes, ends - starts) and np.array_equal(gathered(memo.bytes, memo.byte_at[of], sizes), gathered(raw, starts, sizes))
        if not same:  # two pieces with one hash
            each = [np.concatenate([np.frombuffer(x, self.dtype), end]) for x in self._whole([d.decode() for d in data])]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        counts = memo.id_at[of + 1] - memo.id_at[of]
        at = np.searchsorted(starts, breaks)
        if self.keeps_space:
            counts[at] = 0  # the newlines between the texts
        done = np.concatenate([[0], np.cumsum(counts)])
        stops = done[at]
        ids = gathered(memo.ids, memo.id_at[of], counts)
        return np.insert(ids, np.repeat(stops, len(end)), np.tile(end, len(data))), np.diff(stops, prepend=0) + len(end)

    def encode_flat(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, each text's number of ids); end is put behind every text's own ids."""
        tail = np.array([] if end is None else [end], self.dtype)
        odd = {i: t for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        data = [b"" if i in odd else t.encode() for i, t in enumerate(texts)]
        parts = [self._slice(data[lo:hi], tail) for lo, hi in slices([len(d) for d in data])]
        ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, self.dtype)
        sizes = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
        if odd:
            each = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in zip(odd, self._whole(list(odd.values())), strict=True):
                each[i] = np.concatenate([np.frombuffer(x, self.dtype), tail])
            ids, sizes = np.concatenate(each), np.array([len(x) for x in each], np.int64)
        return ids, sizes

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of self.dtype."""
        ids, sizes = self.encode_flat(texts)
        data, at = ids.tobytes(), [0, *(np.cumsum(sizes) * self.dtype.itemsize).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode_many(self, ids: list[bytes]) -> list[bytes]:
        """What decode(ids, skip_special_tokens=False) gives, in UTF-8."""
        if not self.plain_decoding:
            return [self.tokenizer.decode(np.frombuffer(x, self.dtype).tolist(), skip_special_tokens=False).encode() for x in ids]
        out: list[bytes] = []
        for lo, hi in slices([len(x) for x in ids]):
            flat = np.frombuffer(b"".join(ids[lo:hi]), self.dtype)
            sizes = self.spaced_at[flat + np.int64(1)] - self.spaced_at[flat]
            data, done = gathered(self.spaced, self.spaced_at[flat], sizes).tobytes(), np.concatenate([[0], np.cumsum(sizes)])
            at = done[np.cumsum([0, *(len(x) // self.dtype.itemsize for x in ids[lo:hi])])].tolist()
            out += [data[a : max(a, b - 1)] for a, b in zip(at, at[1:])]
        return out

    def decode_joined(self, ids: bytes) -> bytes:
        return self.decode_many([ids])[0]
