"""Tokenising whole texts with a public tokenizer file, each distinct word once per batch.

The tokenizer splits a text at white space and between letters, digits and other
signs before its merges, so the ids of a text are those of its parts in order.
Parts made of ASCII and Latin letters below U+0250 are cut at those borders and
lower-cased in ASCII (both leave the tokenizer's own result unchanged: such letters
are fixed by its normaliser and no combining mark follows inside the part).  U+0130,
whose lower case is two characters, is the exception; a stretch between ASCII white
space that holds it, or anything else, goes to the tokenizer whole, and so does one with
a special token of the file, which is one id wherever it stands.  Distinct parts are
found by a 64-bit hash and a check sum, encoded once and kept in a bounded per-worker cache.
"""

from __future__ import annotations

import importlib
import os

import numpy as np
import pyarrow as pa

from . import columnar as C

TOKENIZER = "word_bpe_49k.json"
#: Distinct parts that a worker remembers (about 30 bytes each); past it those that came up once go.
CACHE_PARTS = 400_000

_ASCII_SPACE = ~C.VISIBLE
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
#: 0: white space, 1: letters, 2: digits, 3: other signs.
_KIND = np.where(_ASCII_SPACE, 0, np.where(_LETTER, 1, np.where(_DIGIT, 2, 3))).astype(np.int8)
#: Summed over a part, a check beside its hash.
_CHECK = C.mixed(np.arange(256, dtype=np.uint64) + np.uint64(77))[C.ASCII_LOWER]
#: Bytes that make the stretch around them go to the tokenizer whole: apostrophes and lead bytes of U+0250 or above.
_ODD = np.zeros(256, dtype=bool)
_ODD[0x27] = True
_ODD[0xC0:0xC3] = True
_ODD[0xC9:] = True
_ODD[:0x20] = True
_ODD[0x7F] = True
_ODD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def tokenizer_path(name: str = TOKENIZER) -> str:
    """A file of the public vocabularies, or ``name`` itself if it is a path."""
    return name if os.sep in name else importlib.import_module("public_tokenizers").path(name)


def _found(data: np.ndarray, sign: bytes) -> np.ndarray:
    """Places where a byte string stands."""
    at = np.flatnonzero(data[: max(len(data) - len(sign) + 1, 0)] == sign[0])
    for j in range(1, len(sign)):
        if not len(at):
            break
        at = at[data[at + j] == sign[j]]
    return at


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The parts, lower-cased in ASCII, with a blank after each."""
    size = ends - starts + 1
    at = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=at[1:])
    out = C.ASCII_LOWER[data[np.minimum(np.arange(at[-1]) + np.repeat(starts - at[:-1], size), len(data) - 1)]]
    out[at[1:] - 1] = 0x20
    return out.tobytes().decode()


class Encoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False).ids`` of the tokenizers library.

    Without ``specials``, special tokens that a text spells out are plain signs (``encode_special_tokens``).
    """

    def __init__(self, path: str, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.whole = [b"\xc4\xb0", *([t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else [])]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        """Empty the cache of parts."""
        self.hashes, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)  # ascending hashes, and where each is kept
        self.count = 0
        self.second = np.zeros(1 << 16, dtype=np.uint64)
        self.start = np.zeros((1 << 16) + 1, dtype=np.int32)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.ids = np.zeros(1 << 18, dtype=np.int32)

    def _forget_rare(self) -> None:
        """Keep the parts that came up again since they were learnt; if those are too many, none."""
        keep = np.flatnonzero(self.seen[: self.count])
        if len(keep) > CACHE_PARTS // 2:
            return self.forget()
        begin, length = self.start[keep].astype(np.int64), np.diff(self.start[: self.count + 1])[keep]
        at = np.zeros(len(keep) + 1, dtype=np.int64)
        np.cumsum(length, out=at[1:])
        ids = self.ids[np.arange(at[-1]) + np.repeat(begin - at[:-1], length)]
        moved = np.full(self.count, -1, dtype=np.int32)
        moved[keep] = np.arange(len(keep))
        left = moved[self.place] >= 0
        hashes, place, second = self.hashes[left], moved[self.place[left]], self.second[keep]
        self.forget()
        self.hashes, self.place, self.count = hashes, place, len(keep)
        self._room(len(keep), len(ids))
        self.second[: len(keep)], self.start[: len(keep) + 1], self.ids[: len(ids)] = second, at, ids

    def _room(self, parts: int, ids: int) -> None:
        if parts + 1 > len(self.start):
            size = max(parts + 1, min(2 * len(self.start), CACHE_PARTS)) - len(self.start)
            self.start, self.second, self.seen = (np.concatenate([x, np.zeros(size, dtype=x.dtype)]) for x in (self.start, self.second, self.seen))
        if ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(ids, len(self.ids) * 5 // 4) - len(self.ids), dtype=np.int32)])

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, plain, cased) of the parts; plain ones hold one run of letters, cased ones go to the tokenizer whole."""
        opens, closes = C.runs(C.VISIBLE[data], offsets)
        if not len(opens):
            return opens, closes, np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
        odd = np.flatnonzero(_ODD[data])
        signs = np.flatnonzero(data == 0xC3)  # the multiplication and division signs are no letters
        following = data[np.minimum(signs + 1, len(data) - 1)]
        odd = np.concatenate([odd, signs[(following == 0x97) | (following == 0xB7)]])
        odd = np.concatenate([odd, *[_found(data, s) for s in self.whole]])
        chunk_of_odd = np.searchsorted(opens, odd, side="right") - 1
        whole = np.zeros(len(opens), dtype=bool)
        whole[chunk_of_odd[(chunk_of_odd >= 0) & (odd < closes[chunk_of_odd])]] = True
        kind = _KIND[data]
        edge = np.zeros(len(data), dtype=bool)
        edge[1:] = kind[1:] != kind[:-1]
        edge &= kind > 0
        edge[opens] = True
        starts = np.flatnonzero(edge)
        first = np.zeros(len(data), dtype=bool)
        first[opens] = True
        chunk = np.cumsum(first[starts]) - 1
        if whole.any():
            keep = ~whole[chunk] | first[starts]
            starts, chunk = starts[keep], chunk[keep]
        ends = closes[chunk]
        ends[:-1] = np.minimum(ends[:-1], starts[1:])
        return starts, ends, (kind[starts] == 1) & ~whole[chunk], whole[chunk]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Encode new distinct parts and add them to the cache; returns each one's place there."""
        easy, hard = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        order, flat, lengths = [], [], []
        for at in range(0, len(easy), 2000):
            group = easy[at : at + 2000]
            got = np.array(self.tokenizer.encode_batch_fast([_spaced(data, starts[group], ends[group])], add_special_tokens=False)[0].ids, dtype=np.int32)
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(group):  # each run of letters ends with its one word-end token
                order.append(group)
                flat.append(got)
                lengths.append(np.diff(cuts, prepend=0))
            else:
                hard.append(group)
        rest = np.concatenate(hard)
        words = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        one_by_one = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths.append(np.array([len(x) for x in one_by_one], dtype=np.int64))
        flat.append(np.array([i for x in one_by_one for i in x], dtype=np.int32))
        by = np.concatenate([*order, rest])
        have, new, ids = self.count, len(starts), np.concatenate(flat)
        base = int(self.start[have])
        self._room(have + new, base + len(ids))
        self.start[have + 1 : have + new + 1] = base + np.cumsum(np.concatenate(lengths))
        self.second[have : have + new] = second[by]
        self.seen[have : have + new] = False
        self.ids[base : base + len(ids)] = ids
        self.count = have + new
        place = np.empty(new, dtype=np.int32)
        place[by] = have + np.arange(new)
        sort = np.argsort(first)
        into = np.searchsorted(self.hashes, first[sort])
        self.hashes, self.place = np.insert(self.hashes, into, first[sort]), np.insert(self.place, into, place[sort])
        return place

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each text's ids) of the texts in a buffer."""
        rows = len(offsets) - 1
        starts, ends, plain, cased = self._parts(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(rows + 1, dtype=np.int64)
        first = C.RollingHash.of_bytes(data, 0, True).spans(starts, ends)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_CHECK[data], out=sums[1:])
        second = sums[ends] - sums[starts]
        # Parts that the tokenizer gets whole keep their case apart.
        if cased.any():
            size = ends[cased] - starts[cased]
            at = np.zeros(len(size) + 1, dtype=np.int64)
            np.cumsum(size, out=at[1:])
            own = data[np.arange(at[-1]) + np.repeat(starts[cased] - at[:-1], size)]
            first[cased] = C.mixed(first[cased] + C.mixed(C.RollingHash.of_bytes(own, 0).spans(at[:-1], at[1:])) * np.uint64(3))
        coded = pa.array(first).dictionary_encode()
        back, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        at = np.empty(len(distinct), dtype=np.int64)
        at[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        if (second[at][back] != second).any():
            return self._plainly(data, offsets)
        if self.count + len(distinct) > CACHE_PARTS:
            self._forget_rare()
        index = np.full(len(distinct), -1, dtype=np.int32)
        if self.count:
            near = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            index = np.where(self.hashes[near] == distinct, self.place[near], index)
            self.seen[index[index >= 0]] = True
        new = np.flatnonzero(index < 0)
        if len(new):
            pick = at[new]
            index[new] = self._learn(data, starts[pick], ends[pick], plain[pick], distinct[new], second[pick])
        if (self.second[index] != second[at]).any():
            return self._plainly(data, offsets)
        begin, length = self.start[index][back].astype(np.int64), (self.start[index + 1] - self.start[index])[back]
        total = np.zeros(len(length) + 1, dtype=np.int64)
        np.cumsum(length, out=total[1:])
        gather = np.arange(total[-1]) + np.repeat(begin - total[:-1], length)
        return self.ids[gather], total[np.searchsorted(starts, offsets)]

    def _plainly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the cache, should two parts ever share a hash."""
        got = [self.tokenizer.encode(data[a:b].tobytes().decode(), add_special_tokens=False).ids for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        out = np.zeros(len(got) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in got], out=out[1:])
        return np.array([i for x in got for i in x], dtype=np.int32), out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, made once; special tokens in a text are one id each."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
