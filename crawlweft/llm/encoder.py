"""Token ids of whole texts by the tokenizers library, each distinct piece of text asked for once.

A tokeniser file that drops white space and cuts the rest by _SPLIT (both are checked) gives a text the ids of its pieces
one after the other. Pieces of plain characters are found and hashed for a whole batch of texts at once; a sorted table of
KNOWN pieces (64-bit hash, a second hash as a check, place in a pool of ids) keeps their ids, some 30 bytes each; beyond
it, pieces are asked for again in every batch. Words with any other character, or with a special token's string, are
given to the tokeniser whole. A tokeniser of another kind is given whole texts.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np

from .kernels import U64, mix

KNOWN = 1_000_000
#: Words outside the plain characters kept with their ids.
WORDS = 50_000

#: Fixed values, as the tokeniser file spells them: how a text is normalised and cut where no token spans white space.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUTS = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]

#: Classes of code points. Plain ones have the same class, lower case and normal form in every Unicode version, without context.
_SPACE, _LETTER, _NUMBER, _MARK, _ODD = range(5)
_TOP = 0x180
_KIND = np.full(_TOP + 1, _ODD, np.uint8)
_LOW = np.arange(_TOP + 1, dtype=np.uint32)
for _c in (*range(0x21, 0x7F), *range(0xA1, _TOP)):
    if _c != 0x130:
        _KIND[_c] = _LETTER if chr(_c).isalpha() else _NUMBER if chr(_c).isnumeric() else _MARK
        _LOW[_c] = ord(chr(_c).lower())
_KIND[[*range(9, 14), 32]] = _SPACE
_TABLES = [np.random.default_rng(seed).integers(1, 2**63, _TOP + 1, dtype=np.uint64) * U64(2) + U64(1) for seed in (71, 72)]
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def drops_space(spec: dict) -> bool:
    """Whether the tokeniser file cuts texts at white space and by _SPLIT, so that pieces can be encoded one by one."""
    steps = lambda x, key: (x or {}).get(key, [x])
    added = [t["content"] for t in spec.get("added_tokens", [])]
    return steps(spec.get("normalizer"), "normalizers") == _NORMALIZERS and steps(spec.get("pre_tokenizer"), "pretokenizers") == _CUTS and spec.get("post_processor") is None and not any(re.search(r"\s", t) for t in added)


def pieces(low: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """First code points of the pieces that _SPLIT finds in lower-cased text."""
    before = np.concatenate(([_SPACE], kind[:-1]))
    begin = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
    # an apostrophe that begins a piece takes one of s t re ve m ll d with it
    at = np.flatnonzero((low == ord("'")) & begin)
    one, two = (low[np.minimum(at + k, len(low) - 1)] for k in (1, 2))
    is_ = lambda x, c: x == ord(c)
    short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
    long_ = (is_(one, "r") & is_(two, "e")) | (is_(one, "v") & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))
    for takes, n in ((short, 2), (long_, 3)):
        a = at[takes & (at + n <= len(low))]
        begin[a + 1] = False
        a = a[a + n < len(low)] + n
        begin[a[kind[a] == _LETTER]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Calls give (ids of all texts one after the other, number of ids of each text); ids are of type `kind`."""

    def __init__(self, vocabulary: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        from tokenizers import Tokenizer

        self._tokenizer, spec = Tokenizer.from_buffer(vocabulary), json.loads(vocabulary)
        self.kind = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._by_piece = drops_space(spec)
        self._added = [t["content"] for t in spec.get("added_tokens", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        if suffix:
            self._ends[[i for t, i in self._tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        # sorted tables of (hash, check, first id in the pool, number of ids); the second is small and joins the first as it grows
        empty = (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self._tables = [empty, empty]
        self._pool, self._held = np.zeros(1 << 16, self.kind), 0
        self._words: dict[str, np.ndarray] = {}

    def _singly(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and the number of each, by one call where the model marks ends of pieces."""
        ids = np.array(self._tokenizer.encode_batch_fast([" ".join(found)], add_special_tokens=False)[0].ids, self.kind)
        last = np.flatnonzero(self._ends[ids])
        if len(last) != len(found) or (len(ids) and last[-1] != len(ids) - 1):
            every = self._singly(found)
            return np.concatenate(every), np.array([len(x) for x in every])
        return ids, np.diff(last, prepend=-1)

    def _odd(self, words: list[str]) -> list[np.ndarray]:
        new = [w for w in dict.fromkeys(words) if w not in self._words]
        extra = dict(zip(new, self._singly(new), strict=True))
        if len(self._words) < WORDS:
            self._words.update((w, i) for w, i in extra.items() if len(w) < 100)
        return [self._words[w] if w in self._words else extra[w] for w in words]

    def _store(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        if self._held + len(ids) > len(self._pool):
            self._pool = np.concatenate((self._pool[: self._held], np.zeros(max(len(self._pool), len(ids)), self.kind)))
        self._pool[self._held : self._held + len(ids)] = ids
        big, small = self._tables
        first = self._held + np.cumsum(count) - count
        small = tuple(np.concatenate(x) for x in zip(small, (h, check, first, count), strict=True))
        self._held += len(ids)
        if len(small[0]) > len(big[0]) // 4 + 4096:
            big, small = tuple(np.concatenate(x) for x in zip(big, small, strict=True)), tuple(x[:0] for x in small)
            order = np.argsort(big[0], kind="stable")
            big = tuple(x[order] for x in big)
        order = np.argsort(small[0], kind="stable")
        self._tables = [big, tuple(x[order] for x in small)]

    def _looked_up(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id in the pool (-1: unknown) and number of ids of each distinct hash."""
        first, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for table in self._tables:
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
                same = (table[0][at] == h) & (table[1][at] == check)
                first[same], count[same] = table[2][at[same]], table[3][at[same]]
        return first, count

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not self._by_piece:
            every = self._singly([t.decode() for t in texts])
            return np.concatenate([*every, np.zeros(0, self.kind)]), np.array([len(x) for x in every], np.int64)
        whole = [t.decode() for t in texts]
        size = np.fromiter(map(len, whole), np.int64, len(whole)) + 1
        joined = " ".join([*whole, ""])
        del whole
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        within = np.minimum(code, _TOP)
        kind = _KIND[within]
        odd = [(m.start(), m.end()) for t in self._added for m in re.finditer(re.escape(t), joined)]
        space = kind == _SPACE
        at = np.concatenate((np.flatnonzero(kind == _ODD), np.array([a for a, _ in odd], np.int64)))
        words = np.zeros((0, 2), np.int64)
        if len(at):  # the words around them are kept from the rest
            edge = np.flatnonzero(space)
            k = np.unique(np.searchsorted(edge, at))
            words = np.stack((np.where(k > 0, edge[k - 1] + 1, 0), edge[k]), axis=1)
            cover = np.zeros(len(code) + 1, np.int8)
            cover[words[:, 0]] += 1
            cover[words[:, 1]] -= 1
            kind = np.where(np.cumsum(cover, dtype=np.int8)[:-1] > 0, np.uint8(_SPACE), kind)
        low = np.where(kind == _SPACE, np.uint32(32), _LOW[within])
        begin = pieces(low, kind)
        new = np.zeros(len(low) + 1, bool)
        new[begin] = True
        new[np.flatnonzero((kind == _SPACE) & np.concatenate(([False], kind[:-1] != _SPACE)))] = True
        cut = np.flatnonzero(new)
        end = np.append(cut, len(low))[np.searchsorted(cut, begin) + 1] if len(begin) else begin
        h, check = (self._hash(low, begin, end, k) for k in (0, 1))
        value, lead, inverse = np.unique(h, return_index=True, return_inverse=True)
        first, count = self._looked_up(value, check[lead])
        unknown = np.flatnonzero(first < 0)
        pools = [self._pool]
        if len(unknown):
            text = low.tobytes().decode("utf-32-le")
            ids, n = self._together([text[a:b] for a, b in zip(begin[lead[unknown]].tolist(), end[lead[unknown]].tolist(), strict=True)])
            if sum(len(t[0]) for t in self._tables) < KNOWN:
                at_ = self._held
                self._store(value[unknown], check[lead[unknown]], ids, n)
                pools = [self._pool]
            else:
                at_ = len(self._pool)
                pools.append(ids)
            first[unknown], count[unknown] = at_ + np.cumsum(n) - n, n
        place, first, count = begin, first[inverse], count[inverse]
        # of equal hashes with another check, the later ones are asked for by themselves: no collision goes unseen
        apart = np.flatnonzero(check != check[lead][inverse])
        texts_ = [joined[a:b] for a, b in words.tolist()] + [low[a:b].tobytes().decode("utf-32-le") for a, b in zip(begin[apart].tolist(), end[apart].tolist(), strict=True)]
        if texts_:
            got = self._odd(texts_)
            n = np.array([len(x) for x in got])
            lead_ = sum(map(len, pools)) + np.cumsum(n) - n
            pools += got
            first[apart], count[apart] = lead_[len(words) :], n[len(words) :]
            place, first, count = np.append(place, words[:, 0]), np.append(first, lead_[: len(words)]), np.append(count, n[: len(words)])
            order = np.argsort(place, kind="stable")
            place, first, count = place[order], first[order], count[order]
        pool = np.concatenate(pools) if len(pools) > 1 else pools[0]
        run = np.cumsum(count)
        ids = pool[np.repeat(first - (run - count), count) + np.arange(run[-1] if len(run) else 0)]
        edge = np.concatenate(([0], run))[np.searchsorted(place, np.concatenate(([0], np.cumsum(size))))]
        return ids, np.diff(edge)

    @staticmethod
    def _hash(low: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """64-bit hashes of the pieces: a word-wise polynomial over code points, all pieces at once, by length."""
        out = np.zeros(len(begin), U64)
        table, base, n = _TABLES[which], U64(_BASES[which]), end - begin
        left = np.arange(len(begin))
        value = table[low]
        k = 0
        while len(left):
            out[left] = out[left] * base + value[begin[left] + k]
            k += 1
            left = left[n[left] > k]
        return mix(out ^ (n.astype(U64) << U64(48)))


#: One encoder for each vocabulary in a worker process, which serves many tasks.
_ENCODERS: dict[int, Encoder] = {}


def encoder_for(vocabulary: bytes) -> Encoder:
    key = zlib.crc32(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]
