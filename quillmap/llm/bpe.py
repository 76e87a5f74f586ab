"""Byte-pair merges for many words at once, in numpy.

The tokenizers library takes some 15 microseconds for a word that it hasn't seen; texts with many
different words spend most of their time there. This applies the same vocabulary and merges, read
from the tokenizer's file, to arrays of words. It takes words of plain Latin letters with ASCII
marks behind them (a pre-token of letters and one of marks); all others are left to the library,
as are all words of tokenizers of another kind.
"""

from __future__ import annotations

import json
import os

import numpy as np

from . import kernels as K

NONE = np.iinfo(np.int32).max
LONGEST = 40  #: bytes; longer words are left to the library


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class VectorBpe:
    """Merges of a byte-level BPE with an end-of-word suffix."""

    @classmethod
    def of(cls, path: str) -> "VectorBpe | None":
        """None if the file's tokenizer isn't of the kind whose words can be merged here."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        steps = [p.get("type") for p in pre.get("pretokenizers", [])]
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        fits = (
            model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges")
            and steps == ["Split", "ByteLevel"] and r"[\p{L}]+" in pre["pretokenizers"][0]["pattern"].get("Regex", "") and normal == ["NFC", "Replace", "Lowercase"]
        )
        return cls(model["vocab"], model["merges"]) if fits else None

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        letter = byte_letters()
        self.start = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.end = np.array([vocab[letter[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = made
        # an open table of the pairs: (key, rank), found in a few probes
        self.bits = int(2 * len(keys)).bit_length() + 1
        self.table = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.probes = 1
        for rank, key in enumerate(keys.tolist()):
            at, step = self._slot_of(key), 1
            while self.table[at] >= 0:
                at, step = (at + 1) & (1 << self.bits) - 1, step + 1
            self.table[at], self.ranks[at] = key, rank
            self.probes = max(self.probes, step)

    def _slot_of(self, key: int) -> int:
        return ((key * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> (64 - self.bits)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.table[at]
        out = np.where(found == key, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (1 << self.bits) - 1
            found = self.table[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merged(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, all ids) for words in the rows of a matrix of bytes."""
        n, width = raw.shape
        ids = self.start[raw]
        last = raw[np.arange(n), size - 1]
        ids[np.arange(n), size - 1] = self.end[last]
        columns = np.arange(width)
        ids[columns[None, :] >= size[:, None]] = -1
        final = np.full((n, width), -1, np.int64)
        rank = np.full((n, width), NONE, np.int32)
        if width > 1:
            live = columns[None, :-1] < size[:, None] - 1
            rank[:, :-1][live] = self._rank(ids[:, :-1][live], ids[:, 1:][live])
        rows = np.arange(n)
        while len(rows):
            at = rank.argmin(1)
            here = np.arange(len(rows))
            best = rank[here, at]
            done = best == NONE
            if done.any():
                final[rows[done], : ids.shape[1]] = ids[done]
                keep = ~done
                rows, ids, rank, at, best = rows[keep], ids[keep], rank[keep], at[keep], best[keep]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            after = columns[None, : ids.shape[1] - 1] > at[:, None]
            ids[here, at] = self.made[best]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            rank[:, :-1] = np.where(after, rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            for spot in (at - 1, at):
                fine = (spot >= 0) & (spot < ids.shape[1] - 1)
                r, c = here[fine], spot[fine]
                a, b = ids[r, c], ids[r, c + 1]
                new = np.full(len(r), NONE, np.int32)
                real = (a >= 0) & (b >= 0)
                new[real] = self._rank(a[real], b[real])
                rank[r, c] = new
        return (final >= 0).sum(1), final[final >= 0]


# Bytes of ASCII letters, and of ASCII marks that split no contraction.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TextEncoder:
    """Ids of whole texts. The tokenizer drops white space and never joins across it, so a word's ids
    don't depend on its neighbours; a worker keeps the ids of the words that it has seen, by the
    words' 64-bit hashes, in arrays of bounded size."""

    def __init__(self, path: str, most_words: int = 2_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = VectorBpe.of(path)
        self.most_words = most_words
        self.tails: dict[bytes, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.hash, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _library(self, words: list[bytes]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(c.ids, np.int64) for c in coded]

    def many(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        raw, starts, ends, hashes, bounds = K.spans_of(texts)
        if not len(hashes):
            return [b""] * len(texts)
        distinct, sample, of = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hash) + len(distinct) > self.most_words:
            self._forget()
        fresh = distinct[~self._known(distinct)]
        if len(fresh):
            at = sample[np.searchsorted(distinct, fresh)]
            count, ids = self._learn(raw, starts[at], ends[at])
            first = len(self.ids) + np.cumsum(count) - count
            place = np.searchsorted(self.hash, fresh)
            self.hash, self.first, self.count = np.insert(self.hash, place, fresh), np.insert(self.first, place, first), np.insert(self.count, place, count)
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
        entry = np.searchsorted(self.hash, distinct)
        count = self.count[entry][of]
        flat = self.ids[K.spread(self.first[entry][of], count)].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(count)])[bounds] * 4
        return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hash, hashes)
        inside = at < len(self.hash)
        inside[inside] = self.hash[at[inside]] == hashes[inside]
        return inside

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each of these words has, all ids)."""
        n, size = len(starts), ends - starts
        flat = raw[K.spread(starts, size)]
        begin = np.cumsum(size) - size
        # Latin-1 letters are C3 and one more byte; a continuation byte's lead is in the same word
        second = np.zeros(len(flat), bool)
        second[1:] = (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0xBF) & (flat[1:] != 0x97) & (flat[1:] != 0xB7)
        letter, mark = _LETTER[flat] | second, _MARK[flat]
        letter[:-1] |= second[1:]
        low = np.where(second & (flat < 0x9F), flat + 0x20, _LOWER[flat]).astype(np.uint8)
        bad = ~(letter | mark)
        turn = mark[:-1] & letter[1:]
        turn[begin[1:] - 1] = False
        bad[1:] |= turn
        core = np.add.reduceat(letter.astype(np.int64), begin)
        plain = (np.add.reduceat(bad.astype(np.int64), begin) == 0) & letter[begin] & (core <= LONGEST)
        if self.merger is None:
            plain[:] = False
        count = np.zeros(n, np.int64)
        chunks, holders = [], []  # ids and the (word, place in it) that they belong to

        def put(which: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
            chunks.append(ids)
            holders.append((which, counts, count[which].copy()))
            count[which] += counts

        order = np.flatnonzero(plain)
        order = order[np.argsort(core[order], kind="stable")]
        k = 0
        while k < len(order):  # words of like length together
            most = int(core[order[k]])
            most = max(4, most + most // 4)
            upto = min(k + 8192, int(np.searchsorted(core[order], most, "right")))
            part = order[k:upto]
            width = int(core[part[-1]])
            spots = np.minimum(begin[part][:, None] + np.arange(width)[None, :], len(low) - 1)
            put(part, *self.merger.merged(low[spots], core[part]))
            k = upto
        tailed = np.flatnonzero(plain & (core < size))
        tails = [flat[a:b].tobytes() for a, b in zip((begin + core)[tailed].tolist(), (begin + size)[tailed].tolist())]
        if new := list({t for t in tails if t not in self.tails}):
            if len(self.tails) > 100_000:
                self.tails.clear()
                new = list(set(tails))
            self.tails.update(zip(new, self._library(new)))
        if tails:
            ids = [self.tails[t] for t in tails]
            put(tailed, np.array([len(x) for x in ids]), np.concatenate(ids))
        other = np.flatnonzero(~plain)
        if len(other):
            ids = self._library([flat[a : a + s].tobytes() for a, s in zip(begin[other].tolist(), size[other].tolist())])
            put(other, np.array([len(x) for x in ids]), np.concatenate(ids))
        out = np.zeros(int(count.sum()), np.int64)
        first = np.cumsum(count) - count
        for ids, (which, counts, before) in zip(chunks, holders):
            out[K.spread(first[which] + before, counts)] = ids
        return count, out
