"""Token ids of many texts at once: distinct units encoded once per worker, ids gathered by numpy.

A unit is a word with the one space before it, or a line end. No pre-token of a byte-level BPE crosses the start of a
unit, unless two white-space characters meet; a text where they do, or that holds other white space than ASCII, is one
unit of its own. Units are told apart by 64-bit hashes whose bytes are compared as well.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from flowsight.llm import text as T

UNITS = 800_000
UNIT_BYTES = 32_000_000
# units that are encoded in one string, a line end between them
JOINED = 256

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
# last bytes of the white-space characters U+2000 to U+200A, U+2028, U+2029 and U+202F
_E280 = np.zeros(256, bool)
_E280[[*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]] = True


def _wide_white(data: np.ndarray) -> np.ndarray:
    """Byte positions where a white-space character outside ASCII begins."""
    one = np.append(data[1:], 0)
    two = np.append(data[2:], [0, 0])[: len(data)]
    found = (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
    found |= (data == 0xE1) & (one == 0x9A) & (two == 0x80)
    found |= (data == 0xE2) & (((one == 0x80) & _E280[two]) | ((one == 0x81) & (two == 0x9F)))
    return np.flatnonzero(found | ((data == 0xE3) & (one == 0x80) & (two == 0x80)))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all spans, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class UnitEncoder:
    """Byte-level BPE file of the ``tokenizers`` library; special strings are plain text if ``plain``.

    It remembers units by how often they were met: when full, the rarer half goes. That never changes a result.
    """

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = plain
        self.plain = plain
        # a special string may hold a space or line end: then a text that holds it is one unit
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = [] if plain else [s.encode() for s in special]
        # the id of a line end that stands alone; no other text gives it
        end = self._whole(["\n"])[0]
        self.end = end[0] if len(end) == 1 else None
        self._forget()

    def _forget(self) -> None:
        # hashes in order and the unit of each: 16 bytes a unit, a tenth of a dict of int objects
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.hashes, self.seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.id_at, self.raw_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _trim(self) -> None:
        """Keeps the units met most often, at most half of what fits; counts are halved, so old ones fade."""
        half = UNITS // 2
        least = 1 if len(self.seen) <= half else max(1, int(np.partition(self.seen, -half)[-half]))
        keep = np.flatnonzero(self.seen > least)
        lengths, counts = np.diff(self.raw_at)[keep], np.diff(self.id_at)[keep]
        if lengths.sum() > UNIT_BYTES // 2:
            self._forget()
            return
        self.raw, self.ids = self.raw[gather(self.raw_at[keep], lengths)], self.ids[gather(self.id_at[keep], counts)]
        self.raw_at, self.id_at = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(counts)])
        self.hashes, self.seen = self.hashes[keep], self.seen[keep] >> 1
        self.slot = np.argsort(self.hashes)
        self.known = self.hashes[self.slot]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units end to end and how many each has."""
        found = self._whole(units)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _ids(self, units: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_flat``; units marked as words are encoded many at a time: a line end before a word, or before the one
        space that leads it, is a pre-token of its own."""
        at = np.flatnonzero(words)
        if self.end is None or len(at) < JOINED:
            return self._flat(units)
        some = [units[i] for i in at]
        ids, _ = self._flat(["\n".join(some[i : i + JOINED]) + "\n" for i in range(0, len(some), JOINED)])
        ends = np.flatnonzero(ids == self.end)
        if len(ends) != len(some):
            return self._flat(units)
        rest = np.flatnonzero(~words)
        others, counts = self._flat([units[i] for i in rest])
        sizes = np.empty(len(units), np.int64)
        sizes[at], sizes[rest] = np.diff(ends, prepend=-1) - 1, counts
        to = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[gather(to[at], sizes[at])] = ids[ids != self.end]
        out[gather(to[rest], counts)] = others
        return out, sizes

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all units, the text of each and whether it ends a word; empty texts have no units."""
        n = len(data)
        white = _WHITE[data]
        met = np.flatnonzero(white[1:] & white[:-1])
        text_of = lambda at: np.searchsorted(offsets, at, "right") - 1
        met = met[text_of(met) == text_of(met + 1)]
        whole = np.zeros(len(offsets) - 1, bool)
        whole[text_of(met)] = True
        whole[text_of(_wide_white(data))] = True
        if self.special:
            body = data.tobytes()
            for s in self.special:
                at = body.find(s)
                while at >= 0:
                    whole[text_of(np.array([at]))] = True
                    at = body.find(s, at + 1)
        begins = (data == 32) | (data == 10)
        begins[1:] |= data[:-1] == 10
        at = np.flatnonzero(begins)
        at = at[~whole[text_of(at)]]
        edge = np.zeros(n + 1, bool)
        edge[offsets[:-1]] = True
        edge[at] = True
        starts = np.flatnonzero(edge[:n])
        text = text_of(starts)
        return starts, text, ~whole[text] & ~white[np.append(starts[1:], n) - 1]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the first id of each (with the end), from UTF-8 bytes and their offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts, text_of, words = self._units(data, offsets)
        ends = np.append(starts[1:], len(data))
        with np.errstate(over="ignore"):
            hashes = T.span_hashes(T.byte_sums(data), starts, ends)
        some, first, inverse, met = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        if len(self.slot) + len(some) > UNITS or len(self.raw) > UNIT_BYTES:
            self._trim()
        slots = np.full(len(some), -1)
        place = np.searchsorted(self.known, some)
        held = np.flatnonzero(place < len(self.known))
        held = held[self.known[place[held]] == some[held]]
        slots[held] = self.slot[place[held]]
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = len(self.slot) + np.arange(len(new))
            at = first[new]
            self._learn(data, starts[at], ends[at], some[new], words[at])
            # ``some`` is in order, so the new hashes go in between the known ones
            self.known = np.insert(self.known, place[new], some[new])
            self.slot = np.insert(self.slot, place[new], slots[new])
        self.seen[slots] += met
        unit = slots[inverse]
        lengths = ends - starts
        same = np.diff(self.raw_at)[unit] == lengths
        if not same.all() or not np.array_equal(self.raw[gather(self.raw_at[unit], lengths)], data):
            return self._directly(data, offsets)  # two units of one hash
        counts = np.diff(self.id_at)[unit]
        ids = self.ids[gather(self.id_at[unit], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(text_of, np.arange(len(offsets)))]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, words: np.ndarray) -> None:
        body = data.tobytes()
        flat, counts = self._ids([body[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], words)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.seen = np.concatenate([self.seen, np.zeros(len(hashes), np.int64)])
        self.ids = np.concatenate([self.ids, flat])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(counts)])
        self.raw = np.concatenate([self.raw, data[gather(starts, ends - starts)]])
        self.raw_at = np.concatenate([self.raw_at, self.raw_at[-1] + np.cumsum(ends - starts)])

    def _directly(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body = data.tobytes()
        some = self._whole([body[s:e].decode() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        at = np.concatenate([[0], np.cumsum([len(s) for s in some])]).astype(np.int64)
        return np.array([i for s in some for i in s], np.uint32), at


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def unit_encoder(path: str, plain: bool = False) -> UnitEncoder:
    """The encoder of this Python worker: later tasks find what earlier ones have encoded."""
    return UnitEncoder(path, plain)
