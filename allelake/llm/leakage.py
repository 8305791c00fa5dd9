"""Evaluation passages inside a corpus: which documents have them, and of which items.

Method. Texts are sequences of counted words. Every window of ``WINDOW`` words,
of items and of documents, is embedded by CGK random walks (a walk reads a
word, emits it, and moves on if a random bit of the word and the step says so,
for three times the window's length), under which windows a few edits apart get
embeddings of small Hamming distance. Repeated bit sampling of the embeddings
gives the keys under which document windows meet item windows. A document and
an item that meet often enough along one band of diagonals, as the item's
length lets expect at the target recall, are verified exactly, by the longest
common subsequence within a stretch. Runs of equal words are found by their
hashes, and walks are made only over texts that have as many of an item's words,
in whatever order, as a leak needs.

Windows don't have the item's size: with three of ten words gone, walks over a
whole item are out of step nearly everywhere, and a quote of a few lines of a
long item would be met by no window at all. An item's windows are many, though,
and of each the words between two edits stay in step; so few steps are sampled
a key, and meetings are added up over the item. Equal windows have equal keys,
so verbatim passages are always met.

Words of set formulas, which many speeches share, count on neither side: a run
of ``FORMULA`` words of an item that ``FORMULA_SHARE`` of the different speeches
have without most of the item around it. Copies and reissues of a speech are
one speech, so much copied leaks aren't taken for formulas, nor are items that
leaked as a whole into many speeches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelake.llm import words as W

#: Words of a window, steps of a walk, walks, keys a walk, sampled steps a key.
WINDOW, WALKS, KEYS, SAMPLED = 8, 4, 6, 6
STEPS = 3 * WINDOW

#: Keys that must meet along a band, and different windows of the item, as shares of its words less an allowance; at least one. Passages with
#: 70 % of the words, or with a word put in after every second, reached 0.17 and 0.13 of the words in 98 of 100 cases (items of 49 words and more).
MET, APART, ALLOWED = 0.2, 0.15, 3.0

#: Least run of equal words; least share of the item's words in order; least number of them (fewer are a quote of a few words); longest stretch as a multiple of the item.
RUN, SHARE, LEAST, STRETCH = 12, 0.7, 8, 2.0

#: A formula: words in a run; least share of the different speeches, and least number of them.
FORMULA, FORMULA_SHARE, FORMULA_DOCS = 8, 0.01, 5

#: A speech has the item around a run if its runs cover so much of the item's words, and so many; it doesn't make the run a formula.
AROUND, AROUND_LEAST = 0.5, 4 * FORMULA

#: Columns that tell a speech's occasion, which a reissue keeps.
OCCASION = ("source", "sitting_id", "speech_no", "held_at")

#: Characters of items that are compared in one pass over the documents (about 500 bytes of tables a word, so 150 MB a pass), and of those whose
#: formulas are sought in one pass (40 bytes a word). More make further passes; an item longer than that has one of its own.
BLOCK, FORMULA_BLOCK = 2_000_000, 16_000_000

#: Bits of a word by which it is told apart in the look at whole texts that comes before all walks.
CODE = 13

#: Words of a patch, the unit in which a document's words are noted for a look at candidates.
PATCH = 32

_GAP = 2 * RUN + WINDOW
_SLICE = 1 << 15
_WORDS = 400_000
_PAIRS = 8_000_000
_SIDE = 512


def _samples() -> np.ndarray:
    """(walk, key, sampled step) in ascending order, fixed by a seed."""
    rng = np.random.default_rng(20240101)
    return np.sort(np.stack([[rng.permutation(STEPS)[:SAMPLED] for _ in range(KEYS)] for _ in range(WALKS)]), axis=2)


_STEPS = _samples()
_SALT = W.mixed(np.arange(1, WALKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = W.mixed(np.arange(1, STEPS + 1, dtype=np.uint64)) | np.uint64(1)


def embedding_keys(seq: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each (walk, key): the keys of the windows that start in ``lo:hi``. ``seq`` must go on for a window after ``hi``.

    A walk that reaches a window's last word stays there, so a key depends on its window alone.
    """
    part = seq[lo : hi + WINDOW]
    size = hi - lo
    first = np.arange(size)
    last = first + (WINDOW - 1)
    out, coin = np.empty(size, np.uint64), np.empty(size, np.uint8)
    with np.errstate(over="ignore"):
        for walk in range(WALKS):
            bits = W.mixed(part ^ _SALT[walk]).view(np.uint8).reshape(-1, 8)
            coins = [np.ascontiguousarray(bits[:, b]) for b in range((STEPS + 7) // 8)]
            keys = [np.full(size, walk * KEYS + k + 1, np.uint64) for k in range(KEYS)]
            at = first.copy()
            end = int(_STEPS[walk].max())
            for step in range(end + 1):
                users = [k for k in range(KEYS) if step in _STEPS[walk, k]]
                if users:
                    part.take(at, out=out, mode="clip")
                    out *= _ODD[step]
                    for k in users:
                        keys[k] += out
                if step == end:
                    break
                coins[step >> 3].take(at, out=coin, mode="clip")
                coin >>= step & 7
                coin &= 1
                at += coin
                if step >= WINDOW - 2:  # no walk is further before
                    np.minimum(at, last, out=at)
            for k in range(KEYS):
                yield walk * KEYS + k, keys[k]  # sums of hashes times odd numbers: as even as hashes


def without(seq: np.ndarray, formulas: W.Lookup) -> np.ndarray:
    """Whether each word counts: it is in no run that is a formula."""
    counted = np.ones(len(seq), bool)
    if len(formulas):
        starts, _ = formulas.find(W.grams(seq, FORMULA))
        for i in range(FORMULA):
            counted[starts + i] = False
    return counted


@dataclass
class Bags:
    """Which words each item has, and which of them more than once, for a first look at whole texts. Words are told apart by ``CODE`` bits, so no text is missed."""

    once: np.ndarray  # by a word's code: its column, -1 if no item has it
    twice: np.ndarray  # by that column: another for texts that have the word again, -1 if no item does
    need: np.ndarray  # words that a text must have, by item
    width: int  # columns
    parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # of some items each: the first, their columns; then by entry its place among those, the item, how many words

    @classmethod
    def of(cls, words: np.ndarray, size: np.ndarray, need: np.ndarray) -> Bags:
        """``words`` of all items, one item's after another's."""
        both, count = _distinct(np.repeat(np.arange(len(size)), size) << CODE | (words >> np.uint64(64 - CODE)).view(np.int64))
        item, code = both >> CODE, both & ((1 << CODE) - 1)
        known, again = np.unique(code), count > 1
        once, twice = np.full(1 << CODE, -1), np.full(len(known), -1)
        once[known] = np.arange(len(known))
        column = once[code]
        more = np.unique(column[again])
        twice[more] = len(known) + np.arange(len(more))
        # An entry for the first of a word, and one for all others.
        item, column = np.concatenate([item, item[again]]), np.concatenate([column, twice[column[again]]])
        count = np.concatenate([np.ones(len(again), np.int64), count[again] - 1])
        parts = []
        for lo in range(0, len(size), _SIDE):
            own = np.flatnonzero((item >= lo) & (item < lo + _SIDE))
            used, place = np.unique(column[own], return_inverse=True)
            parts.append((lo, used, place, item[own] - lo, count[own]))
        return cls(once, twice, need, len(known) + len(more), parts)

    def enough(self, seq: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(text, item): whether the text has as many of the item's words as a leak needs, in whatever order."""
        out = np.zeros((len(starts) - 1, len(self.need)), bool)
        for a in range(0, len(out), _SIDE):  # bounded memory
            part = starts[a : a + _SIDE + 1]
            own = seq[part[0] : part[-1]]
            column = self.once.take((own >> np.uint64(64 - CODE)).view(np.int64))
            at = np.flatnonzero((column >= 0) & (own != 0))
            has, count = _distinct(np.repeat(np.arange(len(part) - 1), np.diff(part))[at] * self.width + column[at])
            texts = np.zeros((len(part) - 1, self.width), np.float32)
            texts.ravel()[has] = 1
            text, column = np.divmod(has[count > 1], max(self.width, 1))
            column = self.twice[column]
            texts[text[column >= 0], column[column >= 0]] = 1
            for lo, used, place, item, words in self.parts:
                need = self.need[lo : lo + _SIDE]
                items = np.zeros((len(used), len(need)), np.float32)
                items[place, item] = words
                out[a : a + _SIDE, lo : lo + _SIDE] = (texts if len(used) == self.width else texts[:, used]) @ items >= need
        return out


@dataclass
class Items:
    """Items ready to be met: their counted words in one array, and the windows by key."""

    ids: list
    seq: np.ndarray
    first: np.ndarray  # where each item starts in seq
    size: np.ndarray  # counted words of each
    need: np.ndarray  # words in order that make a leak
    item: np.ndarray  # by place in seq: the item
    bags: Bags
    runs: tuple[W.Lookup, np.ndarray, np.ndarray]  # of RUN words: hashes, where each one's places begin, places
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by key number: the keys in order, where each one's windows begin, window starts, bitmap

    @classmethod
    def of(cls, pairs: list[tuple], formulas: W.Lookup) -> Items:
        parts, first, size, at = [np.zeros(_GAP, np.uint64)], [], [], _GAP
        for _, text in pairs:
            own = W.ids(text)
            own = own[without(own, formulas)]
            parts += [own, np.zeros(_GAP, np.uint64)]
            first.append(at)
            size.append(len(own))
            at += len(own) + _GAP
        seq = np.concatenate(parts)
        first, size = np.array(first, np.int64), np.array(size, np.int64)
        item = np.searchsorted(first, np.arange(len(seq)), "right") - 1
        need = np.maximum(LEAST, np.ceil(SHARE * size - 1e-9).astype(np.int64))
        starts = _whole(seq, RUN)
        hashes = W.grams(seq, RUN)[starts]
        runs = W.Lookup(hashes), np.concatenate([[0], np.cumsum(_distinct(hashes)[1])]), starts[np.argsort(hashes, kind="stable")]
        starts = _whole(seq, WINDOW)
        tables = []
        for _, keys in embedding_keys(seq, 0, max(0, len(seq) - WINDOW)):
            own = keys[starts]
            order = np.argsort(own, kind="stable")
            known, count = _distinct(own)
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(known >> np.uint64(44)).astype(np.int64)] = True
            tables.append((known, np.concatenate([[0], np.cumsum(count)]), starts[order].astype(np.int32), bitmap))
        return cls([p[0] for p in pairs], seq, first, size, need, item, Bags.of(seq[seq != 0], size, need), runs, tables)

    def meetings(self, seq: np.ndarray, text: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of window starts, in ``seq`` and in the items, that share keys, and how many they share. Only of pairs of text and item that are open; ``text`` is by place in ``seq``."""
        n = len(seq) - WINDOW
        row, open_ = text * len(self.ids), open_.ravel()
        both = []
        for lo in range(0, max(n, 0), _SLICE):
            hi = min(lo + _SLICE, n)
            for k, keys in embedding_keys(seq, lo, hi):
                known, begin, starts, bitmap = self.tables[k]
                if not len(known):
                    continue
                near = np.flatnonzero(bitmap.take((keys >> np.uint64(44)).view(np.int64)))
                near = near[seq[near + lo] != 0]  # a window that starts between texts may meet what the next text has
                own = keys[near]
                place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                met = known[place] == own
                place = place[met]
                which, at = _each(begin[place], begin[place + 1])
                p, q = (near[met] + lo)[which], starts[at]
                kept = open_.take(row.take(p) + self.item.take(q))
                both.append(p[kept] * np.int64(len(self.seq)) + q[kept])
        if not both:
            return (np.empty(0, np.int64),) * 3
        both, keys = _distinct(np.concatenate(both))
        p, q = np.divmod(both, len(self.seq))
        return p, q, keys

    def verified(self, seq: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(text number, item number) of all leaks in ``seq``, whose texts begin at ``starts`` with gaps between."""
        found: set[tuple[int, int]] = set()
        some = max(1, _PAIRS // max(1, len(self.ids)))
        for a in range(0, len(starts) - 1, some):  # bounded memory
            part = starts[a : a + some + 1]
            found.update((a + t, k) for t, k in self._verified(seq[part[0] : part[-1]], part - part[0]))
        return found

    def _verified(self, seq: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        text, item = self._runs(seq, starts)
        found = set(zip(text.tolist(), item.tolist()))
        # The rest: only texts that have enough words of an item are looked at further.
        open_ = self.bags.enough(seq, starts)
        open_[text, item] = False
        among = np.flatnonzero(open_.any(axis=1))
        if not len(among):
            return found
        sizes = np.diff(starts)
        seq = seq[np.repeat(open_.any(axis=1), sizes)]
        starts = np.concatenate([[0], np.cumsum(sizes[among])])
        number = np.repeat(np.arange(len(among)), sizes[among])
        p, q, keys = self.meetings(seq, number, open_[among])
        text, item = number[p], self.item[q]
        many = np.int64(len(self.ids))
        code, n = text * many + item, self.size[item]
        open_ = np.bincount(code, keys, len(among) * int(many))[code] >= np.maximum(1, MET * n - ALLOWED)  # spares most of the sorting below
        text, item, keys, n, window = text[open_], item[open_], keys[open_], n[open_], q[open_]
        if not len(text):
            return found
        # Bands of diagonals, twice over so that no border cuts all of one. They begin with the text, so what else is looked at makes no difference.
        diagonal = p[open_] - starts[text] - (window - self.first[item])
        least, bands = diagonal.min(), (int(diagonal.max()) + 2 * int(n.max())) // LEAST + 2
        places = []
        wide = int(np.ptp(diagonal)) + 1
        for shift in (0, 1):
            code = (text * many + item) * bands + (diagonal + n + shift * (n // 2)) // n
            order = np.argsort(code)
            code = code[order]
            at = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
            one = order[at]
            kept = np.add.reduceat(keys[order], at) >= np.maximum(1, MET * n[one] - ALLOWED)
            band = np.repeat(np.where(kept, np.cumsum(kept) - 1, -1), np.diff(at, append=len(order)))
            inside = np.flatnonzero(band >= 0)
            apart = np.bincount(_distinct(band[inside] * np.int64(len(self.seq)) + window[order[inside]])[0] // len(self.seq), minlength=int(kept.sum()))
            enough = apart >= np.maximum(1, APART * n[one[kept]] - ALLOWED)
            kept = np.flatnonzero(kept)[enough]
            near, far = np.minimum.reduceat(diagonal[order], at)[kept], np.maximum.reduceat(diagonal[order], at)[kept]
            one = one[kept]
            places.append(((text[one] * many + item[one]) * wide + near - least) * (int(n.max()) + 1) + far - near)
        code, far = np.divmod(_distinct(np.concatenate(places))[0], int(n.max()) + 1)
        code, near = np.divmod(code, wide)
        t, k = np.divmod(code, many)
        if not len(t):
            return found
        near = near + least + starts[t]
        far = far + near
        n = self.size[k]
        slack = n // 4 + WINDOW  # what lies before the first and behind the last meeting may drift so far
        lo, hi = np.maximum(near - slack, starts[t]), np.minimum(far + n + slack, starts[t + 1])
        for c in self._may(seq, lo, hi, k).tolist():
            pair = int(among[t[c]]), int(k[c])
            if pair not in found and self._within(seq, int(k[c]), int(lo[c]), int(hi[c])):
                found.add(pair)
        return found

    def _runs(self, seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and item numbers of pairs that share ``RUN`` equal words."""
        lookup, begin, places = self.runs
        hit, which = lookup.find(W.grams(seq, RUN))
        one, at = _each(begin[which], begin[which + 1])
        p, q = hit[one], places[at]
        for i in range(RUN):
            same = seq[p + i] == self.seq[q + i]
            p, q = p[same], q[same]
        return np.divmod(np.unique((np.searchsorted(starts, p, "right") - 1) * np.int64(len(self.ids)) + self.item[q]), max(1, len(self.ids)))

    def _may(self, seq: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Candidates of whose item enough words are in the stretch or close to it, in whatever order. Words are told apart by ``CODE`` bits, so none is missed."""
        shift, last = np.uint64(64 - CODE), np.maximum(hi - 1, lo) // PATCH
        patch = np.flatnonzero(seq) // PATCH
        there = np.zeros((len(seq) // PATCH // 64 + 2) << CODE, np.uint64)  # by 64 patches and word: a bit for each patch that has it
        np.bitwise_or.at(there, patch // 64 << CODE | (seq[seq != 0] >> shift).view(np.int64), np.uint64(1) << (patch % 64).astype(np.uint64))
        codes, kept = (self.seq >> shift).view(np.int64), [np.empty(0, np.int64)]
        for a in range(0, len(k), 4_000):  # bounded memory
            own = slice(a, a + 4_000)
            size = self.size[k[own]]
            word = codes[_each(self.first[k[own]], self.first[k[own]] + size)[1]]
            seen = np.zeros(len(word), bool)
            first, left = lo[own] // PATCH, last[own] - lo[own] // PATCH + 1
            while (left > 0).any():  # 64 patches, of two rows
                mask = ~np.uint64(0) >> (64 - np.clip(left, 0, 64)).astype(np.uint64)
                place, bit = np.repeat(first // 64 << CODE, size) + word, np.repeat((first % 64).astype(np.uint64), size)
                both = there.take(place) >> bit | there.take(place + (1 << CODE)) << (np.uint64(64) - bit)
                seen |= both & np.repeat(mask, size) != 0
                first, left = np.minimum(first + 64, last[own]), left - 64
            kept.append(a + np.flatnonzero(np.add.reduceat(seen, np.cumsum(size) - size, dtype=np.int64) >= self.need[k[own]]))
        return np.concatenate(kept)

    def _within(self, seq: np.ndarray, k: int, lo: int, hi: int) -> bool:
        """Whether enough words of the item are in order within one stretch of ``seq[lo:hi]``."""
        own, need = self.seq[self.first[k] : self.first[k] + self.size[k]], int(self.need[k])
        if common(own, seq[lo:hi]) < need:
            return False
        part, span = seq[lo:hi], int(STRETCH * self.size[k])
        at = np.flatnonzero(np.isin(part, own))
        # A stretch begins with one of the item's words; of those that hold enough of them each is looked at.
        ends = np.searchsorted(at, at + span)
        return any(common(own, part[at[i] : at[i] + span]) >= need for i in np.flatnonzero(ends - np.arange(len(at)) >= need).tolist())


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each is there."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(at, append=len(x))


def _each(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges ``begin`` to ``end``: the number of the range, and the place."""
    count = end - begin
    which = np.repeat(np.arange(len(begin)), count)
    return which, np.arange(len(which)) + (begin - (np.cumsum(count) - count))[which]


def _whole(seq: np.ndarray, n: int) -> np.ndarray:
    """Starts of ``n`` words without a gap."""
    whole = np.ones(max(0, len(seq) - n), bool)
    for i in range(n):
        whole &= seq[i : i + len(whole)] != 0
    return np.flatnonzero(whole)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two id arrays (bit-parallel)."""
    place: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        place[x] = place.get(x, 0) | 1 << i
    ones = (1 << len(a)) - 1
    row = ones
    for x in b.tolist():
        if x and (m := place.get(x)):
            u = row & m
            row = (row + u | row - u) & ones
    return len(a) - row.bit_count()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, joined words, starts) of a bounded number of words each; a longer text stands alone."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        held: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            held.append(i)
            size += len(t or "") // 6 + _GAP
            if size > _WORDS:
                yield [keys[h] for h in held], *W.joined([texts[h] for h in held], _GAP)
                held, size = [], 0
        if held:
            yield [keys[h] for h in held], *W.joined([texts[h] for h in held], _GAP)


@dataclass
class Runs:
    """The items' runs of ``FORMULA`` words, and where in the items each stands."""

    lookup: W.Lookup
    first: np.ndarray  # by run: where its places start in item and at
    item: np.ndarray
    at: np.ndarray
    size: np.ndarray  # words of each item
    longest: np.ndarray  # by run: the item with most words that has it

    @classmethod
    def of(cls, pairs: list[tuple]) -> Runs:
        none = np.empty(0, np.int64)
        own = [W.ids(t) for _, t in pairs]
        hashes = [W.grams(x, FORMULA) for x in own]
        lookup = W.Lookup(np.concatenate(hashes or [np.empty(0, np.uint64)]))
        run = np.searchsorted(lookup.known, np.concatenate(hashes)) if len(lookup) else none
        item = np.repeat(np.arange(len(own)), [len(h) for h in hashes])
        at = np.concatenate([none, *[np.arange(len(h)) for h in hashes]])
        size = np.array([len(x) for x in own], np.int64)
        order = np.lexsort((at, item, size[item], run))
        run, item, at = run[order], item[order], at[order]
        first = np.searchsorted(run, np.arange(len(lookup) + 1))
        return cls(lookup, first, item, at, size, item[first[1:] - 1])

    def alone(self, seq: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, run) in ascending order of the runs that texts have without most of the item around them."""
        hit, which = self.lookup.find(W.grams(seq, FORMULA))
        both = np.unique((np.searchsorted(starts, hit, "right") - 1) * np.int64(len(self.lookup)) + which)
        if not len(both):
            return both, both
        text, run = both // len(self.lookup), both % len(self.lookup)
        many = self.first[run + 1] - self.first[run]
        place = np.arange(many.sum()) + np.repeat(self.first[run] - (np.cumsum(many) - many), many)
        wide = self.size.max() + FORMULA
        codes = np.unique((np.repeat(text, many) * len(self.size) + self.item[place]) * wide + self.at[place])
        pair, group = np.unique(codes // wide, return_inverse=True)
        covered = np.bincount(group, np.minimum(np.diff(codes, append=codes[-1] + wide), FORMULA))
        around = pair[covered >= np.maximum(AROUND_LEAST, AROUND * self.size[pair % len(self.size)])]
        left = ~np.isin(text * len(self.size) + self.longest[run], around)
        return text[left], run[left]


def _told_apart(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc`` and the text. ``doc`` says what speech a row is of (``root`` by reference, ``occasion`` by its circumstances) and orders its issues; columns that aren't there tell nothing."""
    has = set(documents.columns)
    reissue = F.col("reissue_of") if "reissue_of" in has else F.lit(None)
    root = F.xxhash64(F.coalesce(reissue.cast("string"), F.col(doc_id).cast("string")))
    told = [F.col(c) for c in OCCASION if set(OCCASION) <= has]
    known = F.lit(bool(told))
    for c in told:
        known &= c.isNotNull()
    published = F.unix_micros(F.col("published_at").cast("timestamp")) if "published_at" in has else F.lit(None).cast("long")
    doc = F.struct(
        reissue.isNotNull().cast("long").alias("again"), F.coalesce(published, F.lit((1 << 63) - 1)).alias("published"), F.xxhash64(doc_id).alias("tie"),
        root.alias("root"), F.when(known, F.xxhash64(F.lit("occasion"), *told)).otherwise(root).alias("occasion"),
    )
    return documents.where(F.col(doc_id).isNotNull()).select(doc.alias("doc"), F.col(text))


def _formula_runs(documents: DataFrame, pairs: list[tuple]) -> W.Lookup:
    """The items' runs that are formulas. ``documents`` are as :func:`_told_apart` gives them; of each speech the first issue counts, and equal texts count once."""
    runs = Runs.of(pairs)
    if not len(runs.lookup):
        return runs.lookup
    known = documents.sparkSession.sparkContext.broadcast(runs)  # of at most FORMULA_BLOCK characters, or one item
    fields = ("again", "published", "tie", "root", "occasion")
    schema = pa.struct([*[(f, pa.int64()) for f in fields], ("words", pa.int64()), ("runs", pa.list_(pa.int32()))])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = known.value
        for docs, seq, starts in _chunks(batches):
            text, run = runs.alone(seq, starts)
            ends = np.searchsorted(text, np.arange(len(docs) + 1))
            own = [
                d | {"words": xxhash.xxh3_64_intdigest(seq[starts[i] : starts[i + 1]].tobytes()) - (1 << 63), "runs": run[ends[i] : ends[i + 1]]} for i, d in enumerate(docs)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(own, schema)], names=["speech"])

    speeches = documents.mapInArrow(seen, f"speech struct<{', '.join(f'{f}: long' for f in fields)}, words: long, runs: array<int>>")
    for same in ("root", "occasion", "words"):  # combined before each shuffle, so many copies of one speech are no skew
        speeches = speeches.groupBy(F.col("speech")[same].alias("same")).agg(F.min("speech").alias("speech"))
    counted = speeches.select(F.explode(F.concat(F.array(F.lit(-1)), F.col("speech.runs"))).alias("run")).groupBy("run").count()
    total = dict(counted.collect())  # a row per run of the items
    least = max(FORMULA_DOCS, FORMULA_SHARE * total.pop(-1, 0))
    return W.Lookup(runs.lookup.known[sorted(i for i, n in total.items() if n >= least)])


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each document and item of which the document has a passage: columns ``doc_id``, ``item_id``, each pair once.

    A passage is a run of ``RUN`` words of the item, or ``SHARE`` of its words in
    order within a stretch of ``STRETCH`` times its length. Rows with a null id are
    left out; null and empty texts have no words; items with fewer than ``LEAST``
    counted words can only be too short a quote and are never found; repeated
    rows change nothing; empty tables give no rows. Of other columns only
    ``reissue_of``, ``published_at`` and those of ``OCCASION`` are read, if they are
    there, to count a speech once however often it was issued.
    """
    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id), F.col(text))
    apart = _told_apart(documents, doc_id, text)
    given = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(item_id, item_text).distinct()
    types = _arrow(docs, doc_id), _arrow(given, item_id)
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}"
    send = documents.sparkSession.sparkContext.broadcast

    def one(pairs: list[tuple], formulas: W.Lookup) -> DataFrame:
        ready, runs = send(Items.of(pairs, formulas)), send(formulas)  # of at most BLOCK characters, or one item

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, formulas = ready.value, runs.value
            for keys, seq, starts in _chunks(batches):
                counted = without(seq, formulas)
                starts = np.concatenate([[0], np.cumsum(counted)])[starts]
                seq = seq[counted]
                found = sorted(items.verified(np.concatenate([seq, np.zeros(WINDOW + 1, np.uint64)]), starts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[t] for t, _ in found], types[0]), pa.array([items.ids[k] for _, k in found], types[1])], names=[doc_id, item_id]
                )

        return docs.mapInArrow(search, schema)

    parts: list[DataFrame] = []
    for group in _blocks(given.toLocalIterator(), FORMULA_BLOCK):
        formulas = _formula_runs(apart, group)  # one pass for several blocks
        parts += [one(block, formulas) for block in _blocks(group, BLOCK)]
    out = parts[0] if parts else one([], W.Lookup(np.empty(0, np.uint64)))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _blocks(rows: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    """(id, text) pairs in lists of at most ``most`` characters; a longer text stands alone."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        if held and size + len(row[1]) > most:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += len(row[1])
    if held:
        yield held


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
