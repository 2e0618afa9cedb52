"""Evaluation passages inside pages: pigeonhole pieces under an edit budget, then Myers' bit-parallel distance over the passage.

A leak is a run of ``least`` consecutive words of an item that a page prints in their order with at most ``errors`` letter edits
in all of them together. That many edits leave one of ``errors + 1`` pieces of ``least // (errors + 1)`` words without error,
wherever they stand, so every leak holds an exact hit of a piece. All pieces of all items, at every offset, are the index: sorted
piece numbers with their places, made once and sent to every worker (items are a held-out set of bounded size: ``max_item_words``,
checked). Around every hit all ways to print the neighbouring words are followed, and the runs of ``least`` words are verified:
the passage's letters against the printed letters, by Myers' distance, must stay within the budget.

A run may pass over any number of whole lines (adverts, other columns) and over words broken at a line end, but over no other word:
a word may differ by few edits only (``budget``), and a word that the items use themselves is another word, not a misread one.
Each stretch of words between lines passed over has at least two words (or the item's first or last), so that a chance word at some
line's edge is no run. Stretches with an odd word leave fewer whole pieces: the budget is then one less than the pieces they hold (for
twelve words and five edits never below three), so that here too it doesn't matter where the edits stand.

Pages are read in the order of their columns (from the lines' boxes), or as given if the boxes don't fit the lines.

Defined results
    * words are compared without case (sharp s is ss), accents, punctuation and invisible characters, look-alike letters and compatibility forms made equal.
    * null and empty texts, items of fewer than ``least`` words, null ids: no case. Repeated rows: one case.
    * null boxes, or another number of boxes than lines: lines in the order given.
    * an empty table on either side: no case. Extra columns are ignored.

Scale: one pass over the pages' text and boxes, no shuffle of texts; only found (doc_id, item_id) pairs are made distinct. Hits are
found for a batch of pages at once (binary search), and most chance hits are dropped there by the words beside them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.lookalikes import same_shape

@cache
def folded_shapes() -> dict[str, str]:
    """Letter without case -> the one that stands for all that look like it, in either case: capitals may look alike where small letters don't."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while x in root:
            x = root[x]
        return x

    for other, shape in same_shape().items():
        a, b = find(other.casefold()), find(shape.casefold())
        if a != b:
            a, b = sorted((a, b), key=lambda x: (not x.isascii(), x))
            root[b] = a
    return {x: find(x) for x in root}

class _Fold(dict):
    """Character -> what is compared of it: letters and digits without case, accents and look-alikes; blanks and hyphens kept. Filled as characters are met."""

    def __missing__(self, c: int) -> str | None:
        shape = folded_shapes()
        parts = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(c)).casefold())
        new = "".join(x for x in "".join(shape.get(x, x) for x in parts) if x.isalnum() or x in " \n-")
        if chr(c) in "\u00ad\u200b\u200c\u200d":
            new = ""
        elif unicodedata.category(chr(c)) == "Pd":
            new = "-"
        self[c] = new or None
        return self[c]

_FOLD = _Fold()

def fold(text: str) -> str:
    return text.translate(_FOLD)

def myers(a: str, b: str) -> int:
    """Edit distance (Myers 1999; the pattern's columns are the bits of one integer)."""
    if a == b:
        return 0
    m = len(a)
    if not m or not b:
        return m or len(b)
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for ch in b:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = ((ph << 1) | 1) & full
        pv = ((mh << 1) & full) | (~(xv | ph) & full)
        mv = ph & xv
    return score

def budget(word: str) -> int:
    """Edits that a word may differ by and still be the same word misread: one below three letters (d read as cl is two), two below eight, then three and, from twelve letters on, four."""
    n = len(word)
    return 1 if n < 3 else 2 if n < 8 else 3 if n < 12 else 4

@lru_cache(1_000_000)
def letters(word: str) -> int:
    """The letters of a word as a set of bits: an edit changes two of them at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

def piece_numbers(ids: np.ndarray, size: int) -> np.ndarray:
    """A number for every ``size`` consecutive ids; equal pieces have equal numbers."""
    n = max(0, len(ids) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for s in range(size):
            out = (out ^ (ids[s : s + n].astype(np.uint64) + np.uint64(2))) * MULTIPLIER
            out ^= out >> np.uint64(31)
    return out

class Items:
    """The index of all pieces, and the words of every item: arrays and one dictionary, made once."""

    def __init__(self, rows: list[tuple[int, str]], least: int, errors: int):
        self.least, self.errors, self.size = least, errors, least // (errors + 1)
        if self.size < 1:
            raise ValueError(f"a run of {least} words has no {errors + 1} pieces")
        self.vocabulary: dict[str, int] = {}
        self.names: list[int] = []  # item_id of each item
        self.words: list[list[str]] = []
        lists = []
        for i, text in rows:
            words = [w for w in (x.replace("-", "") for x in fold(text).split()) if w]
            if len(words) >= least:
                self.names.append(i)
                self.words.append(words)
                lists.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        self.start = np.cumsum([0, *map(len, lists)])  # of each item in ids
        self.ids = np.concatenate([*lists, np.full(1, -2)])
        at = [np.arange(a, b - self.size + 1) for a, b in zip(self.start[:-1], self.start[1:])]
        at = np.concatenate([np.zeros(0, np.int64), *at])
        numbers = piece_numbers(self.ids, self.size)[at]
        order = np.argsort(numbers, kind="stable")
        self.at = at[order]
        self.different, first = np.unique(numbers[order], return_index=True)
        self.first = np.append(first, len(at))  # places of each different piece in ``at``
        self.of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])  # item of each place in ids
        self.spelled = list(self.vocabulary)
        self.bits, self.lengths = measures(self.spelled)
        self.budgets = {w: budget(w) for w in self.vocabulary}
        self.most = np.array(list(self.budgets.values()), np.int64)
        self.cache: dict[tuple[str, str], int] = {}

    def alike(self, word: np.ndarray, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """May other words, of which letters and length are given, be the item words (ids) misread? Never denies one that is."""
        most, own = self.most[word], self.bits[word]
        return (np.abs(self.lengths[word] - lengths) <= most) & (np.bitwise_count(own & ~bits) <= most) & (np.bitwise_count(bits & ~own) <= most)

    def misread(self, word: np.ndarray, bits: np.ndarray, lengths: np.ndarray, spelled: Callable[[int], str]) -> np.ndarray:
        """Are other words (spelled(n) for the n-th) item words (ids) misread? Their letters and lengths tell most apart, the rest is compared."""
        hit = self.alike(word, bits, lengths)
        at = np.flatnonzero(hit)
        hit[at] = [self.edits(self.spelled[w], spelled(n)) >= 0 for n, w in zip(at.tolist(), word[at].tolist())]
        return hit

    def may_hold(self, word: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """May the item words (ids), perhaps misread, hold parts of which the letters are given? Never denies one that does."""
        return np.bitwise_count(bits & ~self.bits[word]) <= self.most[word]

    def edits(self, a: str, b: str) -> int:
        """Edits between the item's word a and the page's word b, -1 if b is another word."""
        if a == b:
            return 0
        k = self.budgets[a]
        if not -k <= len(a) - len(b) <= k or b in self.vocabulary:
            return -1
        got = self.cache.get((a, b))
        if got is None:
            x, y = letters(a), letters(b)
            got = myers(a, b) if (x & ~y).bit_count() <= k and (y & ~x).bit_count() <= k else -1
            got = got if got <= k else -1
            if len(self.cache) < 1_000_000:
                self.cache[a, b] = got
        return got


class Page:
    """Words of a page in reading order, with the places where lines start and words that a line end breaks."""

    def __init__(self, lines: list[str]):
        self.words: list[str] = []
        self.line: list[int] = []  # line of each word
        self.start: list[int] = []  # first word of each line
        self.broken: list[bool] = []  # does the word end its line with a hyphen?
        for text in lines:
            n, at, bare = len(self.start), len(self.words), text.replace("-", "").split()
            if bare:
                self.words += bare
                self.line += [n] * len(bare)
                self.broken += [False] * len(bare)
                self.start.append(at)
                text = text.rstrip()
                self.broken[-1] = text[-1] == "-" and text.rsplit(None, 1)[-1].strip("-") != ""
        self.start.append(len(self.words))

    def edges(self, items: Items) -> None:
        """Which lines begin, and which end, with each word that items use; those that begin or end with another word may be misread."""
        self.begins: dict[str, list[int]] = {}
        self.ends: dict[str, list[int]] = {}
        self.odd_begins: list[int] = []
        self.odd_ends: list[int] = []
        for n, (a, b) in enumerate(zip(self.start, self.start[1:])):
            for q, known, odd in ((a, self.begins, self.odd_begins), (b - 1, self.ends, self.odd_ends)):
                w = self.words[q]
                if w in items.vocabulary:
                    known.setdefault(w, []).append(n)
                if b - a == 1 or w not in items.vocabulary and not (q == b - 1 and self.broken[q]):
                    odd.append(n)

    def ways(self, items: Items, word: str, p: int, step: int) -> Iterator[tuple[int, int, str, bool, bool]]:
        """(place after it, edits, letters, lines passed over?, split by them?) of every way to read ``word`` from place p on in direction ``step``."""
        if not 0 <= p < len(self.words):
            return
        line = self.line[p]
        yield from self.here(items, word, p, step)
        if step > 0 and p == self.start[line]:
            others = [n for n in (*self.begins.get(word, ()), *self.odd_begins) if n > line]
        elif step < 0 and p + 1 == self.start[line + 1]:
            others = [n for n in (*self.ends.get(word, ()), *self.odd_ends) if n < line]
        else:
            return
        for n in others:
            for to, e, got, _, split in self.here(items, word, self.start[n] if step > 0 else self.start[n + 1] - 1, step):
                yield to, e, got, True, split

    def here(self, items: Items, word: str, p: int, step: int) -> Iterator[tuple[int, int, str, bool, bool]]:
        """The ways to read ``word`` at place p itself, whole or joined over a line end."""
        if not 0 <= p < len(self.words):
            return
        got, line = self.words[p], self.line[p]
        e = items.edits(word, got)
        if e >= 0:
            yield p + step, e, got, False, False
        if len(got) > len(word) + 4:
            return
        if step > 0 and self.broken[p]:
            for n in range(line + 1, len(self.start) - 1):
                q = self.start[n]
                e = items.edits(word, got + self.words[q])
                if e >= 0:
                    yield q + 1, e, got + self.words[q], n > line + 1, n > line + 1
        elif step < 0 and p == self.start[line]:
            for n in range(line - 1, -1, -1):
                q = self.start[n + 1] - 1
                if self.broken[q]:
                    e = items.edits(word, self.words[q] + got)
                    if e >= 0:
                        yield q - 1, e, self.words[q] + got, n < line - 1, n < line - 1

def follow(items: Items, page: Page, words: list[str], j: int, p: int, step: int, most: int) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """The item's words from j on (downwards if step is -1), at most ``most``: for 0, 1, 2 ... words the ways to print them, each as edits, letters, words of each stretch.

    A new stretch begins behind lines passed over. Of ways that meet at one place with equal stretches that with the fewest edits goes on.
    """
    ways: dict[tuple, tuple[int, str, tuple[int, ...]]] = {(p, (0,)): (0, "", (0,))}
    out = [list(ways.values())]
    while ways and len(out) <= most and 0 <= j < len(words):
        new: dict[tuple, tuple[int, str, tuple[int, ...]]] = {}
        for (at, stretches), (edits, letters, _) in ways.items():
            for to, e, got, over, split in page.ways(items, words[j], at, step):
                total = edits + e
                if total > 2 * items.errors:
                    continue
                if over and 0 <= j + step < len(words) and next(page.here(items, words[j + step], to, step), None) is None:
                    continue  # a chance word
                longer = (*stretches, 0) if split else (*stretches, 1) if over else (*stretches[:-1], stretches[-1] + 1)
                if (to, longer) not in new or new[to, longer][0] > total:
                    new[to, longer] = total, letters + got if step > 0 else got + letters, longer
        ways = new
        j += step
        if ways:
            out.append(list(ways.values()))
    return out

def verified(items: Items, page: Page, words: list[str], j: int, first: int, last: int) -> bool:
    """Is the piece of the item's words from j on, printed at places first to last, in a run of ``least`` words within the budget?"""
    more = items.least - items.size
    right = follow(items, page, words, j + items.size, last + 1, 1, more)
    if len(right) - 1 + j < more:
        return False
    left = follow(items, page, words, j - 1, first - 1, -1, more)
    piece = "".join(words[j : j + items.size])
    for a in range(max(0, more - len(right) + 1), min(more, len(left) - 1) + 1):
        b = more - a
        passage = "".join(words[j - a : j + items.size + b])
        for _, before, x in left[a]:
            for _, after, y in right[b]:
                pieces = sum(n // items.size for n in (*x[1:], *y[1:], x[0] + items.size + y[0]))
                if myers(passage, before + piece + after) <= min(items.errors, pieces - 1):
                    return True
    return False

def measures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters (as bits) and length of each word."""
    return np.array([letters(w) for w in words], np.uint64), np.array([len(w) for w in words], np.int64)

class Edges:
    """The words that the pages' lines begin with (or end with): are two of them, perhaps misread, given item words? (Fewer where a line or item ends.)"""

    def __init__(self, items: Items, ids: np.ndarray, words: list[str], of: np.ndarray, at: np.ndarray, following: np.ndarray, pages: int):
        """ids, words: of all words of the pages; of: page of each line; at: its first (last) word; following: the one beside it, -1 where it may be half a word."""
        self.items, total = items, len(items.vocabulary)
        first = ids[at]
        nexts = np.where(following >= 0, ids[following], -1)
        known = first >= 0
        key = of * total + first
        self.single, self.any = np.unique(key[known & (nexts < 0)]), np.unique(key[known])
        both = known & (nexts >= 0)
        self.double = np.unique(key[both] * total + nexts[both])
        odd = np.flatnonzero(~known)
        self.words = [words[n] for n in at[odd].tolist()]
        self.bits, self.lengths = measures(self.words)
        self.nexts, self.start = nexts[odd], np.searchsorted(of[odd], np.arange(pages + 1))

    def may_be(self, page: np.ndarray, word: np.ndarray, following: np.ndarray) -> np.ndarray:
        """following: the item word after (before) it, -1 if there is none."""
        total = len(self.items.vocabulary)
        key = page * total + word
        hit = within(self.single, key) | within(self.double, key * total + following) | (following < 0) & within(self.any, key)
        rest = np.flatnonzero(~hit)
        of, at = spread(self.start[page[rest]], self.start[page[rest] + 1])
        of = rest[of]
        fits = (self.nexts[at] < 0) | (following[of] < 0) | (self.nexts[at] == following[of])
        of, at = of[fits], at[fits]
        hit[of[self.items.misread(word[of], self.bits[at], self.lengths[at], lambda n: self.words[at[n]])]] = True
        return hit


class Halves:
    """The words that lines end with, broken: is one of them, with a given rest, a given item word?"""

    def __init__(self, items: Items, of: np.ndarray, words: list[str], pages: int):
        self.items, self.words = items, words
        self.bits, self.lengths = measures(words)
        self.start = np.searchsorted(of, np.arange(pages + 1))

    def may_be(self, page: np.ndarray, word: np.ndarray, bits: np.ndarray, rests: list[str]) -> np.ndarray:
        of, at = spread(self.start[page], self.start[page + 1])
        hit, lengths = np.zeros(len(page), bool), np.array([len(x) for x in rests], np.int64)
        hit[of[self.items.misread(word[of], bits[of] | self.bits[at], lengths[of] + self.lengths[at], lambda n: self.words[at[n]] + rests[of[n]])]] = True
        return hit


def spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (n, i) with start[n] <= i < end[n]."""
    times = end - start
    n = np.repeat(np.arange(len(times)), times)
    return n, np.arange(len(n)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start, times)


def within(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)

def leaks(items: Items, pages: list[Page]) -> list[tuple[int, int]]:
    """(page, item) of the pages' leaks, as places in the two lists."""
    size = items.size
    if not pages or not len(items.at):
        return []
    words, line, broken = [], [], []
    for page in pages:
        words += [*page.words, ""]
        line += [*page.line, -1]
        broken += [*page.broken, False]
    lines, split, page_start = np.array(line), np.array(broken), np.cumsum([0, *(len(page.words) + 1 for page in pages)])
    known = items.vocabulary
    ids = np.array([known.get(w, -1) for w in words])
    ids[page_start[1:] - 1] = -3  # between pages
    new_line = lines != np.append(-1, lines[:-1])
    begin, end = np.flatnonzero(new_line & (lines >= 0)), np.flatnonzero((np.append(lines[1:], -1) != lines) & (lines >= 0))
    of = np.searchsorted(page_start, begin, "right") - 1
    size_of = end - begin + 1
    edges = {
        1: Edges(items, ids, words, of, begin, np.where((size_of > 2) | (size_of == 2) & ~split[end], begin + 1, -1), len(pages)),
        -1: Edges(items, ids, words, of, end, np.where(size_of > 2, end - 1, -1), len(pages)),
    }
    halved, kept, at = np.flatnonzero(split), np.ones(len(words), bool), -1
    halves = Halves(items, np.searchsorted(page_start, halved, "right") - 1, [words[p] for p in halved.tolist()], len(pages))
    heads = np.zeros(len(words), np.uint64)
    heads[halved] = halves.bits
    for p in halved.tolist():  # broken words are joined to the next line's first
        if p != at and lines[p + 1] >= 0:
            at = p + 1
            words[p] += words[at]
            ids[p] = known.get(words[p], -1)
            kept[at] = False
    first = np.flatnonzero(kept)
    last = np.append(first[1:], len(kept)) - 1
    words, made, heads, ids = [words[p] for p in first.tolist()], last > first, heads[first], ids[first]
    starts, ends = lines[first] != lines[first - 1], lines[last] != np.append(lines, -1)[last + 1]
    page_of = np.searchsorted(page_start, first, "right") - 1
    first, last = first - page_start[page_of], last - page_start[page_of]
    bits, lengths = items.bits[np.maximum(ids, 0)], items.lengths[np.maximum(ids, 0)]
    odd = np.flatnonzero(ids < 0)
    bits[odd], lengths[odd] = measures([words[n] for n in odd.tolist()])
    numbers = piece_numbers(ids, size)
    place = np.minimum(np.searchsorted(items.different, numbers), len(items.different) - 1)
    hits = np.flatnonzero(items.different[place] == numbers)
    k, at = spread(items.first[place[hits]], items.first[place[hits] + 1])
    k, at = hits[k], items.at[at]
    for s in range(size):  # equal numbers, and equal words
        same = ids[k + s] == items.ids[at + s]
        k, at = k[same], at[same]
    # words beside a hit that must be its item's: a hit goes on where they are, where one may be misread, and where a line ends
    need, reach = items.least - size, np.zeros(len(k), np.int64)
    item = items.of[at]
    for step, x, y, a_line in ((1, k + size - 1, at + size - 1, ends), (-1, k, at, starts)):
        x, y, live = x.copy(), y.copy(), np.arange(len(k))
        bound = items.start[item + 1] - 1 if step > 0 else items.start[item]
        wrong = np.zeros(len(k), np.int64)
        for _ in range(need):
            live = live[y[live] != bound[live]]
            was = x[live]
            x[live] += step
            y[live] += step
            other, word = x[live], items.ids[y[live]]
            equal, odd = ids[other] == word, ids[other] == -1
            alike = ~equal & odd
            some = np.flatnonzero(alike)
            alike[some] = items.misread(word[some], bits[other[some]], lengths[other[some]], lambda n, other=other, some=some: words[other[some[n]]])
            wrong[live[alike]] += 1  # one edit at least
            open_ = odd & made[other] & items.may_hold(word, heads[other])  # a word may be split by lines that don't belong to it
            if step < 0:
                rest = np.flatnonzero(~equal & starts[other] & items.may_hold(word, bits[other]))
                open_[rest] |= halves.may_be(page_of[k[live[rest]]], word[rest], bits[other[rest]], [words[n] for n in other[rest].tolist()])
            edge = np.flatnonzero(~open_ & a_line[was])
            at_edge = y[live[edge]]
            following = np.where(at_edge == bound[live[edge]], -1, items.ids[at_edge + step])
            open_[edge] = edges[step].may_be(page_of[k[live[edge]]], word[edge], following)
            reach[live[open_]] += np.abs(bound - y)[live[open_]] + 1
            live = live[(equal | alike) & ~open_ & (wrong[live] <= 2 * items.errors)]
            reach[live] += 1
    go = np.flatnonzero(reach >= need)
    found: set[tuple[int, int]] = set()
    ready = -1
    for h in go.tolist():
        n, i = int(page_of[k[h]]), int(item[h])
        if (n, i) in found:
            continue
        if n != ready:
            pages[n].edges(items)
            ready = n
        if verified(items, pages[n], items.words[i], int(at[h] - items.start[i]), int(first[k[h]]), int(last[k[h] + size - 1])):
            found.add((n, i))
    return sorted(found)

def reading_order(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Order of the lines by column (left edges with a wide gap between them), then from top to bottom."""
    by_x = np.argsort(x0, kind="stable")
    xs = x0[by_x]
    gap = max(40.0, 0.35 * float(np.median(x1 - x0)))
    column = np.empty(len(x0), np.int64)
    column[by_x] = np.concatenate([[0], np.cumsum(np.diff(xs) > gap)])
    return np.lexsort((y0, column))

def _search(batches: Iterator[pa.RecordBatch], items: Items, many: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, many):
            batch = whole.slice(start, many)
            ids, texts, boxes = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            starts = boxes.offsets.to_numpy()
            flat = boxes.values
            x0, y0, x1 = (flat.field(f).fill_null(0).to_numpy(zero_copy_only=False) for f in ("x0", "y0", "x1"))
            known = boxes.is_valid().to_numpy(zero_copy_only=False)
            pages = []
            for r in range(len(ids)):
                lines = fold(texts[r].as_py()).split("\n")
                a, b = int(starts[r]), int(starts[r + 1])
                if known[r] and b - a == len(lines) > 1:
                    lines = [lines[i] for i in reading_order(x0[a:b], y0[a:b], x1[a:b]).tolist()]
                pages.append(Page(lines))
            found = leaks(items, pages)
            yield pa.RecordBatch.from_arrays([pa.array([ids[n] for n, _ in found], pa.int64()), pa.array([items.names[i] for _, i in found], pa.int64())], names=["doc_id", "item_id"])

def leaked_passages(docs: DataFrame, items: DataFrame, *, least: int = 12, errors: int = 5, max_item_words: int = 5_000_000) -> DataFrame:
    """(doc_id, item_id) of every page that prints at least ``least`` consecutive words of an item, with at most ``errors`` edits in them.

    Raises ValueError if the items have more than ``max_item_words`` words: their index is sent to every worker.
    """
    rows = items.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null and text is not null")
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if words > max_item_words:
        raise ValueError(f"{words} item words are more than {max_item_words}: search the items in several calls")
    index = Items(sorted(tuple(r) for r in rows.distinct().collect()), least, errors)
    held = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search(batches, held.value)

    pages = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "boxes").filter("doc_id is not null and text is not null and text <> ''")
    return pages.mapInArrow(search, "doc_id bigint, item_id bigint").distinct()
