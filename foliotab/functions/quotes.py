"""Places of quotes in one text: exact ones by their rarest word, fuzzy ones by common runs of words."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

from .tokens import TOKEN, Cut

_TOKEN = re.compile(TOKEN)


def stem(word: str) -> str:
    """A lower-cased word without a plural s, as ``norm_token``."""
    return word[:-1] if len(word) > 3 and word[-1] == "s" and word[-2] != "s" else word


#: Characters that become letters of A-Z, or others at a token's edge, when a whole text is lower-cased.
_ODD = re.compile("[\u0130\u03a3\u212a]")


def split(text: str) -> list[str]:
    """Lower-cased tokens."""
    if text.isascii() or not _ODD.search(text):
        return _TOKEN.findall(text.lower())
    return [word.lower() for word in _TOKEN.findall(text)]


def positions(words: list[str]) -> dict[str, list[int]]:
    at: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        at[w].append(i)
    return dict(at)


def occurrence(words: list[str], at: dict[str, list[int]], quote: list[str]) -> int | None:
    """First place at which the words hold the quote; the candidates are the places of its rarest word."""
    if not quote:
        return None
    rarest, places = 0, None
    for i, w in enumerate(quote):
        found = at.get(w)
        if found is None:
            return None
        if places is None or len(found) < len(places):
            rarest, places = i, found
    for p in places:
        first = p - rarest
        if first >= 0 and words[first] == quote[0] and words[first : first + len(quote)] == quote:
            return first
    return None


class Text:
    """A text whose tokens are indexed once for all its quotes."""

    def __init__(self, text: str):
        self.text = text
        self.words = split(text)

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        """First character of each token and the one behind."""
        cut = Cut([self.text])
        return list(zip(cut.start.tolist(), cut.end.tolist()))

    @cached_property
    def at(self) -> dict[str, list[int]]:
        return positions(self.words)

    @cached_property
    def stems(self) -> list[str]:
        known = {w: stem(w) for w in self.at}
        return [known[w] for w in self.words]

    @cached_property
    def stems_at(self) -> dict[str, list[int]]:
        return positions(self.stems)

    def exact(self, quote: list[str]) -> int | None:
        """First token of the first occurrence."""
        return occurrence(self.words, self.at, quote)

    def longest_prefix(self, quote: list[str]) -> tuple[int, int] | None:
        """(first, size) of the longest beginning of the quote that occurs, at its first place."""
        left = self.at.get(quote[0], []) if quote else []
        size, place = 0, None
        while left:
            size, place = size + 1, left[0]
            if size == len(quote):
                break
            left = [p for p in left if p + size < len(self.words) and self.words[p + size] == quote[size]]
        return (place, size) if place is not None else None

    def fuzzy(self, quote: list[str], threshold: float) -> tuple[int, int, int] | None:
        """(first, size, matched) of a window that holds ``threshold`` of the quote; see ``Runs``.

        The first occurrence of the whole quote is the best window there can be.
        """
        stems = [stem(w) for w in quote]
        if threshold <= 1 and (first := occurrence(self.stems, self.stems_at, stems)) is not None:
            return first, len(stems), len(stems)
        return self.but_one(stems, threshold) or Runs(self.stems_at, len(self.words), stems).align(threshold)

    def but_one(self, quote: list[str], threshold: float) -> tuple[int, int, int] | None:
        """What ``Runs.align`` finds for a quote of which the text lacks one word and holds the others as one run, if no
        window before that run's can be as good and no other run of it comes first; None where that does not settle it.
        """
        words, at, m = self.stems, self.stems_at, len(quote)
        foreign = [i for i, w in enumerate(quote) if w not in at]
        if len(foreign) != 1 or len(words) < m or (m - 1) / m < threshold:
            return None
        k = foreign[0]
        rest = quote[:k] + quote[k + 1 :]
        a, b = (0, k) if 2 * k > m - 1 else (k, m - 1)  # the longer part, which is the first block
        if 2 * k == m - 1 or (first := occurrence(words, at, rest)) is None:
            return None
        rare = min(range(a, b), key=lambda i: len(at[rest[i]]))
        low = max(0, first - 1 - m)  # no window along the run begins before
        if 0 < k < m - 1 - k and quote[0] in words[low:first]:
            return None  # the shorter part may be found further left
        for p in at[rest[rare]]:
            if p >= first + rare:
                break
            if low <= p - (rare - a) and words[p - (rare - a) : p - rare + b] == rest[a:b]:
                return None  # so may the longer one
        if first:
            # a window with an earlier start lacks the run's last place: it must hold all words in order without that
            for p in at[rest[rare]]:
                if p >= first + m - 2:
                    break
                left = iter(words[max(0, p - m + 1) : min(p + m, first + m - 2)])
                if all(w in left for w in rest):
                    return None
        return max(0, first - 1), m, m - 1


class Parts:
    """All runs of a sequence as a suffix automaton, which is moved along another sequence step by step."""

    def __init__(self, words: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [0]  # ``end``: behind the first occurrence
        last = 0
        for i, w in enumerate(words):
            new = self._state({}, 0, self.size[last] + 1, i + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                if self.size[q] != self.size[p] + 1:
                    q = self._split(p, w, q)
                self.link[new] = q
            last = new

    def _state(self, following: dict[int, int], link: int, size: int, end: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state of its own for the shorter runs of ``q``."""
        short = self._state(dict(self.next[q]), self.link[q], self.size[p] + 1, self.end[q])
        self.link[q] = short
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = short
            p = self.link[p]
        return short

    def runs(self, places: list[int], kinds: list[int], low: int, high: int):
        """(place, length, place in the sequence) of the longest run that ends with each of the words ``low`` to ``high``."""
        following, link, size, end = self.next, self.link, self.size, self.end
        state = n = 0
        previous = -2
        for k in range(low, high):
            p, w = places[k], kinds[k]
            if p != previous + 1:
                state = n = 0
            previous = p
            while state and w not in following[state]:
                state = link[state]
                n = size[state]
            if w in following[state]:
                state = following[state][w]
                n += 1
                yield p, n, end[state] - n


class Runs:
    """Common runs of a quote's tokens and a text's.

    The measure of a window of the text is the number of quote tokens in its matching blocks: the longest common run (of
    equals the first in the window, then in the quote), then the same to the left and to the right of it on both sides.
    Windows have at least as many tokens as the quote.
    """

    def __init__(self, at: dict[str, list[int]], length: int, quote: list[str]):
        self.length, self.size = length, len(quote)
        own = positions(quote)
        self.quote = [own[w][0] for w in quote]  # a word is named by its first place
        self.at = {js[0]: at[w] for w, js in own.items() if w in at}
        self.masks = {js[0]: sum(1 << j for j in js) for js in own.values()}
        self.shared = {k: min(self.masks[k].bit_count(), len(ps)) for k, ps in self.at.items()}
        self.common = sum(self.shared.values())
        self.parts: dict[tuple[int, int], Parts] = {}

    @cached_property
    def places(self) -> list[int]:
        """Places of the text that hold a word of the quote."""
        self.hold(0, self.length)
        return self.places

    @cached_property
    def kinds(self) -> list[int]:
        """The word at each of the places."""
        self.hold(0, self.length)
        return self.kinds

    def found(self, low: int, high: int) -> list[tuple[int, int]]:
        """(place, word) of the words of the quote in [low, high)."""
        return sorted((p, k) for k, ps in self.at.items() for p in ps[bisect_left(ps, low) : bisect_left(ps, high)])

    def hold(self, low: int, high: int) -> None:
        """Look at this part of the text alone."""
        found = self.found(low, high)
        self.places, self.kinds = [p for p, _ in found], [k for _, k in found]

    def anchors(self, least: int) -> list[int]:
        """Places of the rarest words, of which a window of the measure ``least`` holds one: too few words are left without."""
        spare, places = self.common - least, []
        for k in sorted(self.at, key=lambda k: len(self.at[k])):
            places += self.at[k]
            spare -= self.shared[k]
            if spare < 0:
                break
        return sorted(places)

    def regions(self, anchors: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(low, high, anchors) from left to right: a part of the text with each window along a run that has one of the anchors."""
        reach = 3 * self.size
        group: list[int] = []
        for p in [*anchors, None]:
            if group and (p is None or p - group[-1] > reach or p - group[0] > 4 * reach):
                yield self._gap(max(0, group[0] - reach), -1), self._gap(min(self.length, group[-1] + reach + 1), 1), group
                group = []
            group.append(p)

    def _gap(self, edge: int, step: int) -> int:
        """The edge, moved outwards until the place behind it holds no word of the quote."""
        while 0 < edge < self.length:
            low, high = (max(0, edge - self.size), edge) if step < 0 else (edge, min(self.length, edge + self.size))
            held = {p for p, _ in self.found(low, high)}
            for p in range(high - 1, low - 1, -1) if step < 0 else range(low, high):
                if p not in held:
                    return p + 1 if step < 0 else p
            edge = low if step < 0 else high
        return edge

    @cached_property
    def words(self) -> array:
        """Which word of the quote each place of the text holds, 0 for none."""
        words = array("i", bytes(4 * self.length))
        for p, k in zip(self.places, self.kinds):
            words[p] = k + 1
        return words

    def hits(self, low: int, high: int) -> int:
        return bisect_left(self.places, high) - bisect_left(self.places, low)

    def runs(self, low: int, high: int, first: int, last: int):
        part = self.parts.get((first, last))
        if part is None:
            part = self.parts[first, last] = Parts(self.quote[first:last])
        return part.runs(self.places, self.kinds, bisect_left(self.places, low), bisect_left(self.places, high))

    def longest(self, low: int, high: int, first: int, last: int) -> tuple[int, int, int]:
        """(length, place, quote place) of the longest run of text [low, high) and quote [first, last)."""
        best, at, quote_at = 0, low, first
        for p, n, j in self.runs(low, high, first, last):
            if n > best:
                best, at, quote_at = n, p - n + 1, first + j
        return best, at, quote_at

    def measure(self, low: int, high: int, first: int = 0, last: int | None = None) -> tuple[int, int, int]:
        """(matched, first place, place behind the last) of the matching blocks."""
        total, start, end = 0, high, low
        todo = [(low, high, first, self.size if last is None else last)]
        while todo:
            a, b, i, j = todo.pop()
            n, p, q = self.longest(a, b, i, j)
            if n:
                total, start, end = total + n, min(start, p), max(end, p + n)
                if p > a and q > i:
                    todo.append((a, p, i, q))
                if p + n < b and q + n < j:
                    todo.append((p + n, b, q + n, j))
        return total, start, end

    def in_order(self, low: int, high: int, first: int, last: int) -> int:
        """Longest common subsequence of parts of text and quote, bit by bit: the measure of no part of them is larger."""
        if first >= last:
            return 0
        full = (1 << last - first) - 1
        row = full
        for k in range(bisect_left(self.places, low), bisect_left(self.places, high)):
            taken = row & (self.masks[self.kinds[k]] >> first)
            row = ((row + taken) | (row - taken)) & full
        return last - first - row.bit_count()

    def align(self, threshold: float) -> tuple[int, int, int] | None:
        """(first, size, matched) of a window whose measure is ``threshold`` of the quote or more; None if no window has it.

        Windows along each common run are tried first, the best measure wins, then the smallest and first window. Only
        where none of them has the share, the longest common subsequence may rule all windows out, then the whole text may
        do, and last every window that could.
        """
        m, n = self.size, self.length
        need = next((k for k in range(1, m + 1) if k / m >= threshold), m + 1)
        if m == 0 or n < m or self.common < need:
            return None
        best = self.along(need, self.common)  # no measure is larger
        if best is None and self.common > need:
            best = self.along(need, need)
        if best is None:
            self.hold(0, n)
            if self.in_order(0, n, 0, m) >= need:
                best = self.better(None, 0, n, need)
                for low, high in self.windows(need) if best is None else ():
                    best = self.better(best, low, high, need)
        return (-best[2], -best[1], best[0]) if best else None

    def along(self, need: int, least: int) -> tuple | None:
        """The best of the windows along each common run whose measure is ``least`` or more.

        Each of them holds an anchor, so the rest of the text is not looked at.
        """
        m, n = self.size, self.length
        best, tried = None, set()
        for left, right, anchors in self.regions(self.anchors(least)):
            self.hold(left, right)
            if len(set(self.kinds)) < len(self.at) - (self.common - least):
                continue
            barren = right  # from here on there is nothing better than the best
            for _, d in sorted({(a - b, a - j) for a, b, j in self.stretches()}):
                for pad in (m - need, m):
                    low = min(max(0, d - pad), n - m)
                    high = max(min(n, d + m + pad), low + m)
                    if low >= barren or bisect_left(anchors, low) == bisect_left(anchors, high):
                        continue
                    # only an earlier place is better than all words in a window of the least size
                    end = m - best[2] - 1 if best and best[:2] == (self.common, -m) else n
                    a, b = bisect_left(self.places, low), bisect_left(self.places, min(high, end))
                    words = self.kinds[a:b]
                    # each word of the quote that is not there costs one match at least
                    if b - a < least or len(set(words)) < len(self.at) - (self.common - least) or self.in_order(low, min(high, end), 0, m) < least:
                        barren = low if end <= high else barren
                        continue
                    same = (high - low, tuple([p - low for p in self.places[a:b]]), tuple(words), end < high)
                    if same not in tried:
                        tried.add(same)
                        best = self.better(best, low, high, least)
                        least = best[0] if best else least
            if best and best[:2] == (self.common, -m):
                break  # what is to the right is not before it
        return best

    def better(self, best: tuple | None, low: int, high: int, need: int) -> tuple | None:
        """The better of ``best`` and the smallest part of the window that has the same blocks: (matched, -size, -first)."""
        matched, start, end = self.measure(low, high)
        if matched < need:
            return best
        if end - start < self.size:
            start = max(low, end - self.size)
            end = start + self.size
        found = (matched, start - end, -start)
        return found if best is None or found > best else best

    def windows(self, need: int):
        """Windows of which one has the largest measure, if that is ``need`` or more.

        A window's first block is the longest stretch in it that occurs in the quote: a maximal stretch, or what the
        window's edge leaves of one. Given that block, the part left of it depends on the window's start alone and the
        part right of it on the end alone, as long as no stretch comes in that would be first.
        """
        m, spans = self.size, [(a, b) for a, b, _ in self.stretches()]
        words = self.words
        known: dict[tuple, int] = {}

        def matched(low: int, high: int, first: int, last: int) -> int:
            """Measure of a part; parts of the same words, of which periodic texts are full, are measured once."""
            key = (words[low:high].tobytes(), first, last)
            if key not in known:
                known[key] = self.measure(low, high, first, last)[0]
            return known[key]

        for k, (a, b) in enumerate(spans):
            for p, q in {(a, b), *((s, b) for s in range(a + 1, b)), *((a, e) for e in range(a + 1, b))}:
                size = q - p
                low = p if p > a else next((y - size + 1 for x, y in reversed(spans[:k]) if y - x >= size), 0)
                high = q if q < b else next((x + size for x, y in spans[k + 1 :] if y - x > size), self.length)
                rest = need - size
                if min(m - size, self.hits(low, p) + self.hits(q, high)) < rest:
                    continue
                j = self.longest(p, q, 0, m)[2]
                if self.in_order(low, p, 0, j) + self.in_order(q, high, j + size, m) < rest:
                    continue
                starts = self._steps(self.places[bisect_left(self.places, low) : bisect_left(self.places, p)], low, lambda s: matched(s, p, 0, j))
                ends = self._steps([-e - 1 for e in self.places[bisect_left(self.places, q) : bisect_left(self.places, high)]][::-1], -high, lambda e: matched(q, -e, j + size, m))
                for before, s in starts.items():
                    for after, e in ends.items():
                        if before + after >= rest and -e - s >= m:
                            yield s, -e

    @staticmethod
    def _steps(places: list[int], least: int, value) -> dict[int, int]:
        """Per value the outermost edge that has it, ``places`` being the edges at which it can change."""
        found: dict[int, int] = {}
        for k in range(len(places), -1, -1):
            edge = places[k - 1] + 1 if k else least
            found[value(edge)] = edge
        return found

    def stretches(self) -> list[tuple[int, int, int]]:
        """Maximal stretches [start, end) of the text that occur in the quote, in order, and where they do first."""
        found: list[tuple[int, int, int]] = []
        for p, n, j in self.runs(0, self.length, 0, self.size):
            if found and found[-1][0] == p + 1 - n:
                found.pop()
            found.append((p + 1 - n, p + 1, j))
        return found
