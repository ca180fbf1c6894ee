"""Fuzzy windows against every window of the text, measured by the standard library's matching blocks."""

import difflib
import random

import pytest

from foliotab.functions.quotes import Runs, Text, positions, split


def every_window(words, quote, threshold):
    best = (0.0, None)
    for size in range(len(quote), len(words) + 1):
        for start in range(len(words) - size + 1):
            blocks = difflib.SequenceMatcher(None, words[start : start + size], quote, autojunk=False).get_matching_blocks()
            share = sum(b.size for b in blocks) / len(quote)
            if share > best[0]:
                best = (share, (start, size))
    return best if best[1] and best[0] >= threshold else None


def blocks(words, quote):
    return sum(b.size for b in difflib.SequenceMatcher(None, words, quote, autojunk=False).get_matching_blocks())


@pytest.mark.parametrize("letters,longest,size", [("ab", 14, 7), ("abc", 16, 8), ("abcdef", 18, 9), ("abcdefghijkl", 20, 10)])
@pytest.mark.parametrize("threshold", [0.75, 0.5, 1.0])
def test_same_quotes_align(letters, longest, size, threshold):
    rnd = random.Random(letters + str(threshold))
    found = 0
    for _ in range(400):
        words = [rnd.choice(letters) for _ in range(rnd.randrange(0, longest))]
        quote = [rnd.choice(letters + "z") for _ in range(rnd.randrange(0, size))]
        want = every_window(words, quote, threshold) if quote else None
        got = Runs(positions(words), len(words), quote).align(threshold)
        assert (got is None) == (want is None), (words, quote, got, want)
        if got:
            first, width, matched = got
            assert width >= len(quote) and 0 <= first and first + width <= len(words)
            assert matched == blocks(words[first : first + width], quote) and matched / len(quote) >= threshold
            found += 1
    assert found > 10


def test_every_window_that_could():
    """The last resort alone finds the largest measure there is."""
    rnd = random.Random(9)
    for _ in range(1500):
        letters = rnd.choice(["ab", "abc", "abcde"])
        words = [rnd.choice(letters) for _ in range(rnd.randrange(1, 15))]
        quote = [rnd.choice(letters + "z") for _ in range(rnd.randrange(1, 8))]
        want = every_window(words, quote, 0.3)
        runs = Runs(positions(words), len(words), quote)
        need = next(k for k in range(1, len(quote) + 1) if k / len(quote) >= 0.3)
        got = max((runs.measure(a, b)[0] for a, b in runs.windows(need)), default=0) if len(words) >= len(quote) else 0
        assert (got if got >= need else 0) == (round(want[0] * len(quote)) if want else 0), (words, quote)


@pytest.mark.parametrize("spoil", ["prefix", "infix", "suffix", "gone", "doubled", "plural"])
def test_spoilt_quotes_find_their_place(spoil):
    """In a text without other likely places, the window is the one that every window's search gives."""
    rnd = random.Random(spoil)
    for _ in range(40):
        words = [f"w{rnd.randrange(200)}" for _ in range(60)]
        start, size = rnd.randrange(0, 45), rnd.randrange(8, 14)
        quote = words[start : start + size]
        k = len(quote) // 2
        quote = {
            "prefix": ["zz", *quote], "infix": [*quote[:k], "zz", *quote[k:]], "suffix": [*quote, "zz"], "gone": quote[:k] + quote[k + 1 :],
            "doubled": [*quote[:k], quote[k], *quote[k:]], "plural": quote,
        }[spoil]
        got = Runs(positions(words), len(words), quote).align(0.75)
        share, (first, width) = every_window(words, quote, 0.75)
        assert (got[0], got[1], got[2] / len(quote)) == (first, width, share)


def test_exact_and_longest_beginning():
    text = Text("The cat sat. The cat ran/away; the CAT sat on 12 mats.")
    assert text.exact(split("the cat sat")) == 0
    assert text.exact(split("cat SAT on")) == 9
    assert text.exact(split("cat sat off")) is None and text.exact([]) is None
    assert text.longest_prefix(split("the cat ran off")) == (0, 2)
    assert text.longest_prefix(split("ran/away; the dog")) == (6, 3)
    assert text.longest_prefix(split("dog")) is None
    assert text.fuzzy(split("mats ran off now"), 0.75) is None
    assert text.fuzzy(split("sat on 12 mat"), 0.75)[2] == 4


def test_time_grows_with_the_text():
    import time

    words = [f"w{i % 997}" for i in range(200_000)]
    t0 = time.perf_counter()
    at = positions(words)
    for i in range(0, 300):
        quote = words[i * 7 : i * 7 + 12]
        assert Runs(at, len(words), [*quote[:6], "zz", *quote[6:]]).align(0.75)[2] == 12
    assert time.perf_counter() - t0 < 60
