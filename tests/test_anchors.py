"""Quotes are looked for around their rarest words alone."""

import itertools
import random
import time

from foliotab.functions.quotes import Text


def test_frequent_words_are_not_followed_through_the_text():
    rnd = random.Random(3)
    names = ["".join(p) for p in itertools.product("bcdfgklmnr", "aeiou", "bcdfgklmnr", "aeio", "t")]
    often, seldom = names[:40], names[40:]
    words = [rnd.choice(often) if rnd.random() < 0.8 else rnd.choice(seldom) for _ in range(40_000)]
    text = Text(" ".join(words))
    t0 = time.perf_counter()
    for i in range(200):
        quote = words[i * 190 : i * 190 + 15]
        assert text.fuzzy([*quote[:7], "zz", *quote[7:]], 0.75)[2] == 15
    assert time.perf_counter() - t0 < 2
