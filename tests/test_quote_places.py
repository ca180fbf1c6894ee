"""Places of quotes with one foreign word, which the index of the text settles, and the tokens of texts."""

import random
import re

import pytest

from foliotab.functions.quotes import Runs, Text, positions, split, stem
from foliotab.functions.tokens import TOKEN


@pytest.mark.parametrize("letters", ["abcd", "abcdefghij", "abcdefghijklmnopqrstuvwxy"])
def test_one_foreign_word_is_settled_as_by_the_search(letters):
    """A quote with one word that the text lacks: where its place is settled without the search, the search finds the same."""
    rnd = random.Random(letters)
    settled = 0
    for _ in range(3000):
        words = [rnd.choice(letters) for _ in range(rnd.randrange(3, 40))]
        at = rnd.randrange(len(words))
        quote = words[at : at + rnd.randrange(1, 12)]
        k = rnd.choice([0, 1, len(quote), rnd.randrange(len(quote) + 1)])
        quote = [*quote[:k], "zz", *quote[k:]]
        text = Text(" ".join(words))
        for threshold in (0.5, 0.75, 0.9):
            found = text.but_one(quote, threshold)
            if found:
                settled += 1
                assert found == Runs(positions(words), len(words), quote).align(threshold), (words, quote)
    assert settled > 1000


def test_split_is_by_token():
    """Lower-casing the whole text gives the tokens that lower-casing each gives."""
    rnd = random.Random(4)
    for _ in range(5000):
        text = "".join(rnd.choice("aB1/ \n.ÉİΣKKαΑſßẞ\U0001f600\x85") for _ in range(rnd.randrange(14)))
        tokens = [m for m in re.finditer(TOKEN, text)]
        assert split(text) == [m[0].lower() for m in tokens] and Text(text).spans == [m.span() for m in tokens]


def test_quotes_with_a_foreign_word_need_no_search(monkeypatch):
    """Places of sentences with a foreign word come from the index of the text, mostly."""
    rnd = random.Random(6)
    words = ["".join("abcdefghij"[int(c)] for c in str(int(rnd.paretovariate(0.7)) % 5000)) for _ in range(4000)]
    text, searched = Text(" ".join(words)), []
    align = Runs.align
    monkeypatch.setattr(Runs, "align", lambda self, threshold: searched.append(1) or align(self, threshold))
    for i in range(0, 3900, 13):
        quote = words[i : i + 13]
        k = (0, 13, 5)[i % 3]
        assert text.fuzzy([stem(w) for w in [*quote[:k], "zz", *quote[k:]]], 0.75)[2] == 13
    assert len(searched) < 100  # of 300
