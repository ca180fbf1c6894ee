"""Pre-tokens of the byte-level tokenizer and which of them are one token.

The pattern and the library's own splitter agree on every code point outside ``UNLIKE`` (found by trying all of them);
a text that holds one of those goes to the library whole.
"""

from __future__ import annotations

import json
import os

import regex

from foliotab.llm.worker import kept

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Code points (first, last) whose class differs between the two Unicode tables.
UNLIKE = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]

FIRST_UNLIKE = chr(UNLIKE[0][0])
MEMO_ENTRIES = 250_000
MARKS = ".,;:!?"


class Irregular(Exception):
    """A chunk that cannot be taken by itself."""


class Vocabulary:
    """A byte-level tokenizer file, opened once in each Python worker."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that look at their neighbours are not supported")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
        self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.split_specials = regex.compile("(" + "|".join(regex.escape(x) for x in self.specials) + ")").split if self.specials else lambda text: [text]
        self.odd = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNLIKE) + "]").search
        self.ranks = ranks

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        return kept(("vocabulary", path), lambda: cls(path))

    def apart(self, chunk: str) -> bool:
        """Whether the chunk holds a special string or an odd code point."""
        return any(x in chunk for x in self.specials) or (max(chunk) >= FIRST_UNLIKE and bool(self.odd(chunk)))

    def spaced(self, text: str) -> bool:
        """Whether the text holds a special string with a space in it."""
        return any(" " in x and x in text for x in self.specials)

    def whole_tokens(self) -> dict[str, int]:
        """The vocabulary strings that are a pre-token of their own and that the library encodes as exactly that one token.

        Proven by encoding each of them; about as many as the vocabulary has entries.
        """
        texts = []
        for raw, i in self.ranks.items():
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue  # a part of a character is never a whole pre-token
            if not self.odd(text) and self.pieces(text) == [text]:
                texts.append((text, i))
        encoded = self.library.encode_batch([t for t, _ in texts], add_special_tokens=False)
        return {t: i for (t, i), e in zip(texts, encoded) if e.ids == [i]}


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Chunk between two spaces -> value of its tokens; a chunk is worked out when first met.

    A chunk that starts and ends with a non-blank can be taken by itself, with the space before it: the pattern always
    splits before a single space. ``one`` values a whole token, ``merged`` any other pre-token, ``join`` adds values.
    Holds at most ``MEMO_ENTRIES`` chunks, then starts anew; that bounds memory and changes no result.
    """

    def __init__(self, vocabulary: Vocabulary, whole: dict, merged, join):
        super().__init__()
        self.vocabulary, self.whole, self.merged, self.join = vocabulary, whole, merged, join
        # words and words with a mark are one and two pre-tokens, if the pattern says so and no special string looks like that
        self.words = vocabulary.pieces(" ab.") == [" ab", "."] and not any(all(c.isalpha() or c in MARKS for c in x) for x in vocabulary.specials)

    def value(self, text: str):
        """By pre-tokens: whole tokens directly, the rest merged."""
        whole, merged = self.whole, self.merged
        return self.join([whole[p] if p in whole else merged(p) for p in self.vocabulary.pieces(text)])

    def word(self, chunk: str):
        """Value of a word, or of a word and a mark, with the space before it; None for any other chunk."""
        if not chunk.isascii() and max(chunk) >= FIRST_UNLIKE:
            return None
        whole, merged = self.whole, self.merged
        if chunk.isalpha():
            chunk = " " + chunk
            return whole[chunk] if chunk in whole else merged(chunk)
        mark, chunk = chunk[-1:], chunk[:-1]
        if mark in MARKS and chunk.isalpha():
            chunk = " " + chunk
            return self.join([whole[p] if p in whole else merged(p) for p in (chunk, mark)])
        return None

    def __missing__(self, chunk: str):
        if chunk and self.words and (value := self.word(chunk)) is not None:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = value
            return value
        if not chunk or chunk[0].isspace() or chunk[-1].isspace() or self.vocabulary.apart(chunk):
            raise Irregular
        value = self.value(" " + chunk)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[chunk] = value
        return value

    def encode(self, text: str, special, library):
        """Value of a whole text; ``special(id)`` values a special string in it, ``library(part)`` a part with odd code points."""
        if not text:
            return self.join([])
        try:
            first, *rest = text.split(" ")
            if not first or first[-1].isspace() or self.vocabulary.apart(first) or (rest and self.vocabulary.spaced(text)):
                raise Irregular
            return self.join([self.value(first), *map(self.__getitem__, rest)])
        except Irregular:
            own = self.vocabulary
            out = []
            for part in own.split_specials(text):
                if part in own.specials:
                    out.append(special(own.specials[part]))
                elif part:
                    out.append(library(part) if own.odd(part) else self.value(part))
            return self.join(out)
