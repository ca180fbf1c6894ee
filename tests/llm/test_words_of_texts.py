import struct

from foliotab.llm import bpe
from foliotab.llm.token_counts import default_vocabulary


def test_words_and_marks_need_no_pattern(monkeypatch):
    own = bpe.Vocabulary(default_vocabulary())
    little = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    whole = {t: little([i]) for t, i in own.whole_tokens().items()}
    memo = bpe.Memo(own, whole, lambda piece: little(own.merge(piece.encode())), b"".join)
    library = lambda part: little(own.library.encode(part, add_special_tokens=False).ids)
    texts = ["a thelinge, laéelleeuxè. ñ? x! whouat: y;", "it's we'll don't 'd x.. . , a. .b", "über1 1. ٣ a՘ b՘. ª º. ǅ ʰ", "a <|endoftext|> b<|endoftext|>. c", " a. b\n c,\nd  e\t.", "", "?", "x ?", " a b . c"]
    for text in texts:
        assert memo.encode(text, lambda i: little([i]), library) == library(text)
    asked = []
    real = own.pieces
    monkeypatch.setattr(own, "pieces", lambda text: asked.append(text) or real(text))
    memo = bpe.Memo(own, whole, lambda piece: little(own.merge(piece.encode())), b"".join)
    asked.clear()
    assert memo.encode("start " + texts[0], lambda i: little([i]), library) == library("start " + texts[0])
    assert asked == ["start"]  # one look at the pattern for the first chunk, none for the others
