"""Words are looked up once each, and a text of new words is whole."""

import numpy as np
import public_tokenizers

from paceline.llm import huffman, vocab


def test_new_words_and_a_full_memory(monkeypatch):
    path = public_tokenizers.path(huffman.VOCABULARY)
    monkeypatch.setattr(vocab, "REMEMBERED", 2)
    encoder = huffman.Encoder(path, "<u2")
    assert isinstance(encoder.seen, huffman.Remembered)
    for text in ("a house by the lake", "the lake, the lake!", "zqxj qqwv 17 houses", ""):
        ids = vocab.tokenizer(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == ids
        assert len(encoder.seen) <= 2 + 10
