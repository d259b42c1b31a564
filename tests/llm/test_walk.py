"""The trie walk of op9_bpe."""

from pathlib import Path

from tickloom.llm import bpe


def test_asks_for_few_states():
    """Nodes that no encoding asks for get no state: fewer pairs are judged than a word has bytes."""
    codec, judged = bpe.Codec(Path(bpe.default_vocabulary()).read_text()), []
    follows = codec.follows
    codec.follows = lambda a, b: judged.append((a, b)) or follows(a, b)
    word = " internationalization" * 4
    ids = codec.encode_words({word: word.encode()})[word]
    assert codec.decode(memoryview(ids).cast("i")) == word and len(judged) < len(word) // 4
