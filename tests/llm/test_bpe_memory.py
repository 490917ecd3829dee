"""The pieces of a batch of texts aren't all held at once."""

import tracemalloc

from kelpie.llm import bpe


def test_pieces_of_a_batch_are_not_held(monkeypatch):
    coder = bpe.Encoder(bpe.Automaton({"model": {"vocab": {"a": 0, "b": 1, "Ġ": 2}, "merges": []}}))
    texts = ["ab ba " * 2000 + "a" for _ in range(100)]
    want = coder.encode_many(texts[:1])[0]
    tracemalloc.start()
    got = coder.encode_many(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == {want} and coder.decode(want) == texts[0]
    # beside the ids, less than the pieces of all texts: 400,000 of 50 bytes and a reference
    assert peak - sum(map(len, got)) < 5_000_000
