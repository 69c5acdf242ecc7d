"""The memo of stretches that a worker keeps between tasks."""

import numpy as np
import public_tokenizers

from logweave.llm import token_store


def test_stretches_stay_known_between_tasks_and_when_the_memo_is_full(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = token_store.encoder(path, "<u2", "a run")
    assert token_store.encoder(path, "<u2", "a run") is first and token_store.encoder(path, "<u2", "another") is not first
    monkeypatch.setattr(token_store, "MEMO_WORDS", 50)
    e, learned = token_store.WordEncoder(path, "<u2"), []
    learn = e._learn
    monkeypatch.setattr(e, "_learn", lambda new: (learned.extend(new), learn(new)))
    texts = [f"the cat sat, on line\nx{k}y and q{k}  z{k}." for k in range(60)] + ["", "cat", " ".join(f"v{k}" for k in range(200)), "the cat sat"]
    for text in texts:
        want = np.array(e.tok.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        assert e.encode([text]) == [want]
        assert len(e.known) <= 50 and len(e.aside) <= 50
    assert e.encode(texts) == [np.array(x.ids, "<u2").tobytes() for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert learned[:-1].count("x7y") <= 2 and learned.count("cat") <= 3 and len(e.known) <= 50
