"""The token store's cache of words, when it is full."""

import numpy as np
import pyarrow as pa
import pytest

from regolith.llm import token_store
from regolith.llm.text import buffers


@pytest.mark.parametrize("room", [40, 90, 1000])
def test_a_full_cache_keeps_words_met_again(monkeypatch, room):
    monkeypatch.setattr(token_store, "CACHE_WORDS", room)
    own, asked = token_store.Encoder(token_store.tokenizer_path()), []
    encode = own._encode
    monkeypatch.setattr(own, "_encode", lambda buf, a, b: asked.extend(bytes(buf[i:j]).decode() for i, j in zip(a, b)) or encode(buf, a, b))
    for run in range(30):
        texts = [" ".join([f"common{chr(97 + k)}" for k in range(20)] + [f"rare{chr(97 + run)}{chr(97 + k)}" for k in range(12)]), "", None, "Ünïcode,"]
        buf, offs = buffers(pa.array(texts))
        ids, sizes = own.encode(buf, offs)
        want, counts = own.encode_whole(buf, offs)
        assert np.array_equal(ids, want) and np.array_equal(sizes, counts)
        assert len(own.hashes) <= room
    assert room < 90 or asked.count("commona") == 1
