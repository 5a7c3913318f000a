"""Signatures are made of slices by bytes."""

import numpy as np
import pyarrow as pa

from lodestone.functions import batches, hashing


def test_signatures_by_bytes(monkeypatch):
    seen, own = [], hashing.signatures
    monkeypatch.setattr(hashing, "signatures", lambda texts: seen.append(sum(len(t) for x in texts for t in x)) or own(texts))
    column = pa.array([[f"w{k}-{n}" * 5 for n in range(3_000)] for k in range(40)] + [None])
    found = hashing._signatures(column)
    assert len(seen) > 2 and max(seen) <= batches.SLICE_BYTES and found.null_count == 1
    assert found[7].as_py() == own([column[7].as_py()]).view(np.int64)[0].tolist()


def test_signature_of_a_long_text():
    tokens = [f"w{k}" for k in range(100_000)]
    parts = [" ".join(tokens[k : k + 3]).encode() for k in range(len(tokens) - 2)]
    base, want = hashing.fnv1a_all(parts), []
    for salt in hashing.salts():
        want.append(((base ^ salt) * np.uint64(hashing.GOLDEN)).min())
    assert hashing.signatures([tokens])[0].tolist() == want
