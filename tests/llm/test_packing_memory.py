"""What a packing task holds at a time."""

import pyarrow as pa

from declara.llm import packing


def test_texts_are_encoded_a_few_megabytes_at_a_time():
    texts = pa.array(["ab cd, ef. " * 50_000] * 20 + [None, ""])  # 11 MB
    slices = list(packing._slices(texts))
    assert sum(n for _, n in slices) == len(texts)
    assert all(sum(len(t or "") for t in texts.slice(at, n).to_pylist()) <= 3_000_000 for at, n in slices)
    path = packing.default_tokenizer()
    whole, borders = packing.encode(texts, path)
    parts = [packing.encode(texts.slice(at, n), path)[0] for at, n in slices]
    assert b"".join(p.tobytes() for p in parts) == whole.tobytes() and borders[-1] == len(whole)
