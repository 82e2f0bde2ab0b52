"""What a Python worker still holds when its batches are through."""

import pyarrow as pa
import pytest

from stringmill.llm import bpe_codec, words


@pytest.mark.parametrize("cut", [lambda b: words.slices(b, "text"), lambda b: bpe_codec._rows(lambda x: x)(b)])
def test_the_last_slice_does_not_hold_its_batch(cut):
    texts = [f"{i} " + "word " * 200 for i in range(20_000)] + [None, ""]

    def batches():
        for part in (texts, texts[:2000], []):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int64()), pa.array(part, pa.string())], ["doc_id", "text"])

    before, seen, last = pa.total_allocated_bytes(), [], None
    for part in cut(batches()):
        seen += part.column("text").to_pylist()
        last = part if len(part) else last
    assert seen == texts + texts[:2000]
    assert pa.total_allocated_bytes() - before < 3 << 20  # the batches have 20 and 2 MB
    assert last is not None
