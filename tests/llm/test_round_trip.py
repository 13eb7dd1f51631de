"""Ids that are made and decoded in one pass, in bounded pieces."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quorumspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_a_round_trip_is_one_pass(spark):
    docs = spark.createDataFrame([(1, "Hello there, world"), (2, None), (None, "a  b\n"), (2, ""), (3, "über " * 50)], "doc_id long, text string")
    both = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN, common=3, cache=4)
    want = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted(map(str, both.collect())) == sorted(map(str, want.collect()))
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("size", [1, 700, 5000])
def test_decoding_lays_out_bounded_pieces(monkeypatch, size):
    class Value:
        value = bpe.Merges(bpe.load_ranks(PATH))

    monkeypatch.setattr(bpe, "PIECE", 1000)
    ids = [None, [], *(np.arange(size).tolist() for _ in range(30)), None]
    out = list(bpe._decoder(Value)([pa.record_batch([pa.array(ids, pa.list_(pa.int32()))], ["ids"])]))
    assert all(len(b) == 1 or sum(len(x or []) for x in b.column("ids").to_pylist()) <= 1000 for b in out)
    whole = b"".join(t for t, _ in sorted(Value.value.ranks.items(), key=lambda x: x[1])[:size])
    assert [x for b in out for x in b.column("decoded").to_pylist()] == [whole if x else b"" for x in ids]
