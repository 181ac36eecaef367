"""What Python processes of executors keep between tasks and stages."""

import gc
import tracemalloc
import weakref

import pyarrow as pa
import public_tokenizers

from custvalue.llm import tokens, toxicity
from custvalue.llm.kept import releasing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_a_stage_lets_go_of_the_model_of_another(spark):
    small = toxicity.Settings(buckets=1 << 10, document_epochs=1, window_rounds=1, windows_seen=0)
    score = toxicity._scoring(spark, toxicity.fit(["a vile word", "a good word"], [1, 0], small))
    packing = weakref.ref(tokens.tokenizer(PATH))
    assert tokens.tokenizer(PATH) is packing()
    first = score(pa.array(["a word", None]))
    gc.collect()
    assert packing() is None  # its table of pieces would stay beside the scorer
    tokens.tokenizer(PATH)
    assert score(pa.array(["a word", None])) == first


def test_texts_are_encoded_in_little_memory():
    text = "some words of a text, and others " * 250_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(33)), pa.array([text[:250_000]] * 33)], ["id", "text"])
    next(tokens.encoded([batch], PATH, 1))  # loads the tokenizer
    tracemalloc.start()
    n = sum(len(ids) for _, ids in tokens.encoded([batch], PATH, 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 33 * len(next(tokens.encoded([batch.slice(32)], PATH, 1))[1])
    assert peak < 40_000_000


def test_a_task_returns_all_its_batches():
    batches = [pa.RecordBatch.from_pydict({"x": [i]}) for i in range(3)]
    assert list(releasing(lambda some: (b for b in some))(iter(batches))) == batches
    assert list(releasing(lambda some: some)(iter([]))) == []
