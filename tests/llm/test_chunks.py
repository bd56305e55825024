"""Texts that come in several chunks are all learned from."""

import pyarrow as pa

from buildlode.llm import kernels, langid, quality

TEXTS = ["a good long text of words", None, "", "bad bad bad bad", "ein Satz auf Deutsch", "un mot en français"]


def test_all_chunks_become_one_array():
    whole = kernels.whole(pa.chunked_array([TEXTS[:2], TEXTS[2:4], TEXTS[4:]], pa.string()))
    assert whole.to_pylist() == TEXTS and pa.types.is_large_string(whole.type)
    assert len(kernels.whole(pa.chunked_array([], pa.string()))) == 0


def batches(name, values, kind):
    for a in range(0, len(TEXTS), 2):
        yield pa.RecordBatch.from_arrays([pa.array(TEXTS[a : a + 2], pa.string()), pa.array(values[a : a + 2], kind)], names=["text", name])


def test_fits_see_all_batches(spark):
    fitted = next(quality._fit_task(batches("grade", [2, 1, 1, 0, 2, 3], pa.int64())))
    assert fitted.column("grades").to_pylist() == [[0, 1, 2, 3]]
    pieces = spark.sparkContext.broadcast(langid.read_pieces(langid.VOCABULARY))
    found = next(langid._fit_task(pieces)(batches("lang", ["en", "en", "en", "en", "de", "fr"], pa.string())))
    assert found.column("lang").to_pylist() == ["de", "en", "fr"]
