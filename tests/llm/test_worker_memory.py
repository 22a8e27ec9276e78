"""Python workers outlive their tasks: what a stage of the pipeline has freed must go back to the system before the next one."""

import base64
import random
import tracemalloc

import pyarrow as pa
import pytest

from rutine.llm import bpe, common, langid, ngram_join, symbols


@pytest.mark.parametrize("stage", ["tokens", "language", "languages"])
def test_workers_of_the_pipeline_give_freed_memory_back(spark, monkeypatch, tmp_path, stage):
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    functions, calls = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: (functions.append(f), spark.range(1))[1])
    monkeypatch.setattr(common, "_give_back", lambda: calls.append(len(calls)))
    if stage == "tokens":
        bpe.encode_documents(docs, str(tmp_path / "ranks"), bpe.Splitter.KNOWN)
    elif stage == "language":
        langid.with_language(docs, langid.Network(["de", "en"]))
    else:
        langid.identify(docs, langid.Network(["de", "en"]))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], names=["doc_id", "text"])
    out = list(functions[0](iter([batch, batch])))
    assert [len(x) for x in out] == [1, 1] and len(calls) == 3


def test_a_task_lets_go_what_other_operators_kept_and_keeps_its_own(tmp_path):
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    c = bpe.codec(str(tmp_path / "ranks"), bpe.Splitter.KNOWN)
    c.packed("some text")
    list(common.lean_batches(iter, keeps="tokens")([]))
    assert bpe.codec(str(tmp_path / "ranks"), bpe.Splitter.KNOWN) is c and c.cache
    list(common.lean_batches(iter)([]))
    assert bpe.codec(str(tmp_path / "ranks"), bpe.Splitter.KNOWN) is not c


def test_powers_of_points_are_no_more_than_a_piece_needs(monkeypatch):
    monkeypatch.setattr(symbols, "_points", {})
    texts = [b"a few words", b"x" * (3 * symbols.PIECE), b"a few words"]
    symbols.words(texts[0])
    assert sum(len(x) for pair in symbols._points.values() for x in pair) <= 4 * symbols.PIECE
    assert [symbols.word_hashes(x).tolist() for x in texts] == [symbols.word_hashes(b"\n".join(texts)).tolist()[a:b] for a, b in ((0, 3), (3, 4), (4, 7))]


def test_gram_sets_of_a_batch_take_a_few_texts_at_once():
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([0, 2, 30, 400]))) for _ in range(2500)] + ["", "one"]
    hashes, sizes = ngram_join.gram_sets(texts, 5)
    assert sum(map(len, texts)) > 3 * ngram_join.AT_ONCE
    whole = ngram_join._gram_sets(texts, 5)
    assert hashes.tolist() == whole[0].tolist() and sizes.tolist() == whole[1].tolist()
    assert [x.tolist() for x in ngram_join.gram_sets([], 5)] == [[], []]

    def peak(f) -> int:
        tracemalloc.start()
        f(texts, 5)
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert 2 * peak(ngram_join.gram_sets) < peak(ngram_join._gram_sets)


def test_tokens_and_sets_come_in_small_batches():
    rows = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["some more words of text here"] * 600), pa.array([b"\1\1"] * 600)], names=["id", "text", "codes"])
    out = list(ngram_join._sets(5, 80)([rows, rows.slice(0, 0)]))
    assert [len(x) for x in out] == [250, 250, 100] and [i for x in out for i in x.column(0).to_pylist()] == list(range(600))
