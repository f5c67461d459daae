"""The pipeline's stages, each against a plain version over the rows it was given."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from stratum.llm import decontamination, packing
from stratum.llm.shared import materialize, table

from .test_operators import brute_spans, plain_components, plain_figures, plain_smith_waterman, words

DATA = "/root/testdata/sf0.001"


def plain_kept(text):
    n, chars, symbols, dup, repeat = plain_figures(text)
    return not (n < 50 or 100 * repeat > 50 * n or 100 * symbols > 10 * n or 100 * (text or "").count("!") > 30 * n or chars < 2 * n or chars > 15 * n or (dup >= 5 and 15 * dup > n))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = table(spark, DATA, "documents")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = materialize(stage(spark, docs, DATA), name)
        if name != "packing":
            assert out[name].columns == docs.columns
            docs = out[name]
            seen.append({r.doc_id: r.text for r in docs.collect()})
    raw, good, unique, clean, masked = seen
    assert good == {d: t for d, t in raw.items() if plain_kept(t)}
    assert set(unique) == {d for d, (_, root) in plain_components(good.items(), 5, 4, 5).items() if d == root}
    items = [words(r.text.casefold()) for r in table(spark, DATA, "benchmark").collect()]
    texts = {d: words(t.casefold()) for d, t in unique.items()}
    near = {(d, k) for d, t in texts.items() for k, x in enumerate(items) if 2 * sum((Counter(x) & Counter(t)).values()) >= decontamination.THRESHOLD * 2 * len(x)}
    leaked = {d for d, k in near if plain_smith_waterman(items[k], texts[d]) >= decontamination.THRESHOLD * 2 * len(items[k])}
    assert set(clean) == set(unique) - leaked
    assert all(not brute_spans(t) for t in masked.values()) and set(masked) == set(clean)
    pieces = out["packing"].collect()
    encode = packing.encoder("word_bpe_49k.json")
    assert sum(p.length for p in pieces) == sum(len(encode(t)) // 4 + 1 for t in masked.values())
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((p.doc_id, p.start, p.ids_crc32) for p in pieces)


def test_empty_and_clashing_tables(spark, tmp_path):
    columns = "doc_id long, text string, n_words long, component_id string, spans string, item_id int, length string"
    text = " ".join(f"word{k}" for k in range(70))
    for name, rows in (("empty", []), ("clashing", [(1, text, 0, "a", "b", 1, "c"), (2, text + " more", 0, "a", "b", 1, "c"), (None, "other " + text[::-1], 0, "a", "b", 1, "c"), (3, None, 0, "a", "b", 1, "c")])):
        spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, "a question of five words")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    docs = spark.read.parquet(str(tmp_path / "clashing" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path / "clashing")), name)
        assert docs.columns == [c.split()[0] for c in columns.split(", ")], name
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1]
    assert sorted({r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path / "clashing")).collect()}) == [0, 1]
