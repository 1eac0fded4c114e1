"""The pipeline's stages, each on its own input, against brute force."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from sparkloom.llm.queries import trusted_ids
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows before and after each stage."""
    base = str(tmp_path_factory.mktemp("stages"))
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{base}/{k}")
        after = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stage_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
    assert len(stages) == 5


def test_quality_stage(spark, sf, stages):
    """The stage keeps what a plain Kneser-Ney model of the trusted texts keeps."""
    _, before, after = stages[0]
    trusted = {r["doc_id"] for r in trusted_ids(spark, sf).collect()}
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in before.collect()]
    expected = brute.quality(rows, trusted, 5, 0.999, 40)
    kept = texts(after)
    for i, t, _ in rows:
        _, _, score, threshold = expected[i]
        if abs(score - threshold) > 1:  # costs are rounded to millionths of a nat
            assert (i in kept) == (score < threshold)
        if i in kept:
            assert kept[i] == t
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i in kept for i, q in labels.items() if q == 1]
    junk = [i in kept for i, q in labels.items() if q == 0]
    assert sum(clean) / len(clean) > 0.97 and sum(junk) <= len(junk) / 3


def test_near_copies_stage(stages):
    _, before, after = stages[1]
    docs = texts(before)
    sets = {}
    for i, t in docs.items():
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    roots = brute.components(docs, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert set(texts(after)) == set(roots.values())


def test_benchmark_stage(spark, sf, stages):
    _, before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert texts(after) == {i: t for i, t in texts(before).items() if not brute.contamination(t, items)[4]}


def test_secrets_stage(stages):
    _, before, after = stages[3]
    cleaned = texts(after)
    assert cleaned.keys() == texts(before).keys()
    for i, text in texts(before).items():
        out, at = "", 0
        for start, end in sorted((a, b) for _, a, b in brute.all_secrets(text)):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert cleaned[i] == out + text[at:]
        assert brute.base_secrets(cleaned[i]) == []


def test_pieces_stage(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, before, after = stages[4]
    docs = texts(before)
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == docs.keys()
    for r in rows:
        ids = sp.encode(docs[r["doc_id"]])
        assert (r["n_pieces"], r["pieces_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["pieces"] == ids and r["text"] == docs[r["doc_id"]]
        assert r["decoded_equal"]


def test_run_equals_stages(spark, sf, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, stages[-1][2].collect()))


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, row string, words string, pieces string, _kept string"


def test_stages_take_any_rows(spark, sf):
    """Nulls, empty and repeated rows, clashing names and empty tables pass through every stage."""
    rows = [(1, "a good text of some words here", "en", "a"), (1, "a good text of some words here", "en", "a"), (None, None, None, None), (2, "", "en", "b"), (None, "one\x00", "xx", "a"), (3, "secret=abcdefgh " * 5, None, "c")]
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z", "k") for r in rows], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all((r["row"], r["words"], r["pieces"], r["_kept"]) == ("x", "y", "z", "k") for r in out.collect())
        assert stage(spark, docs.where("false"), sf).count() == 0
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert coded.columns == [*docs.columns, "_pieces", "n_pieces", "pieces_crc32", "decoded_equal"] and coded.count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), sf).count() == 0
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "3", "None"]


def test_decided_rows_wait_in_the_jvm(spark, sf):
    """The first two stages hand Python what they decide by, not whole rows: those would lie there, and in buffers both ways, twice over."""
    rows = [(1, "a good text of some words here", "en", "a"), (2, "A good text of some words here", "en", "a"), (3, "other words", None, "c"), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", "y", "z", "k") for r in rows], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, sf)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
        assert out.dtypes == docs.dtypes
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None"]
