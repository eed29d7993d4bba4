import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from vecspark.llm import language_id, mixing
from vecspark.llm.queries import tokenizer_path

from . import edge

SMALL = "/root/testdata/sf0.001"


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}

    known = stages["language_id"](spark, docs, SMALL)
    assert known.columns == docs.columns
    lettered = {d for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    judged = language_id.predict(docs, language_id.fit(docs)).collect()
    assert {r.doc_id for r in judged if r.lang_pred != "und"} == lettered
    rows = {r.doc_id: rows[r.doc_id] for r in judged if r.doc_id in lettered and r.bits_per_byte < language_id.PLAIN}
    assert {r.doc_id for r in known.collect()} == set(rows)
    assert {r.doc_id for r in docs.collect() if r.lang and r.doc_id in lettered} <= set(rows)

    single = stages["near_duplicates"](spark, known, SMALL)
    assert single.columns == docs.columns
    rows = {d: rows[d] for d, (_, c) in edge.components(list(rows.items())).items() if c == d}
    assert sorted(r.doc_id for r in single.collect()) == sorted(rows)

    clean = stages["decontamination"](spark, single, SMALL)
    assert clean.columns == docs.columns
    rows = {d: rows[d] for d, (_, hit, _) in edge.windows(list(rows.items()), bench).items() if not hit}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(rows)

    mixed = stages["mixing"](spark, clean, SMALL)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    got = sorted(r.doc_id for r in mixed.collect())
    assert got == sorted(d for d, c in copies.items() for _ in range(c))

    out = sorted(stages["token_output"](spark, mixed, SMALL).collect(), key=lambda r: r.start)
    t, at = Tokenizer.from_file(tokenizer_path()), 0
    for r, d in zip(out, got, strict=True):
        ids = np.array([*t.encode(rows[d], add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), edge.crc(ids.tobytes()))
        at += len(ids)


ODD = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c``d` map<string,int>, same string, place int, one array<map<int,string>>, further_0 binary"


def odd_rows():
    rows = [(d, t, lang, s, len(t or ""), f"dot{d}", {"k": d or 0}, "same", d, [{1: "x"}], b"\x00") for d, t, lang, s in edge.TEXTS]
    prose = "the river is wide and the forest is still while the water near the old mill stays cold in every month of the year "
    rows += [(200 + i, prose + f"and person {i} says so " * 8, "en", "bcd"[i % 3], 1, None, None, None, None, None, None) for i in range(30)]
    rows += [(300, "benchmark words of ten or more that stand in both tables at once today", "en", "b", 1, None, {}, None, None, [], None)]
    return [*rows, rows[0], rows[0], (None, rows[0][1], "en", "a", 1, None, None, None, None, None, None)]


def test_run_keeps_columns_of_any_name_and_type(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, ODD).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[-4][1]), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    whole = {str(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [f.name for f in spark.read.parquet(f"{tmp_path}/documents.parquet").schema] and {str(r) for r in docs.collect()} <= whole, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and 300 not in {r.doc_id for r in out} and sorted(r.start for r in out) == [sum(x.n_tokens for x in sorted(out, key=lambda r: r.start)[:i]) for i in range(len(out))]


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
