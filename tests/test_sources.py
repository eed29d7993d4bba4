import struct

import numpy as np
import pytest

from vecspark.operators import hnsw, nf4, pq, rq, scalar
from vecspark.schema import from_arrays
from vecspark.sources import formats, generators, graph_file, ingest, vecstream
from vecspark.streaming import encode as stream


def test_mixed_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id":"one","vector":[1.0,0.0]}\n\ninvalid json line\nid1,1.0,2.0,3.0\n{"id":"x","vector":[1,"y",2e1]}\n1e400,1\n{"vector":[1]}\n')
    rows = [(r.id, r.vector) for r in ingest.read_lines(spark, str(p)).orderBy("ord").collect()]
    assert rows == [("one", [1.0, 0.0]), ("id1", [1.0, 2.0, 3.0]), ("x", [1.0, 20.0]), ("1e400", [1.0])]


def test_keep_empty(spark):
    df = spark.createDataFrame([(0, "a,b"), (1, "c,1")], "ord long, line string")
    assert [r.id for r in ingest.parse_lines(df).collect()] == ["c"]
    assert [r.id for r in ingest.parse_lines(df, keep_empty=True).orderBy("ord").collect()] == ["a", "c"]


def test_type_suffixes_are_no_numbers(spark):
    df = spark.createDataFrame([(0, "a,1.0f,2d,3,.5,4.,+1e2, 7 ")], "ord long, line string")
    assert ingest.parse_lines(df).first().vector == [3.0, 0.5, 4.0, 100.0, 7.0]


def test_words(spark):
    lines = ["king 0.1 0.2 0.3", "", "lonely", "queen 0.4 x 0.6", "man 0.7 0.8 0.9", "woman 1 2 3"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord long, line string")
    assert [r.id for r in ingest.parse_words(df).orderBy("ord").collect()] == ["king", "man", "woman"]
    assert [r.id for r in ingest.parse_words(df, 2).collect()] == ["king", "man"]


def test_bad_queries_are_errors(spark):
    df = spark.createDataFrame([(0, '{"id":"a","vector":[1]}'), (1, "nonsense")], "ord long, line string")
    with pytest.raises(Exception, match="line 2"):
        ingest.parse_queries(df).collect()


def vectors(n=20, d=6):
    return np.random.default_rng(1).standard_normal((n, d)).astype(np.float32)


def test_stream_file(spark, tmp_path):
    v = vectors()
    df = from_arrays(spark, v)
    path = str(tmp_path / "a.stream")
    assert vecstream.write_file(df, path) == 20
    for every, parts in ((None, 1), (90, 10), (1 << 20, 1)):
        if every:
            assert [(r.rows, r.ranges) for r in vecstream.index(spark, path, every).collect()] == [(20, parts)]
        df = vecstream.read(spark, path)
        rows = df.orderBy("ord").collect()
        assert df.rdd.getNumPartitions() == parts
        assert [r.id for r in rows] == [f"vec_{i}" for i in range(20)] and np.allclose([r.vector for r in rows], v) and [r.ord for r in rows] == list(range(20))
    assert np.allclose([r.vector for r in formats.read(spark, path).orderBy("place").collect()], v)
    with pytest.raises(Exception, match="is no scalar file"):
        spark.read.format("vecstream").option("path", path).option("kind", "scalar").load().collect()


def test_any_vendor_is_read(tmp_path):
    data = formats.encode_header("stream", vendor="OTHER") + formats.encode_record("stream", ("a", [1.0]))
    assert [n for n, _ in formats.decode_file(data)] == ["a"]
    assert list(formats.decode_file(formats.encode_header("stream"))) == []


def test_cut_files():
    data = formats.encode_header("stream") + formats.encode_record("stream", ("a", [1.0])) + formats.encode_record("stream", ("b", [2.0]))
    with pytest.raises(EOFError):
        list(formats.decode_file(data[:-1]))
    cut = formats.encode_header("stream") + formats.encode_record("stream", ("a", [1.0])) + struct.pack("<I", 9)[:2]
    assert [n for n, _ in formats.decode_file(cut)] == ["a"]


def test_dataset_file():
    data = formats.encode_dataset([("a", [1.0, 2.0]), ("b", [])])
    assert [(n, v.tolist()) for n, v in formats.decode_file(data)] == [("a", [1.0, 2.0]), ("b", [])]


def test_codec_files(spark, tmp_path):
    v = vectors(40, 8)
    df = from_arrays(spark, v)
    ranges = scalar.fit_arrays(df)
    p, r = pq.train(df, 2, 4, 3), rq.train(df, 2, 2, 4, 3)
    cases = {
        "scalar": (scalar.encode_bytes(df, ranges), np.stack(ranges, axis=1), scalar.decode(scalar.encode(df, ranges), ranges)),
        "nf4": (nf4.encode_packed(df), None, nf4.decode(nf4.encode(df))),
        "pq": (p.encode(df), p, p.decode(p.encode(df))),
        "rq": (r.encode(df), r, r.decode(r.encode(df))),
    }
    for kind, (stored, model, decoded) in cases.items():
        path = str(tmp_path / kind)
        assert vecstream.write_file(stored, path, kind, model, 8) == 40
        back = formats.read(spark, path).orderBy("place").collect()
        assert np.allclose([b.vector for b in back], [d.vector for d in decoded.orderBy("ord").collect()], atol=1e-5), kind
    assert vecstream.write_file(df.limit(0), str(tmp_path / "none")) == 0 and not (tmp_path / "none").exists()


def test_folders_of_all_kinds(spark, tmp_path):
    v = vectors(300, 8)
    df = from_arrays(spark, v).repartition(5)
    ranges = scalar.fit_arrays(df)
    p, r = pq.train(df, 2, 4, 2), rq.train(df, 2, 2, 4, 2)
    cases = {"stream": (df, None, df), "scalar": (scalar.encode_bytes(df, ranges), np.stack(ranges, axis=1), scalar.decode(scalar.encode(df, ranges), ranges)), "nf4": (nf4.encode_packed(df), None, nf4.decode(nf4.encode(df))), "pq": (p.encode(df), p, p.decode(p.encode(df))), "rq": (r.encode(df), r, r.decode(r.encode(df)))}
    for kind, (stored, model, decoded) in cases.items():
        path = str(tmp_path / kind)
        vecstream.write(stored, path, kind, model, 8, file_bytes=1000)
        back = vecstream.read(spark, path, kind)
        rows = back.orderBy("ord").collect()
        assert back.rdd.getNumPartitions() == len(list((tmp_path / kind).glob("part-*"))) > 4
        assert [(x.ord, x.id) for x in rows] == [(i, f"vec_{i}") for i in range(300)]
        assert np.allclose([x.vector for x in rows], [d.vector for d in decoded.orderBy("ord").collect()], atol=1e-5), kind
        assert formats.read(spark, path).count() == 300  # each file stands by itself
    with pytest.raises(Exception, match="is no scalar file"):
        vecstream.read(spark, str(tmp_path / "pq"), "scalar").collect()


def test_commits(spark, tmp_path):
    df = from_arrays(spark, vectors())
    path = tmp_path / "out"
    vecstream.write(df, str(path))
    (path / "part-99999-left-over.stream1").write_bytes(b"a lost task's")  # no manifest names it
    assert vecstream.read(spark, str(path)).count() == 20
    vecstream.write(df.limit(5), str(path))
    rows = vecstream.read(spark, str(path)).orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(25)) and [r.id for r in rows[20:]] == [f"vec_{i}" for i in range(5)]
    vecstream.write(df.limit(0), str(path))
    assert vecstream.read(spark, str(path)).count() == 25
    vecstream.write(df.limit(3), str(path), mode="overwrite")
    assert [r.ord for r in vecstream.read(spark, str(path)).orderBy("ord").collect()] == [0, 1, 2]
    vecstream.write(df.limit(0), str(tmp_path / "none"))
    assert vecstream.read(spark, str(tmp_path / "none")).count() == 0


def test_folders_from_elsewhere(spark, tmp_path):
    for f in ("b", "a"):
        vecstream.write_file(from_arrays(spark, vectors(), ids=[f"{f}{i}" for i in range(20)]), str(tmp_path / f))
    with pytest.raises(Exception, match="index it first"):
        vecstream.read(spark, str(tmp_path)).collect()
    vecstream.index(spark, str(tmp_path), 150)
    rows = vecstream.read(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.id) for r in rows] == [(i, f"{'ab'[i // 20]}{i % 20}") for i in range(40)]
    (tmp_path / "a").write_bytes((tmp_path / "a").read_bytes()[:-3])
    with pytest.raises(Exception, match="ends early"):
        vecstream.index(spark, str(tmp_path))


def test_long_headers(spark, tmp_path):
    model = pq.ProductQuantizer(np.random.default_rng(2).standard_normal((4, 256, 40)), 160)
    codes = spark.createDataFrame([(i, f"v{i}", bytes([i, 0, 255, 7])) for i in range(9)], "ord long, id string, code binary")
    vecstream.write(codes, str(tmp_path / "pq"), "pq", model)
    rows = vecstream.read(spark, str(tmp_path / "pq")).orderBy("ord").collect()
    assert np.allclose(rows[5].vector, model.books[np.arange(4), [5, 0, 255, 7]].ravel(), atol=1e-5)


def test_a_stream_that_restarts_reads_each_row_once(spark, tmp_path):
    vecstream.register(spark)
    df = spark.createDataFrame([(i, "same", [1.0]) for i in range(10)], "ord long, id string, vector array<float>")  # rows alike but for ord
    path, got, marks = str(tmp_path / "in"), str(tmp_path / "got"), str(tmp_path / "marks")
    for n, rows in ((10, df), (10, None), (14, df.limit(4)), (24, df)):
        if rows is not None:
            vecstream.write(rows, path)
        q = spark.readStream.format("vecstream").option("path", path).load().writeStream.format("parquet").option("path", got).option("checkpointLocation", marks).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        assert sorted(r.ord for r in spark.read.parquet(got).collect()) == list(range(n))
        vecstream.write(df.limit(0), path)


def test_generators(spark):
    x = generators.xorshift_cube(spark, 3, 4).collect()
    assert [r.id for r in x] == ["v0", "v1", "v2"] and all(0 <= y < 1 for r in x for y in r.vector)
    a = generators.random_unit(spark, 30, 8, 5)
    assert sorted(map(str, a.collect())) == sorted(map(str, generators.random_unit(spark, 30, 8, 5).repartition(7).collect()))
    assert np.allclose(np.linalg.norm([r.vector for r in a.collect()], axis=1), 1, atol=1e-5)
    t = generators.themed(spark, "mixed", 180, 16)
    assert t.count() == 180 and t.select("ord").distinct().count() == 180
    ids = [r.id for r in generators.themed(spark, "products", 12, 4).orderBy("ord").collect()]
    assert ids[:2] == ["electronics_laptop__0000", "electronics_smartphone__0001"]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a,1,0\nb,0,1\nbad\n")
    rows = stream.read_lines(spark, str(tmp_path / "in"))
    stream.write(stream.encode(rows), str(tmp_path / "out"), str(tmp_path / "ck1")).awaitTermination()
    back = nf4.decode(nf4.unpack(spark.read.parquet(str(tmp_path / "out"))))
    assert {r.id: r.vector for r in back.collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0]}
    found = []
    q = stream.search_stream(stream.read_lines(spark, str(tmp_path / "in")), from_arrays(spark, [[1.0, 0.1], [0.1, 1.0]]), 1, lambda df, n: found.extend(df.collect()), str(tmp_path / "ck2"))
    q.awaitTermination()
    assert {r.qid: r.id for r in found} == {"a": "vec_0", "b": "vec_1"}


def test_graph_file(spark, tmp_path):
    df = from_arrays(spark, vectors(60, 8))
    index = hnsw.build(df, 1).persist()
    path = str(tmp_path / "g.bin")
    assert graph_file.write(index, path) == 60
    back = graph_file.read(spark, path)
    q = spark.createDataFrame([("q", [1.0] * 8)], "qid string, vector array<float>")
    assert [r.id for r in hnsw.batch_top_k(back, q, 5).orderBy("rn").collect()] == [r.id for r in hnsw.batch_top_k(index, q, 5).orderBy("rn").collect()]
    with open(path, "rb") as f:
        data = f.read()
    nodes, entry, params = graph_file.decode_graph(data)
    assert graph_file.encode_graph(nodes, entry) == data and params["m0"] == 32
    empty = graph_file.encode_graph([], -1)
    assert graph_file.decode_graph(empty)[:2] == ([], -1) and len(empty) == 8 + 1 + 4 + 48
    with pytest.raises(ValueError):
        graph_file.write(hnsw.build(df, 4), path)
