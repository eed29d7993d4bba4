import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from vecspark import api, cli
from vecspark.plans import workflow
from vecspark.plans.http import serve
from vecspark.plans.session import BadRequest, NotFound, VectorSession
from vecspark.schema import EMBEDDING, toy_dataset


def test_session(spark):
    s = VectorSession(spark)
    assert s.health()["status"] == "ok" and s.stats()["count"] == 0
    with pytest.raises(NotFound):
        s.search([1.0, 0.0])
    with pytest.raises(BadRequest):
        s.build_index()
    with pytest.raises(BadRequest):
        s.upload(spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0, 2.0])], EMBEDDING))
    s.upload(toy_dataset(spark))
    assert [r["id"] for r in s.search([1.0, 0.0], 2)["results"]] == ["one", "three"]
    assert s.search([1.0, 0.0, 0.0])["results"] == []
    with pytest.raises(NotFound):
        s.index_search([1.0, 0.0])
    assert s.build_index()["nodes"] == 3
    assert s.index_search([0.0, 1.0], 1)["results"][0]["id"] == "two"
    s.upload(toy_dataset(spark).limit(2))
    with pytest.raises(NotFound):
        s.index_search([1.0, 0.0])


def test_http(spark):
    server = serve(VectorSession(spark), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(at + path, json.dumps(body).encode() if body is not None else None)) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert call("/health")[0] == 200
    assert call("/api/search", {"query": [1]})[0] == 404
    assert call("/api/upload", {"embeddings": []})[0] == 400
    assert call("/api/load?path=")[0] == 400
    assert call("/api/upload", {"embeddings": [{"id": "a", "vector": [1, 0]}, {"id": "b", "vector": [0, 1]}]})[0] == 200
    assert call("/api/search", {"query": [0.1, 1], "k": 1})[1]["results"][0]["id"] == "b"
    server.shutdown()


def test_workflow(spark, tmp_path):
    v = np.random.default_rng(0).standard_normal((60, 16))
    df = api.load_embeddings_from_array(v, spark=spark)
    q = spark.createDataFrame([("q", [float(x) for x in v[7]]), ("zero", [0.0] * 16)], "qid string, vector array<float>")
    for kind in ("stream", "scalar", "nf4", "pq", "rq", "auto"):
        done = workflow.compress(df, kind, k=16)
        assert done.write_file(str(tmp_path / kind)) == 60 and done.decoded.count() == 60
    lines = workflow.run(df, str(tmp_path / "p"), "nf4", queries=q, k=3).collect()
    out = [json.loads(r.line) for r in lines]
    assert len(out) == 1 and out[0]["query_id"] == "q" and out[0]["results"][0]["id"] == "vec_7" and len(out[0]["results"]) == 3


def test_api(spark, tmp_path):
    d = api.EmbeddingDataset()
    d.add_vector("a", [1.0, 0.0])
    d.add_embedding(api.Embedding("b", [0.0, 1.0]))
    assert len(d) == 2 and not d.is_empty() and d.get_ids() == ["a", "b"] and d.get_vectors().shape == (2, 2)
    d.save(str(tmp_path / "d.bin"))
    assert api.EmbeddingDataset.load(str(tmp_path / "d.bin")).get_ids() == ["a", "b"]
    for index in (api.SearchIndex.from_dataset(d), api.QuantizedIndex.from_dataset(d)):
        at, s = index.search_vector([0.1, 1.0], 1)
        assert at.tolist() == [1] and s[0] > 0.99
        with pytest.raises(ValueError):
            index.search_vector([1.0], 1)
        with pytest.raises(ValueError):
            index.search_vector([1.0, 0.0], 0)
        (a, _), (b, _) = index.batch_search([[1.0, 0.0], [1.0]], 2)
        assert a.tolist() == [0, 1] and b.tolist() == []
    assert index.compression_ratio() == 4.0 and index.memory_usage_bytes() == 4 + 16
    assert api.generate_quality_report(index)["quality_grade"] == "A+"
    plain = np.array([[1.0, 0.0], [0.0, 1.0], [3.0, 4.0]], np.float32)
    found = api.analyze_compression_quality(plain, index, 2)
    assert found["samples_analyzed"] == 2 and found["average_similarity"] > 0.99 and found["compression_ratio"] == 4.0 and set(found) == {"average_similarity", "max_similarity", "min_similarity", "compression_ratio", "memory_savings_percent", "samples_analyzed"}
    assert api.generate_quality_report(plain, index)["original_size_estimate_mb"] == 24 / 1048576
    assert api.create_quantized_index(plain, config=api.IndexConfig(quantization_bits=16)).dim == 2
    api.save_index(index, str(tmp_path / "i"))
    assert api.load_index(str(tmp_path / "i"), spark=spark).dim == 2
    with pytest.raises(ValueError):
        api.create_index([])


def test_cli(spark, tmp_path, capsys):
    p = tmp_path / "in.jsonl"
    p.write_text("\n".join(json.dumps({"id": f"r{i}", "vector": [i + 1.0, 1.0]}) for i in range(9)))
    assert cli.main(["compress", str(p), str(tmp_path / "o.bin"), "--format", "scalar"]) == 0
    assert [e.id for e in map(lambda x: x, cli.load(spark, str(tmp_path / "o.bin")).orderBy("ord").collect())] == [f"r{i}" for i in range(9)]
    assert cli.main(["search", "1.0, x, 0.0", "--top-k", "1"]) == 0
    assert "1. one -> 1.000000" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        cli.main(["search", "1,0", "--dataset", str(tmp_path / "missing")])


def test_stream_iterator(tmp_path):
    from vecspark.sources import formats

    path = tmp_path / "a"
    path.write_bytes(formats.encode_header("stream") + b"".join(formats.encode_record("stream", (f"v{i}", [i, i + 1.0])) for i in range(5)))
    assert [e.id for e in api.stream_embeddings(str(path))] == [f"v{i}" for i in range(5)]
    path.write_bytes(formats.encode_header("nf4"))
    with pytest.raises(ValueError):
        next(api.stream_embeddings(str(path)))
