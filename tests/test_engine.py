import pytest
from pyspark.sql import functions as F

from quarry import config, errors
from quarry.config import ChunkingConfig, Config, ManagerConfig, ProviderConfig, RerankConfig, RetrieverConfig
from quarry.engine import Engine
from quarry.operators import embedding, prompt, providers, rerank, search
from quarry.sources import store
from quarry.streaming import tasks


def test_errors():
    assert len(errors.MESSAGES) == 18
    e = errors.EngineError("RAG_005", "top_k", ValueError("x"))
    assert str(e) == "[RAG_005] Invalid input parameter: top_k (caused by: x)"
    assert errors.has_code(e, "RAG_005") and not errors.has_code(ValueError(), "RAG_005")
    assert errors.EngineError("other").message == "Unknown error"


def test_config():
    c = config.load('[chunking]\nmax_chunk_size = 300\n[retriever]\nmin_score = 0.2\n[[providers]]\nname = "${N}"\n', {"N": "p"})
    assert (c.chunking.max_chunk_size, c.chunking.overlap_size, c.retriever.min_score, c.providers[0].name) == (300, 200, 0.2, "p")
    for bad in ('[retriever]\nindex_algorithm = "X"', "[retriever]\nvector_weight = 2.0", "[retriever]\ndefault_top_k = 50", "providers = []"):
        with pytest.raises(errors.EngineError):
            config.load(bad)
    assert ChunkingConfig(0, -1, 0) == ChunkingConfig()
    r = RetrieverConfig()
    assert [r.top_k(x) for x in (None, 0, 3, 99)] == [5, 5, 3, 20]


def test_rerank_rules():
    off, on = RerankConfig(), RerankConfig(enabled=True, recall_k=0)
    assert [rerank.recall_k(c, 5) for c in (off, on, RerankConfig(enabled=True, recall_k=20))] == [5, 20, 20]
    rerank.check_limit("qwen3-rerank", 500)
    rerank.check_limit("gte-rerank-v2", 30_000)
    for model, n in (("qwen3-rerank", 501), ("qwen3-vl-rerank", 101)):
        with pytest.raises(errors.EngineError):
            rerank.check_limit(model, n)
    assert rerank.top_n(0, RerankConfig(top_n=0), 3) == 3


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_manager_and_breaker():
    clock, calls = Clock(), []

    def factory(config):
        def embed(texts):
            calls.append(config.name)
            if config.options.get("bad"):
                raise RuntimeError("down")
            return [[1.0]] * len(texts)

        return embed

    embedding.register("fake", factory)
    bad = ProviderConfig("bad", "fake", priority=1, options={"bad": True})
    good = ProviderConfig("good", "fake", priority=2)
    m = embedding.Manager([bad, good], ManagerConfig(circuit_threshold=2, circuit_timeout=10), clock, lambda s: None)
    assert m.embed(["a"]) == [[1.0]] and calls == ["bad", "good"]
    m.embed(["a"])
    assert m.breakers["bad"].state == "open"
    calls.clear()
    m.embed(["a"])
    assert calls == ["good"]
    clock.now = 11
    m.embed(["a"])
    assert calls == ["good", "bad", "good"] and m.breakers["bad"].state == "open"
    rr = embedding.Manager([ProviderConfig("x", "fake"), ProviderConfig("y", "fake")], ManagerConfig(strategy="round_robin"))
    calls.clear()
    rr.embed(["a"]), rr.embed(["a"])
    assert sorted(calls) == ["x", "y"]
    with pytest.raises(errors.EngineError):
        embedding.Manager([ProviderConfig("", "fake")])
    with pytest.raises(errors.EngineError):
        embedding.Manager([bad], ManagerConfig(max_retries=1), clock, lambda s: None).embed(["a"])
    assert embedding.backoff_seconds(10) == 5.0


def test_cache(spark):
    cache = spark.createDataFrame([("h1", [1.0])], "hash string, vector array<float>")
    new = spark.createDataFrame([("h1", [2.0]), ("h2", [3.0])], "hash string, vector array<float>")
    assert {r["hash"]: r["vector"] for r in embedding.put(cache, new).collect()} == {"h1": [2.0], "h2": [3.0]}
    entries = spark.createDataFrame([("a", 1, 9), ("b", 2, 9), ("c", 3, 9), ("d", 4, 0)], "hash string, last_access int, expires_at int")
    assert {r["hash"] for r in embedding.kept_entries(entries, 2, F.lit(5)).collect()} == {"b", "c"}
    log = spark.createDataFrame([(True,), (True,), (False,)], "hit boolean")
    assert tuple(embedding.cache_stats(log).first())[:2] == (2, 1)
    texts = spark.createDataFrame([("x",), (" x ",), ("y",)], "text string")
    rows, fresh = embedding.embed_cached(texts, cache.limit(0), lambda c: F.array(F.length(c).cast("float")))
    assert rows.count() == 3 and fresh.count() == 2


def test_python_and_jvm_embedders_agree(spark):
    texts = ["Hello, World 42", "中文 text", "", "Ünï códe_x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    jvm = [list(r[0]) for r in frame.select(embedding.embedder()("t")).collect()]
    assert jvm == embedding._local(ProviderConfig("local"))(texts)


def test_search_edges(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("c", [2.0, 0.0])], "chunk_id string, vector array<float>")
    got = search.knn(rows, [1.0, 0.0], 10).collect()
    assert [r["chunk_id"] for r in got] == ["a", "c", "b"]
    docs = spark.createDataFrame([("a", "red fish"), ("b", "red red dog"), ("c", None)], "chunk_id string, content string")
    assert [r["chunk_id"] for r in search.bm25(docs, "red", 5).collect()] == ["b", "a"]
    assert search.bm25(docs, "red dog", 5).count() == 1 and search.bm25(docs, "red dog", 5, match_all=False).count() == 2
    assert search.bm25(docs, "!!", 5).count() == 0


def test_ann_recall(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(600, 16))
    rows = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, vector array<float>")
    index = search.IvfIndex(rows, cells=8)
    hit = 0
    for q in x[:10]:
        exact = {t["chunk_id"] for t in search.knn(rows, q.tolist(), 5).collect()}
        hit += len(exact & {t["chunk_id"] for t in index.search(q.tolist(), 5, probes=6).collect()})
    assert hit >= 45


def test_prompt(spark):
    rows = [(1, "c1", "f2", "two.md", 0, "x", 0.91), (2, "c2", "f1", "", 3, "y", 0.8), (3, "c3", "f2", "two.md", 1, "z", 0.705)]
    frame = spark.createDataFrame(rows, "rank int, chunk_id string, file_id string, file_name string, chunk_index int, content string, relevance_score double")
    text = prompt.build(frame, "why?").first()[0]
    assert text.index("=== 文件 1: two.md ===") < text.index("[片段 1] (相关度: 91.0%)\nx") < text.index("[片段 2] (相关度: 70.5%)\nz") < text.index("=== 文件 2: f1 ===")
    assert text.endswith("用户问题：why?\n\n请提供准确、完整的回答：")
    assert prompt.build(frame.limit(0), "why?").first()[0] == "why?"


def test_provider_status(spark):
    calls = spark.createDataFrame([("a", i, True, 1.0) for i in range(20)] + [("b", 1, True, 1.0), ("b", 2, False, 3.0)], "provider string, seq int, ok boolean, latency double")
    open_ = spark.createDataFrame([("b",)], "provider string")
    assert {r["provider"]: r["status"] for r in providers.stats(calls).collect()} == {"a": "healthy", "b": "degraded"}
    got = {r["provider"]: (r["status"], r["avg_latency"]) for r in providers.stats(calls, open_providers=open_).collect()}
    assert got["b"] == ("unhealthy", 4.0)


def test_store_and_migration(spark, tmp_path):
    s = store.ParquetChunkStore(spark, str(tmp_path / "s"), "FLAT", 2)
    kind = "user_id long, file_id string, file_name string, chunk_id string, chunk_index int, content string, vector array<float>"
    s.ensure(1), s.ensure(1)
    assert s.described().count() == 1
    s.upsert(spark.createDataFrame([(1, "f", "f", "a", 0, "x", [1.0]), (1, "f", "f", "b", 1, "y", [1.0]), (2, "g", "g", "c", 0, "z", [1.0])], kind), 1)
    again = spark.createDataFrame([(1, "f", "f", "d", 0, "new", [1.0])], kind)
    s.upsert(again, 2), s.upsert(again, 2)
    assert sorted(r["chunk_id"] for r in s.read().collect()) == ["c", "d"]
    assert s.delete(1, "f") == 1 and s.delete(1, "f") == 0 and s.delete(9, "q") == 0
    assert [r["chunk_id"] for r in s.read().collect()] == ["c"]
    assert store.migrate(s, "HNSW", 2) == 1 and store.migrate(s, "HNSW", 2) == 0
    assert [r["chunk_id"] for r in s.read(2).collect()] == ["c"]


def test_engine_end_to_end(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), Config(retriever=RetrieverConfig(min_score=0.0)))
    docs = spark.createDataFrame(
        [(1, "a", "a.md", "# Cats\n\n- cats purr and sleep\n"), (1, "b", "b.txt", "dogs bark and run"), (2, "c", "c.txt", "cats of another user")], "user_id long, file_id string, file_name string, content string"
    )
    assert {r["file_id"]: r["total_chunks"] for r in e.index(docs).collect()} == {"a": 1, "b": 1, "c": 1}
    hits = e.search("cats purr", 1).collect()
    assert hits[0]["file_id"] == "a" and {h["file_id"] for h in hits} == {"a", "b"}
    assert {h["file_id"] for h in e.search("cats", 1, file_ids=["b"]).collect()} == {"b"}
    assert "cats purr" in e.build_prompt("cats", 1) and e.build_prompt("cats", 7) == "cats"
    assert e.delete("a", 1) == 1 and {h["file_id"] for h in e.search("cats", 1).collect()} == {"b"}
    task = e.index_async(1, "d", "owls hoot")
    assert e.task_status(task)["status"] == "pending"
    e.run_tasks(), e.run_tasks()
    assert e.task_status(task)["status"] == "completed" and e.task_status("none") is None
    assert "d" in {h["file_id"] for h in e.search("owls", 1).collect()}
    for bad in (lambda: e.search("", 1), lambda: e.search("x", 0), lambda: e.index_async(1, "", "x")):
        with pytest.raises(errors.EngineError):
            bad()
    parsed = e.parse(docs).collect()
    assert {r["format"] for r in parsed} == {"markdown", "text"}


def test_failed_tasks_are_marked(spark, tmp_path):
    q = tasks.TaskQueue(spark, str(tmp_path / "q"))
    bad, good = q.submit(1, "bad", "x"), q.submit(1, "good", "y")

    def index(rows):
        if rows.filter("file_id = 'bad'").count():
            raise RuntimeError("broken")

    q.run(index)
    assert (q.status(bad)["status"], q.status(good)["status"]) == ("failed", "completed")


def test_task_status_expires(spark, tmp_path):
    path = str(tmp_path / "q")
    q = tasks.TaskQueue(spark, path)
    assert q.status("none") is None
    known = q.submit(1, "f", "x")
    assert q.status(known)["status"] == "pending" and q.status("none") is None
    assert tasks.TaskQueue(spark, path, config.TaskConfig(task_ttl_seconds=0)).status(known) is None


def test_store_keeps_its_log_when_a_user_is_added(spark, tmp_path):
    s = store.ParquetChunkStore(spark, str(tmp_path / "log"), "FLAT", 2)
    row = "user_id long, file_id string, file_name string, chunk_id string, chunk_index int, content string, vector array<float>"
    s.ensure(1)
    s.upsert(spark.createDataFrame([(1, "a", "a", "c1", 0, "x", [1.0, 0.0])], row))
    s.compact()
    s.upsert(spark.createDataFrame([(1, "b", "b", "c2", 0, "y", [1.0, 0.0])], row))
    s.ensure(2)
    assert s.read().count() == 2 and s.described().count() == 3


def test_index_parses_embeds_once_and_describes(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    e = Engine(spark, str(tmp_path / "e"), pages=lambda raw: [[[raw.decode().split("|")[1]]]])

    def counted(c, embed=e.embed):
        seen = F.udf(lambda t: (calls.add(1), t)[1])
        return embed(seen(c))

    e.embed = counted
    import base64

    pdf_text = "base64:" + base64.b64encode(b"%PDF-1.4|cats purr").decode()
    docs = spark.createDataFrame([(1, "h", "h.html", "<p>cats &amp; dogs</p>", "html"), (1, "t", "t.txt", "<p>raw</p>", ""), (2, "p", "p.pdf", pdf_text, None)], "user_id long, file_id string, file_name string, content string, format string")
    assert e.index(docs).count() == 3
    first = calls.value
    kept = {r["file_id"]: r["content"] for r in e.store.read().collect()}
    assert kept["h"] == "cats & dogs" and kept["t"] == "<p>raw</p>" and "cats purr" in kept["p"]
    assert {r["index"] for r in e.store.described().collect()} == {"rag_user_1:idx", "rag_user_2:idx"}
    e.index(docs).collect()
    assert first == 3 and calls.value == 3 and e.store.read().count() == 3


def test_rerank_limit_ignores_case():
    assert rerank.limit("GTE-Rerank-V2") == 30_000 and rerank.limit("gte-rerank") == 500


def test_weighted_pick_leaves_out_open_breakers():
    from quarry.config import ManagerConfig, ProviderConfig

    m = embedding.Manager([ProviderConfig(name="a", weight=99), ProviderConfig(name="b")], ManagerConfig(strategy="weighted"))
    for _ in range(5):
        m.breakers["a"].record(False)
    assert {m.pick(0)[0].name for _ in range(20)} == {"b"}


def test_term_index_gives_what_a_scan_gives(spark, tmp_path):
    import shutil

    s = store.ParquetChunkStore(spark, str(tmp_path / "t"), "FLAT", 2)
    kind = "user_id long, file_id string, file_name string, chunk_id string, chunk_index int, content string, vector array<float>"
    rows = [(1, "a", "a", "a0", 0, "Red fish red", [1.0]), (1, "a", "a", "a1", 1, "blue fish", [1.0]), (1, "b", "b", "b0", 0, "red dog", [1.0]), (1, "n", "n", "n0", 0, None, [1.0]), (2, "a", "a", "c0", 0, "red red", [1.0])]

    def same():
        for query, where, every in (("fish dog", None, False), ("red", F.col("file_id").isin("a"), True)):
            want, got = search.bm25(s.read(1), query, 5, match_all=every, where=where), s.terms.search(1, query, 5, where, every)
            assert [tuple(r) for r in got.collect()] == [(r["chunk_id"], r["score"]) for r in want.collect()], query

    s.upsert(spark.createDataFrame(rows, kind), 1)
    s.upsert(spark.createDataFrame([(1, "b", "b", "b1", 0, "red fish again", [1.0])], kind), 2)
    s.upsert(spark.createDataFrame([(1, "b", "b", "b1", 0, "red fish again", [1.0])], kind), 2)
    s.delete(1, "n")
    same()
    s.compact()
    shutil.rmtree(s.location() + "_files")  # as a store without an index
    same()
    assert s.terms.search(1, "!!", 5).count() == 0
