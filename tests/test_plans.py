import hashlib
import json
import os
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from quarry.operators import bm25, context, incremental, models
from quarry.operators.answers import NO_QUESTION, extractive_generator, generate
from quarry.operators.retrievers import Retriever
from quarry.plans import cli, server
from quarry.plans import index as plans
from quarry.sources import files, schemas


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "corpus"
    for name, text in {"a/wheel.py": "# wheel\ndef check_wheel_size():\n    return 1\n", "b.md": "# Title\r\nquantum banana guide\r\n", "c.bin": "no", "build/x.py": "x = 1", "d/.md": "no", "E.TXT": "telescope"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text.encode())
    (root / "bad.txt").write_bytes(b"ok \xff\xc3 end")
    return str(root)


def test_scan(spark, raw):
    docs = {r.file_path: r.content for r in files.read_documents(spark, raw, raw).collect()}
    assert set(docs) == {"a/wheel.py", "b.md", "E.TXT", "bad.txt"}
    assert docs["b.md"] == "# Title\nquantum banana guide\n" and docs["bad.txt"] == b"ok \xff\xc3 end".decode(errors="replace")


def test_supported(spark):
    cases = {"/x/a.py": True, "/x/a.PY": True, "/x/.md": False, "/x/a.md.bak": False, "/x/build/a.py": False, "/x/foo.egg-info/a.py": True, "/x/egg-info/a.py": False, "a.c": True, "/x/Makefile": False}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", files.supported(F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in rows} == cases


def test_index_search_and_caches(spark, raw, tmp_path):
    index, cache = str(tmp_path / "index"), str(tmp_path / "cache")
    with pytest.raises(FileNotFoundError):
        plans.search(spark, "wheel", index_dir=index)
    plans.index(spark, raw, index, root=raw)
    found = plans.search(spark, "check_wheel_size", 5, index, cache_dir=cache)
    assert found[0]["file_path"] == "a/wheel.py"
    assert plans.search(spark, "check_wheel_size", 5, index, cache_dir=cache) == found
    assert plans.search(spark, " ", 5, index) == [] and plans.search(spark, "wheel", 0, index) == []
    assert plans.load(spark, index) is plans.load(spark, index)
    ids = [r.chunk_id for r in plans.load(spark, index).lexical.chunks.orderBy("file_path", "first_character_index").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    with pytest.raises(FileNotFoundError):
        plans.search(spark, "banana", 5, index, hybrid=True)
    assert plans.index_semantic(spark, index) == len(ids)
    assert plans.search(spark, "quantum banana", 2, index, hybrid=True)[0]["file_path"] == "b.md"
    with open(f"{raw}/new.md", "w") as f:
        f.write("check_wheel_size again check_wheel_size")
    plans.index_incremental(spark, raw, index, root=raw)
    assert {s["file_path"] for s in plans.search(spark, "check_wheel_size", 5, index, cache_dir=cache)} == {"a/wheel.py", "new.md"}


def test_incremental_equals_rebuild(spark, raw, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    number, counts = plans.index_incremental(spark, raw, one, root=raw)
    assert counts == {"added": 4}
    assert plans.index_incremental(spark, raw, one, root=raw) == (number, {"unchanged": 4})
    with open(f"{raw}/b.md", "a") as f:
        f.write("more text here\n")
    os.remove(f"{raw}/E.TXT")
    _, counts = plans.index_incremental(spark, raw, one, root=raw)
    assert counts == {"unchanged": 2, "changed": 1, "deleted": 1}
    plans.index(spark, raw, two, root=raw)
    rows = lambda d: sorted(map(repr, plans.load(spark, d).lexical.chunks.collect()))
    assert rows(one) == rows(two)
    assert all(len(r.sha256) == 64 for r in plans.load(spark, one).manifest.collect())


def test_reindexing_twice_in_a_session(spark, raw, tmp_path):
    """Nothing of an earlier state of the files comes back: neither chunks nor documents nor manifest."""
    at = str(tmp_path / "index")
    plans.index(spark, raw, at, root=raw)
    for text in ("second state\n", "third state, longer\n"):
        with open(f"{raw}/b.md", "w") as f:
            f.write(text)
        with open(f"{raw}/{len(text)}.md", "w") as f:
            f.write("new " + text)
        plans.index(spark, raw, at, root=raw)
        found = plans.load(spark, at)
        want = {p: open(f"{raw}/{p}", "rb").read().decode(errors="replace") for p in ("a/wheel.py", "b.md", "E.TXT", "bad.txt", *(x for x in os.listdir(raw) if x[0].isdigit()))}
        assert {r.file_path: r.content for r in found.documents.collect()} == want
        assert {r.file_path: r.content for r in found.lexical.chunks.collect()} == {p: t.removesuffix("\n") if p.endswith(".py") else t for p, t in want.items()}
        assert {r.file_path: r.sha256 for r in found.manifest.collect()} == {p: hashlib.sha256(open(f"{raw}/{p}", "rb").read()).hexdigest() for p in want}
        assert {s["file_path"] for s in plans.search(spark, text.split()[0], 9, at)} == {"b.md", f"{len(text)}.md"}


def test_a_frequent_term_is_split_and_rare_ones_are_pushed(spark, raw, tmp_path):
    at = str(tmp_path / "index")
    plans.index(spark, raw, at, root=raw)
    found = plans.load(spark, at).lexical
    asked = spark.createDataFrame([("q", "banana")], "question_id string, question string")
    plan = bm25.pruned(found.postings, asked)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,banana)" in plan or "In(term, [banana])" in plan
    assert {r.term for r in bm25.pruned(found.postings, asked).collect()} == {"banana"}
    many = spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(300)) + " banana")], "question_id string, question string")
    assert [r.chunk_id for r in bm25.retrieve(found, many, 3).collect()] == [r.chunk_id for r in bm25.retrieve(found, asked, 3).collect()]


def test_a_retriever_of_ones_own(spark, raw, tmp_path):
    at = str(tmp_path / "index")
    plans.index(spark, raw, at, root=raw)

    class Last:
        def retrieve(self, questions, k):
            return questions.select("question_id", F.lit(4).cast("long").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    assert isinstance(Last(), Retriever)
    asked = spark.createDataFrame([("q", "x"), ("r", "y")], "question_id string, question string")
    rows = plans.search_batch(spark, asked, at, 3, by=Last()).collect()
    last = plans.load(spark, at).lexical.chunks.filter("chunk_id = 4").first().file_path
    assert [[s.file_path for s in r.retrieved_sources] for r in rows] == [[last], [last]]


def test_hybrid_dataset(spark, raw, tmp_path):
    at = str(tmp_path / "index")
    plans.index(spark, raw, at, root=raw)
    questions = [{"question_id": "q1", "question": "quantum banana"}, {"question_id": "q2", "question": " "}, {"question_id": "q3", "question": "telescope"}]
    (tmp_path / "set.json").write_text(json.dumps({"rag_questions": questions}))
    with pytest.raises(FileNotFoundError):
        plans.search_dataset(spark, str(tmp_path / "set.json"), str(tmp_path / "out"), at, 2, hybrid=True)
    plans.index_semantic(spark, at)
    doc = json.loads(open(plans.search_dataset(spark, str(tmp_path / "set.json"), str(tmp_path / "out"), at, 2, hybrid=True)).read())
    best = [[x["file_path"] for x in r["retrieved_sources"]][:1] for r in doc["search_results"]]
    assert best == [["b.md"], [], ["E.TXT"]] and doc["k"] == 2


def test_models_choose_a_device():
    from types import SimpleNamespace as N

    torch = lambda cuda, mps: N(cuda=N(is_available=lambda: cuda), backends=N(mps=N(is_available=lambda: mps)))
    assert [models.device_of(torch(c, m)) for c, m in ((True, True), (False, True), (False, False))] == ["cuda", "mps", "cpu"]
    assert models.device_of(torch(True, True), "cpu") == "cpu" and models.device_of(N(cuda=N(is_available=lambda: False), backends=N())) == "cpu"


def test_manifest_delta_and_merge(spark):
    m = lambda rows: spark.createDataFrame(rows, schemas.MANIFEST)
    delta = incremental.manifest_delta(m([("a", "1"), ("b", "1"), ("c", "1")]), m([("a", "1"), ("b", "2"), ("d", "1")]))
    assert {r.file_path: r.status for r in delta.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "added"}
    c = lambda tag: spark.createDataFrame([(f, tag) for f in "abcd"], "file_path string, tag string")
    assert sorted((r.file_path, r.tag) for r in incremental.merge_chunks(c("old"), c("new").filter("file_path <> 'c'"), delta).collect()) == [("a", "old"), ("b", "new"), ("d", "new")]


def test_datasets_results_and_evaluation(spark, raw, tmp_path):
    index = str(tmp_path / "index")
    plans.index(spark, raw, index, root=raw)
    span = {"file_path": "a/wheel.py", "first_character_index": 0, "last_character_index": 48}
    questions = [{"question_id": "q1", "question": "check_wheel_size", "sources": [span], "answer": "1"}, {"question_id": "q2", "question": "", "sources": []}, {"question": "banana"}]
    (tmp_path / "set.json").write_text(json.dumps({"rag_questions": questions}))
    (tmp_path / "list.json").write_text(json.dumps(questions))
    (tmp_path / "broken.json").write_text("{")
    for name in ("set.json", "list.json"):
        rows = files.read_questions(spark, str(tmp_path / name)).collect()
        assert sorted(r.question for r in rows) == ["", "banana", "check_wheel_size"] and all(r.question_id for r in rows)
    assert files.read_questions(spark, str(tmp_path / "broken.json")).count() == 0
    out = plans.search_dataset(spark, str(tmp_path / "set.json"), str(tmp_path / "out"), index, 3)
    doc = json.loads(open(out).read())
    assert doc["k"] == 3 and [r["question"] for r in doc["search_results"]] == ["check_wheel_size", "", "banana"]
    assert doc["search_results"][1]["retrieved_sources"] == []
    assert plans.evaluate_results(spark, out, str(tmp_path / "set.json")) == {1: 1, 3: 1, 5: 1, 10: 1}
    answers = plans.answer_dataset(spark, out, str(tmp_path / "answers"), index, extractive_generator())
    doc = json.loads(open(answers).read())
    assert doc["k"] == 3 and doc["search_results"][1]["answer"] == NO_QUESTION and "quantum" in doc["search_results"][2]["answer"]


def documents(spark):
    return spark.createDataFrame([("f", "AAAA BBBB CCCC"), ("g", "x" * 4000), ("h", "  \n ")], schemas.DOCUMENTS)


def cited(spark, *sources):
    return spark.createDataFrame([("q", "what is BBBB?", list(sources))], schemas.RESULT)


def test_context(spark):
    build = lambda *s, **kw: context.build_context(cited(spark, *s), documents(spark), **kw).first().context
    assert build(("f", 5, 9)) == "[Source 1: f]\nBBBB\n"
    assert build(("missing", 0, 5)) == "" and build() == ""
    assert build(("h", 0, 3), ("f", 0, 4)) == "[Source 2: f]\nAAAA\n"
    assert build(("f", 0, 4), ("g", 0, 4000), ("f", 5, 9)) == "[Source 1: f]\nAAAA\n"
    assert build(("f", 0, 4), ("f", 5, 9), ("f", 10, 14), ("f", 0, 9)).count("[Source") == 3


def test_answers(spark):
    seen = lambda: lambda messages, n: f"<think>{n}</think>{messages[1]['content'].count('BBBB')}"
    assert generate(cited(spark, ("f", 5, 9)), documents(spark), seen).first().answer == "2"
    blank = spark.createDataFrame([("q", "  ", [])], schemas.RESULT)
    assert generate(blank, documents(spark), seen).first().answer == NO_QUESTION


def test_service(spark, raw, tmp_path):
    index = str(tmp_path / "index")
    s = server.Service(spark, index)
    assert s.handle("GET", "/health") == (200, server.HEALTH) and s.handle("GET", "/nothing")[0] == 404
    assert s.handle("POST", "/search", {"query": "wheel"})[0] == 503
    plans.index(spark, raw, index, root=raw)
    assert s.handle("POST", "/search", {"query": " "})[0] == 400 and s.handle("POST", "/search", {"query": "x", "k": 0})[0] == 400
    assert s.handle("POST", "/search", {})[0] == 422
    status, body = s.handle("POST", "/search", {"query": "banana", "k": 1})
    assert status == 200 and body["results"][0]["file_path"] == "b.md"
    status, body = s.handle("POST", "/answer", {"query": "quantum banana?"})
    assert status == 200 and "quantum" in body["answer"] and body["sources"]
    s.make = lambda: (_ for _ in ()).throw(RuntimeError("no model"))
    assert s.handle("POST", "/answer", {"query": "banana"})[0] == 500


def test_socket(spark, raw, tmp_path):
    at = str(tmp_path / "index")
    plans.index(spark, raw, at, root=raw)
    s = server.server(spark, at, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"
    try:
        assert json.load(urllib.request.urlopen(f"{url}/health", timeout=60)) == server.HEALTH
        body = json.dumps({"query": "banana", "k": 1}).encode()
        assert json.load(urllib.request.urlopen(f"{url}/search", body, timeout=120))["results"][0]["file_path"] == "b.md"
        with pytest.raises(urllib.error.HTTPError, match="422"):
            urllib.request.urlopen(f"{url}/search", b"{", timeout=60)
    finally:
        s.shutdown()
        s.server_close()


def test_commands(spark, raw, tmp_path, capsys, monkeypatch):
    index = f"--index_dir={tmp_path}/index"
    run = lambda *a: (cli.run(list(a), spark), capsys.readouterr().out)
    assert run("search", "--query=x", index)[0] == 1
    monkeypatch.chdir(os.path.dirname(raw))
    code, out = run("index", f"--raw_dir={raw}", index)
    assert code == 0 and out.startswith("Indexed ")
    assert {r.file_path for r in plans.load(spark, f"{tmp_path}/index").documents.collect()} == {"corpus/a/wheel.py", "corpus/b.md", "corpus/E.TXT", "corpus/bad.txt"}
    code, out = run("search", "--query=banana", index)
    assert code == 0 and "b.md [0:" in out
    assert run("search", "--query= ", index)[0] == 1 and run("index", "--raw_dir=/none", index)[0] == 1
    assert run("index", f"--raw_dir={raw}", index, "--max_chunk_size=3000")[0] == 1
    assert run("index_semantic", index)[0] == 0
    assert "b.md" in run("search_hybrid", "--query=banana", index)[1]
    assert "quantum" in run("answer", "--query=banana", index)[1]
    assert json.loads(run("index_incremental", f"--raw_dir={raw}", index)[1]) == {"unchanged": 4}


def test_stream(spark, tmp_path):
    from quarry.streaming.ingest import ingest, latest

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    put = lambda rows: spark.createDataFrame(rows, schemas.DOCUMENTS).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: ingest(spark.readStream.schema(schemas.DOCUMENTS).parquet(src), out, ck).awaitTermination(60)
    put([("a.md", "one"), ("b.md", "two")])
    stream()
    put([("a.md", "changed"), ("b.md", None), ("c.md", "three")])
    stream()
    assert sorted((r.file_path, r.content) for r in latest(spark, out).collect()) == [("a.md", "changed"), ("c.md", "three")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_true_spans_shuffle_no_text(spark):
    """Documents meet the texts' words by a broadcast of pairs, whatever the sizes that Spark estimates."""
    from quarry.plans import queries as engine

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = engine._truth(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(chunk_id" not in plan
