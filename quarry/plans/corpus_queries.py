"""Registered queries over sources, syntax units, snapshots, results and context, and their SQL.

Files and JSON documents that they read are first made from the test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import bm25, chunking, context, evaluate, incremental, vectors
from quarry.operators.answers import generate
from quarry.operators.retrievers import Lexical
from quarry.plans import index
from quarry.plans.queries import CORPUS, INDEX, ONE_QUERY, QUESTIONS, SCORES, STRIP, WINDOWS, _corpus, _questions, _spans, _table, _vectors, _with
from quarry.sources import files
from quarry.sources.work import Work, filesystem


def _source() -> Column:
    """A Python file made from a document's number: comments, imports, functions, and sometimes a decorated class, other statements or a broken line."""
    c = F.col("doc_id")
    n = c.cast("string")
    head = F.concat(F.lit("# file "), n, F.lit("\nimport os\nx = "), n)
    function = F.concat(F.lit("\n\n# about f\ndef f():\n"), F.repeat(F.lit("    y = 'é'\n"), (c % 150).cast("int")), F.lit("    return "), n)
    other = F.when(c % 3 == 0, "\ny = 2\n\nprint(y)").otherwise("")
    deco = F.when(c % 4 == 1, F.concat(F.lit("\n# first\n@deco\n@other("), n, F.lit(")\nclass K:\n    z = 1"))).otherwise("")
    broken = F.when(c % 5 == 2, "\ndef (:").otherwise("")
    return F.concat(head, function, other, deco, F.lit("\n\n    # tail\n"), broken)


def syntax_units(spark: SparkSession, d: str) -> DataFrame:
    """Python files, by the syntax units they hold; files that don't parse are cut in windows."""
    docs = _table(spark, d, "documents").select(F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("file_path"), _source().alias("content"))
    return _spans(chunking.chunk_documents(docs))


def span_text(spark: SparkSession, d: str) -> DataFrame:
    """A span of each document, stripped; spans may reach over its end."""
    first = (F.col("doc_id") % 97).cast("int")
    cut = T.strip(T.span(F.col("text"), first, first + (F.col("doc_id") % 311).cast("int")))
    return _table(spark, d, "documents").select("doc_id", T.sha256(cut).alias("sha"), T.not_blank(cut).alias("has_text"))


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """What the indexes see of each document, and its citation."""
    path, content = F.col("file_path"), F.col("content")
    return _corpus(spark, d).select("chunk_id", T.sha256(T.lexical_text(path, content)).alias("lexical"), T.sha256(T.embedding_text(path, content)).alias("embedding"), T.citation(path, F.lit(0), F.length("content")).alias("citation"))


def chunk_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Windows numbered by path, part by part, and span."""
    numbered = incremental.number_chunks(chunking.fixed_windows(_corpus(spark, d)), f"{Work(spark, 'numbers').at}/ranges")
    return numbered.select("chunk_id", "file_path", "first_character_index", "last_character_index")


def vector_table(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors written and read again: their number, width and length."""
    v, _ = _vectors(spark, d)
    read = Work(spark, "vectors").save(v, "vectors")
    return read.select(F.col("chunk_id").alias("vec_id"), F.size("embedding").cast("long").alias("width"), F.round(T.dot(F.col("embedding"), F.col("embedding")), 9).alias("norm"))


def mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the turns of a conversation, which are masked by whether they have a text, pooled to one each: here the turn's number and its length."""

    def fn(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for turns in batch.column(1).to_pylist():
                tokens = np.array([[[x["turn"], x["n"]] for x in turns]], float)
                out.append(vectors.mean_pool(tokens, np.array([[x["n"] > 0 for x in turns]], float))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(x[0]) for x in out], pa.float64()), pa.array([float(x[1]) for x in out], pa.float64())], ["conv_id", "turn", "n"])

    turns = _table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))).alias("turns"))
    return turns.mapInArrow(fn, "conv_id long, turn double, n double").select("conv_id", F.round("turn", 6).alias("turn"), F.round("n", 6).alias("n"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's questions with two sources each, made of their number."""
    n = F.col("item_id")
    span = lambda i: F.struct(F.concat(F.lit("f"), ((n + i) % 7).cast("string")).alias("file_path"), (n * i).cast("int").alias("first_character_index"), (n * i + 50).cast("int").alias("last_character_index"))
    return _table(spark, d, "benchmark").select(n.cast("string").alias("question_id"), F.col("text").alias("question"), F.array(span(1), span(2)).alias("sources"), n.alias("pos"))


def json_dataset(spark: SparkSession, d: str) -> DataFrame:
    """A dataset of questions written as one JSON document and read again."""
    at = f"{Work(spark, 'dataset').at}/set"
    listed = _asked(spark, d).agg(F.sort_array(F.collect_list(F.struct("pos", "question_id", "question", "sources"))).alias("r"))
    listed.select(F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in ("question_id", "question", "sources")])).alias("rag_questions")).coalesce(1).write.json(at)
    read = evaluate.usable_truth(files.read_questions(spark, at))
    return read.select("question_id", T.sha256(F.col("question")).alias("sha"), F.col("pos.pos").cast("long").alias("pos"), F.size("sources").cast("long").alias("n_sources"), F.col("sources")[1]["last_character_index"].cast("long").alias("reach"))


def json_results(spark: SparkSession, d: str) -> DataFrame:
    """Results written as one JSON document in one file and read again."""
    path = files.write_results(_asked(spark, d).withColumnRenamed("sources", "retrieved_sources"), files.output_name(Work(spark, "results").at, "x/set.json"), 7)
    read = files.read_results(spark, path)
    return read.select("question_id", T.sha256(F.col("question")).alias("sha"), F.col("pos").cast("long").alias("pos"), F.col("k").cast("long").alias("k"), F.col("retrieved_sources")[0]["file_path"].alias("first_path"), F.col("retrieved_sources")[1]["first_character_index"].cast("long").alias("start"))


def answer_context(spark: SparkSession, d: str) -> DataFrame:
    """The first three of four cited spans of each benchmark item, of documents that may not be there, within a budget."""
    n = F.col("item_id")
    span = lambda i: F.struct(F.concat(F.lit("d/"), (n * i * 3).cast("string")).alias("file_path"), (n % 50 * i).cast("int").alias("first_character_index"), (n % 50 * i + 180).cast("int").alias("last_character_index"))
    cited = _table(spark, d, "benchmark").select(n.cast("string").alias("question_id"), F.array(*map(span, (1, 2, 3, 4))).alias("retrieved_sources"))
    docs = _table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    return context.build_context(cited, docs, 500).select("question_id", T.sha256(F.col("context")).alias("sha"), F.length("context").cast("long").alias("n"))


def nested_results(spark: SparkSession, d: str) -> DataFrame:
    """Ranked hits as lists of sources, one row a question, in order of rank; questions without hits keep an empty list."""
    questions, n = _questions(spark, d), F.col("question_id").cast("long")
    hit = lambda i: F.struct((n * i % 150).alias("chunk_id"), F.lit(4 - i).alias("rank"))
    hits = questions.filter(n % 3 != 0).select("question_id", F.explode(F.array(*map(hit, (1, 2, 3)))).alias("h")).select("question_id", "h.*")
    chunks = _corpus(spark, d).select("chunk_id", "file_path", F.lit(0).alias("first_character_index"), F.length("content").alias("last_character_index"))
    out = evaluate.nest(questions, hits, chunks)
    return out.select("question_id", F.array_join(F.transform("retrieved_sources", lambda x: x["file_path"]), "|").alias("paths"), F.aggregate("retrieved_sources", F.lit(0).cast("long"), lambda a, x: a + x["last_character_index"]).alias("reach"))


KINDS = ("md", "py", "rst", "bin", "txt")


def _make_files(spark: SparkSession, d: str, at: str, more: str = "") -> str:
    """The benchmark, a stated set of a fixed size, as files: Python, Markdown, one kind that isn't read, and some in an ignored directory. The path of their root."""
    fs, root = filesystem(spark, at)
    for r in _table(spark, d, "benchmark").select("item_id", "text").toLocalIterator():
        kind = KINDS[r.item_id % 5]
        text = f'def item_{r.item_id}():\n    return """{r.text}"""\n' if kind == "py" else r.text + (more if r.item_id % 3 == 0 else "")
        out = fs.create(filesystem(spark, f"{at}/{'build' if r.item_id % 11 == 3 else 'src'}/{r.item_id}.{kind}")[1], True)
        out.write(bytearray(text.encode()))
        out.close()
    return root.toUri().getPath()


def _snapshot_chunks(spark: SparkSession, at: str) -> DataFrame:
    found = index.load(spark, at)
    return found.lexical.chunks.join(found.manifest, "file_path").select("chunk_id", "file_path", "first_character_index", "last_character_index", T.sha256(F.col("content")).alias("sha"), "sha256")


def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files scanned, chunked, numbered and indexed: the chunks of the snapshot with the hash of each file."""
    at = Work(spark, "indexed").at
    root = _make_files(spark, d, f"{at}/raw")
    index.index(spark, f"{at}/raw", f"{at}/index", root=root)
    return _snapshot_chunks(spark, f"{at}/index")


def reindexed_files(spark: SparkSession, d: str) -> DataFrame:
    """The same after some files have changed and the index was brought up to date in the same session."""
    at = Work(spark, "reindexed").at
    root = _make_files(spark, d, f"{at}/raw")
    index.index(spark, f"{at}/raw", f"{at}/index", root=root)
    _make_files(spark, d, f"{at}/raw", " and more")
    index.index_incremental(spark, f"{at}/raw", f"{at}/index", root=root)
    return _snapshot_chunks(spark, f"{at}/index")


def searched_files(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's questions over the index of its files, written as results and read again: the best source of each."""
    at = Work(spark, "searched").at
    root = _make_files(spark, d, f"{at}/raw")
    index.index(spark, f"{at}/raw", f"{at}/index", root=root)
    asked = _questions(spark, d).withColumn("pos", F.col("question_id").cast("long"))
    path = files.write_results(index.search_batch(spark, asked, f"{at}/index", 3), f"{at}/out/set.json", 3)
    return files.read_results(spark, path).select("question_id", F.size("retrieved_sources").cast("long").alias("n"), F.col("retrieved_sources")[0]["file_path"].alias("best"))


def reindex_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many files an index update found added, changed, deleted or unchanged: one directory is renamed, some files change."""
    at = Work(spark, "counted").at
    root = _make_files(spark, d, f"{at}/raw")
    index.index(spark, f"{at}/raw", f"{at}/index", root=root)
    _make_files(spark, d, f"{at}/raw", " and more")
    fs, _ = filesystem(spark, at)
    fs.rename(filesystem(spark, f"{at}/raw/src/0.md")[1], filesystem(spark, f"{at}/raw/src/new.md")[1])
    _, counts = index.index_incremental(spark, f"{at}/raw", f"{at}/index", root=root)
    return spark.createDataFrame(sorted(counts.items()), "status string, n long")


def cached_search(spark: SparkSession, d: str) -> DataFrame:
    """One query searched twice, the second time from the cache, and what the cache holds."""
    at = Work(spark, "cached").at
    root = _make_files(spark, d, f"{at}/raw")
    index.index(spark, f"{at}/raw", f"{at}/index", root=root)
    found = [index.search(spark, ONE_QUERY, 4, f"{at}/index", cache_dir=f"{at}/cache") for _ in range(2)]
    rows = [(n + 1, i + 1, s["file_path"], s["last_character_index"]) for n, sources in enumerate(found) for i, s in enumerate(sources)]
    entries = spark.read.parquet(f"{at}/cache").agg(F.count(F.lit(1)).alias("entries"))
    return spark.createDataFrame(rows, "time long, rank long, file_path string, reach long").withColumn("entries", entries.scalar())


def generated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers by a model that tells, behind some thinking, how many sources it was shown; blank questions have a fixed one."""

    def make():
        return lambda messages, most: f"<think>let me see</think> {messages[1]['content'].count('[Source ')} sources, {most} tokens \n"

    n = F.col("item_id")
    span = lambda i: F.struct(F.concat(F.lit("d/"), (n * i * 3).cast("string")).alias("file_path"), F.lit(0).alias("first_character_index"), F.lit(40).alias("last_character_index"))
    results = _table(spark, d, "benchmark").select(n.cast("string").alias("question_id"), F.when(n % 4 == 1, " ").otherwise(F.col("text")).alias("question"), F.array(*map(span, (1, 2, 3, 4))).alias("retrieved_sources"))
    docs = _table(spark, d, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    return generate(results, docs, make).select("question_id", "answer")


def blank_questions(spark: SparkSession, d: str) -> DataFrame:
    """A batch in which some questions are blank or have no term: all keep their row, with so many hits."""
    questions = _questions(spark, d).withColumn("question", F.when(F.col("question_id").cast("long") % 3 == 0, " \n").when(F.col("question_id").cast("long") % 3 == 1, "? !").otherwise(F.col("question")))
    corpus = _corpus(spark, d).withColumn("first_character_index", F.lit(0)).withColumn("last_character_index", F.length("content"))
    hits = Lexical(bm25.build(corpus)).retrieve(questions, 5)
    return evaluate.nest(questions, hits, corpus).select("question_id", F.size("retrieved_sources").cast("long").alias("n"))


# Syntax units by the lengths of the pieces that a file is made of.
SYNTAX = r"""
WITH pieces AS (
  SELECT doc_id, 'p/' || doc_id || '.py' AS file_path, doc_id % 5 = 2 AS broken,
    '# file ' || doc_id || chr(10) || 'import os' || chr(10) || 'x = ' || doc_id AS a,
    chr(10) || chr(10) || '# about f' || chr(10) || 'def f():' || chr(10) || repeat('    y = ''é''' || chr(10), doc_id % 150) || '    return ' || doc_id AS b,
    CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'y = 2' || chr(10) || chr(10) || 'print(y)' ELSE '' END AS c,
    CASE WHEN doc_id % 4 = 1 THEN chr(10) || '# first' || chr(10) || '@deco' || chr(10) || '@other(' || doc_id || ')' || chr(10) || 'class K:' || chr(10) || '    z = 1' ELSE '' END AS d,
    chr(10) || chr(10) || '    # tail' || chr(10) || CASE WHEN doc_id % 5 = 2 THEN chr(10) || 'def (:' ELSE '' END AS e
  FROM documents),
units AS (
  SELECT file_path, 0 AS first, length(a) AS last FROM pieces WHERE NOT broken
  UNION ALL SELECT file_path, length(a), length(a || b) FROM pieces WHERE NOT broken
  UNION ALL SELECT file_path, length(a || b), length(a || b || c) FROM pieces WHERE NOT broken AND c <> ''
  UNION ALL SELECT file_path, length(a || b || c), length(a || b || c || d) FROM pieces WHERE NOT broken AND d <> ''
  UNION ALL SELECT file_path, 0, length(a || b || c || d || e) FROM pieces WHERE broken),
windows AS (
  SELECT file_path, first + i * 650 AS first, least(first + i * 650 + 800, last) AS last
  FROM (SELECT *, unnest(range(CASE WHEN last - first <= 800 THEN 1 ELSE (1 + ceil((last - first - 800) / 650.0))::BIGINT END)) AS i FROM units))
SELECT w.file_path, w.first::INTEGER AS first_character_index, w.last::INTEGER AS last_character_index, sha256(substr(a || b || c || d || e, w.first + 1, w.last - w.first)) AS sha
FROM windows w JOIN pieces p USING (file_path)
"""

CONTEXT = f"""
WITH cited AS (
  SELECT item_id, i AS pos, 'd/' || (item_id * i * 3) AS file_path, substr(d.text, (item_id % 50 * i + 1)::BIGINT, 180) AS cut
  FROM (SELECT item_id FROM benchmark) b, (VALUES (1), (2), (3)) t(i), documents d WHERE d.doc_id = item_id * i * 3),
parts AS (
  SELECT item_id, pos, '[Source ' || pos || ': ' || file_path || ']' || chr(10) || {STRIP.format(x="cut")} || chr(10) AS part
  FROM cited WHERE regexp_matches(cut, '[^\\s\\x1c-\\x1f]')),
used AS (SELECT *, sum(length(part)) OVER (PARTITION BY item_id ORDER BY pos) AS used FROM parts),
joined AS (SELECT item_id, string_agg(part, chr(10) ORDER BY pos) AS context FROM used WHERE used <= 500 GROUP BY item_id)
SELECT item_id::VARCHAR AS question_id, sha256(coalesce(context, '')) AS sha, length(coalesce(context, ''))::BIGINT AS n FROM benchmark LEFT JOIN joined USING (item_id)
"""

ITEMS = """items AS (
  SELECT item_id, (CASE WHEN item_id % 11 = 3 THEN 'build/' ELSE 'src/' END) || item_id || '.' || ['md', 'py', 'rst', 'bin', 'txt'][item_id % 5 + 1] AS file_path,
    CASE WHEN item_id % 5 = 1 THEN 'def item_' || item_id || '():' || chr(10) || '    return ' || repeat(chr(34), 3) || text || repeat(chr(34), 3) || chr(10) ELSE text || {more} END AS content
  FROM benchmark WHERE item_id % 5 <> 3 AND item_id % 11 <> 3)"""

# No item is as long as a window, so a file is one chunk; a Python file's ends before its last line break.
FILES = "WITH " + ITEMS + """
SELECT row_number() OVER (ORDER BY string_split(file_path, '/')) AS chunk_id, file_path, 0 AS first_character_index, (length(content) - (item_id % 5 = 1)::INTEGER)::INTEGER AS last_character_index,
  sha256(substr(content, 1, length(content) - (item_id % 5 = 1)::INTEGER)) AS sha, sha256(content) AS sha256 FROM items
"""

FOUND = _with(
    ITEMS.format(more="''"),
    "chunks AS (SELECT row_number() OVER (ORDER BY string_split(file_path, '/')) AS chunk_id, file_path, substr(content, 1, length(content) - (item_id % 5 = 1)::INTEGER) AS content FROM items)",
    QUESTIONS, INDEX.format(of="chunks"), SCORES,
    "best AS (SELECT question_id, count(*) AS n, min_by(file_path, rank) AS best FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 3 GROUP BY question_id)",
    select="SELECT item_id::VARCHAR AS question_id, coalesce(n, 0) AS n, best FROM benchmark LEFT JOIN best ON question_id = item_id::VARCHAR",
)


def oracle_sql() -> dict[str, str]:
    return {
        "syntax_units": SYNTAX,
        "span_text": f"""SELECT doc_id, sha256(t) AS sha, regexp_matches(coalesce(t, ''), '[^\\s\\x1c-\\x1f]') AS has_text
FROM (SELECT doc_id, {STRIP.format(x="substr(text, doc_id % 97 + 1, doc_id % 311)")} AS t FROM documents)""",
        "prompt_texts": _with(CORPUS, select="SELECT chunk_id, sha256(file_path || ' ' || file_path || ' ' || content) AS lexical, sha256(file_path || ': ' || content) AS embedding, file_path || ' [0:' || length(content) || ']' AS citation FROM corpus"),
        "chunk_numbers": _with(CORPUS, WINDOWS.format(of="corpus"), select="SELECT row_number() OVER (ORDER BY string_split(file_path, '/'), first_character_index) AS chunk_id, file_path, first_character_index, last_character_index FROM windows"),
        "vector_table": "SELECT vec_id, len(embedding) AS width, 1.0::DOUBLE AS norm FROM embeddings",
        "mean_pooling": "SELECT conv_id, coalesce(round(avg(turn) FILTER (WHERE length(text) > 0), 6), 0) AS turn, coalesce(round(avg(length(text)) FILTER (WHERE length(text) > 0), 6), 0) AS n FROM conversations GROUP BY conv_id",
        "json_dataset": "SELECT item_id::VARCHAR AS question_id, sha256(text) AS sha, row_number() OVER (ORDER BY item_id) - 1 AS pos, 2::BIGINT AS n_sources, item_id * 2 + 50 AS reach FROM benchmark",
        "json_results": "SELECT item_id::VARCHAR AS question_id, sha256(text) AS sha, row_number() OVER (ORDER BY item_id) - 1 AS pos, 7::BIGINT AS k, 'f' || ((item_id + 1) % 7) AS first_path, item_id * 2 AS start FROM benchmark",
        "answer_context": CONTEXT,
        "nested_results": _with(
            CORPUS, "hits AS (SELECT item_id::VARCHAR AS question_id, item_id * i % 150 AS chunk_id, 4 - i AS rank FROM benchmark, (VALUES (1), (2), (3)) t(i) WHERE item_id % 3 <> 0)",
            select="SELECT b.item_id::VARCHAR AS question_id, coalesce(string_agg(c.file_path, '|' ORDER BY h.rank), '') AS paths, coalesce(sum(length(c.content)), 0)::BIGINT AS reach FROM benchmark b LEFT JOIN hits h ON h.question_id = b.item_id::VARCHAR LEFT JOIN corpus c ON c.chunk_id = h.chunk_id GROUP BY b.item_id",
        ),
        "indexed_files": FILES.format(more="''"),
        "reindexed_files": FILES.format(more="CASE WHEN item_id % 3 = 0 THEN ' and more' ELSE '' END"),
        "searched_files": FOUND,
        "reindex_counts": """WITH kept AS (SELECT item_id, item_id % 5 <> 1 AND item_id % 3 = 0 AS other FROM benchmark WHERE item_id % 5 <> 3 AND item_id % 11 <> 3)
SELECT CASE WHEN item_id = 0 THEN 'deleted' WHEN other THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS n FROM kept GROUP BY ALL UNION ALL SELECT 'added', 1""",
        "cached_search": _with(
            ITEMS.format(more="''"),
            "chunks AS (SELECT row_number() OVER (ORDER BY string_split(file_path, '/')) AS chunk_id, file_path, substr(content, 1, length(content) - (item_id % 5 = 1)::INTEGER) AS content FROM items)",
            f"questions AS (SELECT 'q' AS question_id, '{ONE_QUERY}' AS question)", INDEX.format(of="chunks"), SCORES,
            select="SELECT time, rank, file_path, length(content) AS reach, 1::BIGINT AS entries FROM ranked JOIN chunks USING (chunk_id), (VALUES (1::BIGINT), (2::BIGINT)) t(time) WHERE rank <= 4",
        ),
        "generated_answers": """SELECT item_id::VARCHAR AS question_id, CASE WHEN item_id % 4 = 1 THEN 'No question provided.' ELSE
  (SELECT count(*) FROM documents d, (VALUES (1), (2), (3)) t(i) WHERE d.doc_id = item_id * i * 3 AND regexp_matches(substr(d.text, 1, 40), '[^\\s\\x1c-\\x1f]')) || ' sources, 256 tokens' END AS answer FROM benchmark""",
        "blank_questions": _with(
            CORPUS, "questions AS (SELECT item_id::VARCHAR AS question_id, CASE item_id % 3 WHEN 0 THEN ' ' WHEN 1 THEN '? !' ELSE text END AS question FROM benchmark)", INDEX.format(of="corpus"), SCORES,
            select="SELECT q.question_id, count(r.chunk_id) AS n FROM questions q LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r USING (question_id) GROUP BY q.question_id",
        ),
    }


def queries() -> dict:
    own = (syntax_units, span_text, prompt_texts, chunk_numbers, vector_table, mean_pooling, json_dataset, json_results, answer_context, nested_results, indexed_files, reindexed_files, searched_files, reindex_counts, cached_search, generated_answers, blank_questions)
    return {f.__name__: f for f in own}
