"""The engine's registered queries over the test tables, and the SQL they are held against.

documents stand for the corpus (one Markdown file each), benchmark for questions,
embeddings for vectors. Doubles are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import bm25, chunking, context, evaluate, fusion, incremental, vectors
from quarry.operators.cache import lookup
from quarry.sources.files import supported
from quarry.sources.work import save

K = 10
#: Pairs of a document and words of a text it may hold are broadcast up to so many (some 50 MB); more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000
ONE_QUERY = "the of and thing erble tion"
SYSTEM = "Answer from the context."


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), path.alias("file_path"), F.col("text").alias("content"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return bm25.build(_corpus(spark, d)).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25.retrieve(bm25.build(_corpus(spark, d)), _questions(spark, d), K)
    return hits.select("question_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def bm25_single_query(spark: SparkSession, d: str) -> DataFrame:
    one = spark.createDataFrame([("q", ONE_QUERY)], "question_id string, question string")
    hits = bm25.retrieve(bm25.build(_corpus(spark, d)), one, K)
    return hits.select(F.col("chunk_id").alias("doc_id"), F.round("score", 6).alias("score"))


def _spans(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path", "first_character_index", "last_character_index", T.sha256(F.col("content")).alias("sha"))


def fixed_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _spans(chunking.fixed_windows(_corpus(spark, d)))


def snap_window_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every third sentence ends a paragraph, so that both kinds of breaks are there."""
    docs = _corpus(spark, d).withColumn("content", F.regexp_replace("content", r"(\. [^.]*\. [^.]*)\. ", "$1.\n\n"))
    return _spans(chunking.snap_windows(docs))


def chunk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Files of four extensions; the Python ones don't parse and fall back to windows."""
    kind = F.element_at(F.array(*map(F.lit, (".md", ".PY", ".json", ".txt"))), (F.col("chunk_id") % 4 + 1).cast("int"))
    docs = _corpus(spark, d).withColumn("file_path", F.concat(F.lit("f"), F.col("chunk_id").cast("string"), kind)).withColumn("content", F.concat(F.lit("= "), F.col("content")))
    chunks = chunking.chunk_documents(docs)
    return chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("last_character_index").cast("long").alias("reach"), F.sum("first_character_index").cast("long").alias("starts"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    v = vectors.normalized(v)
    return v, v.filter(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").cast("string").alias("question_id"), "embedding")


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: the vectors whose id is divisible by 100, against all."""
    hits = vectors.cosine_top_k(*_vectors(spark, d), K)
    return hits.select("question_id", F.col("chunk_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = _table(spark, d, "embeddings").select("vec_id", F.posexplode(T.l2_normalize(F.col("embedding"))).alias("dim", "x"))
    return v.select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    """A question's vector is that of its number, a document's that of its id."""
    questions = _questions(spark, d)
    lexical = bm25.retrieve(bm25.build(_corpus(spark, d)), questions, fusion.CANDIDATES)
    v, _ = _vectors(spark, d)
    asked = v.select(F.col("chunk_id").cast("string").alias("question_id"), "embedding").join(questions.select("question_id"), "question_id", "left_semi")
    fused = fusion.fuse(lexical, vectors.cosine_top_k(v, asked, fusion.CANDIDATES), K)
    return fused.select("question_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the documents that hold a benchmark text word for word.

    A document that holds a text has the second to fourth of its words, split at
    spaces, too. Documents meet the texts on those, by hash; what meets is compared in
    full. Texts of fewer than five words, of which there are few, meet all documents.
    Which documents have which of those words is saved without any text, and broadcast
    up to a checked number, so that no document is shuffled.
    """
    questions, corpus = _questions(spark, d).withColumn("w", F.split("question", " ")), _corpus(spark, d)
    seeds = questions.filter(F.size("w") >= 5).select("question_id", "question", F.xxhash64(*[F.get("w", F.lit(i)) for i in (1, 2, 3)]).alias("seed"))
    w = F.split("content", " ")
    threes = corpus.select("chunk_id", F.explode(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.size(w)).alias("b"), F.slice(w, 3, F.size(w)).alias("c"))).alias("t"))
    met = threes.select("chunk_id", F.xxhash64("t.a", "t.b", "t.c").alias("seed")).join(seeds.select("seed"), "seed", "left_semi").distinct()
    met = save(met, "met")
    met = F.broadcast(met) if met.count() <= BROADCAST_PAIRS else met
    held = F.expr("contains(content, question)")
    hits = corpus.join(met, "chunk_id").join(seeds, "seed").filter(held).select("question_id", "question", "file_path", "content")
    short = corpus.join(questions.filter(F.size("w") < 5), held).select("question_id", "question", "file_path", "content")
    hits = hits.unionByName(short).withColumn("at", F.expr("locate(question, content)"))
    return hits.select("question_id", "question", "file_path", (F.col("at") - 1).cast("int").alias("first_character_index"), (F.col("at") - 1 + F.length("question")).cast("int").alias("last_character_index"))


def iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each true span with each window of its document."""
    t = _truth(spark, d).alias("t")
    w = chunking.fixed_windows(_corpus(spark, d)).alias("w")
    col = lambda x: (F.col(f"{x}.file_path"), F.col(f"{x}.first_character_index"), F.col(f"{x}.last_character_index"))
    pairs = t.join(w, F.col("t.file_path") == F.col("w.file_path"))
    return pairs.select("t.question_id", "t.file_path", F.col("w.first_character_index").alias("window_start"), F.round(T.span_iou(*col("t"), *col("w")), 6).alias("iou"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """End to end: windows, their index, the questions' top 10, and recall against the true spans."""
    chunks = chunking.fixed_windows(_corpus(spark, d)).withColumn("chunk_id", F.split_part("file_path", F.lit("/"), F.lit(3)).substr(F.lit(1), F.length(F.split_part("file_path", F.lit("/"), F.lit(3))) - 3).cast("long") * 100000 + F.col("first_character_index") / 650).withColumn("chunk_id", F.col("chunk_id").cast("long"))
    questions = _questions(spark, d)
    hits = bm25.retrieve(bm25.build(chunks), questions, K)
    results = evaluate.nest(questions, hits, chunks)
    spans = _truth(spark, d).groupBy("question_id", "question").agg(F.collect_list(F.struct("file_path", "first_character_index", "last_character_index")).alias("sources"))
    r = evaluate.recall_at_k(spans, results)
    return r.select(F.col("k").cast("long").alias("k"), F.round("recall", 6).alias("recall"))


def _manifests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An older and a newer state of the corpus, simulated: some files missing on either side, some changed."""
    docs = _corpus(spark, d)
    was = docs.filter("chunk_id % 10 <> 3").withColumn("content", F.when(F.col("chunk_id") % 7 == 0, F.concat("content", F.lit(" old"))).otherwise(F.col("content")))
    return was, docs.filter("chunk_id % 11 <> 5")


def manifest_delta(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("file_path", T.sha256(F.col("content")).alias("sha256")) for x in _manifests(spark, d))
    return incremental.manifest_delta(old, new)


def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _manifests(spark, d)
    delta = incremental.manifest_delta(*(x.select("file_path", T.sha256(F.col("content")).alias("sha256")) for x in (old, new)))
    return _spans(incremental.merge_chunks(chunking.fixed_windows(old), chunking.fixed_windows(new), delta))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Context of each conversation: its turns are sources of a file each, as many as the budget holds."""
    turns = _table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("question_id"), F.col("turn").alias("pos"), F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("file_path"), T.strip(F.coalesce("text", F.lit(""))).alias("text"))
    rows = turns.filter(T.not_blank(F.col("text"))).select("question_id", "pos", T.context_part(F.col("pos"), F.col("file_path"), F.col("text")).alias("part"))
    own = context.within_budget(rows, 600)
    out = own.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda r: r["part"]), "\n").alias("context"), F.count(F.lit(1)).alias("n_parts"))
    return out.select("question_id", "n_parts", T.sha256(F.col("context")).alias("sha"))


def clean_output(spark: SparkSession, d: str) -> DataFrame:
    """Conversation texts with tags set around and into them."""
    raw = F.concat(F.lit("<think>plan\nmore</think> <think>x</think>\n"), F.coalesce("text", F.lit("")), F.lit("</think> <think>left"))
    return _table(spark, d, "conversations").select("conv_id", "turn", T.sha256(T.clean_answer(raw)).alias("sha"))


def chat_messages(spark: SparkSession, d: str) -> DataFrame:
    m = _table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.chat_messages(F.coalesce("text", F.lit("")), F.col("role"), SYSTEM)).alias("pos", "m"))
    return m.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "m.role", T.sha256(F.col("m.content")).alias("sha"))


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Even questions are in the cache, each with an empty list."""
    asked = _table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    params = {"index_dir": "idx", "k": 5}
    kept = asked.filter("item_id % 2 = 0").select(T.cache_key("search", F.col("query"), params).alias("cache_key"), F.array().cast("array<string>").alias("sources")).distinct()
    return lookup(asked, kept, "search", params).select("item_id", "cache_key", "hit")


def file_filter(spark: SparkSession, d: str) -> DataFrame:
    """Paths made from pages' urls: what would be read?"""
    ext = F.element_at(F.array(*map(F.lit, (".MD", ".html", "", ".tar.py", ".egg-info"))), (F.col("page_id") % 5 + 1).cast("int"))
    part = F.element_at(F.array(*map(F.lit, ("src", "build", "rebuild", ".git", "x.egg-info", "egg-info", "docs"))), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(F.lit("/root/"), part, F.lit("/"), F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+://|[?#].*$", ""), ext)
    return _table(spark, d, "pages").select("page_id", path.alias("path"), supported(path).alias("kept"))


def dedupe_results(spark: SparkSession, d: str) -> DataFrame:
    """The last turn of each role in a conversation."""
    rows = _table(spark, d, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), "role").alias("question_id"), F.col("turn").alias("pos"), F.length("text").cast("long").alias("n"))
    return evaluate.dedupe_results(rows)


TOKENS = r"""flatten(list_transform(list_filter(list_transform(string_split_regex(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^a-zA-Z0-9_]+'), lambda w: lower(trim(w, '_'))), lambda w: length(w) > 1),
  lambda w: CASE WHEN contains(w, '_') THEN list_concat([w], list_filter(string_split(w, '_'), lambda p: length(p) > 1)) ELSE [w] END))"""

CORPUS = "corpus AS (SELECT doc_id AS chunk_id, 'corpus/' || source || '/' || doc_id || '.md' AS file_path, text AS content FROM documents)"

WINDOWS = """windows AS (
  SELECT chunk_id AS doc_id, file_path, (i * 650)::INTEGER AS first_character_index, least(i * 650 + 800, length(content))::INTEGER AS last_character_index,
    substr(content, i * 650 + 1, (least(i * 650 + 800, length(content)) - i * 650)::BIGINT) AS content
  FROM (SELECT *, unnest(range(CASE WHEN length(content) <= 800 THEN 1 ELSE (1 + ceil((length(content) - 800) / 650.0))::BIGINT END)) AS i FROM {of}))"""

INDEX = """bags AS (SELECT chunk_id, """ + TOKENS.format(x="file_path || ' ' || file_path || ' ' || content") + """ AS t FROM {of}),
postings AS (SELECT chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM bags) GROUP BY chunk_id, term),
corpus_stats AS (SELECT (SELECT count(*) FROM {of}) AS n, (SELECT sum(tf) FROM postings) / (SELECT count(*) FROM {of}) AS avgdl),
raw_terms AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus_stats),
terms AS (SELECT term, df, CASE WHEN raw >= 0 THEN raw ELSE 0.25 * (SELECT avg(raw) FROM raw_terms) END AS idf FROM raw_terms)"""

SCORES = """asked AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(""" + TOKENS.format(x="question") + """) AS term FROM questions) GROUP BY question_id, term),
scores AS (
  SELECT question_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN terms USING (term) JOIN postings USING (term), corpus_stats GROUP BY question_id, chunk_id HAVING score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scores)"""

QUESTIONS = "questions AS (SELECT item_id::VARCHAR AS question_id, text AS question FROM benchmark)"
NORMAL = "unit AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
TRUTH = "truth AS (SELECT question_id, question, file_path, (instr(content, question) - 1)::INTEGER AS first_character_index, (instr(content, question) - 1 + length(question))::INTEGER AS last_character_index FROM corpus JOIN questions ON contains(content, question))"
STATES = """old AS (SELECT chunk_id, file_path, CASE WHEN chunk_id % 7 = 0 THEN content || ' old' ELSE content END AS content FROM corpus WHERE chunk_id % 10 <> 3),
new AS (SELECT * FROM corpus WHERE chunk_id % 11 <> 5),
delta AS (SELECT file_path, CASE WHEN o.content IS NULL THEN 'added' WHEN n.content IS NULL THEN 'deleted' WHEN sha256(o.content) <> sha256(n.content) THEN 'changed' ELSE 'unchanged' END AS status FROM old o FULL JOIN new n USING (file_path))"""
HULL = "CASE WHEN least(t.last_character_index, w.last_character_index) > greatest(t.first_character_index, w.first_character_index) THEN (least(t.last_character_index, w.last_character_index) - greatest(t.first_character_index, w.first_character_index)) / (greatest(t.last_character_index, w.last_character_index) - least(t.first_character_index, w.first_character_index))::DOUBLE ELSE 0.0 END"
STRIP = r"regexp_replace({x}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"

SNAP = r"""
WITH RECURSIVE files AS (
  SELECT 'corpus/' || source || '/' || doc_id || '.md' AS file_path, regexp_replace(text, '(\. [^.]*\. [^.]*)\. ', '\1.' || chr(10) || chr(10), 'g') AS content FROM documents),
walk(file_path, start, finish) AS (
  SELECT file_path, 0::BIGINT, NULL::BIGINT FROM files
  UNION ALL
  SELECT file_path, CASE WHEN e >= n THEN -1 ELSE start + greatest(1, e - start - 150) END, e FROM (
    SELECT file_path, start, n, CASE WHEN stop >= n THEN stop
      WHEN p > 0 AND length(w) - p - 1 > 400 THEN start + length(w) - p + 1
      WHEN q > 0 AND length(w) - q > 400 THEN start + length(w) - q + 1 ELSE stop END AS e
    FROM (SELECT *, instr(reverse(w), chr(10) || chr(10)) AS p, instr(reverse(w), chr(10)) AS q FROM (
      SELECT k.file_path, k.start, length(f.content) AS n, least(k.start + 800, length(f.content)) AS stop, substr(f.content, k.start + 1, least(800, length(f.content) - k.start)) AS w
      FROM walk k JOIN files f USING (file_path) WHERE k.start >= 0)))),
spans AS (
  SELECT file_path, finish AS last, lag(start) OVER (PARTITION BY file_path ORDER BY CASE WHEN start < 0 THEN 1e18 ELSE start END) AS first FROM walk)
SELECT s.file_path, s.first::INTEGER AS first_character_index, s.last::INTEGER AS last_character_index, sha256(substr(f.content, s.first + 1, s.last - s.first)) AS sha
FROM spans s JOIN files f USING (file_path) WHERE s.first IS NOT NULL AND regexp_matches(substr(f.content, s.first + 1, s.last - s.first), '[^\s]')
"""


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def oracle_sql() -> dict[str, str]:
    index = INDEX.format(of="corpus")
    spans = "file_path, first_character_index, last_character_index, sha256(content) AS sha"
    cosine = "near AS (SELECT q.vec_id::VARCHAR AS question_id, u.vec_id AS chunk_id, round(list_inner_product(q.v, u.v), 9) AS score FROM unit q, unit u WHERE {which}), semantic AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM near)"
    return {
        "tokenize_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, {TOKENS.format(x='text')} AS t FROM documents)",
        "term_stats": _with(CORPUS, index, select="SELECT term, df, round(idf, 6) AS idf FROM terms"),
        "bm25_topk": _with(CORPUS, QUESTIONS, index, SCORES, select="SELECT question_id, chunk_id AS doc_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10"),
        "bm25_single_query": _with(CORPUS, f"questions AS (SELECT 'q' AS question_id, '{ONE_QUERY}' AS question)", index, SCORES, select="SELECT chunk_id AS doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10"),
        "fixed_window_chunks": _with(CORPUS, WINDOWS.format(of="corpus"), select=f"SELECT {spans} FROM windows"),
        "snap_window_chunks": SNAP,
        "cosine_topk": _with(NORMAL, cosine.format(which="q.vec_id % 100 = 0"), select="SELECT question_id, chunk_id AS vec_id, rank, round(score, 6) AS score FROM semantic WHERE rank <= 10"),
        "l2_normalize": _with(NORMAL, select="SELECT vec_id, unnest(range(len(v))) AS dim, round(unnest(v), 6) AS x FROM unit"),
        "rrf_topk": _with(
            CORPUS, QUESTIONS, index, SCORES, NORMAL, cosine.format(which="q.vec_id IN (SELECT item_id FROM benchmark)"),
            "fused AS (SELECT coalesce(l.question_id, s.question_id) AS question_id, coalesce(l.chunk_id, s.chunk_id) AS doc_id, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS score, l.rank AS lr, s.rank AS sr FROM (SELECT * FROM ranked WHERE rank <= 50) l FULL JOIN (SELECT * FROM semantic WHERE rank <= 50) s ON l.question_id = s.question_id AND l.chunk_id = s.chunk_id)",
            "final AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, lr NULLS LAST, sr) AS rank FROM fused)",
            select="SELECT question_id, doc_id, rank, round(score, 6)::DOUBLE AS score FROM final WHERE rank <= 10",
        ),
        "iou_pairs": _with(CORPUS, QUESTIONS, TRUTH, WINDOWS.format(of="corpus"), select=f"SELECT t.question_id, t.file_path, w.first_character_index AS window_start, round({HULL}, 6) AS iou FROM truth t JOIN windows w USING (file_path)"),
        "recall_at_k": _with(
            CORPUS, QUESTIONS, TRUTH, WINDOWS.format(of="corpus"),
            "chunks AS (SELECT doc_id * 100000 + first_character_index // 650 AS chunk_id, file_path, content, first_character_index, last_character_index FROM windows)",
            INDEX.format(of="chunks"), SCORES,
            f"found AS (SELECT t.question_id, t.file_path, min(CASE WHEN {HULL} >= 0.05 THEN w.rank END) AS best FROM truth t LEFT JOIN (SELECT question_id, rank, file_path, first_character_index, last_character_index FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 10) w ON t.question_id = w.question_id AND t.file_path = w.file_path GROUP BY t.question_id, t.file_path)",
            "per AS (SELECT k, question_id, avg(CASE WHEN best <= k THEN 1.0 ELSE 0.0 END) AS r FROM found, (VALUES (1), (3), (5), (10)) ks(k) GROUP BY k, question_id)",
            select="SELECT k::BIGINT AS k, round(avg(r), 6) AS recall FROM per GROUP BY k",
        ),
        "chunk_dispatch": r"""
WITH RECURSIVE files AS (SELECT 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.PY' WHEN 2 THEN '.json' ELSE '.txt' END AS file_path, doc_id % 4 = 1 AS py, '= ' || text AS content FROM documents),
walk(file_path, start, first, last) AS (
  SELECT file_path, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM files
  UNION ALL
  SELECT file_path, CASE WHEN e >= n THEN -1 ELSE start + greatest(1, e - start - 150) END, start, e FROM (
    SELECT file_path, start, n, CASE WHEN stop >= n THEN stop WHEN NOT py AND q > 0 AND length(w) - q > 400 AND NOT (p > 0 AND length(w) - p - 1 > 400) THEN start + length(w) - q + 1
      WHEN NOT py AND p > 0 AND length(w) - p - 1 > 400 THEN start + length(w) - p + 1 ELSE stop END AS e
    FROM (SELECT *, instr(reverse(w), chr(10)) AS q, instr(reverse(w), chr(10) || chr(10)) AS p FROM (
      SELECT k.file_path, f.py, k.start, length(f.content) AS n, least(k.start + 800, length(f.content)) AS stop, substr(f.content, k.start + 1, least(800, length(f.content) - k.start)) AS w
      FROM walk k JOIN files f USING (file_path) WHERE k.start >= 0))))
SELECT file_path, count(*) AS n_chunks, max(last)::BIGINT AS reach, sum(first)::BIGINT AS starts FROM walk JOIN files f USING (file_path) WHERE first IS NOT NULL AND regexp_matches(substr(f.content, first + 1, last - first), '[^\s]') GROUP BY file_path
""",
        "manifest_delta": _with(CORPUS, STATES, select="SELECT file_path, status FROM delta"),
        "incremental_merge": _with(
            CORPUS, STATES, WINDOWS.format(of="old").replace("windows AS", "old_windows AS"), WINDOWS.format(of="new").replace("windows AS", "new_windows AS"),
            select=f"SELECT {spans} FROM old_windows WHERE file_path IN (SELECT file_path FROM delta WHERE status = 'unchanged') UNION ALL SELECT {spans} FROM new_windows WHERE file_path IN (SELECT file_path FROM delta WHERE status IN ('added', 'changed'))",
        ),
        "context_budget": f"""
WITH parts AS (
  SELECT conv_id::VARCHAR AS question_id, turn, '[Source ' || turn || ': conv/' || conv_id || '/' || turn || ']' || chr(10) || {STRIP.format(x="coalesce(text, '')")} || chr(10) AS part
  FROM conversations WHERE regexp_matches(coalesce(text, ''), '[^\\s]')),
used AS (SELECT *, sum(length(part)) OVER (PARTITION BY question_id ORDER BY turn) AS used FROM parts)
SELECT question_id, count(*) AS n_parts, sha256(string_agg(part, chr(10) ORDER BY turn)) AS sha FROM used WHERE used <= 600 GROUP BY question_id
""",
        "clean_output": f"""SELECT conv_id, turn, sha256({STRIP.format(x="regexp_replace(regexp_replace(substr(raw, instr(raw, '</think>') + 8), '<think>.*?</think>', '', 'gs'), '</?think>', '', 'g')")}) AS sha
FROM (SELECT conv_id, turn, '<think>plan' || chr(10) || 'more</think> <think>x</think>' || chr(10) || coalesce(text, '') || '</think> <think>left' AS raw FROM conversations)""",
        "chat_messages": f"""SELECT conv_id, turn, 0::BIGINT AS pos, 'system' AS role, sha256('{SYSTEM}') AS sha FROM conversations
UNION ALL SELECT conv_id, turn, 1::BIGINT, 'user', sha256('Context:' || chr(10) || role || chr(10) || chr(10) || 'Question: ' || coalesce(text, '') || chr(10) || chr(10) || 'Direct Answer:') FROM conversations""",
        "cache_lookup": """WITH keyed AS (SELECT item_id, sha256('search:' || text || ':[(''index_dir'', ''idx''), (''k'', 5)]') AS cache_key FROM benchmark)
SELECT item_id, cache_key, cache_key IN (SELECT cache_key FROM keyed WHERE item_id % 2 = 0) AS hit FROM keyed""",
        "file_filter": r"""
WITH paths AS (SELECT page_id, '/root/' || ['src', 'build', 'rebuild', '.git', 'x.egg-info', 'egg-info', 'docs'][page_id % 7 + 1] || '/' || regexp_replace(coalesce(url, ''), '^[a-z]+://|[?#].*$', '', 'g') || ['.MD', '.html', '', '.tar.py', '.egg-info'][page_id % 5 + 1] AS path FROM pages)
SELECT page_id, path, NOT list_has_any(string_split(path, '/'), ['.git', '__pycache__', '.mypy_cache', '.pytest_cache', 'venv', '.venv', 'build', 'dist', 'egg-info'])
  AND lower(regexp_extract(string_split(path, '/')[-1], '.(\.[^.]+)$', 1)) IN ('.py', '.md', '.markdown', '.txt', '.rst', '.json', '.yaml', '.yml', '.toml', '.c', '.cpp', '.h', '.hpp', '.cu') AS kept FROM paths""",
        "dedupe_results": "SELECT conv_id || ':' || role AS question_id, max(turn) AS pos, max_by(length(text), turn)::BIGINT AS n FROM conversations GROUP BY conv_id, role",
    }


def queries() -> dict:
    own = (tokenize_counts, term_stats, bm25_topk, bm25_single_query, fixed_window_chunks, snap_window_chunks, chunk_dispatch, cosine_topk, l2_normalize, rrf_topk, iou_pairs, recall_at_k, manifest_delta, incremental_merge, context_budget, clean_output, chat_messages, cache_lookup, file_filter, dedupe_results)
    return {f.__name__: f for f in own}
