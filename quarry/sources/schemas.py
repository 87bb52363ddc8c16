"""Schemas of the tables and of the JSON documents that are read and written."""

from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("first_character_index", T.IntegerType()), T.StructField("last_character_index", T.IntegerType())])
QUESTION = T.StructType([T.StructField("question_id", T.StringType()), T.StructField("question", T.StringType())])
ANSWERED_QUESTION = T.StructType([*QUESTION, T.StructField("sources", T.ArrayType(SOURCE)), T.StructField("answer", T.StringType())])
DATASET = T.StructType([T.StructField("rag_questions", T.ArrayType(ANSWERED_QUESTION))])
RESULT = T.StructType([*QUESTION, T.StructField("retrieved_sources", T.ArrayType(SOURCE))])
ANSWER = T.StructType([*RESULT, T.StructField("answer", T.StringType())])
RESULTS = T.StructType([T.StructField("search_results", T.ArrayType(RESULT)), T.StructField("k", T.IntegerType())])
ANSWERS = T.StructType([T.StructField("search_results", T.ArrayType(ANSWER)), T.StructField("k", T.IntegerType())])

DOCUMENTS = "file_path string, content string"
CHUNKS = "chunk_id long, file_path string, first_character_index int, last_character_index int, content string"
MANIFEST = "file_path string, sha256 string"
HITS = "question_id string, chunk_id long, score double, rank int"
CACHE = "cache_key string, sources array<struct<file_path:string,first_character_index:int,last_character_index:int>>"
