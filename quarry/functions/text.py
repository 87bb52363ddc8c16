"""Column functions over text: tokens, white space, spans, prompts and hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.isspace has it, as a Java character class.
SPACE = r"\s\x1c-\x1f"
NOT_BLANK = rf"(?U)[^{SPACE}]"

# Tokens break at these, and prompts are worded so.
CAMEL = "([a-z0-9])([A-Z])"
BREAK = "[^a-zA-Z0-9_]+"


def tokens(text: Column) -> Column:
    """Lower-case ASCII identifiers and words of more than one character; camelCase is split, snake_case kept and split; duplicates stay."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), CAMEL, "$1 $2"), BREAK)
    words = F.filter(F.transform(words, lambda w: F.lower(F.trim(w, F.lit("_")))), lambda w: F.length(w) > 1)
    parts = lambda w: F.filter(F.split(w, "_"), lambda p: F.length(p) > 1)
    return F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit("_")), F.concat(F.array(w), parts(w))).otherwise(F.array(w))))


_CAMEL, _WORD = re.compile(CAMEL), re.compile("[a-zA-Z0-9_]+")


def token_list(text: str) -> list[str]:
    """The tokens of a text, for workers."""
    out = []
    for word in _WORD.findall(_CAMEL.sub(r"\1 \2", text)):
        word = word.strip("_").lower()
        if len(word) > 1:
            out.append(word)
            if "_" in word:
                out += [part for part in word.split("_") if len(part) > 1]
    return out


def not_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(NOT_BLANK)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")


def span(text: Column, first: Column, last: Column) -> Column:
    """Characters [first, last) of a text."""
    return F.substring(text, first + 1, last - first)


def lexical_text(path: Column, content: Column) -> Column:
    """What the lexical index sees of a chunk: its path twice, then its content."""
    return F.concat_ws(" ", path, path, content)


def embedding_text(path: Column, content: Column) -> Column:
    return F.concat(path, F.lit(": "), content)


def citation(path: Column, first: Column, last: Column) -> Column:
    return F.concat(path, F.lit(" ["), first, F.lit(":"), last, F.lit("]"))


def span_iou(path_a: Column, first_a: Column, last_a: Column, path_b: Column, first_b: Column, last_b: Column) -> Column:
    """Overlap of two spans over the span that holds both; 0 in different files."""
    overlap = F.greatest(F.lit(0), F.least(last_a, last_b) - F.greatest(first_a, first_b))
    hull = F.greatest(last_a, last_b) - F.least(first_a, first_b)
    return F.when((path_a == path_b) & (overlap > 0), overlap / hull).otherwise(F.lit(0.0))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(namespace: str, query: Column, params: dict[str, object], snapshot: str = "") -> Column:
    """Hash of namespace, query and parameters in order of name; a snapshot id makes entries of an older index misses."""
    shown = repr(sorted(params.items()))
    tail = f":{shown}" + (f":{snapshot}" if snapshot else "")
    return sha256(F.concat(F.lit(f"{namespace}:"), query, F.lit(tail)))


def context_part(number: Column, path: Column, text: Column) -> Column:
    return F.concat(F.lit("[Source "), number.cast("string"), F.lit(": "), path, F.lit("]\n"), text, F.lit("\n"))


def chat_messages(question: Column, context: Column, system: str) -> Column:
    """System and user message, an array of (role, content)."""
    user = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nDirect Answer:"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def clean_answer(text: Column) -> Column:
    """A model's answer without its thinking: what follows the first closing tag, less other tags, stripped."""
    text = F.regexp_replace(text, r"(?s)\A.*?</think>", "")
    text = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return strip(F.regexp_replace(text, r"</?think>", ""))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector in doubles; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))
