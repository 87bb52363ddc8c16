import hashlib
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def corpus(seed=0, n=80):
    """Documents with nulls, empty and long texts, exact and near copies, shared passages and repeated lines."""
    rng = random.Random(seed)
    vocabulary = ["al", "be", "Cé", "dü", "ex", "fo", "ga", "HI", "jo", "ka", "lu", "mo", "né", "or", "pi"]
    vocabulary += [a + b for a in vocabulary for b in vocabulary]
    line = "this very line is found in many of the documents"
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = [None, "", " \t\n", "one", "two words", "\n\n", "x" * 50]
    while len(texts) < n:
        kind = rng.random()
        old = rng.choice(texts[7:]) if len(texts) > 8 else None
        text = " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(rng.choice([3, 12, 60, 200])))
        if old and kind < 0.15:
            text = old
        elif old and kind < 0.3:
            text = old + " tail"
        elif kind < 0.45:
            text = passage + " " + text + "\n" + line
        elif kind < 0.6:
            text = text + "\n  " + line.upper() + " \n" + line
        elif kind < 0.65:
            text = "again " * rng.choice([5, 100])
        texts.append(text)
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, rng.choice(["xx", "yy", None]), rng.choice(["a", "b", "é", None, "hot", "hot", "hot"]), len(t or "")) for i, t in zip(ids, texts)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)
