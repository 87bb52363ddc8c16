import math
import random
import zlib
from collections import Counter

import numpy as np

from quarry.llm.langid import counted, fit, identify, infer, trigrams
from tests.llm.helpers import frame

SYLLABLES = {"xx": ["the", "an", "ing", "er", "ou"], "yy": ["ung", "der", "ich", "ei", "ü"], "zz": ["eau", "que", "é", "ch", "on"]}


def text(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(n=300):
    rng = random.Random(3)
    return [(i, text(rng, lang := rng.choice("xyz") * 2), lang, "s", 0) for i in range(n)]


def test_held_out_accuracy(spark):
    data = rows()
    out = {r.doc_id: r for r in identify(frame(spark, data)).collect()}
    for i, t, lang, _, _ in data:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= out[i].score <= 1
    held = [(out[r[0]].lang_pred, r[2]) for r in data if out[r[0]].held_out]
    assert np.mean([a == b for a, b in held]) > 0.98


def test_mixture_proportions(spark):
    langs, log_p = fit(frame(spark, rows()))
    rng = random.Random(5)
    both = text(rng, "xx", 300) + " " + text(rng, "zz", 100)
    docs = [counted(trigrams(np.frombuffer(t.encode(), np.uint8))) for t in (both, text(rng, "yy", 200))]
    theta, _ = infer(docs, log_p)
    assert langs == ["xx", "yy", "zz"]
    assert theta[0, 1] == 0 and 0.15 < theta[0, 2] < 0.4
    assert theta[1].tolist() == [0, 1, 0]


def test_edges(spark):
    data = rows(60) + [(900, None, "xx", None, 0), (901, "", "xx", None, 0), (902, "12 34 --", "yy", None, 0), (903, "é", None, None, 0), (None, "the thing", "qq", None, 0)]
    out = {r.doc_id: r for r in identify(frame(spark, data).selectExpr("*", "1 AS code", "2 AS score")).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[900].score == 0
    assert out[903].lang_pred == "zz" and out[None].lang_pred == "xx" and not out[None].held_out
    assert identify(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in identify(frame(spark, [(1, "abc", None, None, 0)])).collect()} == {"und"}


def code(three):
    """The table's entry for three bytes."""
    x = (three[0] << 16 | three[1] << 8 | three[2]) * 0x9E3779B1 & 0xFFFFFFFF
    return (x ^ x >> 15) >> 16


def codes(text, ends):
    clean = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in text.lower().encode())
    clean = b" " + clean + b" " if ends else clean
    return Counter(code(clean[i : i + 3]) for i in range(len(clean) - 2))


def em(p, n, k, rounds):
    """Proportions and log likelihood of counts n whose likelihoods are p[code][language], by plain loops."""
    theta, total = [1 / k] * k, sum(n.values())
    for _ in range(rounds):
        new = [0.0] * k
        for c, m in n.items():
            mass = sum(p[c][i] * theta[i] for i in range(k))
            for i in range(k):
                new[i] += m * p[c][i] * theta[i] / mass
        theta = [x / total for x in new]
    return theta, sum(m * math.log(sum(p[c][i] * theta[i] for i in range(k))) for c, m in n.items())


def brute(data, text):
    """Prediction, score and shares of one text."""
    langs = sorted({r[2] for r in data})
    table = {lang: Counter() for lang in langs}
    for i, t, lang, _, _ in data:
        if zlib.crc32(str(i).encode()) % 3 != 1 and len(t.encode()) >= 3:
            table[lang].update(codes(t, False))
    of = lambda c: [math.log((table[x][c] + 0.1) / (sum(table[x].values()) + 0.1 * 65536)) for x in langs]
    n = codes(text, True)
    logs = {c: of(c) for c in n}
    top = {c: max(v) for c, v in logs.items()}
    single = [sum(m * (logs[c][i] - top[c]) for c, m in n.items()) for i in range(len(langs))]
    best = max(range(len(langs)), key=lambda i: (single[i], -i))
    sure = 1 / sum(math.exp((x - single[best]) / 3) for x in single)
    p = {c: [math.exp(x - top[c]) for x in v] for c, v in logs.items()}
    theta, full = em(p, n, len(langs), 8)
    penalty = 1.5 * math.log(sum(n.values()))
    chosen, value = {best: 1.0}, single[best]
    if full - value > penalty:
        order = [best, *sorted((i for i in range(len(langs)) if i != best), key=lambda i: (-theta[i], i))]
        for k in range(2, len(langs) + 1):
            t, v = em({c: [x[i] for i in order[:k]] for c, x in p.items()}, n, k, 16)
            if v - value <= penalty:
                break
            chosen, value = dict(zip(order, t)), v
    lead = max(sorted(chosen), key=lambda i: (chosen[i], -i))
    return langs[lead], chosen[lead] * sure, {langs[i]: x for i, x in chosen.items()}


def test_like_brute_force(spark):
    data = rows(90)
    rng = random.Random(6)
    more = [text(rng, "xx", a) + " " + text(rng, "zz", b) + " " + text(rng, "yy", c) for a, b, c in ((40, 20, 0), (10, 10, 10), (60, 3, 1), (1, 0, 0), (5, 5, 0), (80, 40, 30))]
    asked = [(1000 + i, t, None, "s", 0) for i, t in enumerate([*more, "ab", "É", "the 123 ÜBER"])]
    out = {r.doc_id: r for r in identify(frame(spark, data + asked)).collect()}
    several = 0
    for i, t, *_ in data[:20] + asked:
        lang, score, shares = brute(data, t)
        r = out[i]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, (i, r, score)
        got = {x.split(":")[0]: float(x.split(":")[1]) for x in r.shares.split(",")}
        assert all(abs(got.get(k, 0) - v) < 2e-3 for k, v in shares.items()) and set(got) <= set(shares)
        several += len(shares) > 1
    assert several >= 3


def test_a_very_long_text(spark):
    rng = random.Random(7)
    data = rows(120) + [(900, text(rng, "yy", 1000) * 200, None, "s", 0)]
    assert {r.doc_id: r.lang_pred for r in identify(frame(spark, data)).collect()}[900] == "yy"
