import base64
import math
from collections import Counter

import numpy as np

from quarry.llm.common import _byte_hash
from quarry.llm.digest import LONG, _rarity, digests, feature_hashes, filters, likeness
from tests.llm.helpers import corpus, frame, sha


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""), reverse=True)
    out = []
    for i, r in enumerate(order):
        a, b = r[1] or "", order[(i + 1) % len(order)][1] or ""
        out.append((r[0], len(a), sha(a[: len(a) - len(a) // 2] + b[: len(a) // 2])))
    return sorted(out, key=repr)


def check(spark, rows, **kw):
    out = digests(frame(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in out], key=repr) == edited(rows)
    assert all(0 <= x <= 1 for r in out for x in (r.near_edited, r.near_next))
    return out


def test_neighbours_and_fingerprints(spark):
    rows = corpus(8, 120)
    out = check(spark, rows)
    text = {r[0]: r[1] or "" for r in rows}
    prints = {}
    for r in out:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in out if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long if r.near_next < 0.9]) > 0.9


def test_across_blocks(spark, monkeypatch):
    import quarry.llm.digest as m

    rows = corpus(9, 60)
    want = sorted(map(repr, digests(frame(spark, rows)).collect()))
    cut = m.cut_points
    monkeypatch.setattr(m, "cut_points", lambda df: cut(df, 10_000))
    assert sorted(map(repr, check(spark, rows))) == want


def test_null_repeats_single_and_empty(spark):
    check(spark, [(None, "abc", None, None, 0), (None, None, None, None, 0), (4, "né" * 40, None, None, 0), (4, "né" * 40, None, None, 0)])
    check(spark, [(1, "alone here", None, None, 0)])
    assert digests(frame(spark, []).selectExpr("*", "1 AS block", "true AS guest")).count() == 0


def test_entropy_is_exact():
    raw = np.random.default_rng(0).integers(97, 110, 300).astype(np.uint8)
    w, _, typical, _ = LONG
    for i, x in enumerate(_rarity(raw, LONG)):
        c = np.bincount(raw[i : i + w])
        e = -sum(n / w * math.log2(n / w) for n in c if n)
        assert abs(abs(e - typical) - x / 65536 / w) < 1e-3


def test_likeness_of_copies_and_strangers():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 117, 9000).astype(np.uint8)) for _ in range(2)]
    a, b, half = map(filters, feature_hashes([*texts, texts[0][:4500] + texts[1][:4500]]))
    assert likeness(a, a) == 1 and likeness(a, b) < 0.05 and 0.25 < likeness(a, half) < 0.8
    none = filters(np.zeros(0, np.uint64))
    assert likeness(none, none) == 1 and likeness(none, a) == 0


MASK = (1 << 64) - 1


def spread(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def window_hash(window):
    of = _byte_hash(False, 9)
    return spread(sum(int(of[b]) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(window)) & MASK)


def rarities(raw, w, typical, least):
    step = [round((c * math.log2(c) - (c - 1) * math.log2(max(c - 1, 1))) * 65536) for c in range(1, w + 1)]
    out = []
    for i in range(len(raw) - w + 1):
        total = sum(sum(step[:n]) for n in Counter(raw[i : i + w]).values())
        usual, dull = int((math.log2(w) - typical) * w * 65536), int((math.log2(w) - least) * w * 65536)
        out.append(0 if total > dull else abs(total - usual))
    return out


def chain_of(raw):
    """Bloom filters as sets of bits, by plain loops over windows."""
    hashes = []
    for (w, group, typical, least), there, add in (((32, 32, 3.55, 1.2), len(raw) >= 256, 0), ((8, 4, 2.5, 0.8), 8 <= len(raw) < 1024, 1)):
        if there:
            r = rarities(raw, w, typical, least)
            places = {max(range(i, i + min(group, len(r))), key=lambda j: (r[j], -j)) for i in range(max(1, len(r) - group + 1))}
            hashes += [spread_one(raw[j : j + w], add) for j in sorted(places)]
    if 0 < len(raw) < 8:
        hashes = [window_hash(raw)]
    hashes = list(dict.fromkeys(hashes))
    return [{h >> 11 * j & 2047 for h in hashes[i : i + 160] for j in range(5)} for i in range(0, len(hashes), 160)]


def spread_one(window, add):
    of = _byte_hash(False, 9)
    return spread((sum(int(of[b]) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(window)) + add) & MASK)


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    total = 0.0
    for x in a:
        best = -math.inf
        for y in b:
            most, chance = min(len(x), len(y)), len(x) * len(y) / 2048
            low = chance + max(0.25 * (most - chance), 3 * math.sqrt(chance))
            best = max(best, (len(x & y) - low) / max(most - low, 1e-9))
        total += len(x) * min(1.0, max(0.0, best))
    return total / sum(map(len, a))


def test_fingerprints_and_likeness_by_plain_loops(spark):
    rows = [r for r in corpus(12, 45) if len(r[1] or "") < 3000]
    rows += [(2000 + i, t, None, None, 0) for i, t in enumerate(["a" * 900, "abc", "12345678", "x y " * 70, "né" * 128])]
    out = {r.doc_id: r for r in digests(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    bits = lambda text: [{i for i in range(2048) if raw[i // 8] >> i % 8 & 1} for raw in np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 256).tolist()]
    for i, r in enumerate(order):
        a, b = r[1] or "", order[(i + 1) % len(order)][1] or ""
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        own, edited_, next_ = (chain_of(x.encode()) for x in (a, e, b))
        got = out[r[0]]
        assert bits(got.fingerprint) == own and bits(got.edited_fingerprint) == edited_
        assert abs(got.near_edited - alike(own, edited_)) < 1e-9 and abs(got.near_next - alike(own, next_)) < 1e-9


def test_a_very_long_text(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 23) for i in range(100_000)) * 30
    check(spark, [(1, text, None, None, 0), (2, "short", None, None, 0)])
