"""Secret scans with inferred grammars.

Base patterns find credentials by their form of writing. Their values are labelled
credentials: of each kind a bounded number, the least by hash, becomes a prefix tree
over character classes, and states whose continuations are statistically alike
(Hoeffding bound) are merged into a probabilistic automaton. Every run of
credential characters, or part of one that base spans leave, of at least the least
length of a labelled value is a candidate; it is added if some automaton makes it
about as likely, per character, as nearly all labelled credentials, and likelier than the
letters of the other candidates do by at least as much as those are.

Defined cases: a null text is empty; a document without spans has empty strings and
the hash of the empty string; with no labelled credential nothing is added, and a kind with
few is fitted on those; ties need no
order, since one automaton that accepts is enough; repeated rows are scanned alike; an
empty table gives an empty result; other columns are ignored. A text is scanned as a
whole in its worker, in about six times its bytes of memory, and a batch of them in as
much more as its other texts have.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import save

# The base patterns, the least length of what each must match, and the candidates.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 or more in all: a run is matched to its end, so a shorter one has no other match
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE_LEAST = ASSIGN_LEAST
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % CANDIDATE_LEAST)
KINDS = ("assign", "access", "hex")
METHOD = "grammar"

#: Labelled values of a kind that an automaton is made of, at most, and shares in which they are looked for.
SAMPLE, SHARES = 250, 64
ALPHA = 0.01
#: Share of labelled credentials that a threshold may turn away.
MISSED = 0.02
#: Nats a character that a candidate may be less likely than those: it may begin and end as no labelled one does.
SLACK = 0.5

CLASSES = {**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"}, **{c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}}
SIZES = Counter(CLASSES.values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) in order of start, then kind."""
    out, low = [], text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, found: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of each run, or part of one that the base spans leave, that is long enough."""
    out, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while i < len(found) and found[i][0] < m.end():
            if found[i][0] - max(at, reach) >= CANDIDATE_LEAST:
                out.append((max(at, reach), found[i][0]))
            reach, i = max(reach, found[i][2]), i + 1
        if m.end() - max(at, reach) >= CANDIDATE_LEAST:
            out.append((max(at, reach), m.end()))
    return out


def _scan(batches):
    fields = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))), ("more", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])))])
    for batch in batches:
        base, more = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            found = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e, "value": v} for s, k, e, v in found])
            more.append([{"start": s, "end": e, "value": text[s:e]} for s, e in candidates(text, found)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, fields.field(1).type), pa.array(more, fields.field(2).type)], schema=fields)


class Automaton:
    """Probabilistic automaton of some strings of classes, by merging states of their prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.edge: list[Counter] = [Counter()]
        self.here, self.ends = [0], [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        for s in strings:
            q = 0
            self.here[0] += 1
            for c in s:
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.edge.append(Counter())
                    self.here.append(0)
                    self.ends.append(0)
                self.edge[q][c] += 1
                q = self.next[q][c]
                self.here[q] += 1
            self.ends[q] += 1
        self._merge_all()

    def _far(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self._far(self.ends[a], self.here[a], self.ends[b], self.here[b]):
                return False
            for c in self.edge[a].keys() | self.edge[b].keys():
                if self._far(self.edge[a][c], self.here[a], self.edge[b][c], self.here[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree at b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.here[a] += self.here[b]
            self.ends[a] += self.ends[b]
            self.edge[a].update(self.edge[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_all(self) -> None:
        kept = [0]
        while True:
            open_ = [(q, c, t) for q in kept for c, t in self.next[q].items() if t not in kept]
            if not open_:
                break
            q, c, t = max(open_, key=lambda x: (self.here[x[2]], -x[2]))
            into = next((r for r in kept if self._alike(r, t)), None)
            if into is None:
                kept.append(t)
            else:
                self.next[q][c] = into
                self._fold(into, t)
        at = {q: i for i, q in enumerate(kept)}
        self.states = [({c: (at[self.next[q][c]], n / self.here[q]) for c, n in self.edge[q].items()}, self.ends[q] / self.here[q]) for q in kept]
        del self.next, self.edge, self.here, self.ends

    def log_likelihood(self, value: str) -> float:
        """Of the value's characters: the automaton's classes, evenly spread within each."""
        q, total = 0, 0.0
        for ch in value:
            c = CLASSES.get(ch, ch)
            to, p = self.states[q][0].get(c, (q, 0.0))
            total += math.log(0.999 * p + 0.001 / 12) - math.log(SIZES.get(c, 1))
            q = to
        return total + math.log(0.999 * self.states[q][1] + 0.001)


def classes(value: str) -> str:
    return "".join(CLASSES.get(ch, ch) for ch in value)


class Grammar:
    """An automaton for each kind, letter frequencies of the rest, and how much likelier a credential is."""

    def __init__(self, labelled: dict[int, list[str]], letters: dict[str, int]):
        total = sum(letters.values())
        alphabet = len(CLASSES) + 6
        self.other = {c: math.log((letters.get(c, 0) + 1) / (total + alphabet)) for c in [*CLASSES, *"+/_.=-"]}
        self.kinds = {}
        for kind, values in sorted(labelled.items()):
            if not values:
                continue
            half = [v for i, v in enumerate(values) if i % 4] or values
            auto = Automaton([classes(v) for v in half])
            at = int(MISSED * len(values))
            gains, fits = sorted(self._gain(auto, v) for v in values), sorted(self._fit(auto, v) for v in values)
            self.kinds[kind] = (auto, max(0.3, gains[at]), fits[at] - SLACK)

    def _fit(self, auto: Automaton, value: str) -> float:
        return auto.log_likelihood(value) / max(1, len(value))

    def _gain(self, auto: Automaton, value: str) -> float:
        return (auto.log_likelihood(value) - sum(self.other.get(c, -8.0) for c in value)) / max(1, len(value))

    def accepts(self, value: str) -> bool:
        return any(self._gain(auto, value) >= low and self._fit(auto, value) >= least for auto, low, least in self.kinds.values())


def _report(shared):
    def fn(batches):
        grammar = shared.value
        known: dict[str, bool] = {}
        for batch in batches:
            counts, sha, spans = [[], [], []], [], []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for k in range(3):
                    counts[k].append(sum(b["kind"] == k for b in base))
                own = [(b["start"], b["kind"], b["end"]) for b in base]
                sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own).encode()).hexdigest())
                for m in more:
                    if len(known) > 100_000:
                        known.clear()
                    v = m["value"]
                    if v not in known:
                        known[v] = grammar.accepts(v)
                    if known[v]:
                        own.append((m["start"], 3, m["end"]))
                spans.append(",".join(f"{(*KINDS, METHOD)[k]}:{s}:{e}" for s, k, e in sorted(own)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return fn


def learn(found: DataFrame, sample: int = SAMPLE) -> Grammar:
    """From scanned documents: `sample` distinct values of each kind at most come to the driver, and a count for each letter."""
    values = found.select(F.explode("base").alias("b")).select("b.kind", "b.value").distinct()
    # Ranked within shares of a kind first, so that no task meets more than SHARES times the sample.
    order = (F.xxhash64("value"), "value")
    values = values.withColumn("share", F.pmod(F.xxhash64(F.lit(5), "value"), F.lit(SHARES)))
    values = values.withColumn("at", F.row_number().over(Window.partitionBy("kind", "share").orderBy(*order))).filter(F.col("at") <= sample)
    least = Window.partitionBy("kind").orderBy(*order)
    labelled: dict[int, list[str]] = {k: [] for k in range(3)}
    for r in values.withColumn("at", F.row_number().over(least)).filter(F.col("at") <= sample).orderBy("kind", "at").collect():
        labelled[r.kind].append(r.value)
    letters = found.select(F.explode("more").alias("m")).select(F.explode(F.split("m.value", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return Grammar(labelled, {r.c: r.n for r in letters.collect()})


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs (doc_id, text)."""
    spans = "array<struct<start:long,kind:int,end:long,value:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = save(rows.mapInArrow(_scan, f"doc_id long, base {spans}, more array<struct<start:long,end:long,value:string>>"), "secret-spans")
    shared = docs.sparkSession.sparkContext.broadcast(learn(found, sample))
    return found.mapInArrow(_report(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
