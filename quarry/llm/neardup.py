"""Near-dedup with HyperMinHash sketches.

A document is the set of its distinct k-word shingles. Its sketch has 256
registers: the high bits of a shingle's hash name the register, which keeps the
least of the remaining bits as a leading-zero count and a mantissa of 10 bits. For
banding, empty registers borrow from pseudo-random filled ones, so short texts band
like long ones. Documents that agree in a band of 5 registers share a bucket; bands
miss a pair of similarity 0.8 with probability (1 - 0.8^5)^40, 1e-7.

Documents of equal sets are collapsed first. Each member of a bucket is then paired
with the bucket's hub, a member chosen by hash. The Jaccard estimate of a pair,
corrected for chance collisions of compressed registers, drops what is far off; the
rest is confirmed on the full sets.

What is left in a bucket beside its hub's component is settled without making the
bucket's pairs. Buckets with members of several components are joined to groups by a
name that they pass on once. A group has a core H of shingles, those in more than half
of some members chosen by hash; any H gives right results, a good one makes less work.
A member x differs from H by the m shingles that it misses and the e that it has
beside H. For c = percent / (100 + percent), x and y are linked if their sets share
c (|x| + |y|) shingles, which is the same as

    shared differences * (100 + percent) >= w(x) + w(y) - (100 - percent) |H|

with w = 100 m + percent e. So the member of least w, the centre, is linked with all
whose w leaves the right side at 0 or below, and needs no pairs for that. Any other
link needs shared differences. Of a member's differences, those that no other
component of the group has cannot be shared; a member with too few left is out. The
others are ordered by how rare they are in the group, and members of different
components meet only on the first f - need + 1 of their f differences, and only if
enough are left behind the one they meet on; so near copies with edits of their own
cost some rows a member and hardly any pair. Met pairs are estimated and confirmed
like the hubs' pairs. All of it is exact at any size of a group: no rounds, no caps.

Defined cases: a text without words or a null text has an empty set, linked with
nothing; fewer than k words are one shingle; rows that repeat a doc_id are one
document, and if their texts differ one of them is compared; a row without doc_id is
linked with nothing, has no component and is kept; an empty table gives an empty
result; ties go by doc_id; other columns are ignored. A worker takes texts in pieces
of 1 MB, or one text if it is longer: about 25 times its bytes of memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Work, Words, _Q, buffers, mix, pieces

P_BITS, MANTISSA, BANDS, BAND = 8, 10, 40, 5
M = 1 << P_BITS
PIECE = 1 << 20
#: Members from which a group's core is taken, about; a group of fewer than 16 takes its hub's set.
SAMPLE = 15
#: Members that meet one copy of a hub's set or of a group's core.
SHARE = 256


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles."""
    words = Words(raw, offsets, lower=True)
    g, ok = words.grams(k)
    counts = np.diff(words.rows)
    for c in range(1, k):
        short = np.flatnonzero(counts == c)
        if len(short):
            at = words.rows[short]
            h, _ = words.grams(c)
            g[at], ok[at] = h[at], True
    keep = np.concatenate([[0], np.cumsum(ok)])
    bounds, g = keep[words.rows], g[ok]
    return [np.unique(g[bounds[i] : bounds[i + 1]]) for i in range(len(counts))]


def compress(rest: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa of 64-bit values, as a number from 1; 0 is an empty register."""
    t = rest >> np.uint64(11)
    e = np.frexp(t.astype(np.float64))[1].astype(np.int64)
    zeros = 53 - e
    mantissa = ((t << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) + mantissa.astype(np.int64) + 1).astype(np.uint16)


_DONORS: list[np.ndarray] = []


def _donors() -> np.ndarray:
    if not _DONORS:
        rng = np.random.default_rng(5)
        _DONORS.append(np.stack([rng.permutation(M) for _ in range(M)]))
    return _DONORS[0]


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, one row each; an empty register is 0."""
    regs = np.zeros((len(sets), M), np.uint16)
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return regs
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    cell = owner * M + (every >> np.uint64(64 - P_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    regs.reshape(-1)[cell[first]] = compress(every[first] << np.uint64(P_BITS))
    return regs


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers of which the empty ones have borrowed; those of an empty set stay empty."""
    has = regs > 0
    row, col = np.nonzero(~has & has.any(axis=1)[:, None])
    donors, out, a = _donors(), regs.copy(), 0
    while len(row):
        from_ = donors[col, a]
        ok = has[row, from_]
        out[row[ok], col[ok]] = regs[row[ok], from_[ok]]
        row, col, a = row[~ok], col[~ok], a + 1
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    r = filled(regs)[:, : BANDS * BAND].astype(np.uint64).reshape(len(regs), BANDS, BAND)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2]).copy()
    for j in range(BAND):
        acc = acc * _Q + r[:, :, j]
    return mix(acc).view(np.int64)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by chance, for disjoint sets of n and m elements."""
    big, small = np.maximum(n, m).astype(float), np.maximum(1, np.minimum(n, m)).astype(float)
    ratio = (1 + big) / small
    return 0.169919487159739093975 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of agreeing registers among those that either fills, less what chance would make agree."""
    used = np.maximum(1, ((a > 0) | (b > 0)).sum(axis=1))
    same = ((a == b) & (a > 0)).sum(axis=1) / used
    chance = collision_rate(n, m)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _sketch(k: int):
    def fn(batches):
        for batch in batches:
            raw, off = buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in pieces(off, PIECE):
                sets = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = np.array([len(s) for s in sets], np.int64)
                h1 = np.array([int(mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([int(mix(s ^ _Q).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sketches(sets)).reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(h1), pa.array(h2), keys], ["doc_id", "n", "h1", "h2", "bands"])

    return fn


def _sets(k: int):
    """id, n, regs, members of each text."""

    def fn(batches):
        for batch in batches:
            raw, off = buffers(batch.column(1))
            for i, j in pieces(off, PIECE):
                sets = shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(ends)), pa.array([r.tobytes() for r in sketches(sets)], pa.binary()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["id", "n", "regs", "members"])

    return fn


def _linked(percent: int):
    """Pairs (a, b) whose estimate is not more than 6 standard deviations below the threshold, and whose full sets reach it."""
    p = percent / 100

    def fn(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in (4, 5))
            ok = jaccard_estimate(a, b, n, m) >= p - 6 * np.sqrt(p * (1 - p) / np.maximum(1, ((a > 0) | (b > 0)).sum(axis=1)))
            for i in np.flatnonzero(ok):
                both = len(np.intersect1d(batch.column(6)[i].values.to_numpy(), batch.column(7)[i].values.to_numpy(), assume_unique=True))
                ok[i] = 100 * both >= percent * (n[i] + m[i] - both)
            yield batch.filter(pa.array(ok)).select([0, 1])

    return fn


def _is_flat(e: DataFrame) -> bool:
    """Has each u one edge, to a v that is no u?"""
    nodes = e.select(F.col("u").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    nodes = nodes.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs"))
    return nodes.filter("ups > 1 or ups = 1 and downs = 1").isEmpty()


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """id, label of each node of edges (a, b) but the least of a component, which is the label. Alternates large and small stars, all in tables."""
    e, turn = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), 0
    e = work.save(e, f"{name}-0")
    while turn == 0 or not _is_flat(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e, turn = work.save(small.filter("u <> v").distinct(), f"{name}-{turn + 1}"), turn + 1
        work.drop(f"{name}-{turn - 1}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _near_labels(links: DataFrame) -> DataFrame:
    """id, label of each node of links (a, b): the one of least hash within two links of it. Nodes of one label are of one component, but not the other way round."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.unionByName(links.select("a", F.col("a").alias("b"))).unionByName(links.select(F.col("b").alias("a"), "b")).distinct()
    one = ends.groupBy("a").agg(_least("b").alias("l")).select(F.col("a").alias("b"), "l")
    return ends.join(one, "b").groupBy("a").agg(_least("l").alias("label")).select(F.col("a").alias("id"), "label")


def _parts(c: Column) -> Column:
    """In how many parts c members are dealt."""
    return F.ceil(c / SHARE).cast("int")


def _part(id_: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(id_), F.col(parts)).cast("int")


def _every_part(rows: DataFrame, parts: str) -> DataFrame:
    """A copy of each row for each of its parts."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, work: Work, name: str) -> DataFrame:
    """The links (a, b) among saved pairs (a, b), estimated on sketches and then compared in full. b, which many may share, is dealt in parts."""
    of = lambda c: sets.select(*[F.col(w).alias(c if w == "id" else f"{w}_{c}") for w in ("id", "n", "regs", "members")])
    shares = pairs.groupBy("b").agg(_parts(F.count(F.lit(1))).alias("parts"))
    one = pairs.join(shares, "b").withColumn("part", _part("a", "parts")).drop("parts").join(of("a"), "a")
    two = _every_part(shares, "parts").join(of("b"), "b")
    both = one.join(two, ["b", "part"]).select("a", "b", *[f"{w}_{c}" for w in ("n", "regs", "members") for c in "ab"])
    return work.save(both.mapInArrow(_linked(percent), "a long, b long"), f"{name}-links")


def _fits(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _least(c: str, by: str | None = None, seed: int = 1) -> Column:
    """The value of c in the row whose `by` has the least hash."""
    return F.min_by(c, F.xxhash64(by or c, F.lit(seed)))


def _groups(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """g, id, n, label, distinct: the members of buckets (key, id, n) that are not settled, by the name of a bucket's group.

    A bucket's first name is the label of least hash among its members. It passes that
    to its members, and takes the least of what they were passed for its name; so
    buckets of one family meet under few names, and a name stays near its bucket.
    """
    named = rows.join(labels, "id", "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    first = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c"), _least("label").alias("v")).filter("x <> y and c > 2").select("key", "v")
    rows = named.join(first, "key")
    passed = rows.groupBy("id").agg(_least("v").alias("w"))
    names = rows.join(passed, "id").groupBy("key").agg(_least("w").alias("g"))
    return rows.join(names, "key").select("g", "id", "n", "label").distinct()


def _deltas(groups: DataFrame, sets: DataFrame, percent: int, work: Work) -> DataFrame:
    """g, id, n, label, h (size of the core), w, delta of each member of a group (g, id, n, label); what it misses of the core is in delta by complement."""
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("c"), _least("id", seed=2).alias("hub"))
    some = F.least(F.lit(SAMPLE), F.floor(F.col("c") / 8))
    members = groups.join(sizes, "g").withColumn("parts", _parts(F.col("c")))
    chosen = (F.col("id") == F.col("hub")) | ((some > 1) & (F.pmod(F.xxhash64("id", F.lit(3)), F.col("c")) < some))
    members = work.save(members.select("g", "id", "n", "label", chosen.alias("chosen"), "parts", _part("id", "parts").alias("part")), "members")
    picked = members.filter("chosen").select("g", "id", "parts")
    votes = picked.groupBy("g").agg(F.count(F.lit(1)).alias("votes"), F.max("parts").alias("parts"))
    held = picked.select("g", "id").join(sets.select("id", "members"), "id").select("g", F.explode("members").alias("element")).groupBy("g", "element").agg(F.count(F.lit(1)).alias("held"))
    core = held.join(votes, "g").filter("2 * held > votes").groupBy("g").agg(F.collect_list("element").alias("core"), F.max("parts").alias("parts"))
    none = F.array().cast("array<bigint>")
    own = members.select("g", "id", "n", "label", "part").join(sets.select("id", "members"), "id").join(_every_part(core, "parts"), ["g", "part"], "left").withColumn("core", F.coalesce("core", none))
    own = own.withColumn("missing", F.array_except("core", "members")).withColumn("more", F.array_except("members", "core"))
    w = 100 * F.size("missing").cast("long") + percent * F.size("more").cast("long")
    delta = F.concat(F.transform("missing", F.bitwise_not), F.col("more"))
    return work.save(own.select("g", "id", "n", "label", F.size("core").cast("long").alias("h"), w.alias("w"), delta.alias("delta")), "deltas")


def _central(deltas: DataFrame, percent: int, work: Work) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of members with the centre of their group, and members (g, id, n, label, h, w, delta, out) with these links in their labels; out: not of the centre's component."""
    centre = deltas.groupBy("g").agg(F.min(F.struct("w", "id", "label")).alias("centre"))
    at = deltas.join(centre, "g").withColumn("near", F.col("w") + F.col("centre.w") <= (100 - percent) * F.col("h"))
    near = work.save(at.select("g", "id", "n", "label", "h", "w", "delta", "near", F.col("centre.id").alias("centre"), F.col("centre.label").alias("main")), "near")
    links = near.filter("near and label <> main").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    joined = near.groupBy("g", "label").agg(F.max(F.col("near") | (F.col("label") == F.col("main"))).alias("joined"))
    members = near.join(joined, ["g", "label"]).withColumn("label", F.when(F.col("joined"), F.col("main")).otherwise(F.col("label")))
    return links, members.select("g", "id", "n", "label", "h", "w", "delta", (~F.col("joined")).alias("out"))


def _met(members: DataFrame, percent: int, work: Work) -> DataFrame:
    """Pairs (a, b) of members (g, id, n, label, h, w, delta, out) of different components that may share as many differences as they need."""
    lacking, whole = 100 - percent, 100 + percent
    open_ = members.join(members.filter("out").select("g").distinct(), "g", "left_semi")
    rows = work.save(open_.select("g", "id", "label", F.explode("delta").alias("element")), "rows")
    common = rows.groupBy("g", "element").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("g", "element", "c")
    rows = work.save(rows.select("g", "id", "element").join(common, ["g", "element"]), "common")
    able = rows.groupBy("g", "id").agg(F.count(F.lit(1)).alias("f")).join(open_.drop("delta"), ["g", "id"])
    most = able.groupBy("g").agg(F.max(whole * F.col("f") - F.col("w")).alias("most"), F.min("w").alias("least"))
    # A partner has at least `percent` of n shingles, so of those beside the core there are some.
    other = F.greatest(F.col("least"), percent * F.greatest(F.lit(0), F.ceil(F.col("n") * percent / 100) - F.col("h")))
    able = able.join(most, "g").withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("w") + other - lacking * F.col("h")) / whole)))
    able = able.filter((F.col("need") <= F.col("f")) & (F.col("w") - lacking * F.col("h") <= F.col("most"))).drop("most", "least")
    order = Window.partitionBy("g", "id").orderBy("c", "element")
    probes = rows.join(able, ["g", "id"]).withColumn("left", F.col("f") - F.row_number().over(order) + 1).filter(F.col("left") >= F.col("need"))
    probes = work.save(probes.select("g", "element", "id", "n", "label", "h", "w", "out", "left"), "probes")
    x = probes.filter("out").select("g", "element", F.col("id").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), F.col("w").alias("aw"), F.col("left").alias("aleft"))
    meet = (F.col("label") != F.col("al")) & (~F.col("out") | (F.col("id") < F.col("a"))) & _fits(F.col("n"), F.col("an"), percent) & (F.least("left", "aleft") * whole >= F.col("w") + F.col("aw") - lacking * F.col("h"))
    return work.save(probes.join(x, ["g", "element"]).filter(meet).select("a", F.col("id").alias("b")).distinct(), "met")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text)."""
    work = Work(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = work.save(docs.mapInArrow(_sketch(k), "doc_id long, n long, h1 long, h2 long, bands array<long>"), "sketch")
    base = work.save(sketch.select("doc_id", "n", "h1", "h2"), "base")
    whole = sketch.filter("n > 0 and doc_id is not null")
    same = work.save(whole.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "same")
    work.drop("sketch")
    again = same.groupBy("rep").agg(F.count(F.lit(1)).alias("c"), F.max("h1").alias("h")).filter("c > 1")
    nodes = same.join(again, "rep", "left").filter("h is null or h = h1")
    keys = nodes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(_least("id").alias("hub"), _least("n", "id").alias("hub_n"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    rows = work.save(keys.join(buckets, "key").select("key", "id", "n", "hub", "hub_n"), "buckets")
    repeated = not base.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    sets = docs.join(rows.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(k), "id long, n long, regs binary, members array<long>")
    if repeated:
        sets = sets.groupBy("id").agg(F.max(F.struct("n", "regs", "members")).alias("s")).select("id", "s.n", "s.regs", "s.members")
    sets = work.save(sets, "sets")
    stars = work.save(rows.filter((F.col("id") != F.col("hub")) & _fits(F.col("n"), F.col("hub_n"), percent)).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    links = _confirm(stars, sets, percent, work, "star")
    labels = work.save(_near_labels(links), "labels")
    groups = work.save(_groups(rows.select("key", "id", "n"), labels), "groups")
    work.drop("buckets", "stars")
    central, members = _central(_deltas(groups, sets, percent, work), percent, work)
    more = _confirm(_met(members, percent, work), sets, percent, work, "met")
    labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(links).unionByName(central).unionByName(more), work, "parts")
    of_rep = work.save(same.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("h1", "h2", "n", F.coalesce("label", "rep").alias("component")), "components")
    work.keep("base", "components")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = base.join(of_rep, ["h1", "h2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
