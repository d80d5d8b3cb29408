"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set of its five-word shingles (words in lower case, without punctuation; weight: occurrences). Its similarity to another one is the
weighted Jaccard similarity; documents of 0.8 or more are linked, and classes are the connected components of the links.

Signature: every shingle owns weight regions [0,1), [1,2), [2,4), ... Darts arrive in a region as a Poisson process whose
times and places depend on the shingle, the region and the dart's number only. A dart hits a document if it lies below the
document's weight; darts are thrown up to a time that gives about k (ln k + 3) hits whatever the document's size, each hit
falls on one of k coordinates, and the earliest per coordinate is kept (with coordinates left empty, the time is doubled).
Two documents agree on a coordinate with the probability of their weighted Jaccard similarity.

Plan: rows with equal shingle multisets are one representative (aggregated before the shuffle); a representative has a number
of its own, so ids that are null or repeat under other texts lose no link. `bands` keys of `rows_per_band` coordinates tie
representatives to the least one of their bucket: one row per member, never pairs. The components of these ties are
candidate groups; in them every pair is compared exactly, by blocked matrix products over shared shingles inside a task.
That settles the classes of groups of up to `block` members. In larger groups, all are first compared with a few central
members, in lanes of `per_lane` members; those tied by that need no comparison with each other, and only the others are
compared with the whole group, in block pairs, and the links found are joined up by components. So a large group of close
copies costs one pass over it. Only spanning edges leave a task.
Missed links: a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^20 < 0.00003.

Defined cases: null and empty texts and texts without a word have no shingles and are classes of their own, one for each row;
texts of one to four words are one shingle; every row is judged by its own text, so rows that share an id, or have none, may
be of different classes; null ids sort behind all others, and a class of such rows only has a null class_id; of a class the
row with the least id stays, of several with that id (repeated rows, or near-copies under one id) one, always of the same
text; an empty table gives no rows; further columns, of any name, are kept by the filter and ignored by the query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, bloom_filter, claim, columns_of, fresh, materialize, release, slices, spread, texts_of, trim
from lodestone.operators.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
BLOCK = 384
PIVOTS, PER_LANE = 8, 512
U = np.uint64
WORD = re.compile(r"\w+")


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles of a text, in order, repeated ones too."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, [w.encode("utf-8", "surrogatepass") for w in words]), dtype=U, count=len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), dtype=U)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(words))):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def unit_interval(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def throw(keys: np.ndarray, low: float, width: float, weights: np.ndarray, until: float) -> tuple[np.ndarray, np.ndarray]:
    """Darts that hit one weight region of some elements before `until`: their times and names."""
    mean = width * until
    n = int(mean + 6 * np.sqrt(mean) + 8)
    while True:
        with np.errstate(over="ignore"):
            name = mix(keys[:, None] + np.arange(1, n + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15))
        time = np.cumsum(-np.log(unit_interval(name)), axis=1) / width
        if not len(keys) or time[:, -1].min() >= until:
            break
        n *= 2
    with np.errstate(over="ignore"):
        place = low + width * unit_interval(mix(name + U(0xD1B54A32D192ED03)))
    hit = (time < until) & (place < weights[:, None])
    return time[hit], name[hit]


def signature(items: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Names of the earliest darts on k coordinates, for distinct items with positive weights."""
    until = k * (np.log(k) + 3) / weights.sum()
    top = float(weights.max())
    while True:
        times, names = [], []
        low, width, layer = 0.0, 1.0, 0
        while low < top:
            own = weights > low
            with np.errstate(over="ignore"):
                keys = mix(items[own] + U(layer) * U(0xA0761D6478BD642F))
            t, d = throw(keys, low, width, weights[own], until)
            times.append(t)
            names.append(d)
            low, width, layer = low + width, max(1.0, low + width), layer + 1
        time, name = np.concatenate(times), np.concatenate(names)
        name = mix(name ^ U(0x5851F42D4C957F2D))
        out = np.zeros(k, dtype=U)
        filled = np.zeros(k, dtype=bool)
        order = np.argsort(-time)
        at = (name[order] % U(k)).astype(np.int64)
        out[at] = name[order]
        filled[at] = True
        if filled.all():
            return out
        until *= 2


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=U)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix(out * U(0x9E3779B97F4A7C15) + sig.reshape(bands, rows)[:, r])
    return out.view(np.int64)


def units(items: np.ndarray) -> np.ndarray:
    """Sorted hashes of (shingle, occurrence): the weighted set as a plain one."""
    s = np.sort(items)
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, dtype=bool)
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    with np.errstate(over="ignore"):
        return np.sort(mix(s + nth.astype(U) * U(0xE7037ED1A0B428DB)))


def local_classes(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Index of the first member of each set's class, by exact comparison of all pairs."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    everywhere = int((count == n).sum())
    shared = (count > 1) & (count < n)
    column = np.cumsum(shared) - 1
    ok = shared[inverse]
    rows, cols = owner[ok], column[inverse[ok]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    inter = np.full((n, n), float(everywhere), dtype=np.float32)
    step = 4096
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(cols, (a, a + step))
        m = np.zeros((n, min(step, int(shared.sum()) - a)), dtype=np.float32)
        m[rows[lo:hi], cols[lo:hi] - a] = 1
        inter += m @ m.T
    inter = inter.astype(np.float64)
    linked = inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def text_key(text: str, doc_id: str) -> list[Column]:
    """doc, x1, x2: the id (LAST_ID for null) and two hashes of the text. Rows that agree on them are repeated rows."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(t).alias("x1"), F.xxhash64(F.lit(1), t).alias("x2")]


def signatures(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """doc, x1, x2, row (a number of its own), f1, f2 (hashes of the shingle multiset, null without shingles), keys (one per band)."""
    own = [("doc", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64())]
    schema = pa.schema([*own, ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("none", lambda: None)
        for batch in slices(batches):
            f1, f2, keys = [], [], []
            for t in texts_of(batch):
                items = shingles(t)
                if not len(items):
                    f1.append(None)
                    f2.append(None)
                    keys.append(None)
                    continue
                u = units(items)
                with np.errstate(over="ignore"):
                    f1.append(mix(u).sum(dtype=U).astype(np.int64))
                    f2.append(mix(u ^ U(0x2545F4914F6CDD1D)).sum(dtype=U).astype(np.int64))
                distinct, weight = np.unique(items, return_counts=True)
                keys.append(band_keys(signature(distinct, weight.astype(np.float64), bands * rows), bands, rows))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c, _ in own], pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)
        trim()

    source = docs.select(*text_key(text, doc_id), F.col(text).alias("text"))
    made = spread(source).mapInArrow(run, "doc long, x1 long, x2 long, f1 long, f2 long, keys array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Exact comparison of two sorted unit sets."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    at = np.searchsorted(b, a)
    inter = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return inter >= similarity * (len(a) + len(b) - inter) - 1e-9


def unit_sets(docs: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """rep, grp, size, units of every member, from one of the rows with its text. `members` has rep, grp, size, doc, x1, x2."""
    kinds = [("rep", pa.int64()), ("grp", pa.int64()), ("size", pa.int64()), ("units", pa.binary())]
    schema = pa.schema(kinds)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of a member: one for each task is enough
        for batch in slices(batches):
            new = [r not in seen and not seen.add(r) for r in batch.column("rep").to_pylist()]
            part = batch.filter(pa.array(new, pa.bool_()))
            made = [units(shingles(t)).tobytes() for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c, _ in kinds[:3]], pa.array(made, pa.binary())], schema=schema)

    key = F.xxhash64("doc", "x1", "x2")
    held = bloom_filter(members.select(key.alias("key")), "key")
    source = docs.select(*text_key(text, doc_id), F.col(text).alias("text")).where(held(key))
    texts = source.join(members.hint("merge"), ["doc", "x1", "x2"]).select("rep", "grp", "size", "text")
    return texts.mapInArrow(sets, "rep long, grp long, size long, units binary")


def pivot_links(big: DataFrame, ties: DataFrame, similarity: float, pivots: int, per_lane: int) -> DataFrame:
    """grp, rep, mask, linked: the central members of a large group that each member is similar to, as bits and as a list.

    The most central members share the most band keys with others. They are repeated for as many lanes as the group's size
    calls for, and each lane's task reads its members as a stream.
    """
    scored = big.select("grp", "rep").join(ties.select("rep", "score"), "rep")
    order = Window.partitionBy("grp").orderBy(F.desc("score"), "rep")
    top = materialize(scored.distinct().withColumn("bit", F.row_number().over(order) - 1).where(F.col("bit") < pivots).select("rep", "bit"), "pivots")
    lanes = F.ceil(F.col("size") / per_lane).cast("int")
    heads = big.join(top, "rep").dropDuplicates(["rep"]).select("grp", F.explode(F.sequence(F.lit(0), lanes - 1)).alias("lane"), "bit", "rep", "units")
    rest = big.select("grp", F.pmod(F.xxhash64("rep"), lanes).cast("int").alias("lane"), F.lit(pivots).alias("bit"), "rep", "units")
    routed = heads.unionByName(rest).repartition("grp", "lane").sortWithinPartitions("grp", "lane", "bit", "rep")
    schema = pa.schema([("grp", pa.int64()), ("rep", pa.int64()), ("mask", pa.int32()), ("linked", pa.list_(pa.int64()))])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, last = None, [], None
        for batch in slices(batches):
            out = []
            for grp, lane, bit, rep, raw in zip(*[batch.column(c).to_pylist() for c in ("grp", "lane", "bit", "rep", "units")]):
                if (grp, lane) != at:
                    at, own, last = (grp, lane), [], None
                mine = np.frombuffer(raw, dtype=U)
                if bit < pivots:
                    own.append((bit, rep, mine))
                elif rep != last:
                    last = rep
                    near = [(b, r) for b, r, u in own if r == rep or similar(mine, u, similarity)]
                    out.append((grp, rep, sum(1 << b for b, _ in near), [r for _, r in near if r != rep]))
            cols = list(zip(*out)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(cols, schema)], schema=schema)

    return materialize(routed.mapInArrow(link, "grp long, rep long, mask int, linked array<long>"), "links")


def main_class(masks: pa.Table) -> pa.Table:
    """grp, mask, tied (of the group's largest class), s and r (members of that class, and others), from the masks of a group.
    Masks that share a bit are of one class; members with no bit are classes of their own."""
    mask, n = masks.column("mask").to_numpy(), masks.column("n").to_numpy()
    joined = mask.copy()
    while True:
        new = np.array([np.bitwise_or.reduce(joined[(joined & m) != 0]) if m else 0 for m in joined])
        if (new == joined).all():
            break
        joined = new
    total = {m: int(n[joined == m].sum()) for m in joined if m}
    main = min(total, key=lambda m: (-total[m], m)) if total else None
    tied = joined == main if total else np.zeros(len(mask), dtype=bool)
    s = int(n[tied].sum())
    return pa.table({"grp": masks.column("grp"), "mask": mask, "tied": tied, "s": np.full(len(mask), s), "r": np.full(len(mask), int(n.sum()) - s)})


def large_blocks(big: DataFrame, linked: DataFrame, block: int) -> DataFrame:
    """grp, rep, units, i, j: block pairs of the members of large groups that the central members don't tie to the largest class,
    with each other and with the tied ones."""
    counts = linked.groupBy("grp", "mask").agg(F.count("*").alias("n"))
    judged = counts.groupBy("grp").applyInArrow(main_class, "grp long, mask int, tied boolean, s long, r long")
    judged = materialize(judged.where("r > 0"), "judged")
    of = linked.join(judged, ["grp", "mask"]).select("rep", "tied", F.ceil(F.col("s") / block).cast("int").alias("ns"), F.ceil(F.col("r") / block).cast("int").alias("nr"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("tied"), F.col("ns")).otherwise(F.col("nr"))).cast("int")
    # Blocks of the others are 0, 1, ...; blocks of the tied ones are -1, -2, ...
    across = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.struct(i.alias("i"), (-own - 1).alias("j")))
    among = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j")))
    every = F.when(F.col("ns") > 0, F.sequence(F.lit(0), F.col("ns") - 1)).otherwise(F.array().cast("array<int>"))
    with_tied = F.transform(every, lambda j: F.struct(own.alias("i"), (-j - 1).alias("j")))
    pairs = F.when(F.col("tied"), across).otherwise(F.concat(among, with_tied))
    return big.join(of, "rep").select("grp", "rep", "units", F.explode(pairs).alias("p")).select("grp", "rep", "units", F.col("grp").alias("g"), "p.i", "p.j")


def compare(similarity: float):
    """Exact comparison of all members of each candidate group in a table: rep and the first member of its class there."""

    def run(t: pa.Table) -> pa.Table:
        reps, grps, raw = t.column("rep").to_numpy(), t.column("grp").to_numpy(), t.column("units")
        order = np.lexsort((reps, grps))
        src, dst = [], []
        for own in np.split(order, np.flatnonzero(np.diff(grps[order])) + 1):
            own = own[np.unique(reps[own], return_index=True)[1]]
            if len(own) > 1:
                label = local_classes([np.frombuffer(raw[int(k)].as_buffer(), dtype=U) for k in own], similarity)
                far = label != np.arange(len(own))
                src.append(reps[own][far])
                dst.append(reps[own][label[far]])
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"src": np.concatenate(src) if src else none, "dst": np.concatenate(dst) if dst else none})

    return run


def verified_classes(docs: DataFrame, members: DataFrame, ties: DataFrame, doc_id: str, text: str, similarity: float, block: int, pivots: int = PIVOTS, per_lane: int = PER_LANE) -> DataFrame:
    """rep, class (a representative) for members with a verified link; the others are classes of their own."""
    shaped = materialize(unit_sets(docs, members, doc_id, text), "units")
    small, big = shaped.where(F.col("size") <= block), shaped.where(F.col("size") > block)
    check, edge = compare(similarity), "src long, dst long"
    bundles = max(1, small.count() // block)
    settled = small.select("grp", "rep", "units", F.pmod(F.xxhash64("grp"), F.lit(bundles)).alias("g")).groupBy("g").applyInArrow(check, edge)
    # In a small group every pair was compared, so the first member of a class names it.
    named = settled.select(F.col("src").alias("rep"), F.col("dst").alias("class")).unionByName(settled.select(F.col("dst").alias("rep"), F.col("dst").alias("class")).distinct())
    if big.isEmpty():
        out = materialize(named, "classes")
        release(shaped)
        return out
    named = materialize(named, "classes")
    linked = pivot_links(big, ties, similarity, pivots, per_lane)
    across = large_blocks(big, linked, block).groupBy("g", "i", "j").applyInArrow(check, edge)
    found = linked.select(F.col("rep").alias("src"), F.explode("linked").alias("dst")).unionByName(across)
    joined = connected_components(found, least=False).select(F.col("node").alias("rep"), F.col("component").alias("class"))
    release(shaped, linked)
    return named.unionByName(joined)


def near_rows(docs: DataFrame, doc_id: str, text: str, similarity: float, bands: int, rows: int, block: int) -> DataFrame:
    """doc, x1, x2, row and win (the same of the row that stays of its class) for every row."""
    sig = materialize(signatures(docs, doc_id, text, bands, rows), "signatures")
    own = F.struct("doc", "x1", "x2", "row")
    reps = materialize(sig.where("f1 is not null").groupBy("f1", "f2").agg(F.min(own).alias("best"), F.first("keys").alias("keys")).withColumn("rep", F.monotonically_increasing_id()), "reps")
    keyed = reps.select("rep", F.explode("keys").alias("key"))
    heads = materialize(keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "heads")
    tied = keyed.where(bloom_filter(heads, "key")(F.col("key")))
    ties = materialize(tied.join(heads.hint("merge"), "key").groupBy("rep").agg(F.sum("n").alias("score"), F.collect_set("pivot").alias("pivots")), "ties")
    groups = connected_components(ties.select("rep", F.explode("pivots").alias("pivot")).where("rep <> pivot"), "rep", "pivot", least=False).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size"))
    members = materialize(groups.join(sizes, "grp").join(reps.select("rep", "best.doc", "best.x1", "best.x2"), "rep"), "members")
    classes = verified_classes(docs, members, ties, doc_id, text, similarity, block)
    release(ties, heads, members)
    several = materialize(reps.select("rep", "best").join(classes, "rep"), "several")
    winners = several.groupBy("class").agg(F.min("best").alias("win"))
    won = several.join(winners, "class").select("rep", "win")
    of_set = reps.select("rep", "f1", "f2", "best").join(won, "rep", "left").select("f1", "f2", F.coalesce("win", "best").alias("win"))
    return sig.select(own.alias("own"), "f1", "f2").join(of_set, ["f1", "f2"], "left").select("own.*", F.coalesce("win", "own").alias("win"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), kept for every row."""
    found = near_rows(docs, doc_id, text, similarity, bands, rows, block)
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return found.select(known("doc").alias("doc_id"), known("win.doc").alias("class_id"), (F.col("row") == F.col("win.row")).alias("kept"))


def keep_first_of_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The documents, with their columns, that stay of their class."""
    found = near_rows(docs, doc_id, text, similarity, bands, rows, block).where(F.col("row") != F.col("win.row"))
    stays = F.struct("doc", "x1", "x2") == F.struct("win.doc", "win.x1", "win.x2")
    names = fresh(docs.columns, "doc", "x1", "x2", "again")
    # again: one of the repeated rows with this key stays; otherwise all go.
    gone = materialize(found.groupBy("doc", "x1", "x2").agg(F.max(stays).alias("again")).toDF(*names), "gone")
    key = [c.alias(n) for c, n in zip(text_key(text, doc_id), names)]
    held = bloom_filter(gone.select(F.xxhash64(*names[:3]).alias("key")), "key")
    marked, own = docs.select("*", *key), columns_of(docs)
    # Only the rows that may go are shuffled.
    asked = marked.where(held(F.xxhash64(*names[:3]))).join(gone.hint("merge"), names[:3], "left")
    out = marked.where(~held(F.xxhash64(*names[:3]))).select(*own).unionByName(asked.where(F.col(names[3]).isNull()).select(*own))
    if gone.where(F.col(names[3])).isEmpty():
        return out
    return out.unionByName(asked.where(F.col(names[3])).dropDuplicates(names[:3]).select(*own))
