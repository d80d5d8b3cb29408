"""Near-duplicate embeddings by lattice hashing.

Vectors of one label are compared by cosine. Each unit vector is projected to eight dimensions by a random Gaussian matrix,
once per table, and decoded to the nearest point of the E8 lattice; its cell is that point. A vector lies in its home cell
and probes the `probes` neighbouring cells that its projection is nearest to. Pairs that meet in a cell, at least one of
them at home there, are compared by exact cosine in double precision, in blocked matrix products.

Equal vectors are one representative (aggregated before the shuffle), with a number of its own, and counted by their number.
Cells with one vector are dropped on ids alone; a Bloom filter of the others spares the rest of the ids a shuffle. What then
meets in a cell is a sketch of 128 signs of further random projections: a vector stays only if it finds another one in the
cell within `SKETCH_BITS` differing signs, so whole vectors are shuffled to the cells of likely links alone. Of a pair at
the threshold 12 % of the signs differ; that more than SKETCH_BITS do has a probability below 1e-7. Cells above `block`
vectors are split into block pairs. A pair that meets in several cells counts only in the first one, which both rows tell
from their own cells, so each task gives one row per vector (links counted, spanning edge) and never a row per pair.

Defined cases: null labels, and vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of unlike length are not compared; every row is a vector of its own, whatever its id, so rows that share an id or
have none lose no link; null ids sort behind all others, and a component of such rows only has a null component_id; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, bloom_filter, materialize, release
from lodestone.operators.components import connected_components
from .minhash import mix

COSINE = 0.93
TABLES, PROBES, WIDTH = 12, 3, 1.1
BLOCK = 1024
SKETCH_BITS = 36
U = np.uint64


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: (+-1, +-1, 0^6) in all places and (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        s = np.array([1 - 2 * (m >> k & 1) for k in range(8)])
        if (s < 0).sum() % 2 == 0:
            out.append(s / 2)
    return np.array(out)


NEAR = minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.round(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        side = np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        r[odd, worst] += side
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


def cell_hash(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Names of lattice points; doubled coordinates are whole numbers."""
    out = salt.astype(U)
    with np.errstate(over="ignore"):
        for k in range(8):
            out = mix(out * U(0x9E3779B97F4A7C15) + np.round(2 * points[..., k]).astype(np.int64).view(U))
    return out


def cells(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = 3) -> np.ndarray:
    """[vectors, tables, 1 + probes] names of the home cell and the probed ones."""
    n, dims = unit.shape
    rng = np.random.default_rng([seed, dims])
    out = np.empty((n, tables, 1 + probes), dtype=U)
    with np.errstate(over="ignore"):
        salt = mix(labels.astype(np.int64).view(U) * U(0xD6E8FEB86659FD93) + U(dims))
    for t in range(tables):
        proj, shift = rng.normal(size=(dims, 8)) / width, rng.random(8)
        x = unit @ proj + shift
        home = nearest_e8(x)
        with np.errstate(over="ignore"):
            own = mix(salt + U(t + 1))
        out[:, t, 0] = cell_hash(home, own)
        if probes:
            gain = (x - home) @ NEAR.T
            best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
            for p in range(probes):
                out[:, t, 1 + p] = cell_hash(home + NEAR[best[:, p]], own)
    return out


def sketches(unit: np.ndarray, seed: int = 5) -> np.ndarray:
    """[vectors, 2] words of the signs of 128 random projections."""
    side = np.random.default_rng([seed, unit.shape[1]]).normal(size=(unit.shape[1], 128))
    return np.packbits(unit @ side > 0, axis=1).view(U)


def likely(cell: np.ndarray, rep: np.ndarray, home: np.ndarray, block: np.ndarray | None, words: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Rows that find another row of their cell within `bits` signs, one of the two at home there; with `block`, in another block.
    Cells of one size are judged together."""
    out = np.zeros(len(cell), dtype=bool)
    if not len(cell):
        return out
    order = np.lexsort((rep, cell))
    starts = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1])))
    sizes = np.diff(np.append(starts, len(order)))
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == n]
        step = max(1, 4_000_000 // (n * n))
        for a in range(0, len(at), step):
            k = order[at[a : a + step, None] + np.arange(n)[None, :]]
            far = np.zeros((len(k), n, n), dtype=np.uint8)
            for w in range(words.shape[1]):
                far += np.bitwise_count(words[k, w][:, :, None] ^ words[k, w][:, None, :])
            near = far <= bits
            near[:, np.arange(n), np.arange(n)] = False
            near &= home[k][:, :, None] | home[k][:, None, :]
            if block is not None:
                near &= block[k][:, :, None] != block[k][:, None, :]
            out[k[near.any(axis=2)]] = True
    return out


def matching(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first cell, in table order, in which each pair of rows of [n, tables, cells] meets; 0 if none."""
    out = np.zeros(len(a), dtype=U)
    open_ = np.ones(len(a), dtype=bool)
    for t in range(a.shape[1]):
        ha, hb = a[:, t, 0], b[:, t, 0]
        in_b = (b[:, t, :] == ha[:, None]).any(axis=1)
        in_a = (a[:, t, :] == hb[:, None]).any(axis=1)
        big = U(0xFFFFFFFFFFFFFFFF)
        cell = np.minimum(np.where(in_b, ha, big), np.where(in_a, hb, big))
        hit = open_ & (in_a | in_b)
        out[hit] = cell[hit]
        open_ &= ~hit
        if not open_.any():
            break
    return out


def usable(c: str) -> F.Column:
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(c).isNotNull() & ~bad & F.exists(c, lambda x: x != 0)


def link_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE,
    tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.coalesce(F.col(vec_id).cast("long"), F.lit(LAST_ID)).alias("vec"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("x"))
    # Equal vectors: two 64-bit hashes and the label name them.
    named = rows.withColumn("ok", F.coalesce(usable("x") & F.col("label").isNotNull(), F.lit(False)))
    named = named.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "x")), "h2": F.when(F.col("ok"), F.xxhash64(F.lit(1), "label", "x"))})
    ids = materialize(named.select("vec", "h1", "h2"), "vector-ids")
    alike = named.where("ok").groupBy("h1", "h2").agg(F.min("vec").alias("vec"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("x").alias("x"))
    shape = dict(tables=tables, probes=probes, width=width)
    own = [("h1", pa.int64()), ("h2", pa.int64()), ("vec", pa.int64()), ("copies", pa.int64())]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*own, ("s1", pa.int64()), ("s2", pa.int64()), ("unit", pa.binary()), ("cells", pa.list_(pa.int64()))])
        for batch in batches:
            xs, label_ = batch.column("x").to_pylist(), batch.column("label").to_numpy()
            unit, found, signs = [b""] * len(xs), [None] * len(xs), np.zeros((len(xs), 2), dtype=np.int64)
            for dims in {len(x) for x in xs}:
                at = [i for i, x in enumerate(xs) if len(x) == dims]
                m = np.array([xs[i] for i in at], dtype=np.float64)
                m /= np.abs(m).max(axis=1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                c = cells(m, label_[at], **shape).reshape(len(at), -1).view(np.int64)
                signs[at] = sketches(m).view(np.int64)
                for k, i in enumerate(at):
                    unit[i], found[i] = m[k].tobytes(), c[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k, _ in own], pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy()), pa.array(unit, pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    made = alike.mapInArrow(keys, "h1 long, h2 long, vec long, copies long, s1 long, s2 long, unit binary, cells array<long>")
    reps = materialize(made.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    each = reps.select("rep", "s1", "s2", F.posexplode("cells").alias("pos", "cell")).select("rep", "cell", (F.col("pos") % (1 + probes) == 0).alias("home"), "s1", "s2")
    busy = materialize(each.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where("n > 1 and homes > 0").select("cell", "n"), "cells")
    meet = each.where(bloom_filter(busy, "cell")(F.col("cell"))).join(busy.hint("merge"), "cell")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j")))).alias("p")

    def dealt(rows: DataFrame, bundles: int) -> DataFrame:
        """Rows by cell and block pair; cells of one block share groups, so that there are not as many groups as cells."""
        group = F.when(F.col("n") <= block, F.pmod(F.xxhash64("cell"), F.lit(bundles))).otherwise(F.col("cell"))
        return rows.withColumn("own", mine).select("*", pairs).select("*", "p.*").drop("p").withColumn("grp", group).withColumn("one", F.col("n") <= block)

    def sift(t: pa.Table) -> pa.Table:
        lo, hi = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        cell, rep, blk = (t.column(k).to_numpy() for k in ("cell", "rep", "own"))
        words = np.column_stack([t.column(k).to_numpy() for k in ("s1", "s2")]).view(U)
        keep = likely(cell, rep, t.column("home").to_numpy(zero_copy_only=False), blk if lo != hi else None, words)
        return t.filter(pa.array(keep)).select(["cell", "n", "home", "rep"])

    bundles = max(1, reps.count() * tables // (8 * block))
    sifted = dealt(meet, bundles).groupBy("grp", "one", "i", "j").applyInArrow(sift, "cell long, n long, home boolean, rep long")
    links = materialize(sifted.groupBy("cell", "rep").agg(F.max("n").alias("n"), F.max("home").alias("home")), "meetings")
    whole = links.join(reps.select("rep", "copies", "unit", "cells").hint("merge"), "rep")
    exact = dealt(whole, max(1, links.count() // block))

    def compare(t: pa.Table) -> pa.Table:
        cell, rep, copies, home, blk = (t.column(k).to_numpy(zero_copy_only=False) if k == "home" else t.column(k).to_numpy() for k in ("cell", "rep", "copies", "home", "own"))
        lo, hi = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        unit_raw, cells_raw = t.column("unit").to_pylist(), t.column("cells")
        all_cells = np.asarray(cells_raw.combine_chunks().flatten()).view(U).reshape(len(rep), tables, 1 + probes)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        order = np.lexsort((rep, cell))
        for own_ in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
            for size in {len(unit_raw[k]) for k in own_}:
                k = own_[np.array([len(unit_raw[x]) == size for x in own_])]
                if len(k) > 1:
                    m = np.stack([np.frombuffer(unit_raw[x], dtype=np.float64) for x in k])
                    near = np.triu(m @ m.T >= cosine, 1)
                    at_home = home[k]
                    near &= at_home[:, None] | at_home[None, :]
                    if lo != hi:
                        near &= blk[k][:, None] != blk[k][None, :]
                    a, b = np.nonzero(near)
                    if len(a):
                        first = np.concatenate([matching(all_cells[k[a[s : s + 50_000]]], all_cells[k[b[s : s + 50_000]]]) for s in range(0, len(a), 50_000)])
                        mine = first == cell[k[0]].astype(np.int64).view(U)
                        a, b = a[mine], b[mine]
                    if len(a):
                        links = np.bincount(a, weights=copies[k[b]], minlength=len(k)) + np.bincount(b, weights=copies[k[a]], minlength=len(k))
                        label_ = np.arange(len(k))
                        while True:
                            new = label_.copy()
                            np.minimum.at(new, a, label_[b])
                            np.minimum.at(new, b, label_[a])
                            new = new[new]
                            if (new == label_).all():
                                break
                            label_ = new
                        got = links > 0
                        out.append((rep[k][got], rep[k][label_[got]], links[got].astype(np.int64)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 3
        return pa.table(dict(zip(("rep", "root", "links"), cols)))

    found = materialize(exact.groupBy("grp", "one", "i", "j").applyInArrow(compare, "rep long, root long, links long"), "links")
    release(busy, links)
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named_by = connected_components(found, "rep", "root", least=False).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    several = materialize(reps.select("rep", "vec").join(named_by, "rep").join(counted, "rep", "left"), "linked")
    least = several.groupBy("comp").agg(F.min("vec").alias("component"))
    per_rep = reps.select("rep", "h1", "h2", "vec", "copies").join(several.join(least, "comp").select("rep", "links", "component"), "rep", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "vec").alias("component")
    )
    full = ids.join(per_rep, ["h1", "h2"], "left")
    comp = F.coalesce("component", "vec")
    return full.select(
        F.when(F.col("vec") != LAST_ID, F.col("vec")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(comp != LAST_ID, comp).alias("component_id"), (comp == F.col("vec")).alias("kept"),
    )
