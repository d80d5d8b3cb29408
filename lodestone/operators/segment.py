"""Word segmentation for languages whose words hold spaces: a unit is one to three syllables, learnt from counts.

Learning is an aggregate: runs of one to three syllables of every text are counted, and a longer run is a unit if it is frequent
and its syllables attract each other (the log of its count against what independent parts would give, for its best split into
two). The most frequent units, up to a bound, and the log of their shares are the model, which is sent to the tasks. A text is
cut by a Viterbi pass over its syllables: of all ways to cut it into known units and single syllables, the likeliest.

Syllables are runs of letters, digits and underscores in lower case; units do not cross other signs but blanks. Every character
of a text stays: the segmented text differs from the text only by underscores in place of the blanks inside units.

Defined cases: null texts give null; texts without a syllable stay as they are; ties go to the longer unit at the end; an empty
corpus has an empty model, under which every syllable is a unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import small_batches, spread

#: Longest unit in syllables, units of a model at most (about 100 bytes each in a task), least count of a unit, least attraction.
LONGEST, MAX_UNITS, LEAST, ATTRACTION = 3, 200_000, 5, 3.0
#: Bytes of text that are counted at once in a task.
CHUNK = 4 << 20
#: What ends a run of syllables: all but letters, digits, underscores and blanks.
OTHER = r"[^\p{L}\p{N}_ ]+"
PY_SYLLABLE = re.compile(r"\w+")
PY_RUN, PY_BLANKS = re.compile(r"\w+(?: +\w+)*"), re.compile(" +")


def syllable_runs(text: Column) -> Column:
    """Arrays of runs between other signs: syllables with blanks between them."""
    return F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), OTHER), lambda r: F.trim(r)), lambda r: r != "")


def counted(runs: pa.Array, longest: int) -> Iterator[pa.RecordBatch]:
    """unit, n, count of the runs of one to `longest` syllables in an array of strings, a batch for each length."""
    lists = pc.split_pattern_regex(runs, " +")
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    code, syllables = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    at, ids = np.arange(len(code)), np.zeros(len(code), dtype=np.int64)
    for n in range(1, longest + 1):
        inside = at + n - 1 < len(code)
        at, ids = at[inside], ids[inside]
        same = owner[at] == owner[at + n - 1]
        at, ids = at[same], ids[same]
        # Runs get numbers of their own at each length, so that a number is below the product of two counts of syllables.
        _, first, ids, counts = np.unique(ids * len(syllables) + code[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        parts = [syllables.take(pa.array(code[at[first] + k])) for k in range(n)]
        unit = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
        yield pa.RecordBatch.from_arrays([unit, pa.array(np.full(len(first), n, dtype=np.int32)), pa.array(counts.astype(np.int64))], names=["unit", "n", "count"])


def run_counts(df: DataFrame, text: str, longest: int = LONGEST) -> DataFrame:
    """unit (syllables joined by one space), n (syllables), count: all runs of one to `longest` syllables. Counting begins inside the
    tasks, in blocks of about CHUNK bytes of text, so a frequent syllable is one row a task."""
    small_batches(df.sparkSession)
    rows = spread(df.select(text)).select(syllable_runs(F.col(text)).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column("runs").flatten())
            size += held[-1].nbytes
            if size >= CHUNK:
                yield from counted(pa.concat_arrays(held), longest)
                held, size = [], 0
        if size:
            yield from counted(pa.concat_arrays(held), longest)

    each = rows.mapInArrow(run, "unit string, n int, count long")
    return each.groupBy("unit", "n").agg(F.sum("count").alias("count"))


def learnt_units(counts: DataFrame, least: int = LEAST, attraction: float = ATTRACTION, most: int | None = None) -> DataFrame:
    """unit, n, count, score of the units: every frequent syllable, and every frequent run whose best split into two is still
    unlikely by chance. If `most` is given, that many of the most frequent ones at most."""
    known = counts.where(F.col("count") >= least)
    total = counts.where("n = 1").agg(F.sum("count").cast("double").alias("total"))
    words = F.split("unit", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), " ").alias("a"), F.array_join(F.slice(words, i + 1, F.col("n") - i), " ").alias("b")))
    longer = known.where("n > 1").withColumn("cut", F.explode(cuts)).select("unit", "n", "count", "cut.*")
    part = lambda c: known.select(F.col("unit").alias(c), F.col("count").alias(f"n_{c}"))
    met = longer.join(part("a"), "a").join(part("b"), "b").join(F.broadcast(total))
    score = F.log(F.col("count") * F.col("total") / (F.col("n_a") * F.col("n_b")))
    best = met.groupBy("unit", "n", "count").agg(F.min(score).alias("score")).where(F.col("score") >= attraction)
    single = known.where("n = 1").withColumn("score", F.lit(0.0))
    units = single.unionByName(best)
    return units if most is None else units.orderBy(F.desc("count"), "unit").limit(most)


@dataclass
class Model:
    """Log shares of units, and that of a syllable that is none."""

    share: dict[str, float]
    unknown: float
    longest: int

    def cut(self, syllables: list[str]) -> list[int]:
        """Lengths (in syllables) of the units of the likeliest cut."""
        n, get, unknown = len(syllables), self.share.get, self.unknown
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            unit = syllables[end - 1]
            top, size = best[end - 1] + get(unit, unknown), 1
            for more in range(2, min(self.longest, end) + 1):
                unit = f"{syllables[end - more]} {unit}"
                share = get(unit)
                if share is not None and best[end - more] + share >= top:
                    top, size = best[end - more] + share, more
            best[end], back[end] = top, size
        out = []
        while n:
            out.append(back[n])
            n -= back[n]
        return out[::-1]


def load_model(units: DataFrame, longest: int = LONGEST, most: int = MAX_UNITS) -> Model:
    """The model of the `most` most frequent of the learnt units."""
    rows = units.select("unit", "count").orderBy(F.desc("count"), "unit").limit(most).collect()
    total = float(sum(r["count"] for r in rows)) or 1.0
    return Model({r["unit"]: log(r["count"] / total) for r in rows}, log(0.5 / total), longest)


def segmented(model: Model, text: str) -> tuple[str, list[str]]:
    """The text with underscores inside units, and its units in lower case."""
    pieces, units, end = [], [], 0
    for m in PY_RUN.finditer(text):
        run = m.group()
        signs, syllables = PY_BLANKS.split(run), PY_BLANKS.split(run.lower())
        gaps = PY_BLANKS.findall(run)
        pieces.append(text[end : m.start()])
        end, at = m.end(), 0
        for size in model.cut(syllables):
            if size == 1:
                units.append(syllables[at])
                pieces.append(signs[at])
            else:
                units.append("_".join(syllables[at : at + size]))
                for k in range(at, at + size - 1):
                    pieces += (signs[k], "_" * len(gaps[k]))
                pieces.append(signs[at + size - 1])
            at += size
            if at < len(signs):
                pieces.append(gaps[at - 1])
    pieces.append(text[end:])
    return "".join(pieces), units


def with_segments(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds segmented (text) and units (array)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("segmented string, units array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [(None, None) if t is None else segmented(shared.value, t) for t in batch]
            yield pd.DataFrame({"segmented": [r[0] for r in rows], "units": [r[1] for r in rows]}, dtype=object)

    return df.withColumn("__cut", cut(text)).select(*df.columns, "__cut.segmented", "__cut.units")
