"""Error rates of many score columns of the same rows (a grid of formulas, a curve of weights) without exploding the rows.

A task computes the columns of its rows in blocks and leaves counts a (column, code, label, bucket); the code is a row's
family or part. Counts tell where the two error rates of a column cross. After that either only the scores of crossing
buckets move (``eer_by_code``), or all scores once, cut into ranges of some rows each (``ranked``), for what needs their order.

``columns(rows)`` yields (number, scores, labels, picked rows or None) for a batch with the input's columns. A missing score
ranks below all others, as NULL does in an ORDER BY score DESC. If it has ``some(numbers)``, giving the function of some numbers,
and ``reads``, the names of what that one reads, a pass over a few columns computes and reads no others.

Scores move in passes of a few columns each, whose shuffle files go before the next pass: what lies on disk at once is some
bytes a row, whatever the number of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, shuffles_removed
from . import crossing as C
from .prefix import join_back

Columns = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray, np.ndarray, "np.ndarray | None"]]]

OCTAVES = 15  # buckets halve towards 0 and 1 down to 2^-16
CELL_LIMIT = 8_000_000  # counts a task holds at once
CHUNK_ROWS = 65_536  # rows whose scores leave a task together
RANGE_ROWS = 250_000  # rows of a column that are ordered together
PASS_COLUMNS = 16  # columns whose scores move in one pass, at least
PASS_BYTES = 256 << 20  # of scores that move in one pass; on large tables the columns above are more


def n_buckets(steps: int) -> int:
    return 2 * OCTAVES * steps + 2


def bucket(score: np.ndarray, steps: int) -> np.ndarray:
    """Ordered buckets, ``steps`` (a power of two) an octave from 0 and 1 to the middle: whole-number work on the bits of the
    score, so that the same score gets the same bucket everywhere and a higher one never a lower bucket."""
    shift = 52 - (steps.bit_length() - 1)
    near = np.fmax(np.minimum(score, 1.0 - score), 2.0**-16)
    k = (near.view(np.int64) >> shift) - (np.float64(2.0**-16).view(np.int64) >> shift)
    return np.where(score < 0.5, k, n_buckets(steps) - 1 - k)


def rounded(score: np.ndarray, places: int | None) -> np.ndarray:
    """As Spark's round: half up on the shortest decimal form. Only what lies at a half takes the way through that form."""
    if places is None:
        return score
    with np.errstate(invalid="ignore"):
        y = np.abs(score) * 10.0**places
        out = np.copysign(np.floor(y + 0.5) / 10.0**places, score)
        at = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-5)
    if len(at):
        values, back = np.unique(score[at], return_inverse=True)
        unit = Decimal(1).scaleb(-places)
        out[at] = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) for v in values])[back]
    return out


def _ready(score: np.ndarray, places: int | None) -> np.ndarray:
    s = rounded(score, places)
    return np.where(np.isnan(s), -np.inf, s)


def floats(rows: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles, NULL as NaN."""
    return np.array(rows.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)


def _codes(rows: pa.RecordBatch, code: str) -> tuple[np.ndarray, list]:
    """Numbers of the rows' codes and the codes themselves; NULL is a code, too."""
    d = rows.column(code).cast(pa.string()).dictionary_encode()
    names = d.dictionary.to_pylist()
    return d.indices.fill_null(len(names)).to_numpy(zero_copy_only=False).astype(np.int64), [*names, None]


def some(df: DataFrame, columns: Columns, numbers: Sequence[int], keep: Sequence[str]) -> tuple[DataFrame, Columns]:
    """The function of some numbers, and the table with the columns it reads and those to keep."""
    if hasattr(columns, "some"):
        mine = columns.some(numbers)
        return df.select(*dict.fromkeys([*keep, *mine.reads])), mine
    wanted = set(numbers)
    return df, lambda rows: (c for c in columns(rows) if c[0] in wanted)


def passes(n_columns: int, rows: int) -> list[range]:
    """The columns of each pass over so many rows."""
    width = max(PASS_COLUMNS, PASS_BYTES // (9 * max(rows, 1)))
    return [range(a, min(a + width, n_columns)) for a in range(0, n_columns, width)]


def bucket_counts(df: DataFrame, code: str, columns: Columns, n_columns: int, steps: int, places: int | None = None) -> DataFrame:
    """(col, code, label, _b, n): rows of a column by code, label and bucket."""
    size = n_buckets(steps)

    def emit(names: list, counts: np.ndarray):
        at = np.flatnonzero(counts)
        n = counts.ravel()[at]
        who, col, label, b = np.unravel_index(at, counts.shape)
        for i in range(0, len(at), 100_000):
            cut = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(col[cut].astype(np.int32)), pa.array([names[k] for k in who[cut]], pa.string()), pa.array(label[cut].astype(np.int32)),
                pa.array(b[cut].astype(np.int32)), pa.array(n[cut])], names=["col", "code", "label", "_b", "n"])

    def run(batches):
        seen: dict = {}
        counts = np.zeros((0, n_columns, 2, size), np.int64)
        for rows in batches:
            if not rows.num_rows:
                continue
            local, names = _codes(rows, code)
            used = np.unique(local)
            new = sorted({names[k] for k in used} - set(seen), key=lambda x: (x is not None, x))
            if seen and (len(seen) + len(new)) * n_columns * 2 * size > CELL_LIMIT:
                yield from emit(list(seen), counts)
                seen, counts = {}, counts[:0]
                new = sorted({names[k] for k in used}, key=lambda x: (x is not None, x))
            for x in new:
                seen[x] = len(seen)
            if new:
                counts = np.concatenate([counts, np.zeros((len(new), n_columns, 2, size), np.int64)])
            lookup = np.array([seen.get(x, -1) for x in names], np.int64)
            base = lookup[local] * 2 * size
            for k, score, label, pick in columns(rows):
                place = (base if pick is None else base[pick]) + label * size + bucket(_ready(score, places), steps)
                counts[:, k] += np.bincount(place, minlength=len(seen) * 2 * size).reshape(-1, 2, size)
        if seen:
            yield from emit(list(seen), counts)

    parts = df.mapInArrow(run, "col int, code string, label int, _b int, n long")
    return parts.groupBy("col", "code", "label", "_b").agg(F.sum("n").alias("n"))


def classes(n: str = "n") -> tuple[Column, Column]:
    return tuple(F.sum(F.when(F.col("label") == y, F.col(n)).otherwise(0)).alias(c) for y, c in ((1, "pos"), (0, "neg")))


def eer_by_code(df: DataFrame, code: str, columns: Columns, n_columns: int, steps: int = 64, places: int | None = None) -> DataFrame:
    """(col, code, eer) of the rows of each code; NULL with one class only."""
    k = ["col", "code"]
    counts = materialize(bucket_counts(df, code, columns, n_columns, steps, places).groupBy(*k, "_b").agg(*classes()), "column-counts")
    cross = materialize(C.crossing_bucket(C.running(counts, k), k), "column-crossings")
    # one number a (column, code)
    at = {(r["col"], r["code"]): r["_b"] for r in cross.select(*k, "_b").collect()}

    def run(batches):
        for rows in batches:
            local, names = _codes(rows, code)
            cols, who, scores, labels = [], [], [], []
            for c, score, label, pick in columns(rows):
                s = _ready(score, places)
                mine = local if pick is None else local[pick]
                want = np.array([at.get((c, x), -1) for x in names], np.int64)
                near = np.flatnonzero(want[mine] == bucket(s, steps))
                cols.append(np.full(len(near), c, np.int32)), who.append(mine[near]), scores.append(s[near]), labels.append(label[near])
            if not cols:
                continue
            key = np.concatenate(who)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(cols)), pa.array(names, pa.string()).take(pa.array(key)), pa.array(np.concatenate(scores)),
                pa.array(np.concatenate(labels).astype(np.int32))], names=["col", "code", "score", "label"])

    near = df.mapInArrow(run, "col int, code string, score double, label int").groupBy(*k, "score").agg(*C.class_counts())
    found = C.best_point(join_back(near, cross.drop("_b"), k), k)
    return join_back(counts.select(*k).distinct(), found, k, "left")


def _ranges(counts: DataFrame) -> DataFrame:
    """(col, _b, _r): ranges of buckets with some RANGE_ROWS rows, counted down from 0 at the highest scores."""
    above = Window.partitionBy("col").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = counts.groupBy("col", "_b").agg(F.sum("n").alias("n"))
    return per.select("col", "_b", (-F.floor(F.coalesce(F.sum("n").over(above), F.lit(0)) / RANGE_ROWS)).cast("int").alias("_r"))


def _starts(per: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts before each range of all rows, and of each family in the range in which it crosses; the sums of all rows."""
    from .crossing import crossing_bucket, running

    total = running(per.groupBy("col", "_r").agg(*classes()), ["col"], "_r")
    own = crossing_bucket(total, ["col"], "_r").select("col", F.col("_r").alias("_x"))
    whole = join_back(total, own, ["col"], "left").select(
        "col", "_r", F.lit(None).cast("string").alias("fam"), F.lit(True).alias("whole"), F.coalesce(F.col("_r") == F.col("_x"), F.lit(False)).alias("crosses"), "tp0", "fp0", "n_pos", "n_neg")
    zero = F.lit(0).cast("long")
    fakes = per.where("label = 1").groupBy("col", "code", "_r").agg(F.sum("n").alias("pos"))
    reals = total.select("col", "_r", zero.alias("pos"), "neg").where("neg > 0")
    families = fakes.select("col", "code").distinct()
    axis = join_back(families, reals, ["col"]).select("col", "code", "_r", "pos", "neg").unionByName(fakes.withColumn("neg", zero))
    both = axis.groupBy("col", "code", "_r").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    k = ["col", "code"]
    each = crossing_bucket(running(both, k, "_r"), k, "_r").select(
        "col", "_r", F.col("code").alias("fam"), F.lit(False).alias("whole"), F.lit(True).alias("crosses"), "tp0", "fp0", "n_pos", "n_neg")
    return whole.unionByName(each), total


def _dealt(df: DataFrame, code: str, columns: Columns, ranges: DataFrame, steps: int, places: int | None, reals: bool = False) -> DataFrame:
    """(col, _r, scores, who, names): every score once, packed by the range it lies in; who is the place of a fake's code among
    the names and -1 for a real row, or with ``reals`` twice the place of any row's code plus its label."""
    # a few numbers a column: the lowest bucket of each range
    lowest: dict = {}
    for r in ranges.groupBy("col", "_r").agg(F.min("_b").alias("low")).collect():
        lowest.setdefault(r["col"], []).append((r["low"], r["_r"]))
    cuts = {c: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for c, v in lowest.items()}

    def chunks(batches):
        held, n = [], 0
        for rows in batches:
            held.append(rows)
            n += rows.num_rows
            if n >= CHUNK_ROWS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def deal(batches):
        for rows in chunks(batches):
            local, names = _codes(rows, code)
            out: list[tuple] = []
            for c, score, label, pick in columns(rows):
                s = _ready(score, places)
                mine = local if pick is None else local[pick]
                who = (2 * mine + label if reals else np.where(label == 1, mine, -1)).astype(np.int8 if len(names) < 64 else np.int32)
                low, number = cuts[c]
                at = np.searchsorted(low, bucket(s, steps), side="right") - 1
                order = np.argsort(at, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    out.append((c, int(number[at[part[0]]]), s[part].tobytes(), who[part].tobytes(), names))
                if len(out) >= 64:
                    yield dealt(out)
                    out = []
            if out:
                yield dealt(out)

    def dealt(out):
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["col", "_r", "scores", "who", "names"])

    return df.mapInArrow(deal, "col int, _r int, scores binary, who binary, names array<string>")


def _who(who: bytes, names: list) -> np.ndarray:
    return np.frombuffer(who, np.int8 if len(names) < 64 else np.int32).astype(np.int64)


def ranked(df: DataFrame, family: str, columns: Columns, n_columns: int, steps: int = 8, places: int | None = None,
           edges: Sequence[float] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of every column: the summary of all rows, the EER of all reals against each family's fakes, and score bounds.

    Summary (col, n_files, n_real, n_fake, eer, roc_auc, tie_rate, distinct_score_ratio), families (col, family, eer), bounds
    (col, edge, bound): the highest score at which the difference of the error rates has passed an edge. Each score moves
    once, together with the others of its range, and is ordered there.
    """
    with shuffles_removed(df.sparkSession):
        return _ranked(df, family, columns, n_columns, steps, places, edges)


def _ranked(df: DataFrame, family: str, columns: Columns, n_columns: int, steps: int, places: int | None, edges: Sequence[float]):
    counts = materialize(bucket_counts(df, family, columns, n_columns, steps, places), "column-counts")
    ranges = materialize(_ranges(counts), "column-ranges")
    per = materialize(join_back(counts, ranges, ["col", "_b"]).groupBy("col", "code", "label", "_r").agg(F.sum("n").alias("n")), "range-counts")
    starts, total = _starts(per)
    starts = materialize(starts, "range-starts")
    rows = per.groupBy("col").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0

    kinds = "col int, fam string, whole boolean, eer double, wins long, tied long, distinct long, bounds array<struct<edge:int,bound:double>>"

    def settle(key, left: pa.Table, right: pa.Table) -> pa.Table:
        number: dict = {}
        scores, who = [], []
        for s, w, names in zip(left.column("scores").to_pylist(), left.column("who").to_pylist(), left.column("names").to_pylist()):
            scores.append(np.frombuffer(s, np.float64))
            lookup = np.array([*[number.setdefault(x, len(number)) for x in names], -1], np.int64)
            who.append(lookup[_who(w, names)])
        flat, fam = np.concatenate([np.zeros(0), *scores]), np.concatenate([np.zeros(0, np.int64), *who])
        order = np.argsort(-flat, kind="stable")
        flat, fam = flat[order], fam[order]
        edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        sums = lambda mask: np.add.reduceat(mask.astype(np.int64), edge) if len(edge) else np.zeros(0, np.int64)
        pos, neg = sums(fam >= 0), sums(fam < 0)
        fp, size = np.cumsum(neg), pos + neg
        out = []
        for r in right.to_pylist():
            tp = np.cumsum(pos if r["whole"] else sums(fam == number.get(r["fam"], -2)))
            eer, found = None, []
            if r["n_pos"] and r["n_neg"]:
                fpr, fnr = (r["fp0"] + fp) / r["n_neg"], 1.0 - (r["tp0"] + tp) / r["n_pos"]
                first = (r["fp0"] / r["n_neg"], 1.0 - r["tp0"] / r["n_pos"])
                if r["crosses"]:
                    gap = np.abs(fpr - fnr)
                    i = int(gap.argmin()) if len(gap) else 0
                    eer = (fpr[i] + fnr[i]) / 2.0 if len(gap) and gap[i] < abs(first[0] - first[1]) else (first[0] + first[1]) / 2.0
                if r["whole"]:
                    d, before = fpr - fnr, first[0] - first[1] if r["tp0"] or r["fp0"] else -np.inf
                    for k, e in enumerate(edges):
                        if before < e and len(d) and d[-1] >= e:
                            found.append(dict(edge=k, bound=float(flat[edge[np.searchsorted(d, e)]])))
            every = r["whole"]
            out.append((key[0].as_py(), r["fam"], every, eer, int((pos * (2 * (fp[-1] - fp) + neg)).sum()) if every and len(fp) else 0,
                        int(size[size > 1].sum()) if every else 0, len(edge) if every else 0, found))
        kinds = (pa.int32(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("edge", pa.int32()), ("bound", pa.float64())])))
        names = ["col", "fam", "whole", "eer", "wins", "tied", "distinct", "bounds"]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, kinds))})

    path = scratch_path(df.sparkSession, "column-ranks")
    for numbers in passes(n_columns, rows):
        here = F.col("col").between(numbers[0], numbers[-1])
        table, mine = some(df, columns, numbers, [family])
        moved = _dealt(table, family, mine, ranges.where(here), steps, places)
        found = moved.groupBy("col", "_r").cogroup(starts.where(here).groupBy("col", "_r")).applyInArrow(settle, kinds)
        found.write.mode("append").parquet(path)
    done = df.sparkSession.read.schema(kinds).parquet(path)
    # twice the pairs won, as whole numbers: inside the ranges, and between them from the counts
    inside = done.where("whole").groupBy("col").agg(F.max("eer").alias("eer"), F.sum("wins").alias("_in"), F.sum("tied").alias("_tied"), F.sum("distinct").alias("_distinct"))
    across = total.groupBy("col").agg(
        F.sum("pos").alias("n_fake"), F.sum("neg").alias("n_real"), F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp0") - F.col("neg"))).alias("_out"))
    both = (F.col("n_real") > 0) & (F.col("n_fake") > 0)
    n = F.col("n_fake") + F.col("n_real")
    wins = F.col("_out").cast("double") + F.col("_in") / 2.0
    summary = join_back(across, inside, ["col"]).select(
        "col", n.alias("n_files"), "n_real", "n_fake", "eer", F.when(both, F.try_divide(wins, F.col("n_fake").cast("double") * F.col("n_real"))).alias("roc_auc"),
        (F.col("_tied") / n).alias("tie_rate"), (F.col("_distinct") / n).alias("distinct_score_ratio"))
    families = join_back(per.where("label = 1").select("col", F.col("code").alias("fam")).distinct(), done.where("NOT whole").select("col", "fam", "eer"), ["col", "fam"], "left")
    bounds = done.where("whole").select("col", F.explode("bounds").alias("e")).select("col", "e.*")
    return summary, families.withColumnRenamed("fam", "family"), bounds


def sliced(df: DataFrame, code: str, slices: Column, names: Sequence[str], columns: Columns, n_columns: int, steps: int = 8,
           places: int | None = None) -> DataFrame:
    """(names, col, n_files, n_real, n_fake, eer, roc_auc) of every column in every slice of the rows.

    ``slices`` is an array of structs with the fields ``names``, as an expression of the code: the slices rows of this code
    belong to. Each score moves once, whatever the number of slices; a range of scores is ordered once and read for each slice.
    """
    counts = materialize(bucket_counts(df, code, columns, n_columns, steps, places), "column-counts")
    ranges = materialize(_ranges(counts), "column-ranges")
    k = [*names, "col"]
    per = join_back(counts, ranges, ["col", "_b"]).groupBy("col", "code", "label", "_r").agg(F.sum("n").alias("n"))
    per = materialize(per.select("*", F.explode(slices).alias("s")).select("col", "code", "label", "_r", "n", "s.*"), "slice-counts")
    total = C.running(per.groupBy(*k, "_r").agg(*classes()), k, "_r")
    own = C.crossing_bucket(total, k, "_r").select(*k, F.col("_r").alias("_x"))
    members = per.groupBy(*names).agg(F.collect_set(F.struct("code")).alias("codes"))
    starts = join_back(join_back(total, own, k, "left"), members, names).select(
        *k, "_r", "codes.code", F.coalesce(F.col("_r") == F.col("_x"), F.lit(False)).alias("crosses"), "tp0", "fp0", "n_pos", "n_neg")
    starts = materialize(starts, "slice-starts")

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        number: dict = {}
        scores, who = [], []
        for s, w, found in zip(left.column("scores").to_pylist(), left.column("who").to_pylist(), left.column("names").to_pylist()):
            scores.append(np.frombuffer(s, np.float64))
            lookup = np.array([number.setdefault(x, len(number)) for x in found], np.int64)
            w = _who(w, found)
            who.append(2 * lookup[w >> 1] + (w & 1))
        flat, row = np.concatenate([np.zeros(0), *scores]), np.concatenate([np.zeros(0, np.int64), *who])
        order = np.argsort(-flat, kind="stable")
        flat, row = flat[order], row[order]
        place = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1 if len(flat) else row
        out = []
        for r in right.to_pylist():
            mine = np.zeros(max(len(number), 1), bool)
            mine[[number[x] for x in r["code"] if x in number]] = True
            at = np.flatnonzero(mine[row >> 1])
            fake, here = row[at] & 1, place[at]
            edge = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])) if len(here) else here
            pos, size = (np.add.reduceat(fake, edge), np.diff(np.append(edge, len(here)))) if len(edge) else (edge, edge)
            neg = size - pos
            tp, fp = np.cumsum(pos), np.cumsum(neg)
            eer = None
            if r["crosses"]:
                fpr, fnr = (r["fp0"] + fp) / r["n_neg"], 1.0 - (r["tp0"] + tp) / r["n_pos"]
                first = (r["fp0"] / r["n_neg"], 1.0 - r["tp0"] / r["n_pos"])
                gap = np.abs(fpr - fnr)
                i = int(gap.argmin()) if len(gap) else 0
                eer = (fpr[i] + fnr[i]) / 2.0 if len(gap) and gap[i] < abs(first[0] - first[1]) else (first[0] + first[1]) / 2.0
            out.append((*[r[c] for c in k], eer, int((pos * (2 * (fp[-1] - fp) + neg)).sum()) if len(fp) else 0))
        kinds = [pa.string()] * len(names) + [pa.int32(), pa.float64(), pa.int64()]
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip([*k, "eer", "wins"], kinds))})

    moved = _dealt(df, code, columns, ranges, steps, places, reals=True)
    kinds = ", ".join([*[f"{c} string" for c in names], "col int, eer double, wins long"])
    done = moved.groupBy("col", "_r").cogroup(starts.groupBy("col", "_r")).applyInArrow(settle, kinds)
    # twice the pairs won, as whole numbers: inside the ranges, and between them from the counts
    inside = done.groupBy(*k).agg(F.max("eer").alias("eer"), F.sum("wins").alias("_in"))
    across = total.groupBy(*k).agg(
        F.sum("pos").alias("n_fake"), F.sum("neg").alias("n_real"), F.sum(F.col("pos") * (F.col("n_neg") - F.col("fp0") - F.col("neg"))).alias("_out"))
    both = (F.col("n_real") > 0) & (F.col("n_fake") > 0)
    wins = F.col("_out").cast("double") + F.col("_in") / 2.0
    return join_back(across, inside, k).select(
        *k, (F.col("n_fake") + F.col("n_real")).alias("n_files"), "n_real", "n_fake", "eer",
        F.when(both, F.try_divide(wins, F.col("n_fake").cast("double") * F.col("n_real"))).alias("roc_auc"))
