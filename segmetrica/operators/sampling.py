"""Seeded sampling and splits: order comes from hashes of stable ids, never from rand()."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_long, hash_text, hash_uniform
from ..session import cut_lineage, materialize, scratch_path
from .graph import components, with_least
from .prefix import accumulate, attach, hash_rank, join_back


def _hash_bucket12(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def group_kfold(df: DataFrame, group: str, folds: int = 4, seed: int = 0) -> DataFrame:
    """Groups in random order cut into folds of equal group counts (the first ones take the rest)."""
    g = df.select(F.col(group).alias("_g")).distinct().withColumn("_h", hash_text(seed, F.col("_g")))
    r = hash_rank(g, [], "_h", "_g")
    pos, n = F.col("pos") - 1, F.col("n")
    size, rest = F.floor(n / folds), n % folds
    cut = rest * (size + 1)
    fold = F.when(pos < cut, F.floor(pos / (size + 1))).otherwise(rest + F.floor((pos - cut) / F.greatest(size, F.lit(1))))
    return df.join(r.select("_g", fold.cast("int").alias("fold")), F.col(group) == F.col("_g")).drop("_g")


def group_split(df: DataFrame, group: str, label: str, fraction: float, seed: int = 0, attempts: int = 200) -> DataFrame:
    """Adds is_val: whole groups in random order until the row target is met, both classes on each side.

    One small aggregate per attempt decides; the first attempt almost always succeeds, so
    attempts are tried one after another instead of all being computed.
    """
    counts = df.groupBy(F.col(group).alias("_g")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("pos_rows"), F.lit(1).cast("long").alias("one"))
    counts = cut_lineage(counts)
    for attempt in range(attempts):
        h = counts.withColumn("_h", hash_text(seed, F.lit(attempt), F.col("_g")))
        run = accumulate(h, [], [F.col("_h").asc(), F.col("_g").asc()], _hash_bucket12("_h"), ["rows", "one"], descending=False)
        target = F.greatest(F.lit(1.0), F.rint(F.col("rows_all") * F.lit(float(fraction))))
        taken = (F.col("rows_cum") - F.col("rows") < target) & (F.col("one_cum") < F.col("one_all"))
        marked = run.select("_g", "rows", "pos_rows", taken.alias("is_val"))
        ok = marked.groupBy("is_val").agg(F.sum("pos_rows").alias("p"), F.sum("rows").alias("r")).filter("p > 0 AND p < r").count() == 2
        if ok:
            return df.join(marked.select("_g", "is_val"), F.col(group) == F.col("_g")).drop("_g")
    raise ValueError("no group split with both classes on each side")


def stratified_subsample(df: DataFrame, key: str, label: str, limit: int, seed: int = 0) -> DataFrame:
    """About ``limit`` rows, each label keeping its share."""
    ranked = hash_rank(df.withColumn("_h", hash_text(seed, F.col(key))), [label], "_h", key)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    out = attach(ranked, total, [])
    return out.filter(F.col("pos") <= F.rint(F.lit(float(limit)) * F.col("n") / F.col("_t"))).drop("_h", "pos", "n", "_t")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order; Spark keeps n rows a task, so nothing is sorted whole."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """n rows drawn by a hash of their key, in that order. A sample of one class only is an error when it is computed."""
    picked = first_rows(df.withColumn("_h", hash_text(seed, F.col(key))), ["_h", key], n).drop("_h")
    both = picked.agg((F.min(label) < F.max(label)).alias("_both"))
    fail = F.raise_error(F.lit("the sample has rows of one class only"))
    return attach(picked, both, []).filter(F.when(F.col("_both"), True).otherwise(fail.cast("boolean"))).drop("_both")


def draw_weights(df: DataFrame, source: str, label: str, weight: str, shares: dict[str, float] | None = None, balanced: bool = True) -> DataFrame:
    """Adds draw_weight: share per source, labels balanced inside it (or not), row weight inside that.

    A row whose source has no share is an error when it is computed.
    """
    src = F.col(source) if shares else F.lit("")
    y = F.col(label) if balanced else F.lit(0)
    cells = df.groupBy(src.alias("_s"), y.alias("_y")).agg(F.sum(weight).alias("_w"))
    per = cells.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.join(per, "_s")
    share = F.lit(1.0)
    if shares:
        total = float(sum(shares.values()))
        known = F.element_at(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v / total))]), F.col("_s"))
        share = F.coalesce(known, F.raise_error(F.concat(F.lit("no share for source "), F.col("_s"))).cast("double"))
    j = df.withColumn("_src", src).withColumn("_cls", y).join(cells, (F.col("_src") == F.col("_s")) & (F.col("_cls") == F.col("_y")))
    return j.withColumn("draw_weight", share * F.col(weight) / (F.col("_w") * F.col("_n"))).drop("_s", "_y", "_w", "_n", "_src", "_cls")


def limit_groups(df: DataFrame, group: str, limit: int, seed: int = 0) -> DataFrame:
    g = df.select(F.col(group).alias("_g")).distinct().withColumn("_h", hash_text(seed, F.col("_g")))
    keep = hash_rank(g, [], "_h", "_g").filter(F.col("pos") <= limit).select("_g")
    return df.join(keep, F.col(group) == F.col("_g"), "left_semi")


def balanced_pairs(df: DataFrame, key: str, group: str, label: str, max_rows: int | None = None, seed: int = 0) -> DataFrame:
    """One real and one fake per group that has both; fewer groups if max_rows asks so."""
    h = hash_text(seed, F.col(key))
    picked = df.groupBy(F.col(group).alias("grp")).agg(
        F.min_by(key, F.when(F.col(label) == 0, h)).alias("real_id"), F.min_by(key, F.when(F.col(label) == 1, h)).alias("fake_id"),
        F.max(label).alias("_hi"), F.min(label).alias("_lo"),
    ).filter((F.col("_hi") == 1) & (F.col("_lo") == 0)).drop("_hi", "_lo")
    if max_rows is not None:
        picked = limit_groups(picked, "grp", max(1, max_rows // 2), seed)
    return picked


CANDIDATES = 1_000_000  # rows that one task plays out at a time, shared evenly by the families


def _play(table: pa.Table, names: list, limit: dict, turn: int, at: int, budget: int) -> tuple[list, dict, tuple[int, int], bool]:
    """Takes turns over the candidates of every family, in order, as long as each family's candidates last.

    Returns the picks (candidate row, family, turn), how many candidates each family is past, the turn and the family to go
    on with, and whether the game is over. ``limit`` holds the position of each family's last candidate; a family whose
    list goes on behind it can't pass.
    """
    family, grp = table.column("family").to_pylist(), table.column("grp").combine_chunks().dictionary_encode()
    groups, free, pos = grp.indices.to_numpy(), table.column("free").to_numpy(zero_copy_only=False), table.column("pos").to_numpy()
    more = {f: limit[f][0] < limit[f][1] for f in names}
    lists: dict = {f: [] for f in names}
    for k in np.argsort(pos, kind="stable"):
        lists[family[k]].append(int(k))
    taken = np.zeros(len(grp.dictionary), bool)
    taken[groups[~free]] = True
    past, picks, idle = dict.fromkeys(names, 0), [], 0
    while len(picks) < budget:
        f = names[at]
        mine, k = lists[f], past[f]
        while k < len(mine) and taken[groups[mine[k]]]:
            k += 1
        past[f] = k
        if k < len(mine):
            taken[groups[mine[k]]] = True
            picks.append((mine[k], f, turn))
            past[f], idle = k + 1, 0
        elif more[f]:
            return picks, past, (turn, at), False
        else:
            idle += 1
            if idle == len(names):
                return picks, past, (turn, at), True
        at += 1
        if at == len(names):
            at, turn = 0, turn + 1
    return picks, past, (turn, at), True


def generator_round_robin(df: DataFrame, key: str, group: str, label: str, family: str, budget: int | None = None, seed: int = 0,
                          candidates: int = CANDIDATES) -> DataFrame:
    """Fakes picked family by family in turn, each from a group nobody took yet: (grp, family, fake_id, round).

    Every family's groups are ranked once, by prefix sums. Then a task plays many rounds at once over the next
    ``candidates`` / families groups of each family, until a family has used up its share and its list goes on; the next
    share is read from there, without the groups taken meanwhile. So the number of jobs follows the number of (group,
    family) pairs over ``candidates``, not the rounds. One row a family passes the driver. If the free groups run out
    before the budget, an error says so.
    """
    spark = df.sparkSession
    fakes = df.filter(F.col(label) == 1)
    paired = df.groupBy(F.col(group).alias("grp")).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo = 0 AND hi = 1").select("grp")
    h = hash_text(seed, F.col(key))
    offers = fakes.select(F.col(group).alias("grp"), F.col(family).alias("family"), F.struct(h.alias("h"), F.col(key).alias("id")).alias("c"))
    offers = offers.join(paired, "grp", "left_semi").groupBy("grp", "family").agg(F.min("c").alias("c"))
    ranked = hash_rank(offers.select("grp", "family", F.col("c.h").alias("_h"), F.col("c.id").alias("id")), ["family"], "_h", "id")
    ranked = materialize(ranked.select("grp", "family", "id", "pos", "n"), "offers")
    total = paired.count()
    budget = total if budget is None else min(budget, total)
    ends = {r["family"]: int(r["n"]) for r in ranked.groupBy("family").agg(F.max("n").alias("n")).collect()}
    names = sorted(ends)
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    schema = f"grp {kinds['grp']}, family {kinds['family']}, fake_id {kinds['id']}, round int"
    folder, made, place, done = scratch_path(spark, "picks"), 0, (0, 0), not names
    share = max(1, candidates // max(1, len(names)))
    past = dict.fromkeys(names, 0)
    while not done and made < budget:
        limit = {f: (min(past[f] + share, ends[f]), ends[f]) for f in names}
        picked = None if not made else spark.read.schema(schema).parquet(f"{folder}/*").select("grp", F.lit(True).alias("gone"))
        near = F.lit(False)
        for f in names:
            near = near | (F.col("family").eqNullSafe(F.lit(f)) & (F.col("pos") > past[f]) & (F.col("pos") <= limit[f][0]))
        block = ranked.where(near)
        block = block.withColumn("gone", F.lit(None).cast("boolean")) if picked is None else block.join(picked, "grp", "left")
        block = block.select("grp", "family", "id", "pos", F.col("gone").isNull().alias("free"))
        turn, at, left = *place, budget - made

        def run(table: pa.Table) -> pa.Table:
            picks, used, (t, a), over = _play(table, names, limit, turn, at, left)
            rows = pa.array([k for k, _, _ in picks], pa.int64())
            chosen = table.take(rows)
            # a last row a family tells how far it is
            state = pa.table({
                "grp": pa.nulls(len(names), chosen.column("grp").type), "family": pa.array(names, chosen.column("family").type),
                "fake_id": pa.nulls(len(names), chosen.column("id").type), "round": pa.array([t] * len(names), pa.int32()),
                "used": pa.array([used[f] for f in names], pa.int64()), "at": pa.array([a] * len(names), pa.int32()), "over": pa.array([over] * len(names)),
            })
            won = pa.table({
                "grp": chosen.column("grp"), "family": chosen.column("family"), "fake_id": chosen.column("id"),
                "round": pa.array([t_ for _, _, t_ in picks], pa.int32()), "used": pa.nulls(len(picks), pa.int64()),
                "at": pa.nulls(len(picks), pa.int32()), "over": pa.nulls(len(picks), pa.bool_()),
            })
            return pa.concat_tables([won, state])

        played = materialize(block.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(run, f"{schema}, used long, at int, over boolean"), "played")
        state = played.where("used IS NOT NULL").collect()  # one row a family
        if not state:
            break
        won = played.where("used IS NULL").drop("used", "at", "over")
        won.write.parquet(f"{folder}/part-{made}")
        made += won.count()
        for r in state:
            past[r["family"]] = past[r["family"]] + int(r["used"])
        place, done = (int(state[0]["round"]), int(state[0]["at"])), bool(state[0]["over"])
    if made < budget or not budget:
        raise ValueError("not enough free paired groups")
    return spark.read.schema(schema).parquet(f"{folder}/*").select("grp", "family", "fake_id", "round")


def window_draws(items: DataFrame, key: str, pool: str, length: str, n_draws: int, shares: dict[str, float], seed: int, width: int) -> DataFrame:
    """(draw, item, start): pick a pool by share, an item in it, a start in the item.

    Each draw is one row of a range; items are looked up by their position in the pool.
    """
    spark = items.sparkSession
    ranked = hash_rank(items.select(F.col(key).alias("item"), F.col(pool).alias("pool"), F.col(length).alias("len"))
                       .withColumn("_h", hash_text(seed, F.col("item"))), ["pool"], "_h", "item")
    ranked = ranked.select("pool", (F.col("pos") - 1).alias("idx"), "item", "len", F.col("n").alias("_n"))
    sizes = ranked.groupBy("pool").agg(F.max("_n").alias("pool_n"))
    total, acc, chosen = sum(shares.values()), 0.0, None
    u = hash_uniform(seed, F.lit("pool"), F.col("draw"))
    for name, share in shares.items():
        acc += share / total
        chosen = F.when(u < acc, name) if chosen is None else chosen.when(u < acc, name)
    draws = spark.range(n_draws).select(F.col("id").alias("draw"))
    draws = draws.withColumn("pool", chosen.otherwise(list(shares)[-1])).join(sizes, "pool")
    draws = draws.withColumn("idx", F.pmod(hash_long(seed, F.lit("item"), F.col("draw")), F.col("pool_n")))
    j = draws.join(ranked.drop("_n"), ["pool", "idx"])
    slack = F.greatest(F.col("len") - width, F.lit(0)) + 1
    return j.select("draw", "pool", "item", F.pmod(hash_long(seed, F.lit("start"), F.col("draw")), slack).alias("start"))


DRAW_BINS = 4096  # of a stratum's summed weights


def stratified_draws(items: DataFrame, key: str, strata: Sequence[str], n_draws: int, seed: int, weight: str | None = None) -> DataFrame:
    """(draw, strata..., key): draws with replacement, first a stratum (all alike), then an item in it by weight.

    Strata with items but no weight are never drawn. An item owns the stretch of its stratum's summed weights that ends at
    its own running sum, in order of its hash; a draw takes the item on whose stretch its uniform number falls. Running sums
    are made in two levels. Draws meet items by bins of the stretch, DRAW_BINS a stratum, so a stratum with very many items
    or a third of all draws is shared by many tasks; an item as long as several bins stands in each of them.
    """
    spark, strata = items.sparkSession, list(strata)
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = items.select(*strata, F.col(key).alias("_key"), w.alias("_w")).where("_w > 0").withColumn("_h", hash_text(seed, F.col("_key")))
    summed = accumulate(rows, strata, [F.col("_h").asc(), F.col("_key").asc()], _hash_bucket12("_h"), ["_w"], descending=False)
    # one row a stratum, numbered in order; strata are few
    sizes = summed.groupBy(*strata).agg(F.max("_w_all").alias("_all"))
    numbered = sizes.withColumn("_s", F.row_number().over(Window.orderBy(*strata)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    numbered = cut_lineage(numbered)
    n = numbered.count()
    if not n:
        raise ValueError("no stratum has an item with weight")
    stretch = join_back(summed.drop("_w_all"), numbered, strata)
    lo, hi = F.col("_w_cum") - F.col("_w"), F.col("_w_cum")
    bin_of = lambda x: F.least(F.floor(x / F.col("_all") * DRAW_BINS), F.lit(DRAW_BINS - 1)).cast("int")
    stretch = stretch.select("_s", "_key", *strata, lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(bin_of(lo), bin_of(hi))).alias("_bin"))
    draws = spark.range(n_draws).select(F.col("id").alias("draw"))
    draws = draws.withColumn("_s", F.pmod(hash_long(seed, F.lit("stratum"), F.col("draw")), F.lit(n)).cast("int"))
    draws = draws.join(numbered.select("_s", "_all"), "_s").withColumn("_u", hash_uniform(seed, F.lit("item"), F.col("draw")) * F.col("_all"))
    draws = draws.withColumn("_bin", bin_of(F.col("_u")))
    hit = draws.join(stretch, ["_s", "_bin"]).where("_lo <= _u AND _u < _hi")
    return hit.select("draw", *strata, F.col("_key").alias(key))


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(int(times)))))


def connected_groups(edges: DataFrame, item: str, token: str) -> DataFrame:
    """(item, component): items linked by shared tokens, labelled by their smallest item.

    Each token ties its items to the smallest of them. A token that very many items carry is cut into salts
    (``graph.with_least``), so that no task gets all of its items.
    """
    e = cut_lineage(edges.select(F.col(item).alias("i"), F.col(token).alias("t")).distinct())
    ties = with_least(e, "t", "i", e.count()).select(F.col("i").alias("a"), F.col("m").alias("b"))
    found = components(ties)
    items = e.select("i").distinct()
    return items.join(found, F.col("i") == F.col("node"), "left").select(F.col("i").alias(item), F.coalesce("root", "i").alias("component"))
