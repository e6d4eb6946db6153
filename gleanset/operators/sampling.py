"""Samples and quota splits.

Every draw takes a prefix of the seeded draw order, so what a class gives to a sample, a split or
a top-up is a prefix of that class's order too. Selection therefore works on (id, label) rows and
ranks; text is fetched at the end by id. Counts and quotas are columns of small tables inside the
same plan, and nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanset import fixed
from gleanset.operators import ranking as rk


def remaining(df: DataFrame, taken: DataFrame, id_col: str = "id", bound: int | None = None) -> DataFrame:
    """Rows whose id was not taken; ``bound`` is the most rows ``taken`` can have."""
    ids = taken.select(id_col)
    if bound is not None and bound <= rk.BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, id_col, "left_anti")


def random_n(df: DataFrame, n: int, id_col: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """``n`` rows without replacement (all of them when there are fewer)."""
    drawn = rk.with_draw(df.select(F.col(id_col).alias("id")), "id", seed)
    picked = rk.rank_by_slots(drawn, rk.slot_counts(drawn), upto=n, groups=1).select(F.col("id").alias(id_col))
    return rk.fetch(df, picked, id_col, n)


def shuffled(df: DataFrame, id_col: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """All rows in draw order; for sinks."""
    return rk.with_draw(df, id_col, seed).orderBy("_draw", id_col).drop("_draw", "_slot")


def top_up(sample: DataFrame, pool: DataFrame, target: int, id_col: str = "id", seed: int = fixed.SEED) -> DataFrame:
    """Fill a sample up to ``target`` rows from the pool, whatever the class; all or nothing.

    Both counts and the draw come from the ids alone; the rows are fetched once at the end.
    """
    ids = sample.select(F.col(id_col).alias("id"), F.lit(True).alias("_have")).unionByName(
        pool.select(F.col(id_col).alias("id"), F.lit(False).alias("_have"))
    )
    drawn = rk.with_draw(ids, "id", seed)
    slots = rk.slot_counts(drawn, ["_have"])
    need = F.greatest(F.lit(target) - F.coalesce(F.sum(F.when(F.col("_have"), F.col("_n"))), F.lit(0)), F.lit(0))
    size = F.coalesce(F.sum(F.when(~F.col("_have"), F.col("_n"))), F.lit(0))
    grant = slots.agg(F.when(size >= need, need).otherwise(0).alias("grant")).scalar()
    ranked = rk.rank_by_slots(drawn, slots, ["_have"], upto=target, groups=2)
    picked = ranked.filter(~F.col("_have") & (F.col("rank") <= grant)).select(F.col("id").alias(id_col))
    return sample.unionByName(rk.fetch(pool, picked, id_col, target))


def sample_per_class(
    df: DataFrame,
    label: str,
    n: int,
    id_col: str = "id",
    seed: int = fixed.SEED,
    classes: Sequence[str] | None = None,
) -> DataFrame:
    """``min(available, n)`` rows of every class, as the labels come or of the given ``classes``.

    A null label is no class. :func:`outside_classes` counts what given classes leave out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter(F.col("label").isNotNull())
    if classes is not None:
        rows = rows.filter(F.col("label").isin(list(classes)))
    drawn = rk.with_draw(rows, "id", seed)
    groups = len(classes) if classes is not None else None
    picked = rk.rank_by_slots(drawn, rk.slot_counts(drawn, ["label"]), ["label"], upto=n, groups=groups)
    bound = groups * n if groups is not None else None
    return rk.fetch(df, picked.select(F.col("id").alias(id_col)), id_col, bound)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _class_sizes(slots: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row: the size of every class as ``n0, n1, ..``."""
    sums = [
        F.expr(f"coalesce(sum(_n) FILTER (WHERE label = {_quoted(c)}), 0) AS n{i}") for i, c in enumerate(classes)
    ]
    return slots.agg(*sums)


def _per_class(one_row: DataFrame, classes: Sequence[str], own: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """One row per class: ``own`` columns carry the class number as suffix, ``shared`` ones do not."""
    structs = [
        f"struct({_quoted(c)} AS label, "
        + ", ".join([*(f"bigint({o}{i}) AS {o}" for o in own), *(f"bigint({x}) AS {x}" for x in shared)])
        + ")"
        for i, c in enumerate(classes)
    ]
    return one_row.selectExpr(f"inline(array({', '.join(structs)}))")


def _grant(need: str, available: str, strict: str | None = None) -> str:
    """All-or-nothing: the whole need, or zero when it is not covered (``strict`` names the split that
    then fails the run)."""
    short = "0"
    if strict is not None:
        told = f"concat('{strict} lacks ', string({need}), ' rows and the pool has ', string({available}))"
        short = f"CASE WHEN {need} > 0 THEN bigint(raise_error({told})) ELSE 0 END"
    return f"CASE WHEN {need} > 0 AND {available} >= {need} THEN {need} ELSE {short} END"


def _candidates(rows: DataFrame, bound: int, classes: Sequence[str], seed: int):
    """Ranked (id, label) rows up to ``bound`` per class, and the one-row class sizes."""
    drawn = rk.with_draw(rows.filter(F.col("label").isin(list(classes))), "id", seed)
    slots = rk.slot_counts(drawn, ["label"])
    ranked = rk.rank_by_slots(drawn, slots, ["label"], upto=bound, groups=len(classes))
    return ranked, _class_sizes(slots, classes)


def scarce_first_quotas(
    sizes: DataFrame, classes: Sequence[str], scarce: str, eval_rows: int, train_rows: int
) -> DataFrame:
    """Quotas per class when one class is scarce: the others share evenly what it lacks."""
    numbers, first = range(len(classes)), list(classes).index(scarce)
    e_goal, t_goal, others = eval_rows // len(classes), train_rows // len(classes), max(len(classes) - 1, 1)
    steps = [f"least(n{first}, {e_goal}) AS e{first}", f"least(n{first} - e{first}, {t_goal}) AS t{first}"]
    for i in numbers:
        if i != first:
            steps.append(f"least(n{i}, {e_goal} + ({e_goal} - e{first}) div {others}) AS e{i}")
            steps.append(f"least(n{i} - e{i}, {t_goal} + ({t_goal} - t{first}) div {others}) AS t{i}")
    steps += [
        f"{eval_rows} - {' - '.join(f'e{i}' for i in numbers)} AS need_e",
        f"{train_rows} - {' - '.join(f't{i}' for i in numbers)} AS need_t",
        f"{' + '.join(f'n{i} - e{i} - t{i}' for i in numbers)} AS pool",
        f"{_grant('need_e', 'pool')} AS more_e",
        f"{_grant('need_t', 'pool - more_e')} AS more_t",
    ]
    return _per_class(sizes.selectExpr("*", *steps), classes, ["n", "e", "t"], ["more_e", "more_t"])


def scarce_first_split(
    rows: DataFrame,
    eval_rows: int,
    train_rows: int,
    scarce: str = "neutral",
    classes: Sequence[str] = fixed.LABELS,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Split (id, label) rows into ``eval`` and ``train``, serving the scarce class first."""
    bound = eval_rows + train_rows
    ranked, sizes = _candidates(rows, bound, classes, seed)
    quotas = F.broadcast(scarce_first_quotas(sizes, classes, scarce, eval_rows, train_rows))
    placed = ranked.join(quotas, "label").withColumn(
        "split",
        F.when(F.col("rank") <= F.col("e"), "eval").when(F.col("rank") <= F.col("e") + F.col("t"), "train"),
    )
    placed = placed.withColumn("_pool", F.col("split").isNull())
    placed = rk.rank_drawn(placed, ["_pool"], bound * len(classes), "_turn")
    topped = F.when(F.col("_turn") <= F.col("more_e"), "eval").when(
        F.col("_turn") <= F.col("more_e") + F.col("more_t"), "train"
    )
    return (
        placed.withColumn("split", F.when(F.col("_pool"), topped).otherwise(F.col("split")))
        .filter(F.col("split").isNotNull())
        .select("id", "label", "split")
    )


def balanced_split(
    rows: DataFrame,
    eval_rows: int,
    train_rows: int,
    classes: Sequence[str] = fixed.LABELS,
    seed: int = fixed.SEED,
    strict: bool = False,
) -> DataFrame:
    """Split (id, label) rows: equal classes for ``eval`` and its top-up, then ``train`` from the rest.

    Both top-ups are all or nothing; :func:`shortfall` shows what is missing. With ``strict`` a run whose
    ``eval`` cannot be topped up fails; ``train`` may always be short.
    """
    bound = eval_rows + train_rows
    e_goal, t_goal = eval_rows // len(classes), train_rows // len(classes)
    ranked, sizes = _candidates(rows, bound, classes, seed)

    numbers = range(len(classes))
    steps = [f"least(n{i}, {e_goal}) AS e{i}" for i in numbers]
    steps += [
        f"{eval_rows} - {' - '.join(f'e{i}' for i in numbers)} AS need_e",
        f"{' + '.join(f'n{i} - e{i}' for i in numbers)} AS pool",
        f"{_grant('need_e', 'pool', 'eval' if strict else None)} AS more_e",
    ]
    eval_quotas = _per_class(sizes.selectExpr("*", *steps), classes, ["n", "e"], ["more_e"])

    placed = ranked.join(F.broadcast(eval_quotas), "label").withColumn("_pool", F.col("rank") > F.col("e"))
    placed = rk.rank_drawn(placed, ["_pool"], bound * len(classes), "_turn")
    placed = placed.withColumn("_extra", F.col("_pool") & (F.col("_turn") <= F.col("more_e")))

    # What the top-up took from each class shifts the ranks that train may use.
    left = (
        placed.groupBy("label")
        .agg(F.max("n").alias("n"), F.max("e").alias("e"), F.count_if("_extra").alias("u"))
        .selectExpr("*", f"least(n - e - u, {t_goal}) AS t")
        .selectExpr("*", f"{train_rows} - sum(t) OVER () AS need_t", "sum(n - e - u - t) OVER () AS pool")
        .selectExpr("label", "u", "t", f"{_grant('need_t', 'pool')} AS more_t")
    )
    placed = placed.drop("_turn").join(F.broadcast(left), "label")
    placed = placed.withColumn(
        "split",
        F.when(~F.col("_pool") | F.col("_extra"), "eval").when(
            F.col("rank") <= F.col("e") + F.col("u") + F.col("t"), "train"
        ),
    ).withColumn("_open", F.col("split").isNull())
    placed = rk.rank_drawn(placed, ["_open"], bound * len(classes), "_turn")
    topped = F.when(F.col("_turn") <= F.col("more_t"), "train")
    return (
        placed.withColumn("split", F.coalesce("split", topped))
        .filter(F.col("split").isNotNull())
        .select("id", "label", "split")
    )


def proportional_quotas(counts: DataFrame, n: int) -> DataFrame:
    """Rows to take per class so that ``n`` rows keep the class shares.

    ``counts`` has (label, c). Shares are rounded half to even; what rounding adds or lacks is
    settled on the smallest or largest quota, ties broken by descending count, then label.
    """
    every = Window.partitionBy()
    by_count = Window.orderBy(F.col("c").desc(), "label")
    by_quota = Window.orderBy("q", F.col("c").desc(), "label")
    rounded = (
        counts.withColumn("total", F.sum("c").over(every))
        .withColumn("q", F.bround(F.col("c") / F.col("total") * n).cast("bigint"))
        .withColumn("diff", n - F.sum("q").over(every))
        .withColumn("_large", F.row_number().over(by_count) == 1)
        .withColumn("_small", F.row_number().over(by_quota) == 1)
    )
    settled = (
        F.when((F.col("diff") > 0) & F.col("_large"), F.col("q") + F.col("diff"))
        .when((F.col("diff") < 0) & F.col("_small"), F.greatest(F.col("q") + F.col("diff"), F.lit(0)))
        .otherwise(F.col("q"))
    )
    take = F.when(F.col("total") <= n, F.col("c")).otherwise(F.least(settled, F.col("c")))
    return rounded.select("label", "c", take.alias("take")).withColumn(
        "more", F.greatest(F.least(F.lit(n), F.sum("c").over(every)) - F.sum("take").over(every), F.lit(0))
    )


def outside_classes(df: DataFrame, label: str, classes: Sequence[str] = fixed.LABELS) -> DataFrame:
    """(label, n) of the rows whose label is null or not one of ``classes``."""
    other = F.col(label).isNull() | ~F.col(label).isin(list(classes))
    return df.filter(other).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _proportional_ids(rows: DataFrame, n: int, seed: int, classes: Sequence[str] | None) -> DataFrame:
    """Ids that a proportional sample of narrow (id, label) rows takes."""
    rows = rows.filter(F.col("label").isNotNull())
    if classes is not None:
        rows = rows.filter(F.col("label").isin(list(classes)))
    drawn = rk.with_draw(rows, "id", seed)
    slots = rk.slot_counts(drawn, ["label"])
    quotas = proportional_quotas(slots.groupBy("label").agg(F.sum("_n").alias("c")), n)
    groups = len(classes) if classes is not None else None
    ranked = rk.rank_by_slots(drawn, slots, ["label"], upto=n, groups=groups)
    placed = ranked.join(quotas, "label").withColumn("_in", F.col("rank") <= F.col("take"))
    if groups is not None:
        placed = rk.rank_drawn(placed, ["_in"], n * groups, "_turn")
    else:  # any number of classes: ranked over the slots of the draw
        placed = rk.rank_by_slots(placed, rk.slot_counts(placed, ["_in"]), ["_in"], upto=n, out="_turn", groups=2)
    wanted = F.when(F.col("_in"), F.col("_turn") <= n).otherwise(F.col("_turn") <= F.col("more"))
    return placed.filter(wanted).select("id")


def proportional_sample(
    df: DataFrame,
    label: str,
    n: int,
    id_col: str = "id",
    seed: int = fixed.SEED,
    classes: Sequence[str] | None = None,
    narrow: DataFrame | None = None,
) -> DataFrame:
    """At most ``n`` rows with the class shares of the table; all rows when there are no more.

    Labels are taken as they come, or only the given ``classes``; a null label is no class.
    :func:`outside_classes` counts what that leaves out. ``narrow`` has the (id, label) rows to draw
    from where they are cheaper to get than from ``df``, which is then only read for the chosen ids.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label")) if narrow is None else narrow
    picked = _proportional_ids(rows, n, seed, classes).select(F.col("id").alias(id_col))
    return rk.fetch(df, picked, id_col, n)


def shortfall(
    splits: DataFrame, wanted: Mapping[str, int], classes: Sequence[str] = fixed.LABELS
) -> DataFrame:
    """What each split wanted and got, per class and for the whole split (class ``*``).

    ``wanted`` maps a split to its row target; every class is meant to give the same part of it.
    """
    got = splits.groupBy("split", "label").agg(F.count(F.lit(1)).alias("got"))
    goals = [
        F.struct(F.lit(s).alias("split"), F.lit(c).alias("label"), F.lit(v // len(classes)).cast("bigint").alias("wanted"))
        for s, v in wanted.items()
        for c in classes
    ]
    per_class = got.sparkSession.range(1).select(F.inline(F.array(*goals))).join(got, ["split", "label"], "left")
    per_class = per_class.withColumn("got", F.coalesce("got", F.lit(0)))
    targets = F.create_map(*[F.lit(x) for s, v in wanted.items() for x in (s, v)])
    whole = per_class.groupBy("split").agg(F.sum("got").alias("got")).select(
        "split", F.lit("*").alias("label"), F.try_element_at(targets, F.col("split")).cast("bigint").alias("wanted"), "got"
    )
    return per_class.unionByName(whole).withColumn("missing", F.greatest(F.col("wanted") - F.col("got"), F.lit(0)))


def split_overlap(splits: DataFrame, id_col: str = "id", text_key: str = "key") -> DataFrame:
    """How far ``eval`` and ``train`` share ids and texts, from (id, split, key) rows.

    Both sides are counted per value first, so a text with any number of copies costs one row.
    """
    entries = F.array(
        F.struct(F.lit("id").alias("measure"), F.col(id_col).cast("string").alias("value")),
        F.struct(F.lit("text").alias("measure"), F.hex(F.col(text_key)).alias("value")),
    )
    return (
        splits.select("split", F.inline(entries))
        .groupBy("measure", "value")
        .agg(F.count_if(F.col("split") == "eval").alias("e"), F.count_if(F.col("split") == "train").alias("t"))
        .groupBy("measure")
        .agg(
            F.count_if((F.col("e") > 0) & (F.col("t") > 0)).alias("shared_values"),
            F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("e"))), F.lit(0)).alias("eval_rows_shared"),
            F.coalesce(F.sum(F.when(F.col("e") > 0, F.col("t"))), F.lit(0)).alias("train_rows_shared"),
        )
    )
