"""Train / validation / test splits, random or leaving one group out.

A split is a long table ``(fold INT, role STRING, record_id BIGINT)``
(``role`` in train, val, test), or, per fold, a role column on the records.

Random splits order records by ``md5(seed|split|fold|stage|id)`` and hold
out exactly ``floor(n * size)`` rows, as a shuffled list cut at that
length would. The cut is found by ``nth_smallest`` (bucket counts, no
global sort); assigning roles is then a map-only comparison with constants.
Folds of a random split are independent reshuffles, not disjoint k-fold.

Group folds (leave one group out) are a table, one row per group, joined to
the records: any number of groups, nothing collected. A record then has one
``test_fold`` and its ``val_folds``; it trains in all other folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key60
from ..plans.prefix import nth_smallest, nth_smallest_by_group, running_sums
from ..session import ensure_checkpoint_dir
from ..sources.records import group_key

ROLES = ("train", "val", "test")
SPLIT_TYPES = ("random", "key")


def effective_val_size(test_size: float, val_size: float) -> float:
    """Validation share of the rows left after the test cut: ``val/(1-test)``."""
    return val_size / (1 - test_size) if (1 - test_size) > 0 else 0


def held_count(n: int, size: float | None) -> int:
    """``int(n * size)``: a truncated float product (``int(100*0.29)`` is 28)."""
    if size is None:
        raise ValueError("a split needs a size")
    return int(n * size)


def split_key(seed: int, fold, stage: str, record_id: str = "record_id") -> Column:
    f = fold if isinstance(fold, Column) else F.lit(fold)
    return key60(F.lit(seed), F.lit("split"), f, F.lit(stage), F.col(record_id))


def split_exact(df: DataFrame, size: float | None, seed: int = 42, fold: int = 1, stage: str = "test",
                record_id: str = "record_id", n: int | None = None):
    """``(held_predicate, threshold, n_held)`` for one cut of ``df``.

    ``held_predicate`` is a Column true for exactly ``int(n * size)`` rows.
    """
    n = df.count() if n is None else n
    m = held_count(n, size)
    keyed = df.select(split_key(seed, fold, stage, record_id).alias("_k"), F.col(record_id).alias("_id"))
    threshold = nth_smallest(keyed, "_k", "_id", m)
    pred = _held(seed, fold, stage, record_id, threshold)
    return pred, threshold, m


def _held(seed, fold, stage, record_id, threshold) -> Column:
    if threshold is None:
        return F.lit(False)
    tk, tt = threshold
    # one struct comparison, so the md5 key is computed once per row
    row = F.struct(split_key(seed, fold, stage, record_id).alias("k"), F.col(record_id).cast("bigint").alias("t"))
    return row <= F.struct(F.lit(tk).cast("bigint").alias("k"), F.lit(tt).cast("bigint").alias("t"))


@dataclass
class FoldPlan:
    """What defines every fold: constants (random) or a table (groups)."""
    kind: str
    folds: list[int]                               # random folds; group folds are rows of ``groups``
    seed: int = 42
    no_test: bool = False
    test_cut: dict = field(default_factory=dict)   # fold -> threshold
    val_cut: dict = field(default_factory=dict)    # fold -> threshold
    sizes: dict = field(default_factory=dict)      # fold -> {role: n}
    group_col: str | None = None
    groups: DataFrame | None = None                # (fold, test_group, val_group), written once

    def fold_numbers(self) -> Iterator[int]:
        """Fold by fold; group folds stream from the table, none is held back."""
        if self.kind == "random":
            yield from self.folds
        else:
            for row in self.groups.select("fold").orderBy("fold").toLocalIterator():
                yield row["fold"]


def random_holdout(records: DataFrame, test_size: float = 0.2, val_size: float = 0.2, num_splits: int = 1,
                   no_test: bool = False, seed: int = 42, record_id: str = "record_id") -> FoldPlan:
    """Random split plan: test cut first, validation cut from the rest.

    ``no_test`` gives a two-way split per fold whose held part (sized by
    ``test_size``) is the validation set. All folds share each pass over
    the ids: one for the test cuts, one for the validation cuts.
    """
    # every pass below reads ids only: the non-empty filter upstream reads the text once, here
    ensure_checkpoint_dir(records.sparkSession)
    ids = records.select(F.col(record_id).cast("bigint").alias("_id")).checkpoint(eager=True)
    n = ids.count()
    plan = FoldPlan("random", list(range(1, num_splits + 1)), seed, no_test)
    val_eff = effective_val_size(test_size, val_size)
    m_test = held_count(n, test_size)
    folds = F.explode(F.array(*[F.lit(f) for f in plan.folds]))
    keyed = ids.select(folds.alias("_f"), "_id").withColumn("_k", split_key(seed, F.col("_f"), "test", "_id"))
    plan.test_cut = nth_smallest_by_group(keyed, "_f", "_k", "_id", {f: m_test for f in plan.folds})
    if no_test:
        plan.sizes = {f: {"val": m_test, "train": n - m_test} for f in plan.folds}
        return plan
    m_val = held_count(n - m_test, val_eff)
    rest = keyed.where(~_held_col(F.col("_f"), plan.test_cut, F.col("_k"), F.col("_id")))
    rest = rest.withColumn("_k", split_key(seed, F.col("_f"), "val", "_id"))
    plan.val_cut = nth_smallest_by_group(rest, "_f", "_k", "_id", {f: m_val for f in plan.folds})
    plan.sizes = {f: {"test": m_test, "val": m_val, "train": n - m_test - m_val} for f in plan.folds}
    return plan


def _held_col(fold: Column, cuts: dict, key: Column, rid: Column) -> Column:
    """``(key, id) <= cut[fold]`` for a fold column: one array lookup, whatever the number of folds."""
    def cut(value) -> Column:
        k, t = value or (-1, -1)  # keys are not negative: nothing is held
        return F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(t).cast("bigint").alias("t"))

    table = F.array(*[cut(cuts.get(f)) for f in range(1, max(cuts, default=1) + 1)])
    return F.struct(key.alias("k"), rid.cast("bigint").alias("t")) <= F.element_at(table, fold.cast("int"))


def no_test_split(records: DataFrame, test_size: float = 0.2, num_splits: int = 1, seed: int = 42,
                  record_id: str = "record_id") -> FoldPlan:
    """Two-way random split: the held part becomes ``val``."""
    return random_holdout(records, test_size=test_size, num_splits=num_splits, no_test=True, seed=seed,
                          record_id=record_id)


def distinct_groups(records: DataFrame, group_col: str, record_id: str = "record_id") -> DataFrame:
    """``(group, first_seen, position)``: groups in first-seen order, null kept.

    One row per group after a partial aggregate; positions are running
    counts over ranges of first-seen ids, so no task orders all groups.
    """
    g = records.groupBy(group_key(records, group_col).alias("group")).agg(F.min(record_id).alias("first_seen"))
    counted = running_sums(g.withColumn("one", F.lit(1)), "first_seen", ["one"])
    return counted.select("group", "first_seen", F.col("cum_one").cast("int").alias("position"))


def pick_val_group(n_groups: int, fold: int | Column, seed: int = 42) -> Column:
    """Position of the validation group for a fold: uniform over the others."""
    if n_groups < 2:
        raise IndexError("no other group to validate on: the records form one group")
    f = fold if isinstance(fold, Column) else F.lit(fold)
    r = F.pmod(key60(F.lit(seed), F.lit("group"), f), F.lit(n_groups - 1)) + 1
    return F.when(r < f, r).otherwise(r + 1).cast("int")


def fold_groups(records: DataFrame, group_col: str, seed: int = 42, no_test: bool = False,
                record_id: str = "record_id") -> DataFrame:
    """``(fold, test_group, val_group)``: one fold per group, in first-seen order.

    With ``no_test`` the fold's group is the validation set and there is
    no test group. Joins are 1:1 on position, never groups x groups.
    """
    ensure_checkpoint_dir(records.sparkSession)
    groups = distinct_groups(records, group_col, record_id).checkpoint(eager=True)  # one narrow row per group
    n = groups.count()
    if no_test:
        return groups.select(F.col("position").alias("fold"), F.lit(None).cast("string").alias("test_group"),
                             F.col("group").alias("val_group"))
    folds = groups.select(F.col("position").alias("fold"), F.col("group").alias("test_group"),
                          pick_val_group(n, F.col("position"), seed).alias("val_pos"))
    vals = groups.select(F.col("position").alias("val_pos"), F.col("group").alias("val_group"))
    return folds.join(vals, "val_pos").select("fold", "test_group", "val_group")


def leave_one_group_out(records: DataFrame, group_col: str = "source", seed: int = 42, no_test: bool = False,
                        record_id: str = "record_id") -> FoldPlan:
    """Plan: each group once as test, one other random group as validation.

    The plan is a table with one row per group, written once.
    """
    table = fold_groups(records, group_col, seed, no_test, record_id).checkpoint(eager=True)
    return FoldPlan("key", [], seed, no_test, group_col=group_col, groups=table)


def with_group_folds(records: DataFrame, plan: FoldPlan) -> DataFrame:
    """Add ``test_fold INT`` and ``val_folds ARRAY<INT>`` of each record's group.

    One join on the group (null is a group); the adaptive planner broadcasts
    the group table when it is measured to be small and splits hot groups
    when it is not.
    """
    vals = plan.groups.groupBy(F.col("val_group").alias("_g")).agg(F.sort_array(F.collect_list("fold")).alias("val_folds"))
    if plan.no_test:
        table = vals.select("_g", F.lit(None).cast("int").alias("test_fold"), "val_folds")
    else:
        tests = plan.groups.select(F.col("test_group").alias("_t"), F.col("fold").cast("int").alias("test_fold"))
        table = tests.join(vals, F.col("_t").eqNullSafe(F.col("_g")), "left").select(
            F.col("_t").alias("_g"), "test_fold", "val_folds")
    out = records.join(table, records[plan.group_col].eqNullSafe(table["_g"]), "left")
    return out.select(*[records[c] for c in records.columns], "test_fold",
                      F.coalesce("val_folds", F.array().cast("array<int>")).alias("val_folds"))


def make_splits(records: DataFrame, split_type: str = "random", split_key_col: str | None = None,
                test_size: float = 0.2, val_size: float = 0.2, num_splits: int = 1, no_test: bool = False,
                seed: int = 42) -> FoldPlan:
    """Dispatch on the split type; group splits ignore ``num_splits`` and sizes."""
    if split_type == "random":
        return random_holdout(records, test_size, val_size, num_splits, no_test, seed)
    if split_type == "key":
        if split_key_col is None:
            raise ValueError("a group split needs the name of the key column")
        return leave_one_group_out(records, split_key_col, seed, no_test)
    raise ValueError(f"split_type is {split_type!r}; it can be one of {SPLIT_TYPES}")


def role_column(plan: FoldPlan, fold: int | Column, record_id: str = "record_id") -> Column:
    """Role of each record in a fold (a number; of random folds also a column)."""
    if plan.kind == "key":
        row = plan.groups.where(F.col("fold") == int(fold)).first()
        g = F.col(plan.group_col)
        test = F.lit(False) if plan.no_test else g.eqNullSafe(F.lit(row["test_group"]))
        return F.when(test, "test").when(g.eqNullSafe(F.lit(row["val_group"])), "val").otherwise("train")
    if isinstance(fold, int):
        test = _held(plan.seed, fold, "test", record_id, plan.test_cut.get(fold))
        if plan.no_test:
            return F.when(test, "val").otherwise("train")
        val = _held(plan.seed, fold, "val", record_id, plan.val_cut.get(fold))
        return F.when(test, "test").when(val, "val").otherwise("train")
    rid = F.col(record_id)
    test = _held_col(fold, plan.test_cut, split_key(plan.seed, fold, "test", record_id), rid)
    if plan.no_test:
        return F.when(test, "val").otherwise("train")
    val = _held_col(fold, plan.val_cut, split_key(plan.seed, fold, "val", record_id), rid)
    return F.when(test, "test").when(val, "val").otherwise("train")


def fold_split(records: DataFrame, plan: FoldPlan, fold: int, record_id: str = "record_id") -> DataFrame:
    """Records of one fold with a ``role`` column (map-only)."""
    return records.withColumn("role", role_column(plan, fold, record_id))


def split_table(records: DataFrame, plan: FoldPlan, record_id: str = "record_id") -> DataFrame:
    """Random folds: ``(fold, role, record_id)``, every record once per fold.

    Group folds: ``(record_id, test_fold, val_folds)``, every record once; it
    trains in all folds that are not named.
    """
    if plan.kind == "key":
        x = with_group_folds(records.select(record_id, plan.group_col), plan)
        return x.select(F.col(record_id).cast("bigint").alias("record_id"), "test_fold", "val_folds")
    x = records.select(record_id, F.explode(F.sequence(F.lit(1), F.lit(len(plan.folds)))).alias("fold"))
    return x.select(F.col("fold").cast("int").alias("fold"), role_column(plan, F.col("fold"), record_id).alias("role"),
                    F.col(record_id).cast("bigint").alias("record_id"))


def split_sizes(table: DataFrame) -> DataFrame:
    """``(fold, role, n)``."""
    return table.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))
