"""Comparators of record pairs.

Values are taken and encoded once per record, before any pair exists; `prepare`
adds them as columns and `vector` compares the prepared columns of two sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.functions.fields import Spec, getter
from linkweave.operators.blocking import SPLIT, Blocking, candidates, meet, one_key, pairs

Compare = Callable[[Column, Column], Column]
Encode = Callable[[Column], Column]


def scaled(similarity: Compare, low: float = 0.0, high: float = 1.0, rmax: float = 1.0, missing: float | None = None, test: Encode | None = None) -> Compare:
    """A similarity mapped from (low, high) to (0, rmax); 1.0, not rmax, from high on.
    Null, and values of which either fails the test, give `missing` unscaled."""
    if not 0.0 <= low < high:
        raise ValueError(f"low: {low}, high: {high}")

    def of(a: Column, b: Column) -> Column:
        v, none = similarity(a, b), F.lit(missing).cast("double")
        out = F.when(v.isNull(), none).when(v <= low, 0.0).when(v >= high, 1.0).otherwise(F.lit(float(rmax)) * (v - low) / F.lit(float(high - low)))
        return out if test is None else F.when(test(a) & test(b), out).otherwise(none)

    return of


class Field:
    """Similarity of one field: null where either value is null before encoding."""

    def __init__(self, compare: Compare, field1: Spec, encode1: Encode | None = None, field2: Spec | None = None, encode2: Encode | None = None):
        self.compare = compare
        self.fields = (field1, field1 if field2 is None else field2)
        encode1 = encode1 or (lambda c: c)
        self.encodes = (encode1, encode2 or encode1)

    def raw(self, df: DataFrame, side: int) -> Column:
        return getter(df, self.fields[side])

    def value(self, df: DataFrame, side: int) -> Column:
        """What is compared later: whether the field has a value, and its encoding."""
        raw = self.raw(df, side)
        return F.struct(raw.isNotNull().alias("some"), self.encodes[side](raw).alias("v"))

    def similarity(self, a: Column, b: Column) -> Column:
        return F.when(a["some"] & b["some"], self.compare(a["v"], b["v"]).cast("double"))


class _Multi(Field):
    """Fields of several values: distinct after encoding; a null list is empty."""

    def value(self, df: DataFrame, side: int) -> Column:
        raw = self.raw(df, side)
        return F.array_distinct(F.transform(raw, self.encodes[side]))

    def _empty(self, a: Column) -> Column:
        null = F.try_element_at(F.slice(a, 1, 0), F.lit(1))
        return self.compare(null, null).cast("double")

    @staticmethod
    def _none(a: Column, b: Column) -> Column:
        return (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)


class Average(_Multi):
    """Mean, over the smaller set (record 1's if even), of the best similarity to
    the larger; null similarities count 0."""

    def similarity(self, a: Column, b: Column) -> Column:
        best = lambda v, others, turn: F.aggregate(others, F.lit(0.0), lambda s, w: F.greatest(s, (self.compare(w, v) if turn else self.compare(v, w)).cast("double")))
        # The value from the smaller set comes first, as its owner's order has it.
        mean = lambda short, long: F.aggregate(short, F.lit(0.0), lambda s, v: s + best(v, long, False)) / F.size(short)
        return F.when(self._none(a, b), self._empty(a)).when(F.size(a) <= F.size(b), mean(a, b)).otherwise(mean(b, a))


class Maximum(_Multi):
    """Greatest similarity of any two values, 0.0 at least."""

    def similarity(self, a: Column, b: Column) -> Column:
        top = F.aggregate(a, F.lit(0.0), lambda s, v: F.greatest(s, F.aggregate(b, F.lit(0.0), lambda t, w: F.greatest(t, self.compare(v, w).cast("double")))))
        return F.when(self._none(a, b), self._empty(a)).otherwise(top)


class Record:
    """Named comparators to a struct of nullable doubles; a name given twice keeps
    its first place and its last comparator."""

    def __init__(self, *fields: tuple[str, Field]):
        self.fields: dict[str, Field] = {}
        for name, f in fields:
            if not name.isidentifier():
                raise ValueError(f"not a name: {name!r}")
            self.fields[name] = f

    @property
    def names(self) -> list[str]:
        return list(self.fields)

    def prepare(self, df: DataFrame, side: int, id_col: str, prefix: str) -> DataFrame:
        """(prefix_id, prefix_0, ...): encoded values of each record."""
        return df.select(F.col(id_col).alias(f"{prefix}_id"), *(f.value(df, side).alias(f"{prefix}_{i}") for i, f in enumerate(self.fields.values())))

    def vector(self, a: str = "a", b: str = "b") -> Column:
        return self._vector(lambda i: F.col(f"{a}_{i}"), lambda i: F.col(f"{b}_{i}"))

    def _vector(self, a: Callable[[int], Column], b: Callable[[int], Column]) -> Column:
        return F.struct(*(f.similarity(a(i), b(i)).alias(n) for i, (n, f) in enumerate(self.fields.items())))

    def compare(self, pairs: DataFrame, left: DataFrame, right: DataFrame | None = None, id_col: str = "id") -> DataFrame:
        """pairs (a_id, b_id) with `sim`. Only ids and encoded values are shuffled."""
        x = pairs.join(self.prepare(left, 0, id_col, "a"), "a_id").join(self.prepare(right if right is not None else left, 1, id_col, "b"), "b_id")
        return x.select("a_id", "b_id", self.vector().alias("sim"))

    def compare_bundles(self, left: DataFrame, blockings: list[Blocking], id_col: str = "id", right: DataFrame | None = None, right_blockings: list[Blocking] | None = None, split: int | None = SPLIT, carry: Callable[[DataFrame], Column] | None = None, member: Callable[[DataFrame], Column] | None = None) -> DataFrame:
        """(a_ids, b_ids, sim) of the bundles that meet in these indices (`blocking.meet`):
        records of the same keys and values are compared once, and no pair is shuffled.
        carry: adds a_c and b_c, of values that are to be the same in a bundle too.
        member: what each record brings along (m)."""
        other = left if right is None else right
        one = lambda df, side: F.struct(*(f.value(df, side).alias(f"_{i}") for i, f in enumerate(self.fields.values())))
        twice = right is None and any(f.fields[0] is not f.fields[1] or f.encodes[0] is not f.encodes[1] for f in self.fields.values())

        def value(df: DataFrame, side: int) -> Column:
            both = [one(df, side).alias("s"), *([one(df, 1).alias("t")] if twice else []), *([] if carry is None else [carry(df).alias("c")])]
            return F.struct(*both)

        members = (None, None) if member is None else (member(left), member(other))
        met = meet(left, blockings, id_col, right, right_blockings, split, (value(left, 0), value(other, 1)), members)
        a, b = F.col("a_v.s"), F.col("b_v.t" if twice else "b_v.s")
        carried = [] if carry is None else [F.col("a_v.c").alias("a_c"), F.col("b_v.c").alias("b_c")]
        return met.select("a_ids", "b_ids", self._vector(lambda i: a[f"_{i}"], lambda i: b[f"_{i}"]).alias("sim"), *carried)

    def compare_blocks(self, left: DataFrame, blockings: list[Blocking], id_col: str = "id", right: DataFrame | None = None, right_blockings: list[Blocking] | None = None, split: int | None = SPLIT) -> DataFrame:
        """(a_id, b_id, sim) of all candidate pairs of these indices."""
        if one_key(blockings, left) and (right is None or one_key(right_blockings or blockings, right)):
            return pairs(self.compare_bundles(left, blockings, id_col, right, right_blockings, split), right is None, "sim")
        return self.compare(candidates(left, blockings, id_col, right, right_blockings, split), left, right, id_col)
