"""Match verdicts and scores of compared pairs.

Every classifier takes (a_id, b_id, sim) and adds is_match (boolean, null for
uncertain) and score (double).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from linkweave.functions.vectors import as_array, l2, log_ratio
from linkweave.operators.blocking import Blocking, pairs
from linkweave.operators.compare import Record
from linkweave.plans.lineage import staged

Rule = Callable[..., Column]
#: The compared tables, the second None where it is the first, and their id column.
Sides = tuple[DataFrame, DataFrame | None, str]
Distance = Callable[[Column, Column], Column]
Vector = Sequence[float | None]
#: In place of sides: the records' columns are in structs a_c and b_c already.
CARRIED = "carried"
#: Labelled examples that load_examples brings to the driver at most.
MAX_EXAMPLES = 10_000


def rule_verdicts(compared: DataFrame, rule: Rule, sides: Sides | str | None = None) -> DataFrame:
    """is_match: the rule's value, true, false or null (uncertain); it must be boolean.
    A rule gets `sim`; with sides, also both records, as structs of their columns (what
    it doesn't use of them is not read)."""
    x, args = compared, [F.col("sim")]
    if sides == CARRIED:
        args += [F.col("a_c"), F.col("b_c")]
    elif sides:
        left, right, id_col = sides
        for p, df in (("a", left), ("b", left if right is None else right)):
            record = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(f"_{p}")
            x = x.join(df.select(F.col(id_col).alias(f"{p}_id"), record), f"{p}_id")
            args.append(F.col(f"_{p}"))
    out = x.withColumn("is_match", rule(*args)).select(*compared.columns, "is_match")
    if not isinstance(out.schema["is_match"].dataType, BooleanType):
        raise TypeError("a rule must be true, false or null")
    return out


def rule_classify(compared: DataFrame, rule: Rule, sides: Sides | str | None = None) -> DataFrame:
    """Scores 1.0 and 0.0; uncertain pairs are left out."""
    return rule_verdicts(compared, rule, sides).where("is_match is not null").withColumn("score", F.col("is_match").cast("double"))


def _literal(v: Vector) -> Column:
    return F.array(*(F.lit(x).cast("double") for x in v)).cast("array<double>")


def _as_value(compared: DataFrame, examples: Sequence[Vector]) -> Column:
    rows = [[None if x is None else float(x) for x in e] for e in examples]
    return compared.sparkSession.createDataFrame([(rows,)], "examples array<array<double>>").scalar()


def _nearest(v: Column, examples: Column, distance: Distance) -> Column:
    none = F.raise_error(F.lit("no examples")).cast("double")
    return F.when(F.size(examples) == 0, none).otherwise(F.array_min(F.transform(examples, lambda e: distance(v, e))))


def nearest_classify(compared: DataFrame, matches: Sequence[Vector], nonmatches: Sequence[Vector], distance: Distance = l2, rule: Rule | None = None, sides: Sides | None = None) -> DataFrame:
    """Match where the nearest match example is nearer than the nearest non-match
    one (a tie is a non-match); score is the log ratio of the distances. A rule that
    gives true or false decides first, with score 1.0 or 0.0; with sides it sees the
    records. No shuffle but for these: examples, of the caller's own number, go to tasks
    as one value, not as literals of the plan."""
    v = as_array(F.col("sim"), compared.schema["sim"].dataType.names)
    x = compared.withColumn("_r", F.lit(None).cast("boolean")) if rule is None else rule_verdicts(compared, rule, sides).withColumnRenamed("is_match", "_r")
    x = x.withColumns({"_m": _as_value(compared, matches), "_n": _as_value(compared, nonmatches)})
    near = F.struct(_nearest(v, F.col("_m"), distance).alias("m"), _nearest(v, F.col("_n"), distance).alias("n"))
    x = x.withColumn("_d", F.when(F.col("_r").isNull(), near))
    x = x.withColumn("is_match", F.coalesce("_r", F.col("_d.m") < F.col("_d.n")))
    return x.withColumn("score", F.coalesce(F.col("_r").cast("double"), log_ratio(F.col("_d.m"), F.col("_d.n")))).drop("_r", "_d", "_m", "_n")


def kmeans_classify(compared: DataFrame, distance: Distance = l2, maxiter: int = 10, weight: str | None = None) -> DataFrame:
    """Two means, from the greatest and least of each component; match where the high
    centroid is nearer. Null components count nowhere; a component without any value
    is an error. Labels are those of the last pass, scores use the centroids updated
    after it. One aggregation a pass, of 2 * components averages. weight: a column that tells
    how many pairs a row stands for, for bundles; rows of none are left out."""
    names = compared.schema["sim"].dataType.names
    data = staged(compared if weight is None else compared.where(F.col(weight) > 0), "kmeans")
    v = as_array(F.col("sim"), names)
    n = range(len(names))

    def mean(side: Column, x: Column) -> Column:
        if weight is None:
            return F.avg(F.when(side, x))
        w = F.col(weight)
        return F.try_divide(F.sum(F.when(side, x * w)), F.sum(F.when(side & x.isNotNull(), w)))

    first = data.agg(F.count("*"), *(F.max(v[i]) for i in n), *(F.min(v[i]) for i in n)).first()
    if not first[0]:
        return data.withColumn("is_match", F.lit(None).cast("boolean")).withColumn("score", F.lit(None).cast("double"))
    high, low = list(first[1 : 1 + len(names)]), list(first[1 + len(names) :])
    if None in high:
        raise ValueError("a component without values")
    match = F.lit(False)
    for _ in range(maxiter):
        before, match = match, F.coalesce(distance(v, _literal(high)) < distance(v, _literal(low)), F.lit(False))
        means = [mean(side, v[i]) for side in (match, ~match) for i in n]
        row = data.agg(F.sum((match != before).cast("int")), *means).first()
        high, low = list(row[1 : 1 + len(names)]), list(row[1 + len(names) :])
        if not row[0]:
            break
    score = log_ratio(distance(v, _literal(high)), distance(v, _literal(low)))
    return data.withColumn("is_match", match).withColumn("score", score)


def label_value(label: Column, kind: str) -> Column:
    """true, false, or null for other labels. Strings are case-sensitive."""
    if kind == "boolean":
        return label
    if kind == "string":
        return F.when(label.isin("TRUE", "T", "YES", "Y", "1"), True).when(label.isin("FALSE", "F", "NO", "N", "0"), False)
    return F.when(label == 1, True).when(label == 0, False)


def example_vectors(comparator: Record, records: DataFrame, label: str, key: str, id_col: str) -> DataFrame:
    """(label, a_id, b_id, sim): similarity of all records that share label and key.
    Other labels are left out; empty keys are errors."""
    x = records.withColumn("_label", label_value(F.col(label), records.schema[label].dataType.typeName())).where("_label is not null")

    def keys(df: DataFrame) -> Column:
        k = F.col(key).cast("string")
        return F.when(k.isNull() | (k == ""), k).otherwise(F.concat_ws("|", F.col("_label").cast("string"), k))

    met = comparator.compare_bundles(x, [Blocking("examples", keys)], id_col, carry=lambda d: F.col("_label"))
    return pairs(met.withColumnRenamed("a_c", "label"), True, "label", "sim").select("label", "a_id", "b_id", "sim")


def load_examples(comparator: Record, records: DataFrame, label: str, key: str, id_col: str, outdir: str | None = None) -> tuple[list[Vector], list[Vector]]:
    """(match vectors, non-match vectors), for nearest_classify. outdir: where the pairs'
    comparisons are reported too, as folders examples_true.csv and examples_false.csv."""
    x = example_vectors(comparator, records, label, key, id_col)
    if outdir:
        from linkweave.plans.reports import comparison_report
        from linkweave.sources.csv_files import write_csv

        keyed = Blocking(key, lambda d: F.col(f"`{key}`"), strict=False)
        order = ["a_id", "b_id", "ordinal"]
        for name, side in (("true", x.where("label")), ("false", x.where("not label"))):
            report = comparison_report(side, records, [keyed], comparator, id_col)
            write_csv(report.orderBy(*order).drop(*order), f"{outdir}/examples_{name}.csv")
    rows = x.limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} examples")
    return [list(r["sim"]) for r in rows if r["label"]], [list(r["sim"]) for r in rows if not r["label"]]
