"""Would an intervention help? Outcome frame, regression effect, robustness and decision, for all scopes in one pass."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions.vocabulary import CAUSAL_FINDINGS
from caselens.sources.scratch import held

from .log import Log, assignees, objects

MIN_ROWS = 6
MIN_ROBUSTNESS = 0.3
SINGULAR = 1e-6  # of a column, what is left of its length beside the others


def outcome_frame(log: Log, flagged: DataFrame) -> DataFrame:
    """flagged: cse_id, case_id. T is 1 for a SENIOR and 0 for a JUNIOR assignee, Y is 1 if the case isn't flagged."""
    mark = flagged.select("cse_id", "case_id", F.lit(1).alias("_f")).distinct()
    return _treated(log).join(mark, ["cse_id", "case_id"], "left").select("cse_id", "case_id", "t", F.when(F.col("_f").isNull(), 1).otherwise(0).alias("y"))


def _treated(log: Log) -> DataFrame:
    """cse_id, case_id, t of every case whose assignee is SENIOR or JUNIOR."""
    # Written, so that its size is known before the cases are joined to it: cases that share an analyst needn't meet.
    tiers = held(objects(log, "Analyst", "tier").where("tier in ('SENIOR', 'JUNIOR')").select("cse_id", F.col("object_id").alias("analyst_id"), "tier").coalesce(1))
    return assignees(log).join(tiers, ["cse_id", "analyst_id"]).select("cse_id", "case_id", (F.col("tier") == "SENIOR").cast("int").alias("t"))


def outcome_counts(log: Log, flagged: DataFrame, kinds: list[str]) -> DataFrame:
    """cse_id, finding_type, t, y, n: for each of some kinds the outcome frame's rows, counted. flagged: cse_id, case_id,
    finding_type. All cases are counted once where they lie; only those that are flagged move."""
    cases = _treated(log)
    marks = flagged.where(F.col("finding_type").isin(kinds)).select("cse_id", "case_id", "finding_type").distinct()
    hit = cases.join(marks, ["cse_id", "case_id"]).groupBy("cse_id", "finding_type", "t").agg(F.count("*").alias("_hit"))
    every = cases.groupBy("cse_id", "t").agg(F.count("*").alias("_all")).withColumn("finding_type", F.explode(F.array(*map(F.lit, kinds))))
    both = every.join(hit, ["cse_id", "finding_type", "t"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0).cast("long")))
    rows = both.select("cse_id", "finding_type", "t", F.explode(F.array(F.struct(F.lit(0).alias("y"), F.col("_hit").alias("n")), F.struct(F.lit(1).alias("y"), (F.col("_all") - F.col("_hit")).alias("n")))).alias("_o"))
    return rows.select("cse_id", "finding_type", "t", "_o.*").where("n > 0")


def t_quantile(spark: SparkSession, df: float, p: float = 0.975) -> float:
    return spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df)).inverseCumulativeProbability(p)


def slope(rows: DataFrame, keys: list[str], t: str = "t", y: str = "y", weight: str | None = None) -> DataFrame:
    """Effect of t on y by least squares, with standard error, t statistic and degrees of freedom, for each key.

    weight: how many rows each one stands for, above 0; t and y aren't null then. Under MIN_ROWS rows, or one value of t or
    y alone: `sufficient` is false and the numbers are null.
    """
    values = [F.count_distinct(t).alias("_t"), F.count_distinct(y).alias("_y")]
    if weight is None:
        sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_sxx(y, t).alias("sxx"), F.regr_sxy(y, t).alias("sxy"), F.regr_syy(y, t).alias("syy"), *values)
    else:
        n, x, z = F.col(weight).cast("double"), F.col(t).cast("double"), F.col(y).cast("double")
        added = {"_x": x, "_z": z, "_xx": x * x, "_xz": x * z, "_zz": z * z}
        sums = rows.groupBy(*keys).agg(F.sum(weight).alias("n"), *(F.sum(n * v).alias(name) for name, v in added.items()), *values)
        about = lambda both, one, other: (F.col("n") * F.col(both) - F.col(one) * F.col(other)) / F.col("n")
        sums = sums.withColumns({"sxx": about("_xx", "_x", "_x"), "sxy": about("_xz", "_x", "_z"), "syy": about("_zz", "_z", "_z")})
    enough = (F.col("n") >= MIN_ROWS) & (F.col("_t") > 1) & (F.col("_y") > 1)
    effect, df = F.col("sxy") / F.col("sxx"), F.col("n") - 2
    left = F.greatest(F.col("syy") - effect * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(left / df / F.col("sxx"))
    out = sums.select(*keys, "n", enough.alias("sufficient"), F.when(enough, effect).alias("effect"), F.when(enough, se).alias("se"), F.when(enough, df).alias("df"))
    return out.withColumn("t_stat", F.when(F.col("se") > 0, F.col("effect") / F.col("se")).when(F.col("effect") != 0, F.lit(float("inf")) * F.signum("effect")))


def regression(rows: DataFrame, confounders: list[str], t: str = "t", y: str = "y") -> dict[str, float]:
    """Effect of t on y with confounders held, over one whole frame."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    held = adjustment_set(confounders)
    ready = VectorAssembler(inputCols=[t, *held], outputCol="_x").transform(rows)
    got = LinearRegression(featuresCol="_x", labelCol=y, solver="normal").fit(ready)
    s = got.summary
    effect, se, df = float(got.coefficients[0]), float(s.coefficientStandardErrors[0]), float(s.degreesOfFreedom)
    q = t_quantile(rows.sparkSession, df)
    return {"effect": effect, "se": se, "df": df, "t_stat": effect / se, "ci_low": effect - q * se, "ci_high": effect + q * se}


def adjusted(rows: DataFrame, keys: list[str], confounders: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """Effect of t on y with confounders held, for each key: n, sufficient, effect, se, df, t_stat as `slope` gives them.

    The centred sums of squares and products of all columns are one aggregate with map-side sums, so rows never meet; each
    key's small system is then solved by Cholesky's decomposition. Rows with a null in any of the columns don't count.
    Under MIN_ROWS rows, one value of t or y alone, no degree of freedom, or columns that follow from each other:
    `sufficient` is false and the numbers are null.
    """
    names = [t, *adjustment_set(confounders)]
    rows = rows.dropna(subset=[*names, y]).select(*keys, *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*names, y])))
    k = len(names)
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.covar_pop(f"_x{i}", f"_x{j}") * F.count("*") for i, j in pairs)).alias("_s"))

    @F.pandas_udf("sufficient boolean, effect double, se double, df long")
    def solve(n: pd.Series, s: pd.Series) -> pd.DataFrame:
        out = []
        for rows_of, flat in zip(n, s, strict=True):
            full = np.zeros((k + 1, k + 1))
            for (i, j), v in zip(pairs, flat, strict=True):
                full[i, j] = full[j, i] = v
            left, sizes = rows_of - k - 1, np.sqrt(np.diag(full))
            if rows_of < MIN_ROWS or left < 1 or not (sizes > 0).all():
                out.append((False, None, None, None))
                continue
            scaled = full / np.outer(sizes, sizes)  # correlations
            try:
                low = np.linalg.cholesky(scaled[:k, :k])
            except np.linalg.LinAlgError:
                low = np.zeros((k, k))
            if np.diag(low).min() < SINGULAR:
                out.append((False, None, None, None))
                continue
            inverse = np.linalg.inv(low)
            beta = inverse.T @ (inverse @ scaled[:k, k])
            rest = max(0.0, 1 - float(beta @ scaled[:k, k])) * full[k, k]
            out.append((True, beta[0] * sizes[k] / sizes[0], math.sqrt(rest / left * float(inverse[:, 0] @ inverse[:, 0])) / sizes[0], left))
        return pd.DataFrame(out, columns=["sufficient", "effect", "se", "df"]).astype({"df": "Int64"})

    out = sums.withColumn("_o", solve("n", "_s")).select(*keys, "n", "_o.*")
    return out.withColumn("t_stat", F.when(F.col("se") > 0, F.col("effect") / F.col("se")).when(F.col("effect") != 0, F.lit(float("inf")) * F.signum("effect")))


def adjustment_set(confounders: list[str]) -> list[str]:
    """With every confounder a cause of both, and nothing else, all of them close the back doors."""
    return sorted(set(confounders))


def with_interval(effects: DataFrame) -> DataFrame:
    """Adds the 95 % interval by the t distribution; its quantile is looked up once for each number of rows."""
    spark = effects.sparkSession
    sizes = [r["df"] for r in effects.select("df").where("df is not null and df <= 1000").distinct().collect()]  # 1000 at most
    table = {float(d): t_quantile(spark, d) for d in sizes}
    large = F.lit(1.959963984540054) + F.lit(2.3722712358) / F.col("df") + F.lit(2.8225) / (F.col("df") * F.col("df"))  # the quantile's expansion in 1 / df
    q = F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("df").cast("double")], large) if table else large
    return effects.withColumns({"ci_low": F.col("effect") - q * F.col("se"), "ci_high": F.col("effect") + q * F.col("se")})


def robustness(t_stat: Column, df: Column, q: float = 1.0) -> Column:
    """Share of both residual variances that a hidden confounder must explain to undo the effect."""
    f = q * F.abs(t_stat) / F.sqrt(df)
    return F.when(f == float("inf"), 1.0).when(f == 0, 0.0).otherwise(2 * f * f / (F.sqrt(F.pow(f, 4) + 4 * f * f) + f * f))


def decide(ci_low: Column, ci_high: Column, value: Column) -> Column:
    clear = (ci_low > 0) | (ci_high < 0)
    return F.when(clear & (value >= MIN_ROBUSTNESS), "ACT").otherwise("INVESTIGATE_MORE")


def opportunities(rows: DataFrame, keys: list[str], confounders: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Effect, interval, robustness and decision for each key; insufficient frames decide nothing. weight: as in slope,
    without confounders."""
    if confounders and weight:
        raise ValueError("counted rows with confounders")
    out = with_interval(adjusted(rows, keys, confounders) if confounders else slope(rows, keys, weight=weight)).withColumn("robustness", robustness(F.col("t_stat"), F.col("df")))
    return out.withColumn("decision", F.when(F.col("sufficient"), decide(F.col("ci_low"), F.col("ci_high"), F.col("robustness"))))


class NotConfirmed(ValueError):
    """An intervention is only estimated for a finding that was confirmed."""


def gate(verdict: str) -> None:
    if verdict != "TRUE_SUPERVISORY_FINDING":
        raise NotConfirmed(verdict)


def entity_report(log: Log, concerns: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """For each entity and supported finding type a `preliminary` row, and a `confirmed` row for each finding with a
    TRUE verdict (verdicts: finding_id, verdict). Both give the same estimate; only the second passed the gate."""
    rows = held(outcome_counts(log, concerns.select("cse_id", F.col("primary_id").alias("case_id"), "finding_type"), list(CAUSAL_FINDINGS)))
    seen = concerns.where(F.col("finding_type").isin(*CAUSAL_FINDINGS)).select("cse_id", "finding_type").distinct()
    found = opportunities(rows, ["cse_id", "finding_type"], weight="n").join(seen, ["cse_id", "finding_type"], "left_semi")
    out = found.withColumns({"level": F.lit("preliminary"), "finding_id": F.lit(None).cast("string")})
    if verdicts is None:
        return out
    true = concerns.select("cse_id", "finding_type", "finding_id").join(verdicts.where("verdict = 'TRUE_SUPERVISORY_FINDING'").select("finding_id").distinct(), "finding_id", "left_semi")
    return out.unionByName(found.join(true, ["cse_id", "finding_type"]).withColumn("level", F.lit("confirmed")))


def unsupported(concerns: DataFrame) -> DataFrame:
    """Finding types that no intervention is estimated for, with how many concerns each entity has of them."""
    return concerns.where(~F.col("finding_type").isin(*CAUSAL_FINDINGS)).groupBy("cse_id", "finding_type").agg(F.count("*").alias("n"))


# The rates that a scenario starts from, as log odds, and how common its confounder is.
BASE_RATE = -0.5
CONFOUNDED = 0.4


def scenario(spark: SparkSession, n: int, seed: int, effect: float, c_to_t: float = 0.0, c_to_y: float = 0.0) -> DataFrame:
    """C is Bernoulli(CONFOUNDED); T and Y are logistic in C, and Y in T, from BASE_RATE."""
    drawn = lambda k, odds: (F.rand(seed + k) < 1 / (1 + F.exp(-(BASE_RATE + odds)))).cast("int")
    rows = spark.range(n).select((F.rand(seed) < CONFOUNDED).cast("int").alias("c"))
    rows = rows.withColumn("t", drawn(1, c_to_t * F.col("c")))
    return rows.withColumn("y", drawn(2, effect * F.col("t") + c_to_y * F.col("c")))
