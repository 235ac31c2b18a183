"""Error metrics: reconstruction, structures to energies and forces, and seven grouped energy tasks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.order import quantiles

MEV = 1000.0
#: Energy (eV) and force (eV per length) tolerances of a structure that counts as predicted well.
ENERGY_TOLERANCE, FORCE_TOLERANCE = 0.02, 0.03


def error_summary(df: DataFrame, error: Column, by: Iterable[str] = ()) -> DataFrame:
    """mae, median_error, rmse and max_error of a column of signed errors, per group. Groups are a few: their rows pass through the driver."""
    by = list(by)
    rows = df.select(*by, F.abs(error).alias("__e")).persist()
    e = F.col("__e")
    found = quantiles(rows, "__e", [0.5], by, also=[F.avg(e), F.sqrt(F.avg(e * e)), F.max(e)])
    out = [(*g, mean, (median or [None])[0], rmse, most) for g, (median, (mean, rmse, most)) in found.items()]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by]
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, ", ".join([*kinds, "mae double, median_error double, rmse double, max_error double"]))


def stacked(df: DataFrame, channels: dict[str, list[tuple[str, str]]], keep: Iterable[str] = ()) -> DataFrame:
    """(keep..., channel, error) with a row per component: channels names pairs of (original, reconstructed) columns."""
    pairs = [F.struct(F.lit(name).alias("channel"), (F.col(a) - F.col(b)).alias("error")) for name, columns in channels.items() for a, b in columns]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("x")).select(*keep, "x.channel", "x.error")


def s2ef(predicted: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """Energy and force metrics of predictions against targets (key, energy, forces array<array<double>>), joined by key.

    Forces are compared atom by atom inside the row, so one shuffle on the key and one aggregation are all there is.
    Structures without a prediction are not counted. A zero vector's cosine is 0.
    """
    p = predicted.select(key, F.col("energy").alias("pe"), F.col("forces").alias("pf"))
    t = target.select(key, F.col("energy").alias("te"), F.col("forces").alias("tf"))
    both = p.join(t, key)
    get = lambda v, i: F.get(v, F.lit(i))
    length = lambda v: F.sqrt(get(v, 0) * get(v, 0) + get(v, 1) * get(v, 1) + get(v, 2) * get(v, 2))
    atom = F.zip_with("pf", "tf", lambda a, b: F.struct(
        *(F.abs(get(a, i) - get(b, i)).alias(n) for i, n in enumerate("xyz")), F.abs(length(a) - length(b)).alias("m"),
        F.when(length(a) * length(b) > 0, (get(a, 0) * get(b, 0) + get(a, 1) * get(b, 1) + get(a, 2) * get(b, 2)) / (length(a) * length(b))).otherwise(0.0).alias("c"),
    ))
    rows = both.select(F.abs(F.col("pe") - F.col("te")).alias("e"), F.size("tf").alias("n"), atom.alias("a"))
    total = lambda f: F.aggregate(F.transform("a", lambda r: r[f]), F.lit(0.0), lambda s, x: s + x)
    worst = F.array_max(F.transform("a", lambda r: F.greatest(r["x"], r["y"], r["z"])))
    rows = rows.select("e", "n", *(total(f).alias(f) for f in "xyzmc"), ((F.col("e") < ENERGY_TOLERANCE) & (F.coalesce(worst, F.lit(0.0)) < FORCE_TOLERANCE)).alias("good"))
    per_atom = lambda c: F.try_divide(F.sum(c), F.sum("n"))
    return rows.agg(
        (F.avg("e") * MEV).alias("energy_mae"), (F.avg(F.try_divide(F.col("e"), F.col("n"))) * MEV).alias("energy_mae_per_atom"),
        (F.try_divide(F.sum(F.col("x") + F.col("y") + F.col("z")), 3 * F.sum("n")) * MEV).alias("forces_mae"),
        *((per_atom(c) * MEV).alias(f"forces{c}_mae") for c in "xyz"), per_atom("c").alias("forces_cos"), (per_atom("m") * MEV).alias("forces_magnitude"),
        F.avg(F.col("good").cast("double")).alias("efwt"), F.count("*").alias("n_structures"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_atoms"),
    )


def conformers(rows: DataFrame) -> DataFrame:
    """Share of groups whose lowest predicted energy is the lowest target energy (the first index on ties)."""
    low = lambda c: F.min(F.struct(F.col(c).alias("e"), F.col("idx").alias("i")))["i"]
    groups = rows.groupBy("group_id").agg(low("pred").alias("p"), low("target").alias("t"))
    hit = F.sum((F.col("p") == F.col("t")).cast("long"))
    return groups.agg(F.coalesce(F.try_divide(hit, F.count("*")), F.lit(0.0)).alias("accuracy"), F.coalesce(hit, F.lit(0)).alias("correct"), F.count("*").alias("total"))


def distance_scaling(rows: DataFrame) -> DataFrame:
    """Mean over systems of each one's mean absolute error."""
    systems = rows.groupBy("group_id").agg(F.avg(F.abs(F.col("pred") - F.col("target"))).alias("mae"))
    return systems.agg((F.coalesce(F.avg("mae"), F.lit(0.0)) * MEV).alias("mae_mev"), F.count("*").alias("n_systems"))


def distance_detail(rows: DataFrame) -> DataFrame:
    """Per system its distances, predictions and targets in order of distance: lists as long as the system."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("d"), "pred", "target")))
    return rows.groupBy("group_id").agg(listed.alias("l")).select("group_id", F.col("l.d").alias("distances"), F.col("l.pred").alias("preds"), F.col("l.target").alias("targets"))


def _states(rows: DataFrame, *names: str) -> DataFrame:
    """A row per group with <state>_p and <state>_t for each state: one aggregation instead of self-joins."""
    at = lambda n, c: F.first(F.when(F.col("state") == n, F.col(c)), ignorenulls=True)
    return rows.groupBy("group_id").agg(*(at(n, c).alias(f"{n}_{c[0]}") for n in names for c in ("pred", "target")))


def gap_errors(rows: DataFrame, upper: str, lower: str) -> DataFrame:
    """(group_id, pred_gap, target_gap, error) of the groups that have both states: energy of `upper` minus that of `lower`."""
    both = _states(rows, upper, lower)
    gap = lambda c: F.col(f"{upper}_{c}") - F.col(f"{lower}_{c}")
    out = both.select("group_id", gap("p").alias("pred_gap"), gap("t").alias("target_gap")).where("pred_gap IS NOT NULL AND target_gap IS NOT NULL")
    return out.withColumn("error", F.col("pred_gap") - F.col("target_gap"))


def gap_mae(rows: DataFrame, upper: str, lower: str) -> DataFrame:
    """Mean absolute error of the gaps; 0 without any."""
    return gap_errors(rows, upper, lower).agg((F.coalesce(F.avg(F.abs("error")), F.lit(0.0)) * MEV).alias("mae_mev"), F.count("*").alias("n"))


def ionisation_affinity(rows: DataFrame) -> DataFrame:
    """Errors of cation minus neutral and of neutral minus anion, each over the groups that have the states."""
    all_three = _states(rows, "neutral", "cation", "anion")
    gap = lambda a, b, c: F.col(f"{a}_{c}") - F.col(f"{b}_{c}")
    miss = lambda a, b: F.abs(gap(a, b, "p") - gap(a, b, "t"))
    out = all_three.select(miss("cation", "neutral").alias("ie"), miss("neutral", "anion").alias("ea"))
    mae = lambda c: (F.coalesce(F.avg(c), F.lit(0.0)) * MEV).alias(f"{c}_mae_mev")
    return out.agg(mae("ie"), F.count("ie").alias("n_ie"), mae("ea"), F.count("ea").alias("n_ea"))


def pocket_mae(rows: DataFrame) -> DataFrame:
    """Mean absolute error of the complexes' total energies."""
    return rows.agg((F.coalesce(F.avg(F.abs(F.col("pred") - F.col("target"))), F.lit(0.0)) * MEV).alias("mae_mev"), F.count("*").alias("n"))


TASKS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "conformers": conformers,
    "distance_scaling": distance_scaling,
    "spin_gap": lambda rows: gap_mae(rows, "triplet", "singlet"),
    "ie_ea": ionisation_affinity,
    "protonation": lambda rows: gap_mae(rows, "protonated", "deprotonated"),
    "ligand_strain": lambda rows: gap_mae(rows, "bound", "relaxed"),
    "ligand_pocket": pocket_mae,
}


def task_rows(evaluation: DataFrame, task: str) -> DataFrame:
    return evaluation.where(F.col("task") == task)


#: States of each task, and the gaps (upper, lower) that its errors are of.
GAPS = {
    "spin_gap": {"": ("triplet", "singlet")}, "protonation": {"": ("protonated", "deprotonated")}, "ligand_strain": {"": ("bound", "relaxed")},
    "ie_ea": {"ie_": ("cation", "neutral"), "ea_": ("neutral", "anion")},
}


def all_tasks(evaluation: DataFrame, tasks: Iterable[str]) -> dict[str, Row]:
    """Every named task's result row from one scan: rows meet by task and group, then by task; nothing is read twice."""
    tasks = list(tasks)
    low = lambda c: F.min(F.struct(F.col(c).alias("e"), F.col("idx").alias("i")))["i"]
    miss = F.abs(F.col("pred") - F.col("target"))
    states = sorted({n for t in tasks for pair in GAPS.get(t, {}).values() for n in pair})
    at = lambda n, c: F.first(F.when(F.col("state") == n, F.col(c)), ignorenulls=True)
    seen = [at(n, c).alias(f"{n}_{c[0]}") for n in states for c in ("pred", "target")]
    groups = evaluation.where(F.col("task").isin(tasks)).groupBy("task", "group_id").agg((low("pred") == low("target")).cast("long").alias("hit"), F.avg(miss).alias("mean"), F.sum(miss).alias("total"), F.count(miss).alias("known"), F.count("*").alias("rows"), *seen)
    gap = lambda a, b, c: F.col(f"{a}_{c}") - F.col(f"{b}_{c}")
    error = lambda a, b: F.abs(gap(a, b, "p") - gap(a, b, "t"))
    pairs = [(f"{t}/{name}", *pair) for t in tasks for name, pair in GAPS.get(t, {}).items()]
    own = lambda key, e: F.when(F.col("task") == key.split("/")[0], e)
    sums = [x for key, a, b in pairs for x in (F.avg(own(key, error(a, b))).alias(f"{key}/mae"), F.count(own(key, error(a, b))).alias(f"{key}/n"))]
    found = groups.groupBy("task").agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.avg("mean").alias("mean"), F.try_divide(F.sum("total"), F.sum("known")).alias("each"), F.sum("rows").alias("rows"), *sums
    )
    by = {r["task"]: r for r in found.collect()}  # a row per task
    out = {}
    for t in tasks:
        r = by[t].asDict() if t in by else {}
        mev = lambda x: (x or 0.0) * MEV
        if t == "conformers":
            n = r.get("groups", 0)
            out[t] = Row(accuracy=r["hits"] / n if n else 0.0, correct=r.get("hits", 0), total=n)
        elif t == "distance_scaling":
            out[t] = Row(mae_mev=mev(r.get("mean")), n_systems=r.get("groups", 0))
        elif t == "ligand_pocket":
            out[t] = Row(mae_mev=mev(r.get("each")), n=r.get("rows", 0))
        else:
            out[t] = Row(**{k: v for name in GAPS[t] for k, v in ((f"{name}mae_mev", mev(r.get(f"{t}/{name}/mae"))), (f"n_{name[:-1]}" if name else "n", r.get(f"{t}/{name}/n", 0)))})
    return out


def run_tasks(evaluation: DataFrame, tasks: Iterable[str] | None = None) -> dict[str, DataFrame | dict]:
    """A one-row result table per task. Unknown tasks are passed over.

    All tasks share one scan. Where that fails, in its plan or on some task's rows, they run one by one: a task that
    fails gives {"error": ...} and the others go on.
    """
    names, spark = [t for t in tasks or TASKS if t in TASKS], evaluation.sparkSession
    if len(names) > 1:
        try:
            return {t: spark.createDataFrame([r], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in r.asDict().items())) for t, r in all_tasks(evaluation, names).items()}
        except Exception as e:  # noqa: BLE001 - which task it was shows below
            logging.getLogger(__name__).info("tasks run one by one: %s", e)
    out: dict[str, DataFrame | dict] = {}
    for name in names:
        try:
            made = TASKS[name](task_rows(evaluation, name))
            out[name] = spark.createDataFrame(made.collect(), made.schema)  # one row: here a task fails, if it does
        except Exception as e:  # noqa: BLE001 - a task's failure is its result
            out[name] = {"error": str(e)}
    return out


#: The first of these that a task's result has is its headline.
HEADLINES = ("accuracy", "mae_mev", "ie_mae_mev")


def headlines(results: dict[str, DataFrame | dict], spark: SparkSession) -> DataFrame:
    """(task, metric, value) of every result of `run_tasks`; a failed task has the metric "error" and no value."""
    rows = []
    for name, result in results.items():
        if isinstance(result, DataFrame):
            metric = next(h for h in HEADLINES if h in result.columns)
            rows.append((name, metric, float(result.first()[metric])))
        else:
            rows.append((name, "error", None))
    return spark.createDataFrame(rows, "task string, metric string, value double")


def summary(evaluation: DataFrame, tasks: Iterable[str] | None = None) -> DataFrame:
    """(task, metric, value) of every task's headline."""
    return headlines(run_tasks(evaluation, tasks), evaluation.sparkSession)
