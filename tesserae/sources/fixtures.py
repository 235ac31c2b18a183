"""Molecule-shaped views of plain tables: what the operators' queries run on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An atom per line item: mol_id, atom_idx, atomic_number, x, y, z, fx, fy, fz."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return line.select(
        F.col("l_orderkey").alias("mol_id"),
        (F.row_number().over(order) - 1).alias("atom_idx"),
        (1 + F.col("l_partkey") % 118).cast("int").alias("atomic_number"),
        (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y"), (F.col("l_discount") * 50).alias("z"),
        (F.col("l_tax") - 0.04).alias("fx"), (F.col("l_discount") - 0.05).alias("fy"), ((F.col("l_quantity") - 25) / 100).alias("fz"),
    )


def order_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mol_id"), (-F.col("o_totalprice") / 1000).alias("energy"))


def order_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A molecule per order, atoms as arrays in order; orders without line items have none."""
    atom = F.struct("atom_idx", "atomic_number", F.array("x", "y", "z").alias("p"), F.array("fx", "fy", "fz").alias("f"))
    rows = order_atoms(spark, sf_dir).groupBy("mol_id").agg(F.array_sort(F.collect_list(atom)).alias("a"))
    whole = order_energies(spark, sf_dir).join(rows, "mol_id", "left")
    own = F.coalesce("a", F.array().cast("array<struct<atom_idx:int,atomic_number:int,p:array<double>,f:array<double>>>"))
    return whole.select("mol_id", own["atomic_number"].alias("atomic_numbers"), own["p"].alias("positions"), own["f"].alias("forces"), "energy")


def vector_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A molecule of 21 atoms per embedding: floats 1 to 63 as positions, in reverse as forces, float 64 as energy."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    at = F.sequence(F.lit(0), F.lit(20))
    triple = lambda i: F.slice("e", i * 3 + 1, 3)
    back = lambda i: F.reverse(F.slice("e", 63 - i * 3 - 2, 3))
    return v.select(
        F.col("vec_id").alias("mol_id"), "label",
        F.transform(at, lambda i: (1 + (i * 7 + F.col("label")) % 118).cast("int")).alias("atomic_numbers"),
        F.transform(at, triple).alias("positions"), F.transform(at, back).alias("forces"), F.get("e", F.lit(63)).alias("energy"),
    )


def vector_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded vector_molecules: mol_id, atom_idx, atomic_number, x, y, z, fx, fy, fz, energy."""
    return explode_atoms(vector_molecules(spark, sf_dir))


def explode_atoms(molecules: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    rows = molecules.select("mol_id", "energy", *keep, F.posexplode(F.arrays_zip("atomic_numbers", "positions", "forces")).alias("atom_idx", "a"))
    axes = [F.get(F.col("a")[k], F.lit(i)).alias(n) for k, names in (("positions", "x y z"), ("forces", "fx fy fz")) for i, n in enumerate(names.split())]
    return rows.select("mol_id", "atom_idx", F.col("a.atomic_numbers").alias("atomic_number"), *axes, "energy", *keep)


def task_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, group_id, state, idx, pred, target) of the seven grouped tasks, from pairs of embedding components."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    at = lambda n: F.get("e", F.lit(n - 1))

    def rows(task: str, group, state, idx, pred: int, keep=None) -> DataFrame:
        df = v if keep is None else v.where(keep)
        return df.select(F.lit(task).alias("task"), group.cast("long").alias("group_id"), state.cast("string").alias("state"), idx.cast("long").alias("idx"), at(pred).alias("pred"), at(pred + 1).alias("target"))

    vec, half, third = F.col("vec_id"), F.floor(F.col("vec_id") / 2), F.floor(F.col("vec_id") / 3)
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (vec % n + 1).cast("int"))
    none = F.lit("")
    parts = [
        rows("conformers", F.col("label"), none, vec, 63), rows("distance_scaling", F.col("label"), none, vec, 63),
        rows("spin_gap", half, pick(2, "singlet", "triplet"), vec, 63), rows("protonation", half, pick(2, "protonated", "deprotonated"), vec, 61),
        rows("ligand_strain", half, pick(2, "bound", "relaxed"), vec, 59),
        rows("ie_ea", third, pick(3, "neutral", "cation", "anion"), vec, 63, ((vec % 3 != 1) | (F.col("label") % 4 != 0)) & ((vec % 3 != 2) | (F.col("label") % 3 != 0))),
        rows("ligand_pocket", vec, F.lit("complex"), vec, 63),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
