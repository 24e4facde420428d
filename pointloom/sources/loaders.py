"""Public tables as point clouds: a cached file where there is one, else a stand-in of the same shape."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources.generators import DataSpec, from_table, generate, inject_noise, inject_outliers
from pointloom.sources.sinks import read_table

#: Endings under which a table is looked for, in turn; a tsv has its label first and no header, as series archives have them.
ENDINGS = ("parquet", "csv", "tsv")


def cached(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, str] | None:
    """(table, path) of the first file of `name` in `folder` that can be read, or None."""
    for ending in ENDINGS:
        path = f"{folder.rstrip('/')}/{name}.{ending}"
        try:
            return read_table(spark, path), path
        except AnalysisException:
            continue
    return None


def load_points(spark: SparkSession, name: str, spec: DataSpec, folder: str | None = None, label: str | None = None) -> tuple[DataFrame, str]:
    """(points, where they are from): `name` from a file of `folder`, or drawn by the generator of that name.

    Of a file, `label` (by default the column `target`, `class` or `label`, of a tsv the
    first) is numbered densely by value, all other numeric columns are features, of
    more than `spec.n_features` a random projection is taken and of more than
    `spec.n_samples` rows a hash sample. Noise and outliers of `spec` are added to
    either. A name without file and generator is a KeyError.
    """
    found = cached(spark, name, folder) if folder else None
    if found is None:
        return generate(spark, name, spec), "generated"
    table, path = found
    if label is None:
        label = table.columns[0] if path.endswith(".tsv") else next((c for c in ("target", "class", "label") if c in table.columns), None)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    features = [c for c, t in table.dtypes if c != label and t.startswith(numeric)]
    known = table.select(*[F.nanvl(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features else F.col(c) for c in table.columns]).fillna(0.0, features)
    points = from_table(known, features, label, spec.n_samples or None, spec.n_features or None, spec.seed)
    if spec.noise:
        points = inject_noise(points, spec.noise, spec.seed)
    if spec.outliers:
        points = inject_outliers(points, spec.outliers, spec.seed, spec.outlier_extremity)
    return points, path
