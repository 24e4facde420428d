"""Text features against the matrix of all terms."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector

from pointloom.functions.text import axes, text_points


def test_axes_are_the_principal_ones(spark):
    x = np.random.default_rng(1).normal(size=(60, 12)) * np.linspace(5, 1, 12) + 3.0
    rows = spark.createDataFrame([(list(range(12)), v.tolist()) for v in x], "i array<int>, v array<double>")
    pc = PCA(k=3, inputCol="w", outputCol="p").fit(rows.select(array_to_vector("v").alias("w"))).pc.toArray()
    got = axes(rows, 60, 12, 3)
    assert np.allclose(np.abs((pc * got).sum(axis=0)), 1.0, atol=1e-6)


def test_documents_of_rare_terms_are_no_zero_vectors(spark):
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c for a in letters for b in letters for c in "xyz"][:1001]  # more than were kept
    docs = [(i, " ".join(words)) for i in range(3)] + [(3, "seltenes wort"), (4, "seltenes wort"), (5, "anderes wort")]
    got = {r["point_id"]: np.abs(r["x"]).max() for r in text_points(spark.createDataFrame(docs, "id long, text string"), "id", "text", 2).collect()}
    assert len(got) == 6 and got[3] > 1e-3
