"""Cost model, gap search and mutation over algorithm cards.

Cards are a small dimension table (`name`, `mechanism_tags`, `inductive_biases`,
`time_expr`, `memory_expr`, ...); tasks and fingerprints may be many. Whatever pairs
the two joins the exploded biases of the cards with a table of rules, so work grows
with fingerprints times distinct rules.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.relational import expand_grid, nearest, strided, upper_median

#: Distinct cost formulas that cards may have; each becomes a branch of one expression.
MAX_FORMULAS = 1000
DEFAULT_TIME, DEFAULT_MEMORY = 1e-8, 8e-6

# Bias, signal, when it counts, weight. The second name of a bias is the one used by the supplied cards.
BIAS_RULES = (
    ("convex_clusters", "conv_cv", "low", 0.30),
    ("round_groups", "conv_cv", "low", 0.30),
    ("non_convex_capable", "conv_cv", "high", 0.25),
    ("curved_groups", "conv_cv", "high", 0.25),
    ("outlier_robust", "outlier_frac", "high", 0.30),
    ("noise_aware", "outlier_frac", "high", 0.30),
    ("subspace_structured", "eff_dim", "low_relative_to_d", 0.25),
    ("scales_quadratic", "log_n", "high", -0.10),
    ("ensemble", "conv_cv", "any", 0.05),
    ("meta", "conv_cv", "any", 0.10),
)

# Axes of the fingerprint grid, and the span of each axis in distances.
AXES = {
    "log_n": (2.0, 3.0, 4.0),
    "d": (2.0, 10.0, 50.0, 200.0),
    "k": (2.0, 5.0, 20.0),
    "eff_dim_ratio": (0.05, 0.5, 1.0),
    "conv_cv": (0.1, 0.5, 0.9),
    "outlier_frac": (0.0, 0.05, 0.2),
    "density_skew": (0.0, 0.3, 0.8),
}
SPANS = {"log_n": 2.0, "d": 200.0, "k": 20.0, "eff_dim_ratio": 1.0, "conv_cv": 1.0, "outlier_frac": 0.2, "density_skew": 1.0}


# What is known of a generated or public dataset without drawing it: conv_cv and eff_dim over the dimensions.
PRIORS = {
    "mdcgen": (0.30, 1.00),
    "blobs": (0.30, 1.00),
    "mixed": (0.45, 0.50),
    "anisotropic": (0.50, 1.00),
    "moons": (0.85, 0.50),
    "circles": (0.90, 0.50),
    "spiral": (0.85, 0.50),
    "swiss_roll": (0.80, 0.50),
    "s_curve": (0.70, 0.50),
    "rings": (0.85, 0.50),
    "varying_density": (0.60, 1.00),
    "imbalanced": (0.55, 1.00),
    "mixed_shapes": (0.75, 0.70),
    "extreme_outliers": (0.55, 1.00),
    "inverse_pca": (0.40, 0.10),
    "iris": (0.50, 1.00),
    "wine": (0.60, 0.85),
    "breast_cancer": (0.50, 0.50),
    "digits": (0.65, 0.40),
    "olivetti_faces": (0.75, 0.05),
    "glass": (0.65, 0.80),
    "vehicle": (0.60, 0.80),
    "segment": (0.55, 0.50),
    "yeast": (0.65, 1.00),
    "ecoli": (0.60, 0.85),
    "text20news": (0.60, 0.20),
}
# Parts of a dataset's name that speak of shapes that aren't convex.
SHAPE_NAMES = ("shape", "ring", "spiral", "moon", "graves", "fcps", "wut", "sipu")


def priors(spark, known: Mapping[str, tuple[float, float]] = PRIORS) -> DataFrame:
    """(`dataset`, `conv_cv`, `eff_dim_ratio`) as a table."""
    return spark.createDataFrame([(k, *v) for k, v in known.items()], "dataset string, conv_cv double, eff_dim_ratio double")


def formula(cards: DataFrame, column: str) -> Column:
    """The value of each row's cost formula over its columns n, d and k."""
    texts = [r[0] for r in cards.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_FORMULAS + 1).collect()]
    if len(texts) > MAX_FORMULAS:
        raise ValueError(f"more than {MAX_FORMULAS} cost formulas")
    out = F.lit(None).cast("double")
    for t in sorted(texts):
        out = F.when(F.col(column) == t, F.expr(f"cast({t} as double)")).otherwise(out)
    return out


def with_costs(tasks: DataFrame, cards: DataFrame, algo: str = "algo", time: float | str = DEFAULT_TIME, memory: float | str = DEFAULT_MEMORY) -> DataFrame:
    """Predicted `wall_pred_s` and `rss_pred_mb` of tasks (n, d, k doubles); null without a card. Calibrations are numbers or columns."""
    c = cards.select(F.col("name").alias(algo), "time_expr", "memory_expr")
    joined = tasks.join(c, algo, "left")
    factor = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    wall = F.greatest(F.lit(1e-6), factor(time) * formula(cards, "time_expr"))
    rss = F.greatest(F.lit(0.001), factor(memory) * formula(cards, "memory_expr"))
    known = F.col("time_expr").isNotNull()
    return joined.withColumn("wall_pred_s", F.when(known, wall)).withColumn("rss_pred_mb", F.when(known, rss)).drop("time_expr", "memory_expr")


def calibrate(tasks: DataFrame, cards: DataFrame, algo: str = "algo", wall: str = "wall_time_s", rss: str = "rss_delta_mb") -> DataFrame:
    """(`algo`, `time_cal`, `mem_cal`): upper median of what runs took over what the card's formula counts; defaults without runs."""
    c = cards.select(F.col("name").alias(algo), "time_expr", "memory_expr")
    joined = tasks.join(c, algo).withColumn("per_op", F.when(F.col(wall) > 0, F.col(wall) / formula(cards, "time_expr"))).withColumn("per_cell", F.when(F.col(rss) > 0, F.col(rss) / formula(cards, "memory_expr")))
    got = joined.groupBy(algo).agg(upper_median("per_op").alias("time_cal"), upper_median("per_cell").alias("mem_cal"))
    return got.select(algo, F.coalesce("time_cal", F.lit(DEFAULT_TIME)).alias("time_cal"), F.coalesce("mem_cal", F.lit(DEFAULT_MEMORY)).alias("mem_cal"))


def extremes(df: DataFrame, name: str, value: str, most: int) -> DataFrame:
    """The `most` lowest and the `most` highest rows by `value`, ties by name, each once, with the `side` they are on."""
    low = df.orderBy(F.asc_nulls_last(value), name).limit(most).withColumn("side", F.lit("lowest"))
    high = df.orderBy(F.desc_nulls_last(value), F.desc(name)).limit(most).withColumn("side", F.lit("highest"))
    return low.unionByName(high.join(low.select(name), name, "left_anti"))


def row_fingerprint(tasks: DataFrame, priors: DataFrame | None = None, dataset: str = "dataset") -> DataFrame:
    """The fingerprint that a task's parameters alone give, with priors of its dataset (conv_cv, eff_dim_ratio; 0.5 and 1 if unknown)."""
    t = tasks if priors is None else tasks.join(priors, dataset, "left")
    known = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if priors is not None else F.lit(d)
    num = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d))
    n, o, d = num("n_samples", 0.0), num("outliers", 0.0), num("n_features", 1.0)
    return t.withColumns(
        {
            "log_n": F.log10(F.greatest(F.lit(2.0), n)), "d": d, "k": num("k_target", 1.0), "eff_dim_ratio": known("eff_dim_ratio", 1.0), "conv_cv": known("conv_cv", 0.5),
            "outlier_frac": o / F.greatest(F.lit(1.0), n + o),
            "density_skew": F.least(F.lit(1.0), 1.0 - num("density", 1.0)) + F.when(num("noise", 0.0) > 0, 0.1).otherwise(0.0),
        }
    ).withColumn("eff_dim", F.col("d") * F.col("eff_dim_ratio"))


def mutator_fingerprint(tasks: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Add the other fingerprint that a task's parameters give, by which mutated cards are scored.

    `conv_cv` rises with words for shapes in the dataset's name, with low compactness
    and with noise; `outlier_frac` with outliers and low compactness, both within 0..1;
    `eff_dim` is at most twice k and four; `log_n` is a fifth of the decimal logarithm.
    """
    or_else = lambda c, d: F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) == 0, F.lit(d)).otherwise(F.col(c).cast("double"))
    n, d, k, o, c, noise = (or_else(*p) for p in (("n_samples", 1.0), ("n_features", 1.0), ("k_target", 2.0), ("outliers", 0.0), ("compactness", 1.0), ("noise", 0.0)))
    name = F.lower(F.coalesce(F.col(dataset), F.lit("")))
    hints = sum((F.when(F.contains(name, F.lit(w)), 0.25).otherwise(0.0) for w in SHAPE_NAMES), F.lit(0.0))
    bent = hints + F.greatest(F.lit(0.0), 1.0 - c) * 0.5 + F.least(F.lit(0.4), noise * 2.0)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    made = {"conv_cv": unit(bent), "outlier_frac": unit(o + 0.5 * (1.0 - c)), "eff_dim": F.least(d, k * 2.0 + 4.0), "log_n": F.log10(F.greatest(n, F.lit(10.0))) / 5.0}
    return tasks.withColumns({**made, "d": d, "n": n, "k": k})


def ari_bounds(fingerprints: DataFrame, cards: DataFrame, key: str, rules: Sequence[tuple[str, str, str, float]] = BIAS_RULES) -> DataFrame:
    """(`key`, `algo`, `bound`): 0.5 and the weights of the card's biases that a fingerprint's signals match, within 0..1.

    Cards are grouped by their weights first: a fingerprint is scored once per
    distinct set of relevant biases, in one array expression over the broadcast cards.
    """
    value = {s: F.col(s) for _, s, _, _ in rules}
    test = {"high": lambda v: v > 0.5, "low": lambda v: v < 0.3, "low_relative_to_d": lambda v: (F.col("d") > 0) & (v / F.col("d") < 0.25), "any": lambda v: F.lit(True)}
    gained = F.map_from_arrays(
        F.array(*[F.lit(b) for b, *_ in rules]), F.array(*[F.when(value[s].isNotNull() & test[p](value[s]), F.lit(w)).otherwise(0.0) for _, s, p, w in rules])
    )
    packed = cards.select(F.struct(F.col("name").alias("algo"), F.array_distinct("inductive_biases").alias("biases")).alias("c")).agg(F.collect_list("c").alias("cs"))
    scored = fingerprints.withColumn("__pl_gain", gained).join(F.broadcast(packed))  # one row of cards, a dimension table of bounded size
    total = lambda c: F.aggregate(c["biases"], F.lit(0.5), lambda s, b: s + F.coalesce(F.try_element_at("__pl_gain", b), F.lit(0.0)))
    each = F.explode(F.transform("cs", lambda c: F.struct(c["algo"].alias("algo"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(c))).alias("bound"))))
    return scored.select(key, each.alias("e")).select(key, "e.algo", "e.bound")


def fingerprint_grid(spark, axes: Mapping[str, Sequence[float]] = AXES, most: int = 500) -> DataFrame:
    """The product of the axes at even strides, with `row_number` as its id and `eff_dim`."""
    total = 1
    for v in axes.values():
        total *= len(v)
    return strided(expand_grid(spark, axes), "row_number", total, most).withColumn("eff_dim", F.col("d") * F.col("eff_dim_ratio"))


def gaps(grid: DataFrame, cards: DataFrame, existing: DataFrame, existing_id: str, threshold: float, top: int) -> DataFrame:
    """The `top` fingerprints of the grid that no card is expected to do well on, by (1 - best bound) * exp(-distance to what was run)."""
    best = ari_bounds(grid, cards, "row_number").groupBy("row_number").agg(F.max("bound").alias("best"))
    near = nearest(grid, existing, list(SPANS), "row_number", existing_id, SPANS)
    joined = grid.join(best, "row_number").join(near, "row_number").where(F.col("best") < threshold)
    interest = F.round((1 - F.col("best")) * F.exp(-F.col("distance")), 4)
    return joined.withColumn("interest", interest).orderBy(F.desc("interest"), "row_number").limit(top)


def overrides(df: DataFrame) -> DataFrame:
    """Generator parameters that would give a fingerprint; halves are rounded to even."""
    n = F.bround(F.pow(F.lit(10.0), F.col("log_n"))).cast("long")
    of, skew = F.col("outlier_frac"), F.col("density_skew")
    outliers = F.bround(of * n / F.greatest(F.lit(1e-9), 1.0 - of)).cast("long")
    return df.withColumns(
        {
            "n_samples": n, "n_features": F.bround("d").cast("long"), "centers": F.bround("k").cast("long"), "compactness": F.bround(0.5 + 1.5 * F.col("conv_cv"), 3),
            "outliers": outliers, "noise": F.when(skew > 0.4, F.bround(0.05 * n).cast("long")).otherwise(F.lit(0).cast("long")), "density": F.bround(F.greatest(F.lit(0.05), 1.0 - skew), 3),
            "outlier_extremity": F.bround(F.when(outliers > 0, 1.0 + 4.0 * of).otherwise(1.0), 2), "intrinsic_dim_ratio": F.bround("eff_dim_ratio", 3),
        }
    )


# Biases that a mechanism brings with it. The last ones are the mechanisms of the supplied cards.
IMPLIED = {
    "medoid": ("outlier_robust",), "trimmed_mean": ("outlier_robust",), "trimmed_bandwidth": ("outlier_robust",), "posterior_weighted": ("outlier_robust",), "lof_prefilter": ("outlier_robust",),
    "lof_estimate": ("outlier_robust",), "knn_graph": ("non_convex_capable",), "laplacian_eigen": ("non_convex_capable",), "kde": ("non_convex_capable",), "mode_seeking": ("non_convex_capable",),
    "epsilon_ball": ("non_convex_capable", "outlier_robust"), "reachability": ("non_convex_capable",), "minibatch": ("scales_sublinear",), "online_update": ("scales_sublinear",), "mapreduce": ("scales_linear",),
    "random_fourier_basis": ("scales_linear",), "autoencoder_basis": ("scales_linear",), "sparse_subspace": ("subspace_structured",), "majority_vote": ("ensemble",), "weighted_vote": ("ensemble",),
    "fingerprint_dispatch": ("meta",), "knn_fingerprint": ("meta", "learned"), "rule_based": ("meta",), "nystrom_laplacian": ("non_convex_capable", "scales_linear"),
    "density_link": ("curved_groups", "noise_aware"), "neighbour_graph": ("curved_groups",), "eigen_basis": ("curved_groups",), "voting": ("ensemble",), "routing": ("meta",), "sampling": ("scales_linear",),
}


def _implied(tags: Column) -> Column:
    table = F.create_map(*[x for t, bs in IMPLIED.items() for x in (F.lit(t), F.array(*[F.lit(b) for b in bs]))])
    return F.array_distinct(F.flatten(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))))


def _sorted(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def swap_mechanism(cards: DataFrame, old: str, new: str) -> DataFrame:
    """Every card that has mechanism `old` with `new` instead; the biases that the old mechanisms implied give way to those of the new ones."""
    tags = F.array_union(F.array_except("mechanism_tags", F.array(F.lit(old))), F.array(F.lit(new)))
    biases = F.array_union(F.array_except("inductive_biases", _implied(F.array(F.lit(old)))), _implied(tags))
    return cards.where(F.array_contains("mechanism_tags", old) & ~F.array_contains("mechanism_tags", new)).select(
        F.concat_ws("_", F.lit("swap"), "name", F.lit(old), F.lit(new)).alias("name"), F.array(F.col("name")).alias("parents"), _sorted(tags).alias("tags"), _sorted(biases).alias("biases"), "time_expr"
    )


def add_bias(cards: DataFrame, bias: str) -> DataFrame:
    """Every card without `bias` with it, at 1.2 times the cost."""
    return cards.where(~F.array_contains("inductive_biases", bias)).select(
        F.concat_ws("_", F.lit("bias"), "name", F.lit(bias)).alias("name"), F.array("name").alias("parents"), _sorted(F.col("mechanism_tags")).alias("tags"),
        _sorted(F.array_union("inductive_biases", F.array(F.lit(bias)))).alias("biases"), F.concat(F.lit("1.2 * ("), "time_expr", F.lit(")")).alias("time_expr"),
    )


def _couples(cards: DataFrame) -> DataFrame:
    """Every two cards once, by name; cards are a bounded table, and a mutation search is over its pairs by definition."""
    b = cards.select(F.col("name").alias("name_b"), F.col("mechanism_tags").alias("tags_b"), F.col("inductive_biases").alias("biases_b"), F.col("time_expr").alias("time_b"))
    return cards.join(b, F.col("name") < F.col("name_b"))


def stack(cards: DataFrame) -> DataFrame:
    """Two cards one after the other: all mechanisms and biases, the sum of the costs."""
    return _couples(cards).select(
        F.concat_ws("_", F.lit("stack"), "name", "name_b").alias("name"), F.array("name", "name_b").alias("parents"), _sorted(F.array_union("mechanism_tags", "tags_b")).alias("tags"),
        _sorted(F.array_union("inductive_biases", "biases_b")).alias("biases"), F.concat(F.lit("("), "time_expr", F.lit(") + ("), "time_b", F.lit(")")).alias("time_expr"),
    )


def crossover(cards: DataFrame) -> DataFrame:
    """Half of each parent's mechanisms, rounded up, in order of name, all biases, the greater cost."""
    half = lambda c: F.slice(F.array_sort(c), 1, F.ceil(F.size(c) / 2).cast("int"))
    return _couples(cards).select(
        F.concat_ws("_", F.lit("cross"), "name", "name_b").alias("name"), F.array("name", "name_b").alias("parents"), _sorted(F.array_union(half("mechanism_tags"), half("tags_b"))).alias("tags"),
        _sorted(F.array_union("inductive_biases", "biases_b")).alias("biases"), F.concat(F.lit("greatest("), "time_expr", F.lit(", "), "time_b", F.lit(")")).alias("time_expr"),
    )


def near_duplicates(mutants: DataFrame, cards: DataFrame, least: float = 0.85) -> DataFrame:
    """Mutants with the card most like them if that is at least `least` by Jaccard likeness of mechanisms and biases together."""
    traits = cards.select(F.struct(F.array_union("mechanism_tags", "inductive_biases").alias("t"), F.col("name").alias("n")).alias("c")).agg(F.collect_list("c").alias("cs"))
    own = F.array_union("tags", "biases")
    like = lambda c: F.size(F.array_intersect(own, c["t"])) / F.size(F.array_union(own, c["t"]))
    best = F.array_max(F.transform("cs", lambda c: F.struct(F.round(like(c), 9).alias("s"), c["n"].alias("n"))))
    joined = mutants.join(F.broadcast(traits)).withColumn("m", best)  # one row of cards
    return joined.where(F.col("m.s") >= least).select("name", F.col("m.n").alias("card"), F.col("m.s").alias("likeness"))


def search(mutants: DataFrame, fingerprints: DataFrame, cards: DataFrame, key: str, gain: float = 0.02, top: int = 10) -> DataFrame:
    """The `top` mutants whose mean bound over the fingerprints beats the best card's by `gain` or more, equal ones once.

    All mutants are scored, not a random draw of them.
    """
    shaped = mutants.select("name", F.col("biases").alias("inductive_biases"))
    means = ari_bounds(fingerprints, shaped, key).groupBy(F.col("algo").alias("name")).agg(F.avg("bound").alias("score"))
    best = ari_bounds(fingerprints, cards, key).groupBy("algo").agg(F.avg("bound").alias("s")).agg(F.max("s").alias("best"))
    better = means.join(F.broadcast(best)).where(F.round(F.col("score") - F.col("best"), 9) >= gain).join(mutants, "name")
    once = better.withColumn("r", F.row_number().over(Window.partitionBy("parents", "tags", "biases").orderBy("name"))).where("r = 1")
    return once.orderBy(F.round("score", 9).desc(), "name").limit(top).select("name", "parents", "tags", "biases", "score", (F.col("score") - F.col("best")).alias("gain"))


def suggestion(mutants: DataFrame) -> DataFrame:
    """A sentence on how each mutant might be built."""
    kind = F.split("name", "_")[0]
    text = (
        F.when(kind == "swap", F.format_string("Start from %s and replace its mechanism so that it has: %s.", F.element_at("parents", 1), F.concat_ws(", ", "tags")))
        .when(kind == "bias", F.format_string("Wrap %s so that it also is: %s.", F.element_at("parents", 1), F.concat_ws(", ", "biases")))
        .when(kind == "cross", F.format_string("Take part of %s and part of %s: %s.", F.element_at("parents", 1), F.element_at("parents", -1), F.concat_ws(", ", "tags")))
        .otherwise(F.format_string("Run %s, then %s on what it leaves.", F.element_at("parents", 1), F.element_at("parents", -1)))
    )
    return mutants.select("name", text.alias("text"))
