"""Queries of the closed forms, on a grid of the parts table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import theory as th
from strandframe.plans._tables import read
from strandframe.plans.registry import register

_GRID = "g as (select p_partkey, (p_partkey % 99 + 1) / 100.0::double as f, p_size::double as n, (p_partkey % 7 + 1) / 1000.0::double as mu, (p_partkey % 13 + 1) / 100.0::double as u, (p_partkey % 5 + 1) / 10.0::double as d from part)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", ((k % 99 + 1) / 100.0).alias("f"), F.col("p_size").cast("double").alias("n"), ((k % 7 + 1) / 1000.0).alias("mu"), ((k % 13 + 1) / 100.0).alias("u"), ((k % 5 + 1) / 10.0).alias("d"))


_FORMS = {
    "theory_heterozygosity": {"h": (lambda f, n, mu, u, d: th.heterozygosity(f), "2 * f * (1 - f)"), "theta": (lambda f, n, mu, u, d: th.theta(n, mu), "4 * n * mu"), "pi": (lambda f, n, mu, u, d: th.pairwise_pi(mu, n), "2 * mu * (2 * n)"), "drift": (lambda f, n, mu, u, d: th.drift_variance(f), "f * (1 - f)")},
    "theory_observable_fraction": {"observable": (lambda f, n, mu, u, d: th.observable_fraction(f, n), "1 - pow(1 - f, n)"), "silent": (lambda f, n, mu, u, d: th.silent_fraction(f, n), "pow(1 - f, n)")},
    "theory_conversion_balance": {"loss": (lambda f, n, mu, u, d: th.loss(u, n, f), "u * n * f * f"), "input": (lambda f, n, mu, u, d: th.mutation_input(mu, f), "mu * f"), "equilibrium": (lambda f, n, mu, u, d: th.equilibrium(mu, u, n), "mu / (u * n)"), "at_change": (lambda f, n, mu, u, d: th.at_change(f, mu, u, d), "(1 - f) * (mu - u * d * f)"), "at_equilibrium": (lambda f, n, mu, u, d: th.at_equilibrium(mu, u, d), "mu / (u * d)")},
    "theory_selection": {"scaled": (lambda f, n, mu, u, d: th.scaled_selection(n, u), "4 * n * u"), "reduction": (lambda f, n, mu, u, d: th.reduction(n * mu), "exp(-(n * mu))"), "load": (lambda f, n, mu, u, d: th.background_load(u, d), "u / d"), "bias": (lambda f, n, mu, u, d: th.bias_strength(d), "d - 0.5"), "conversion": (lambda f, n, mu, u, d: th.conversion_rate(u, d), "u * d"), "scaled_conversion": (lambda f, n, mu, u, d: th.scaled_conversion(n, u, d), "4 * n * u * d")},
    "theory_saturation": {"effective": (lambda f, n, mu, u, d: th.effective_rate(u, d, f), "u * d * 2 * f * (1 - f)"), "strong": (lambda f, n, mu, u, d: th.strong_diversity(mu, u, d), "2 * mu / (u * d)"), "weak": (lambda f, n, mu, u, d: th.weak_diversity(n, mu), "4 * n * mu"), "crossover": (lambda f, n, mu, u, d: th.crossover_size(u, d), "1 / (2 * u * d)")},
    "theory_repeats": {"rate": (lambda f, n, mu, u, d: th.repeat_rate(n, u), "1 / (2 * n) + u"), "time": (lambda f, n, mu, u, d: th.repeat_time(th.repeat_rate(n, u)), "1 / (1 / (2 * n) + u)"), "diversity": (lambda f, n, mu, u, d: th.repeat_diversity(mu, th.repeat_rate(n, u)), "2 * mu / (1 / (2 * n) + u)"), "mix": (lambda f, n, mu, u, d: th.genome_mix(f, mu, u), "(1 - f) * mu + f * u"), "distortion": (lambda f, n, mu, u, d: th.distortion(d), "2 * d - 1"), "undistorted": (lambda f, n, mu, u, d: th.undistorted(d), "1 - 2 * d"), "converts": (lambda f, n, mu, u, d: th.converts(f, d).cast("double"), "(f <= d)::int::double")},
}


def _query(forms: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = [F.col(c) for c in ("f", "n", "mu", "u", "d")]
        return _grid(spark, sf_dir).select("p_partkey", *[(F.round(form(*columns), 9) + 0.0).alias(name) for name, (form, _) in forms.items()])

    return run


for _name, _forms in _FORMS.items():
    register(_name, f"with {_GRID} select p_partkey, " + ", ".join(f'round({sql}, 9) + 0.0 as "{n}"' for n, (_, sql) in _forms.items()) + " from g")(_query(_forms))
