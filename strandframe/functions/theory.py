"""Closed-form population-genetic expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

heterozygosity = lambda p: 2 * p * (1 - p)
theta = lambda n, mu: 4 * n * mu
silent_fraction = lambda h, length: F.pow(1 - h, length)
observable_fraction = lambda h, length: 1 - F.pow(1 - h, length)
loss = lambda c, length, h: c * length * h * h
mutation_input = lambda mu, h: mu * h
equilibrium = lambda mu, c, length: mu / (c * length)
pairwise_pi = lambda mu, n: 2 * mu * (2 * n)
scaled_selection = lambda n, s: 4 * n * s
reduction = lambda gamma: F.exp(-gamma)
background_load = lambda u, s: u / s
bias_strength = lambda b: b - 0.5
conversion_rate = lambda u, delta: u * delta
scaled_conversion = lambda n, u, delta: 4 * n * u * delta
at_change = lambda f, mu, u, delta: (1 - f) * (mu - u * delta * f)
at_equilibrium = lambda mu, u, delta: mu / (u * delta)
effective_rate = lambda u, delta, f: u * delta * 2 * f * (1 - f)
strong_diversity = lambda mu, u, delta: 2 * mu / (u * delta)
weak_diversity = lambda n, mu: 4 * n * mu
crossover_size = lambda u, delta: 1 / (2 * u * delta)
repeat_rate = lambda n, g: 1 / (2 * n) + g
repeat_time = lambda rate: 1 / rate
repeat_diversity = lambda mu, rate: 2 * mu / rate
genome_mix = lambda x, a, b: (1 - x) * a + x * b
drift_variance = lambda p: p * (1 - p)
distortion = lambda b: 2 * b - 1
undistorted = lambda b: 1 - 2 * b


def converts(distance: Column, most: Column) -> Column:
    return F.when(distance <= most, 1).otherwise(0)
