"""Clustering operators: a registry of kernels, and their application to tables of points."""

from pointloom.operators.clustering.base import REGISTRY, Fit, Step, register
from pointloom.operators.clustering import adaptive, ensembles, graph, mixtures, partition, routers  # noqa: F401
from pointloom.operators.clustering.apply import cluster
from pointloom.operators import rl  # noqa: F401, E402  (registration)

__all__ = ["REGISTRY", "Fit", "Step", "cluster", "register"]
