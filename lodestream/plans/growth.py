"""Queries of trees and forests on every supplier's line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import growing, trees
from .catalogue import FEATURES, query, rounded
from .workflows import _stream


def _accuracy(predicted):
    return rounded(predicted.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") == F.col("y")).cast("double")).alias("accuracy")))


def _forest(spark, sf_dir):
    growth = trees.forest(len(FEATURES), 3, depth=3, bins=16, grace=100)
    return growing.grown(_stream(spark, sf_dir), FEATURES, 3, 200, growth, growing.Adapt(0.3, 0.1))


@query()
def tree_accuracy(spark, sf_dir):
    """Prequential accuracy of one tree a supplier that grows from block to block of 200 rows."""
    return _accuracy(growing.grown(_stream(spark, sf_dir), FEATURES, 3, 200, trees.Growth(depth=3, bins=16, grace=150))[0])


@query()
def patches_accuracy(spark, sf_dir):
    """The same of three trees on reweighted rows and random features."""
    growth = trees.patches(len(FEATURES), 3, depth=3, bins=16, grace=150)
    return _accuracy(growing.grown(_stream(spark, sf_dir), FEATURES, 3, 200, growth)[0])


@query()
def forest_accuracy(spark, sf_dir):
    """Prequential accuracy of an adaptive forest of three trees a supplier."""
    return _accuracy(_forest(spark, sf_dir)[0])


@query()
def forest_swaps(spark, sf_dir):
    """Warnings, swaps of background trees and resets, by supplier, block and learner."""
    return _forest(spark, sf_dir)[1]


@query()
def block_tree_accuracy(spark, sf_dir):
    """The accuracy where each block's tree is learned from that block alone."""
    p = trees.by_blocks(_stream(spark, sf_dir), FEATURES, 3, 200, trees.Growth(depth=3, bins=16, grace=150))
    return _accuracy(p)
