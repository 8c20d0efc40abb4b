"""Folds over ordered arrays, and waivers of rule hits (which scan.py finds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def triples(sizes: Column | str, most: int = 3) -> Column:
    """WN-09 (fragments): how often three in a row have one to most words, each fragment used once."""
    sizes = F.col(sizes) if isinstance(sizes, str) else sizes
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(x.between(1, most), acc["run"] + 1).otherwise(0)
        return F.struct(F.when(run == 3, 0).otherwise(run).alias("run"), (acc["n"] + (run == 3).cast("int")).alias("n"))

    return F.aggregate(sizes, start, step, lambda acc: acc["n"])


def waived(hits: Column | str, ids: tuple[str, ...], word: str | None = None) -> Column:
    """FLT-08: true if there are hits and all are of the given ids (and hold the word)."""
    hits = F.col(hits) if isinstance(hits, str) else hits
    fits = lambda h: h["id"].isin(*ids) & (F.contains(F.lower(h["span"]), F.lit(word)) if word else F.lit(True))
    return (F.size(hits) > 0) & F.forall(hits, fits)
