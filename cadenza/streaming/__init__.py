"""Trim and filter on streams: both are stateless, so a streaming table of observations goes straight through.

`to_times` and `evaluate` need an annotation's whole content and don't stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from cadenza.errors import BadArgument
from cadenza.operators import filter_by, trim
from cadenza.plans.corpus import Corpus


def over_stream(corpus: Corpus, observations: DataFrame) -> Corpus:
    """corpus with a stream of observations (annotation, obs_index and its columns) in place of its own."""
    missing = [c for c in ("annotation", "obs_index", *corpus.columns()) if c not in observations.columns]
    if not observations.isStreaming or missing:
        raise BadArgument(f"a stream with the corpus's columns is needed; missing: {missing}")
    return corpus.with_(observations=observations.select("annotation", "obs_index", *corpus.columns()))


def trim_stream(corpus: Corpus, observations: DataFrame, **bounds) -> DataFrame:
    return trim(over_stream(corpus, observations), **bounds).observations


def filter_stream(corpus: Corpus, observations: DataFrame, predicate: Callable, **options) -> DataFrame:
    return filter_by(over_stream(corpus, observations), predicate, **options).observations
