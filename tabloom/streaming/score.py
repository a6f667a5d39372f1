"""Apply fitted steps to a stream.

The reference is batch-only; what carries over to Structured Streaming is
that every fitted ``transform`` here is a projection (cleaning without the
de-duplication, candidate features, numeric scaling, one-hot) or a
stream–static join (frequency dictionaries).  ``score_stream`` chains them
on a streaming DataFrame, and optionally a fitted Spark ML ``PipelineModel``
(``features`` vector in, ``prediction`` out).  No state is kept.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from ..operators.clean import CleanModel
from ..operators.encode import EncoderModel
from ..operators.features import FeaturePlan


def score_stream(stream: DataFrame, *, clean: CleanModel | None = None, features: FeaturePlan | None = None,
                 encoder: EncoderModel | None = None, model=None, keep: list[str] | None = None) -> DataFrame:
    """Streaming DataFrame of encoded rows (and predictions when ``model`` is given)."""
    keep = keep or []
    d = stream
    if clean is not None:
        d = clean.transform(d, deduplicate=False)  # de-duplication would need unbounded state
    if features is not None:
        d = features.transform(d)
    if encoder is not None:
        d = encoder.transform(d, keep=keep)
        if model is not None:
            d = VectorAssembler(inputCols=encoder.feature_names, outputCol="features", handleInvalid="keep").transform(d)
            d = model.transform(d)
    return d
