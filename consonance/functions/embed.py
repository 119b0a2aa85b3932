"""Default offline embedder (F9): token counts hashed into a fixed number of buckets.

The bucket of a token is the first 8 hex digits of its md5 modulo ``dim`` –
a hash both Spark and DuckDB compute identically. It is a stand-in that makes
pipelines runnable without a model; a real embedder is supplied as a
``predict_batch_udf`` returning ``array<float>`` (see ``model_embedder``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as TX

DIM = 64


def token_bucket(tok: Column, dim: int = DIM) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dim))


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """array<double> of per-bucket token counts."""
    buckets = F.transform(TX.tokens(text), lambda t: token_bucket(t, dim))
    # The bucket list enters the per-dimension lambda through array_repeat, so it is
    # computed once per row (an outer column referenced inside a lambda would be
    # re-evaluated for every dimension after projection collapsing).
    return F.zip_with(F.sequence(F.lit(0), F.lit(dim - 1)), F.array_repeat(buckets, dim),
                      lambda b, bs: F.size(F.filter(bs, lambda x: x == b)).cast("double"))


def model_embedder(make_predict_fn, dim: int, batch_size: int = 64):
    """Wrap a user model as a batched Spark function text → array<float> (Arrow batches).

    ``make_predict_fn()`` is called once per Python worker and returns
    ``fn(np.ndarray[str]) -> np.ndarray[float32] (n, dim)``.
    """
    from pyspark.ml.functions import predict_batch_udf

    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                             batch_size=batch_size, input_tensor_shapes=None)
