"""Declared table schemas and the check every operator runs on its inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_VEC = T.ArrayType(T.FloatType())

USERS = _fields(("user_id", _S), ("lang", _S), ("country", _S))
TWEETS = _fields(("user_id", _S), ("tweet", _S))
EXPERT_LABELED = _fields(("user_id", _S), ("tweet", _S), ("anhedonia", _B), ("lang", _S), ("country", _S))
VECTORS = _fields(("id", _S), ("text", _S), ("embedding", _VEC), ("label", _S), ("metadata", T.MapType(_S, _S)))
RETRIEVAL_INDEX = _fields(("prediction_id", _L), ("rank", _I), ("train_id", _L), ("distance", _D))
PREDICTIONS = _fields(("prediction_id", _L), ("prediction", _I))
SHAPLEY = _fields(("train_id", _L), ("shapley_value", _D))
MEMO = _fields(("input_hash", _S), ("input", _S), ("output", _S), ("version", _L))

# Stage columns of a run ledger, in file order.  Round 2 columns exist in experiment 2 only.
LEDGER_ROUND_1 = (
    "original_pipeline",
    "original_pipeline_preprocess",
    "original_pipeline_eval",
    "detect_eval_1",
    "detect_eval_1_detect",
    "detect_eval_1_eval",
    "fix_eval_1",
    "fix_eval_1_fix",
    "fix_eval_1_eval",
    "explanation_1",
)
LEDGER_ROUND_2 = (
    "original_pipeline_diff",
    "original_pipeline_diff_preprocess",
    "original_pipeline_diff_eval",
    "detect_eval_2",
    "detect_eval_2_detect",
    "detect_eval_2_eval",
    "fix_eval_2",
    "fix_eval_2_fix",
    "fix_eval_2_eval",
    "explanation_2",
)
LEDGER_KEYS = ("experiment", "scenario", "variant", "opt")


def ledger_schema(columns=LEDGER_ROUND_1 + LEDGER_ROUND_2) -> T.StructType:
    return _fields(*[(c, _D) for c in columns])


def require(df: DataFrame, operator: str, *columns: str) -> DataFrame:
    """Fail before any job starts when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{operator}: missing column(s) {missing}; table has {df.columns}")
    return df


def require_type(df: DataFrame, operator: str, column: str, *dtypes: type) -> DataFrame:
    require(df, operator, column)
    actual = df.schema[column].dataType
    if not isinstance(actual, dtypes):
        raise ValueError(f"{operator}: column {column!r} is {actual.simpleString()}")
    return df
