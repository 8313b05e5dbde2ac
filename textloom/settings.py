"""Schemas, constants and the content hash of a configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
DOCUMENTS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("doc_id", T.StringType()), ("source", T.StringType()), ("split", T.StringType()), ("label", T.ByteType()), ("text", T.StringType()),
        ("text_orig", T.StringType()), ("lang", T.StringType()), ("lang_stratum", T.StringType()), ("cluster_id", T.StringType()),
        ("spans", T.ArrayType(SPAN)), ("meta_json", T.StringType()), ("dedup_dropped", T.BooleanType()))]
)
WINDOWS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("window_id", T.StringType()), ("doc_id", T.StringType()), ("source", T.StringType()), ("split", T.StringType()), ("start", T.IntegerType()),
        ("end", T.IntegerType()), ("text", T.StringType()), ("label", T.ByteType()), ("cluster_id", T.StringType()), ("text_hash", T.StringType()),
        ("dedup_excluded", T.BooleanType()), ("dup_of", T.StringType()))]
)

# Fixed values that results depend on.
WINDOW, STRIDE, MIN_SPAN = 256, 192, 64
MAIN_LANG = "en"
NGRAMS, BINS, FEW_BINS = (3, 4, 5), 16384, 51
EXPANSION_INPUTS, EXPANSION_FACTOR, WINNERS = 6, 20, 0.05
GAMMAS = (0.0, 0.5, 0.9, 0.99)
C_GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
TPR_TARGET, FPR_SMALL, FPR_LARGE, POOL_SMALL, POOL_LARGE = 0.90, 0.01, 0.05, 2000, 500
SHINGLE, PERMUTATIONS, NEAR = 5, 128, 0.8
VAL_SHARE = 0.2
BOOTSTRAPS, ALPHA, TOST_LEVEL, TOST_SHARE = 1000, 0.05, 0.90, 0.05


def content_hash(config: Mapping, ignored: tuple[str, ...] = ("threads", "processes", "workdir")) -> str:
    """sha256 of the canonical JSON without keys that only say how to run."""

    def view(x):
        if isinstance(x, Mapping):
            return {str(k): view(v) for k, v in x.items() if k not in ignored}
        return [view(v) for v in x] if isinstance(x, (list, tuple)) else x

    return hashlib.sha256(json.dumps(view(config), sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
