"""The custom functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from verdigris.functions.text import nfkd_udf, stem_udf, terms_udf
from verdigris.functions.toon import toon_udf
from verdigris.operators.calibrate import fnv64_udf, fnv128_udf, fold_udf
from verdigris.operators.chunks import CHUNK, split_file


@F.udtf(returnType=CHUNK)
class SplitChunks:
    """Chunks of one file: SELECT f.path, c.* FROM files f, LATERAL split_chunks(f.path, f.text) c."""

    def eval(self, path: str, text: str):
        for start, end, symbol, body in split_file(path or "", text or ""):
            yield path, start, end, symbol, body


def register(spark: SparkSession) -> None:
    """Makes terms, stem, nfkd, toon, fold_of, fnv64, fnv128 and the table function split_chunks callable from spark.sql."""
    for name, f in (("terms", terms_udf), ("stem", stem_udf), ("nfkd", nfkd_udf), ("toon", toon_udf), ("fold_of", fold_udf), ("fnv64", fnv64_udf), ("fnv128", fnv128_udf)):
        spark.udf.register(name, f)
    spark.udtf.register("split_chunks", SplitChunks)
