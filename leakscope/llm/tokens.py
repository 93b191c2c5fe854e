"""Token counts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.session import spread

#: How the byte-level tokenizers of the given kind cut text before merging (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    """The file of the installed multilingual byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            counts, feats = [], []
            for t in b.column("text").to_pylist():
                ids = enc.encode_ordinary(t.encode("utf-8", "surrogatepass").decode("utf-8", "replace"))
                counts.append(len(ids))
                if buckets:
                    kinds, n = np.unique(np.array(ids, np.int64) * 40503 % buckets, return_counts=True)
                    feats.append(np.stack([kinds.astype(np.uint16), np.minimum(n, 65535).astype(np.uint16)]).tobytes())
            arrays = [*b.drop_columns(["text"]).columns, pa.array(counts, pa.int64())]
            names = [*(n for n in b.schema.names if n != "text"), "tokens"]
            if buckets:
                arrays, names = [*arrays, pa.array(feats, pa.binary())], [*names, "feats"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def token_counts(texts: DataFrame, ident: str, text: str, path: str | None = None, keep: tuple[str, ...] = (), buckets: int = 0) -> DataFrame:
    """(id, *keep, tokens[, feats]) of each row whose id and text are not null; an empty text has 0 tokens.

    With ``buckets`` also the counts of hashed tokens, packed as two rows of 16-bit numbers (bucket, count). Texts are
    read whole. There is no shuffle unless the scan has fewer partitions than there are cores.
    """
    src = spread(texts.select(F.col(ident).alias("id"), *keep, F.col(text).alias("text")).where("id is not null and text is not null"))
    schema = ", ".join(f"{c} {t}" for c, t in src.dtypes if c != "text") + ", tokens long" + (", feats binary" if buckets else "")
    return src.mapInArrow(_count(path or default_tokenizer(), buckets), schema)
