"""Sizes of texts in tokens: a plain counting rule, or a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FOLDER = "/opt/tokenizers"
_SHIPPED: dict[str, set[str]] = {}  # application -> files sent

#: The characters that count one by one.
_SINGLE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
TOKEN = rf"(?U)[{_SINGLE}]|[\p{{L}}\p{{N}}_&&[^{_SINGLE}]]+|[^\s]"


def plain_tokens(text: str) -> Column:
    """Kana and Han characters one by one, other runs of letters, digits and underscores, and every
    other visible character; null texts have 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def tokenizer_tokens(text: str, folder: str = TOKENIZER_FOLDER, name: str = "byte_bpe_50k.json") -> Column:
    """Tokens of a public tokenizer file of ``folder``, which the driver ships to the executors; read once per Python worker."""
    context = SparkSession.active().sparkContext
    if os.path.join(folder, name) not in _SHIPPED.setdefault(context.applicationId, set()):
        context.addFile(os.path.join(folder, name))
        _SHIPPED[context.applicationId].add(os.path.join(folder, name))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(SparkFiles.get(name))
        tokenizer.encode_special_tokens = True
        for texts in batches:
            coded = tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(c.ids) for c in coded])

    return count(F.col(text))
