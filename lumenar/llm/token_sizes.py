"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file lies; every executor must see the same path. ``none`` says that no tokenizer is at hand.
TOKENIZER = os.environ.get("LUMENAR_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
_PLAIN = re.compile(r"[^\W_]+|[^\w\s]|_")


def _counter(path: str | None):
    """Counts of a batch of texts: by the tokenizer of ``path``, or without one by runs of letters or digits and other characters. A file that can't be read raises."""
    if path is None:
        return lambda texts: [len(_PLAIN.findall(t)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def usable_path(path: str | None) -> str | None:
    """``path`` if it can be read, None if it names no tokenizer (None, '' or ``none``). A named file that is missing or can't be read, or a missing library, raises: another count would look like the one asked for."""
    if not path or path == "none":
        return None
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no tokenizer file {path}; LUMENAR_TOKENIZER=none counts runs of letters or digits instead")
    _counter(path)
    return path


def with_tokens(documents: DataFrame, path: str | None = TOKENIZER) -> DataFrame:
    """(``doc_id``, ``source``, ``tokens``) of each document; 0 for a null or empty text. Repeated rows of a ``doc_id`` count once, null ids are left out.

    ``path`` is read once on the driver too, so a named tokenizer that is missing or broken fails before anything is counted, on an executor as well. None, '' or ``none`` counts without a tokenizer.
    """
    use = usable_path(path)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts = _counter(use)
        for texts in batches:
            plain = [t or "" for t in texts]
            out: list[int] = []
            for at in range(0, len(plain), 256):
                out += counts(plain[at : at + 256])
            yield pd.Series(out, dtype="int32")

    return documents.filter("doc_id is not null").select("doc_id", "source", count("text").alias("tokens")).dropDuplicates(["doc_id"])
