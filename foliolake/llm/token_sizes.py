"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from foliolake.runtime import spread

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level BPE of that file cuts text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def load_tokenizer(path: str = TOKENIZER_PATH):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_sizes(docs: DataFrame, *, path: str = TOKENIZER_PATH) -> DataFrame:
    """(doc_id, source, n_tokens): whole texts are counted; a null or empty text has 0. Rows without a doc_id are left out, other
    columns ignored. Strings of special tokens in a text are ordinary text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_tokenizer(path)
        for pdf in batches:
            texts = [x or "" for x in pdf["text"]]
            sizes = [len(x) for x in encoding.encode_ordinary_batch(texts, num_threads=1)] if texts else []
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": sizes})

    return spread(docs.filter("doc_id is not null").select("doc_id", "source", "text")).mapInPandas(count, "doc_id long, source string, n_tokens long")
