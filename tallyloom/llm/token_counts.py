"""Token counts without token ids.

A block of documents is split into pre-tokens; the block's distinct pre-tokens that this worker has not met are
encoded, once each, into a table (pre-token, number of pieces), which is then joined to the documents' pre-token
frequencies and summed. The join is by key in the block: shuffling every (document, pre-token, frequency) row
instead would move more bytes than the texts have, while a pre-token's pieces cost a microsecond to count.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, texts

#: The pre-token pattern of the byte-level vocabulary, for texts of characters on which re and the library agree.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Texts with any other character are split by the library's own pre-tokenizer.
UNUSUAL = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbeİ]|[^\x00-ſ‐-‧‰-⁞€]")
#: Distinct pre-tokens that a worker keeps between blocks.
KEEP = 400_000

_loaded: dict[str, tuple] = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _loaded:
        tok = Tokenizer.from_file(path)
        special = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or r"(?!)")
        _loaded[path] = tok, special, {}
    return _loaded[path]


def split_by_library(text: str, tok, special: re.Pattern) -> Counter:
    """Frequencies of the pre-tokens of any text; a special token is one by itself."""
    out = Counter(special.findall(text))
    for part in special.split(text):
        out.update(part[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(part))
    return out


def count_texts(values: list[str], path: str) -> list[int]:
    tok, special, pieces = load(path)
    odd = lambda text: UNUSUAL.search(text) or special.search(text)
    counts = [split_by_library(t, tok, special) if odd(t) else Counter(PRETOKEN.findall(t)) for t in values]
    new = list({p for c in counts for p in c if p not in pieces})
    if len(pieces) + len(new) > KEEP:
        pieces.clear()
        new = list({p for c in counts for p in c})
    for k in range(0, len(new), 4096):
        part = new[k : k + 4096]
        pieces.update(zip(part, (len(e.ids) for e in tok.encode_batch_fast(part, add_special_tokens=False))))
    return [sum(map(int.__mul__, map(pieces.__getitem__, c), c.values())) for c in counts]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text is empty and has no tokens. Strings of special tokens inside a text count as those tokens, as the
    library does by default. Nothing is cut off, however long; repeated rows are counted each; no rows in, none out.
    """

    def count(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(count_texts(b.column("text").to_pylist(), tokenizer_path), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
