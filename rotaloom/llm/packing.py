"""Filling containers of fixed capacity: vector bin packing with the dot-product heuristic."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of that vocabulary (contractions, words, numbers, signs, white space).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts by the vocabulary file at ``path`` (by its ending:
    tiktoken ranks, a tokenizers file or a sentencepiece model)."""
    if path.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
        encoding = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id`` and ``tokens`` of each document with text (null texts are left out, blank ones count too)."""
    kept = documents.where(F.col("text").isNotNull()).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "tokens": count(batch.text.tolist())})

    return kept.mapInPandas(run, T.StructType([T.StructField("doc_id", kept.schema["doc_id"].dataType), T.StructField("tokens", T.LongType())]))


def fill(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The container number of each item (rows of ``sizes``; none may exceed ``capacity``).

    Containers are filled one after the other. The next item is the one of the greatest dot product of
    its size and the room left, each as a share of capacity, among those that fit in every dimension.
    Equal sizes are handled together, so a step costs the number of different sizes.
    """
    n = len(sizes)
    out = np.full(n, -1, np.int64)
    if n == 0:
        return out
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)  # sorted by the first dimension
    kind = kind.reshape(-1)
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1])
    left = np.array([len(m) for m in members])
    share = kinds / np.maximum(capacity, 1)
    alive = np.arange(len(kinds))
    number, placed = 0, 0
    while placed < n:
        room = capacity.astype(np.int64).copy()

        def take(k: int) -> None:
            nonlocal placed, room
            left[k] -= 1
            out[members[k][left[k]]] = number
            room = room - kinds[k]
            placed += 1

        while placed < n:
            alive = alive[left[alive] > 0]
            fits = alive[(kinds[alive] <= room).all(axis=1)]
            if not len(fits):
                break
            best = fits[np.argmax(share[fits] @ (room / np.maximum(capacity, 1)))]
            take(best)
        number += 1
    return out


def pack(items: DataFrame, tokens: int = 2048, segments: int = 256, loss: int | None = None, block: int = 20_000) -> DataFrame:
    """Every item's container, with limits on tokens, segments and loss-bearing tokens at once.

    ``items``: ``item_id``, ``tokens`` and, if there, ``segments`` (else 1) and ``loss`` (else tokens);
    nulls count as 0 (segments as 1), negative numbers as 0; further columns are ignored. Result:
    ``item_id``, ``part``, ``part_tokens``, ``container``. An item is split only if it alone exceeds a
    limit: into parts of which all but the last are full if tokens need the most parts, else into even
    parts. Items of 0 tokens take a segment. Repeated rows are items of their own.

    Items are dealt by hash into blocks of about ``block``, so no task holds more whatever the input; each
    block is a partition of its own and filled by ``fill``; a block leaves at most one container badly
    filled.
    """
    loss = tokens if loss is None else loss
    whole = lambda name, other: F.greatest(F.coalesce(F.col(name).cast("bigint"), F.lit(other)), F.lit(0)).cast("bigint")
    size = items.select("item_id", whole("tokens", 0).alias("t"), (whole("segments", 1) if "segments" in items.columns else F.lit(1).cast("bigint")).alias("g"), (whole("loss", 0) if "loss" in items.columns else whole("tokens", 0)).alias("l"))
    parts = F.greatest(F.ceil(F.col("t") / tokens), F.ceil(F.col("g") / segments), F.ceil(F.col("l") / loss), F.lit(1)).cast("int")
    cut = size.withColumn("_n", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # full parts and a rest where tokens decide, else even parts
    step = F.when(F.ceil(F.col("t") / tokens) == F.col("_n"), F.lit(tokens)).otherwise(F.greatest(F.ceil(F.col("t") / F.col("_n")), F.lit(1)))
    own = F.greatest(F.least(F.col("t") - F.col("part") * step, step), F.lit(0)).cast("bigint")
    share = lambda c: F.ceil(F.col(c) / F.col("_n")).cast("bigint")
    base = cut_lineage(cut.select("item_id", "part", own.alias("t"), share("g").alias("g"), F.when((F.col("l") == F.col("t")) & (own <= loss), own).otherwise(share("l")).alias("l")))
    count = base.count()  # one number
    blocks = max(1, -(-count // block))
    dealt = base.withColumn("_b", F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)).cast("int"))
    capacity = np.array([tokens, segments, loss])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["item_id", "part"], kind="stable")
        inside = fill(group[["t", "g", "l"]].to_numpy(np.int64), capacity)
        return pd.DataFrame({"item_id": group.item_id, "part": group.part, "part_tokens": group.t, "container": inside * blocks + group._b.astype(np.int64)})

    schema = T.StructType([T.StructField("item_id", base.schema["item_id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("part_tokens", T.LongType()), T.StructField("container", T.LongType())])
    spread = dealt.repartition(blocks, "_b")  # a number that is asked for isn't merged again
    return spread.groupBy("_b").applyInPandas(run, schema)


def example_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents as training examples: ``item_id``, ``tokens``, ``segments`` (paragraphs) and ``loss``, the
    tokens of the lines that aren't comments; null texts are left out."""
    kept = documents.where(F.col("text").isNotNull()).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for batch in batches:
            texts = batch.text.tolist()
            said = ["\n".join(line for line in t.splitlines() if not line.lstrip().startswith("%")) for t in texts]
            parts = [max(1, sum(1 for p in re.split(r"\n[ \t]*\n", t.replace("\r\n", "\n")) if p.strip())) for t in texts]
            tokens = count(texts)
            yield pd.DataFrame({"item_id": batch.doc_id, "tokens": tokens, "segments": parts, "loss": [min(a, b) for a, b in zip(count(said), tokens)]})

    return kept.mapInPandas(run, T.StructType([T.StructField("item_id", kept.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("tokens", "segments", "loss"))]))
