"""Filling fixed-capacity containers with items: sum-of-squares online packing.

Sizes are tokens of a public tokenizer (a .tiktoken file of ranks; its path is a parameter). Items are packed one after
the other: each goes to the fill level h that minimises the sum over levels of the squared number of containers
filled to that level (see cost()); full containers leave the count.
The counts are one array of `capacity` cells, so placing an item costs one pass over it whatever the number of containers.

Items are spread over shards by a hash of their id, with SHARD_ITEMS items in each, so the shards, not the table,
set the memory of a task, and the few containers a shard leaves partly filled stay a fixed share. Only ids and token
counts are shuffled; texts are read once, by the tokenizing stage.

Defined results: null and empty texts have 0 tokens and get no container; an item larger than the capacity is cut
into pieces of exactly `capacity` tokens and a rest, which is packed like any item; every other item is whole; ids that
occur twice are packed twice only if their rows differ.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ITEMS = 100_000
CACHED_WORDS = 400_000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenizing pattern of the public byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PACKED = "item_id long, piece int, token_start long, tokens int, shard int, container long"

_WIDE = regex.compile(r"[^\S ]|  ")
_encoders: dict[str, object] = {}


def encoder(path: str):
    """One for each Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


class _Words(dict):
    """Token counts of words with the blank before them; forgotten when there are too many."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        n = self[word] = len(self.encode(word))
        return n


def token_counter(path: str):
    """Tokens of a text. The pattern never joins what is before a single blank to what follows it, so words are counted
    one by one and remembered; lines split the same way where no other white space touches the break."""
    encode = encoder(path).encode_ordinary
    words = _Words(encode)

    def line(t: str) -> int:
        if _WIDE.search(t):
            return len(encode(t))
        first, *rest = t.split(" ")
        return (words[first] if first else 0) + sum([words[" " + w] for w in rest])

    breaks = regex.compile(r"(?<=\S)(\n+)(?=\S)")

    def count(t: str | None) -> int:
        if not t:
            return 0
        if "\n" not in t:
            return line(t)
        # Between visible characters a run of line breaks is its own token sequence: \s+(?!\S) takes all but the last.
        return sum(words[p] if p[0] == "\n" else line(p) for p in _split_breaks(breaks, t))

    return count


def _split_breaks(breaks, t: str) -> list[str]:
    out, at = [], 0
    for m in breaks.finditer(t):
        out.append(t[at : m.start()])
        n = m.end() - m.start()
        if n > 1:
            out.append("\n" * (n - 1))
        out.append("\n")
        at = m.end()
    out.append(t[at:])
    return [p for p in out if p]


def count_tokens(df: DataFrame, item: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """item_id, tokens, digest (of the text, which tells rows of one id apart)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer)
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "tokens": [count(t) for t in b["t"]], "digest": b["h"]})

    x = df.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("t"), F.sha2(text, 256).alias("h"))
    return x.mapInPandas(run, "item_id long, tokens long, digest string")


def cost(n: np.ndarray, h: int, s: int, capacity: int) -> float:
    """Change of the sum of squares when an item of size s goes to a container filled to h (0: a new one)."""
    if h and not n[h]:
        return float("inf")
    leaves = 1 - 2 * int(n[h]) if h else 0
    enters = 2 * int(n[h + s]) + 1 if h + s < capacity else 0
    return leaves + enters


class SumOfSquares:
    """The level array of one shard. level[h]: containers filled to h; ids: which, the latest first."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.ids: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, s: int) -> int:
        c = self.capacity
        if s == c:
            self.made += 1
            return self.made - 1
        n = self.level
        cost = 2 * (n[s:] - n[: c + 1 - s]) + 2  # for fill levels h = 0 .. c-s
        cost[1:][n[1 : c + 1 - s] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[s] + 1
        if n[c - s]:
            cost[c - s] = 1 - 2 * n[c - s]
        # On ties the fullest level: it leaves the least room.
        h = c - s - int(np.argmin(cost[::-1]))
        if h:
            got = self.ids[h].pop()
            self.level[h] -= 1
        else:
            got, self.made = self.made, self.made + 1
        if h + s < c:
            self.level[h + s] += 1
            self.ids[h + s].append(got)
        return got


def pack_shard(sizes: np.ndarray, capacity: int) -> np.ndarray:
    p = SumOfSquares(capacity)
    return np.fromiter((p.place(int(s)) for s in sizes), dtype=np.int64, count=len(sizes))


def pack(counted: DataFrame, items: int, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """counted: item_id, tokens and, if rows of one id are to be told apart, digest; items: how many rows it has about, which sets the number of shards. Gives PACKED."""
    shards = max(1, -(-items // shard_items))
    x = counted if "digest" in counted.columns else counted.withColumn("digest", F.lit(""))
    x = x.where("tokens > 0").select("item_id", "tokens", "digest").distinct()
    x = x.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)))
    x = x.select(
        "item_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("token_start"),
        F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("tokens"),
        F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)).cast("int").alias("shard"),
        "digest",
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "digest", "piece"], kind="stable").drop(columns="digest")
        return pdf.assign(container=pdf["shard"].to_numpy(np.int64) * (1 << 40) + pack_shard(pdf["tokens"].to_numpy(), capacity))

    return x.groupBy("shard").applyInPandas(run, PACKED)
