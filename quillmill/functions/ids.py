"""Identities and hashes: SHA-256 over unit-separated parts, canonical JSON, content hashes, keys."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmill.functions.text import UNIT_SEPARATOR, strip

NO_UPSTREAM = "NO_UPSTREAM_PROCESSING_FINGERPRINT"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of the parts between unit separators; a null part counts as the empty string."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def element_id(document_id: Column, version: Column, sha256: Column, fmt: Column, locator: Column, kind: Column) -> Column:
    return digest(document_id, version, sha256, fmt, locator, kind)


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, characters as they are, no NaN."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def profile_hash(profile: dict[str, Any]) -> str:
    return hashlib.sha256(canonical_json(profile).encode()).hexdigest()


def normalise_sha256(c: Column) -> Column:
    """Null unless 64 hex digits are left. The prefix is removed before lower-casing, so only its lower-case form is."""
    x = F.lower(F.regexp_replace(strip(c), "^sha256:", ""))
    return F.when(x.rlike("^[0-9a-f]{64}$"), x)


def idempotency_key(document_id: Column, version: Column, sha256: Column) -> Column:
    return F.concat_ws(":", F.lit("start"), document_id, version.cast("string"), sha256)


def backoff_seconds(job: Column, generation: Column, attempt: Column, base: int = 5, most: int = 900, jitter: float = 0.2) -> Column:
    """min(most, base * 2^(attempt-1)) moved by up to the jitter, by the first eight bytes of a hash of the key."""
    raw = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)).cast("double")))
    key = F.concat_ws(":", job.cast("string"), generation.cast("string"), attempt.cast("string"))
    unit = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1))
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.bround(raw * (1 + (unit * 2 - 1) * jitter)))).cast("long")


#: Fields of a location in the canonical form of a block, with their defaults.
LOCATION = {"page_start": 0, "page_end": 0, "char_start": 0, "char_end": 0, "section_path": "", "heading": "", "table_id": "", "row_index": 0, "column_index": 0}
UINT32 = 2**32 - 1


def canonical_block(b: dict[str, Any]) -> dict[str, Any]:
    """A block as it is hashed; missing fields have their defaults."""
    loc = b.get("source_location")
    place: dict[str, Any] = {}
    if loc is not None:
        place = {k: d if loc.get(k) is None else type(d)(loc[k]) for k, d in LOCATION.items()}
        if any(isinstance(v, int) and not 0 <= v <= UINT32 for v in place.values()):
            raise ValueError("source_location is out of range")
    meta = b.get("metadata") or {}
    return {
        "block_id": b["block_id"],
        "parent_block_id": b.get("parent_block_id") or "",
        "block_type": int(b["block_type"]),
        "text": b.get("text") or "",
        "order_index": int(b["order_index"]),
        "metadata": dict(meta),
        "source_location": place,
        "source_links": list(b.get("source_links") or ()),
    }


def batch_hash(blocks: list[dict[str, Any]]) -> str:
    if not blocks:
        raise ValueError("a batch has at least one block")
    return hashlib.sha256(canonical_json([canonical_block(b) for b in blocks]).encode()).hexdigest()


@F.pandas_udf(StringType())
def canonical_json_of(s: pd.Series) -> pd.Series:
    """The canonical form of JSON text; null where it isn't JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else canonical_json(json.loads(t))
        except ValueError:
            return None

    return s.map(one)


def rendered_block(text: Column, heading: Column) -> Column:
    """A block's share of the text whose hash closes a delivery."""
    head = F.when(F.length(strip(F.coalesce(heading, F.lit("")))) > 0, F.concat(strip(heading), F.lit("\n"))).otherwise("")
    return F.concat(head, strip(F.coalesce(text, F.lit(""))), F.lit("\n\n"))
