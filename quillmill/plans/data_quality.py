"""Queries of problems 3 (messages delivered more than once) and 6 (hierarchies)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import hierarchy, message_dedup
from quillmill.runtime import fresh_dir, read_table

ORDER_CHUNK = 4096
TREES = (("logical_block", "block_id", "parent_block_id"), ("normalized_element", "source_element_id", "parent_element_id"))
MESSAGE_COLUMNS = [
    "delivery_id", "batch_id", "received_at", "requested_at", "producer_request_id", "document_id", "document_version", "source_uri", "access_zone_code",
    "knowledge_type", "external_revision", "requested_ttl_days", "source_file_name", "source_content_hash", "source_size_bytes", "priority", "max_attempts",
]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    x = read_table(spark, sf, "new_indexation_job").select("delivery_id", "received_at", *message_dedup.IDENTITY)
    store = message_dedup.load_in_two(x, fresh_dir(spark, "messages"), [])
    return message_dedup.dropped_rows(x, store)


def p3_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """One row of each message with all of its columns; rows without a request id as they are."""
    x = read_table(spark, sf, "new_indexation_job").select(*MESSAGE_COLUMNS)
    store = message_dedup.load_in_two(x, fresh_dir(spark, "messages"), MESSAGE_COLUMNS)
    loose = x.where(message_dedup.blank_to_null(F.col("producer_request_id")).isNull()).dropDuplicates(["delivery_id"])
    kept = store.rows()
    return loose if kept is None else kept.select(*MESSAGE_COLUMNS).unionByName(loose)


def _locality() -> list:
    """Stretches of a document's elements, and stretches of these."""
    return [F.concat_ws("\x1f", "document_id", F.floor(F.col("order_index") / n).cast("string")) for n in (ORDER_CHUNK, 16 * ORDER_CHUNK)]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table, node, parent in TREES:
        x = read_table(spark, sf, table).select(node, parent, "document_id", "order_index")
        bad = hierarchy.unreachable(x, node, parent, _locality())
        bad = bad.select(F.lit(table).alias("node_table"), F.col("node").alias("node_id"), "end_id")
        out = bad if out is None else out.unionByName(bad)
    return out


def p6_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table, node, parent in TREES:
        x = read_table(spark, sf, table).select(node, parent, "document_id", "order_index")
        h = hierarchy.hierarchy(x, node, parent, _locality())
        h = h.select(F.lit(table).alias("node_table"), F.col("node").alias("node_id"), "root", "depth", F.array_join("path", hierarchy.SEP).alias("path"), "descendants", "end_kind", "end_id")
        out = h if out is None else out.unionByName(h)
    return out


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for table, node, parent in TREES:
        x = read_table(spark, sf, table).select(node, parent, "document_id", "order_index")
        d = hierarchy.descendants(hierarchy.hierarchy(x, node, parent, _locality()))
        d = d.select(F.lit(table).alias("node_table"), "ancestor", "node", "distance")
        out = d if out is None else out.unionByName(d)
    return out


QUERIES = {"p3_found": p3_found, "p3_deduplicated": p3_deduplicated, "p6_found": p6_found, "p6_hierarchy": p6_hierarchy, "p6_descendants": p6_descendants}

_UUID = """CASE WHEN regexp_matches(regexp_replace(regexp_replace(lower(trim({c}, ' \t\n\r')), '^(urn:)?uuid:', ''), '[{{}}\\-\\s]', '', 'g'), '^[0-9a-f]{{32}}$')
 THEN regexp_replace(regexp_replace(regexp_replace(lower(trim({c}, ' \t\n\r')), '^(urn:)?uuid:', ''), '[{{}}\\-\\s]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
 ELSE lower(trim({c}, ' \t\n\r')) END"""
_RID, _DOC = _UUID.format(c="producer_request_id"), _UUID.format(c="document_id")

_RANKED = f"""
WITH k AS (SELECT *, nullif({_RID}, '') AS rid, {_DOC} AS doc FROM new_indexation_job),
r AS (SELECT *, row_number() OVER (PARTITION BY rid, doc, document_version ORDER BY received_at NULLS LAST, delivery_id) AS rn FROM k)
"""

_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"

SQL = {
    "p3_found": _RANKED + "SELECT DISTINCT delivery_id FROM r WHERE rid IS NOT NULL AND rn > 1",
    "p3_deduplicated": _RANKED + "SELECT " + ", ".join(f"{c} AT TIME ZONE 'UTC' AS {c}" if c.endswith("_at") else c for c in MESSAGE_COLUMNS) + " FROM r WHERE rid IS NULL OR rn = 1",
    "p6_descendants": "WITH RECURSIVE "
    + ", ".join(
        "l_{t} AS (SELECT node, min(parent) AS parent FROM (SELECT regexp_replace({n}, '{b}', '', 'g') AS node, nullif(regexp_replace({p}, '{b}', '', 'g'), '') AS parent FROM {t}) GROUP BY node), "
        "ok_{t} AS (SELECT node FROM l_{t} WHERE parent IS NULL UNION ALL SELECT c.node FROM l_{t} c JOIN ok_{t} u ON c.parent = u.node), "
        "c_{t} AS (SELECT node AS ancestor, node, 0::BIGINT AS distance FROM ok_{t} "
        "UNION ALL SELECT c.ancestor, l.node, c.distance + 1 FROM c_{t} c JOIN l_{t} l ON l.parent = c.node)".format(t=t, n=n, p=p, b=_ENDS)
        for t, n, p in TREES
    )
    + " "
    + " UNION ALL ".join(f"SELECT '{t}' AS node_table, ancestor, node, distance FROM c_{t}" for t, _, _ in TREES),
}


def _tree_sql(found: bool) -> str:
    """Walks down from the roots and from the nodes whose parent is missing; what is left runs into cycles."""
    ctes, out = [], []
    for t, n, p in TREES:
        ctes.append(
            "l_{t} AS (SELECT node, min(parent) AS parent FROM (SELECT regexp_replace({n}, '{b}', '', 'g') AS node, nullif(regexp_replace({p}, '{b}', '', 'g'), '') AS parent FROM {t}) WHERE node <> '' GROUP BY node), "
            "ok_{t} AS (SELECT node, node AS root, 0::BIGINT AS depth, node AS path FROM l_{t} WHERE parent IS NULL UNION ALL SELECT c.node, u.root, u.depth + 1, u.path || '/' || c.node FROM l_{t} c JOIN ok_{t} u ON c.parent = u.node), "
            "up_{t} AS (SELECT node AS ancestor, node FROM ok_{t} UNION ALL SELECT u.ancestor, l.node FROM up_{t} u JOIN l_{t} l ON l.parent = u.node), "
            "below_{t} AS (SELECT ancestor AS node, count(*) - 1 AS descendants FROM up_{t} GROUP BY 1), "
            "miss_{t} AS (SELECT node, parent AS end_id FROM l_{t} WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM l_{t}) UNION ALL SELECT c.node, u.end_id FROM l_{t} c JOIN miss_{t} u ON c.parent = u.node), "
            "rest_{t} AS (SELECT node, parent FROM l_{t} WHERE node NOT IN (SELECT node FROM ok_{t}) AND node NOT IN (SELECT node FROM miss_{t})), "
            "reach_{t} AS (SELECT node AS start, parent AS node FROM rest_{t} UNION SELECT r.start, x.parent FROM reach_{t} r JOIN rest_{t} x ON x.node = r.node), "
            "ring_{t} AS (SELECT start AS node FROM reach_{t} WHERE start = node), "
            "cyc_{t} AS (SELECT start AS node, min(node) AS end_id FROM reach_{t} WHERE node IN (SELECT node FROM ring_{t}) GROUP BY 1)".format(t=t, n=n, p=p, b=_ENDS)
        )
        if found:
            out += [f"SELECT '{t}' AS node_table, node AS node_id, end_id FROM {k}_{t}" for k in ("miss", "cyc")]
        else:
            out.append(f"SELECT '{t}' AS node_table, node AS node_id, root, depth, path, descendants, 'root' AS end_kind, root AS end_id FROM ok_{t} JOIN below_{t} USING (node)")
            out += [f"SELECT '{t}', node, NULL, NULL, NULL, NULL, '{kind}', end_id FROM {k}_{t}" for k, kind in (("miss", "missing"), ("cyc", "cycle"))]
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + " UNION ALL ".join(out)


SQL |= {"p6_found": _tree_sql(True), "p6_hierarchy": _tree_sql(False)}
