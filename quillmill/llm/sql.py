"""SQL for the queries of this subpackage that SQL can express; the others are tested by brute force in tests/llm."""

SQL = {
    "p5_found": """SELECT DISTINCT 'logical_block' AS item_table, block_id AS item_id FROM logical_block WHERE length(text) > 2000
UNION SELECT DISTINCT 'normalized_element', source_element_id FROM normalized_element WHERE length(normalized_text) > 2000""",
}
