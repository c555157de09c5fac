"""SQL for the queries that SQL can express over whole tables."""

from html.entities import name2codepoint


def _unescaped(text: str) -> str:
    """SQL of text with the character entities of HTML 4, and the numbers of the same characters, resolved."""
    for name, code in sorted(name2codepoint.items()):
        if name != "amp" and code < 0x2100:
            for entity in (f"&{name};", f"&#{code};", f"&#x{code:x};"):
                text = f"replace({text}, '{entity}', chr({code}))"
    return f"CASE WHEN contains(text, '&') THEN replace({text}, '&amp;', '&') ELSE text END"


_CUES = r"(?m)^[ \t]*(?:\d+[ \t]*\r?\n[ \t]*)?\d{1,3}:\d{2}(?::\d{2})?[.,]\d{1,3}[ \t]*-->[^\n]*$"
_UPPER = "A-ZÀ-ÖØ-Þ"
_LABELS = (
    r"(?m)^[ \t]*(?:>>+|[-–—])?[ \t]*(?:<v[^>\n]{1,60}>|[\[(][^\])\n\d]{1,40}\d{0,3}[\])][ \t]*:?[ \t]"
    rf"|(?:\p{{L}}[\p{{L}}\p{{N}}_.]*[ _]?(?:n[º°o.]*[ ]?)?\d{{1,3}}|[{_UPPER}][^\s:,.!?;]*(?:[ ][{_UPPER}][^\s:,.!?;]*){{0,3}}|\p{{L}}+)[ \t]*:[ \t])"
)


def _grams(table: str, key: str) -> str:
    words = f"regexp_extract_all(replace(lower(strip_accents(regexp_replace(regexp_replace({_unescaped('text')}, '{_CUES}', ' ', 'g'), '{_LABELS}', ' ', 'g'))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"
    return f"SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 12), ' ') AS gram FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL), unnest(range(1, len(w) - 11)) AS r(i)"


SQL: dict[str, str] = {
    "p2_coverage": """
WITH b AS (SELECT DISTINCT block_id, job_id, block_index, planner_id, length(text) AS n FROM editorial_blocks WHERE text IS NOT NULL)
SELECT job_id, block_index, max_chars AS capacity, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(greatest(1, ceil(n / max_chars))) AS BIGINT) AS parts, false AS over
FROM b JOIN planners USING (planner_id) GROUP BY job_id, block_index, max_chars
""",
    "p7_found": f"WITH d AS ({_grams('documents', 'doc_id')}), i AS ({_grams('eval_items', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (gram)",
    "p8_caps": """
SELECT mix_id, lower(trim(source)) AS source, max_repeats, false AS twice, false AS over FROM mix_targets WHERE trim(source) <> ''
""",
    "p5_found": """
SELECT DISTINCT block_id FROM editorial_blocks JOIN planners USING (planner_id)
WHERE length(trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12))) > floor(target_duration * chars_per_sec)
""",
}
