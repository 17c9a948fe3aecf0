"""DuckDB statements for those pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

_CANON = "array_to_string(list_sort(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')), ' ')"


def _p2(rest: str) -> str:
    c = _CANON.format
    return f"""
WITH r AS (
  SELECT 'tracks' AS tbl, track_id AS id, {c('title')} AS a, {c('artist')} AS b, {c('album')} AS c, {c('album_artist')} AS d,
    concat_ws('|', coalesce(CAST(year AS VARCHAR), 'x'), coalesce(CAST(disc_number AS VARCHAR), 'x'), coalesce(CAST(track_number AS VARCHAR), 'x'), coalesce(CAST(duration_ms AS VARCHAR), 'x')) AS e, NULL AS f
  FROM tracks
  UNION ALL
  SELECT 'album_groups', group_id, {c('album')}, {c('album_artist')}, NULL, NULL,
    concat_ws('|', coalesce(CAST(year AS VARCHAR), 'x'), coalesce(CAST(track_count AS VARCHAR), 'x')), barcode
  FROM album_groups),
w AS (SELECT tbl, id, min(id) OVER g AS kept_id, count(*) OVER g AS copies FROM r WINDOW g AS (PARTITION BY tbl, a, b, c, d, e, f))
{rest}"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _p2("SELECT tbl, kept_id, id AS dup_id FROM w WHERE id > kept_id"),
        "p2_records": _p2("SELECT tbl, kept_id, copies FROM w WHERE id = kept_id"),
    }
