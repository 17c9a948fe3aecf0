"""DuckDB statements for the queries that SQL can express over whole tables."""

from __future__ import annotations

_COMPACT = r"regexp_replace(barcode, '[\s-]+', '', 'g')"
_GTIN = rf"""CASE WHEN regexp_full_match({_COMPACT}, '\d{{8}}|\d{{12,14}}') AND NOT regexp_full_match({_COMPACT}, '0+')
  AND list_sum(list_transform(range(1, length({_COMPACT}) + 1), lambda i: CAST(substr(reverse({_COMPACT}), i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0 THEN {_COMPACT} END"""
_UUID = "CASE WHEN regexp_full_match(replace(lower({0}), '-', ''), '[0-9a-f]{{32}}') AND NOT regexp_full_match(replace({0}, '-', ''), '0+') THEN regexp_replace(replace(lower({0}), '-', ''), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END"
_LINES = """
WITH x AS (SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS disc, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS v, l_partkey FROM lineitem),
p AS (SELECT l_orderkey, disc, l_linenumber, min(v) AS ms, min(v + (l_partkey * 37) % 5000) AS other_ms FROM x GROUP BY ALL)
"""
_SIMILARITY = "CASE WHEN abs(ms - other_ms) > t THEN 0.0 ELSE 1.0 - 0.2 * (abs(ms - other_ms) / t) END"
_DISCS = """
SELECT id, disc, count(*) AS n, count(track_number) AS numbered, count(DISTINCT track_number) AS places, min(track_number) AS low, max(track_number) AS high FROM src GROUP BY id, disc
"""
_INCOMPLETE = f"""
SELECT id, (bool_or(numbered < n OR low < 1 OR places < numbered OR high > places) OR min(disc) < 1 OR count(*) < max(disc)) AS incomplete FROM ({_DISCS}) GROUP BY id
"""

# vowel signs that stand in a place of their own separate words; other marks are dropped, and the final sigma is a sigma
_FOLD = r"trim(regexp_replace(replace(replace(replace(strip_accents(regexp_replace(lower({0}), '[\x{{0900}}-\x{{0903}}\x{{093A}}\x{{093B}}\x{{093E}}-\x{{094C}}\x{{094E}}\x{{094F}}\x{{0955}}-\x{{0957}}]', ' ', 'g')), 'ß', 'ss'), 'ς', 'σ'), '&', ' and '), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"

# Labels of versions; most are named as they read.
_LABELS = {x: x for x in "deluxe expanded anniversary extended soundtrack live mono stereo acoustic instrumental drumless demo bonus".split()} | {"special": "special edition", "collector": "collector( s)? edition", "radio edit": "radio edit"}
_YEAR = r"((?:18|19|20|21)\d{2})"


def _dated(name: str, words: str) -> list[str]:
    """The label, and the label with its year."""
    pattern = rf"(?:^| )(?:{_YEAR} )?{words}(?: {_YEAR})?(?: |$)"
    year = f"coalesce(nullif(regexp_extract(x, '{pattern}', 1), ''), nullif(regexp_extract(x, '{pattern}', 2), ''))"
    return [f"CASE WHEN regexp_matches(x, '{pattern}') THEN '{name}' END", f"'{name}:' || {year}"]


_FOUND = ", ".join([
    *(f"CASE WHEN regexp_matches(x, '(^| ){words}( |$)') THEN '{name}' END" for name, words in _LABELS.items()),
    r"'anniversary:' || nullif(regexp_extract(x, '(?:^| )(\d{1,3})(?:st|nd|rd|th) anniversary(?: |$)', 1), '')",
    *_dated("remaster", "(?:digital )?remaster(?:ed)?"), *_dated("remix", "remix(?:ed)?"),
])

STATEMENTS = {
    "version_qualifiers": f"""
WITH f AS (SELECT collection_id, {_FOLD.format('album')} AS x FROM catalog_albums), l AS (SELECT collection_id, list_sort(list_filter([{_FOUND}], lambda v: v IS NOT NULL)) AS q, x FROM f)
SELECT collection_id, CASE WHEN x IS NOT NULL THEN array_to_string(q, ',') END AS labels,
  CASE WHEN x IS NOT NULL THEN array_to_string(list_filter(q, lambda v: NOT regexp_matches(v, '^(remaster(:.*)?|expanded|deluxe)$')), ',') END AS semantic FROM l""",
    "fold_text": f"SELECT collection_id, {_FOLD.format('album')} AS album_n, {_FOLD.format('artist')} AS artist_n FROM catalog_albums",
    "glob_filter": r"""SELECT track_id, path FROM tracks WHERE (regexp_matches(path, '^/lib0[^/]/([^/]+/)*[^/]*\.flac$') OR regexp_matches(path, '^/lib1[^/]*/[^/]*/r0000[^/]*/1-[^/]*\.mp3$')) AND NOT regexp_matches(path, '^/lib05/')""",
    "protected_prefix_filter": r"""SELECT track_id, path FROM tracks WHERE len(list_filter(string_split(path, '/')[1:-2], lambda s: regexp_matches(lower(s), '^(an|ka|lib07)'))) > 0""",
    "required_fields": """
SELECT missing, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN coalesce(album, '') = '' THEN 'album' END,
  CASE WHEN coalesce(nullif(album_artist, ''), nullif(artist, '')) IS NULL THEN 'artist' END) AS missing FROM tracks) WHERE missing <> '' GROUP BY missing""",
    "clean_text": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\p{C}', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) AS cleaned FROM documents""",
    "layout_folders": r"""
SELECT folder, count(*) AS n, regexp_full_match(lower(trim(regexp_replace(folder, '[^\p{L}\p{N}_]+', ' ', 'g'))), 'aac|aiff|alac|flac|lossless|m4a|mp3|ogg|opus|wav|wave|(cd|disc|disk)\s*\d{1,3}') AS layout
FROM (SELECT unnest(list_filter(string_split(path, '/')[1:-2], lambda s: s <> '')) AS folder FROM tracks) GROUP BY folder""",
    "gtin_check": f"SELECT track_id, {_GTIN} AS gtin, lpad({_GTIN}, 14, '0') AS gtin_key FROM tracks",
    "uuid_canonical": f"SELECT track_id, {_UUID.format('mb_release_id')} AS release_id, {_UUID.format('mb_recording_id')} AS recording_id FROM tracks",
    "number_pair": """
SELECT track_id, CAST(CASE WHEN track_number BETWEEN 1 AND 9999 AND coalesce(track_total, 0) <= 9999 THEN track_number END AS VARCHAR) AS number,
  CAST(CASE WHEN track_number BETWEEN 1 AND 9999 AND track_total BETWEEN track_number AND 9999 THEN track_total END AS VARCHAR) AS total, CAST(CASE WHEN disc_total BETWEEN 1 AND 9999 THEN disc_total END AS VARCHAR) AS discs FROM tracks""",
    "year_extract": r"""SELECT collection_id, nullif(regexp_extract(' ' || concat_ws(' ', album, CAST(release_year AS VARCHAR)) || ' ', '\D((18|19|20|21)\d{2})\D', 1), '') AS year_found FROM catalog_albums""",
    "matching_basis": f"""
SELECT group_id, coalesce(nullif(concat_ws('+', CASE WHEN {_UUID.format('mb_release_id')} IS NOT NULL THEN 'musicbrainz' END, CASE WHEN {_GTIN} IS NOT NULL THEN 'upc' END), ''), 'legacy') AS basis FROM album_groups""",
    "url_allowlist": r"""
SELECT collection_id, coalesce(regexp_matches(artwork_url, '^https://(art\.invalid|[^/?#:@]+\.mzstatic\.com)(:443)?([/?#]|$)'), false) AS allowed,
  regexp_replace(artwork_url, '/\d+x\d+(bb)?(-\d+)?\.(jpg|png|webp)$', '/3000x3000bb.jpg') AS first_url,
  CASE WHEN artwork_url IS NULL THEN 0 WHEN regexp_matches(artwork_url, '/\d+x\d+(bb)?(-\d+)?\.(jpg|png|webp)$') THEN CASE WHEN regexp_matches(artwork_url, '/(3000x3000|1200x1200|600x600)bb\.jpg$') THEN 3 ELSE 4 END ELSE 1 END AS urls
FROM catalog_albums""",
    "url_ids": "SELECT collection_id, CASE WHEN collection_id % 4 < 2 AND collection_id % 7 <> 0 AND collection_id % 5 <> 0 THEN CAST(collection_id AS VARCHAR) END AS found FROM catalog_albums",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "sha256_key": """SELECT group_id, sha256('{' || concat_ws(',', '"artist":' || to_json(album_artist), '"limit":50', '"term":' || to_json(album)) || '}') AS cache_key FROM album_groups""",
    "picture_size": "SELECT doc_id, CAST(32 + coalesce(strlen(lang), 0) + coalesce(strlen(subject), 0) + coalesce(strlen(text), 0) AS INT) AS bytes FROM documents",
    "retry_delay": "SELECT event_id, round(least(30.0, pow(1.8, event_id % 9)) + (user_id % 4) / 16.0, 6) AS seconds FROM events",
    "token_jaccard": """
WITH w AS (SELECT collection_id, list_distinct(list_filter(string_split(lower(album), ' '), lambda s: s <> '')) AS a, list_distinct(list_filter(string_split(lower(artist), ' '), lambda s: s <> '')) AS b FROM catalog_albums)
SELECT collection_id, round(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 6) AS jaccard FROM w""",
    "duplicate_positions": "SELECT l_suppkey, l_linenumber, count(*) AS copies, min(l_partkey) AS first_part FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "conflict_detect": """
SELECT l_partkey, count(*) FILTER (s > 1) AS conflicts FROM (SELECT l_partkey, l_linenumber, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY ALL) GROUP BY l_partkey""",
    "tracklist_incomplete": f"WITH src AS (SELECT l_orderkey AS id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS disc, l_linenumber AS track_number FROM lineitem) {_INCOMPLETE}",
    "catalog_incomplete": f"WITH src AS (SELECT collection_id AS id, coalesce(disc_number, 1) AS disc, track_number FROM catalog_tracks) {_INCOMPLETE}",
    "topology": """
WITH t AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, coalesce(disc_number, 1) AS disc, track_number, track_total, disc_total FROM tracks),
d AS (SELECT folder, disc, count(*) AS n, count(DISTINCT track_number) AS places, list_distinct(list(track_number) FILTER (track_number IS NOT NULL)) AS numbers, count(DISTINCT track_total) AS totals, min(track_total) AS tl, max(track_total) AS th,
  min(disc_total) AS dl, max(disc_total) AS dh FROM t GROUP BY ALL),
g AS (SELECT folder, count(*) AS discs, sum(n) AS tracks, max(totals) AS mt, min(tl) AS tl, max(th) AS th, count(th) AS declared, min(dl) AS dl, max(dh) AS dh, sum(places) AS places,
  len(list_distinct(flatten(list(coalesce(numbers, []))))) AS dn, list_sort(list(disc)) AS seen, list_sort(list(struct_pack(disc := disc, th := th, numbers := coalesce(numbers, [])))) AS per FROM d GROUP BY folder),
s AS (SELECT *, CASE WHEN mt > 1 THEN 'conflicting' WHEN discs > 1 AND declared = discs AND tl = th AND th >= tracks THEN 'album' WHEN declared > 0 THEN 'disc' ELSE 'unknown' END AS scope,
  flatten(list_transform(per, lambda x: list_transform(list_filter(range(1, coalesce(x.th, 0) + 1), lambda k: NOT list_contains(x.numbers, k)), lambda k: x.disc || '.' || k))) AS gaps FROM g)
SELECT folder, scope, CASE WHEN scope = 'album' AND places = dn THEN 'global' WHEN places > 0 THEN 'per_disc' ELSE 'unknown' END AS layout, discs, CAST(tracks AS BIGINT) AS tracks,
  CAST(CASE WHEN scope = 'album' THEN greatest(0, th - tracks) WHEN scope IN ('disc', 'conflicting') THEN len(gaps) END AS BIGINT) AS missing_count,
  CASE WHEN scope IN ('disc', 'conflicting') THEN array_to_string(gaps, ',') END AS missing,
  CASE WHEN dl = dh AND dh > 0 THEN array_to_string(list_filter(range(1, dh + 1), lambda k: NOT list_contains(seen, k)), ',') END AS missing_discs FROM s""",
    "release_assembly": """
WITH d AS (SELECT collection_id, coalesce(disc_number, 1) AS disc, count(*) AS n, (count(DISTINCT track_number) = count(*) AND min(track_number) = 1 AND max(track_number) = count(*)) AS ok FROM catalog_tracks GROUP BY ALL),
c AS (SELECT collection_id, sum(n) AS songs, bool_and(coalesce(ok, false)) AND min(disc) = 1 AND max(disc) = count(*) AS sound FROM d GROUP BY 1),
f AS (SELECT collection_id, arg_min(coalesce(title, chr(1)), struct_pack(d := coalesce(disc_number, 1), t := track_number)) AS first_title FROM catalog_tracks WHERE track_number IS NOT NULL GROUP BY 1)
SELECT a.collection_id, CASE WHEN songs IS NULL THEN 'no songs' WHEN NOT sound THEN 'positions broken' WHEN track_count <> songs THEN 'count differs' ELSE 'complete' END AS status,
  CAST(CASE WHEN coalesce(sound, false) THEN songs ELSE 0 END AS INT) AS listed, CASE WHEN coalesce(sound, false) THEN nullif(first_title, chr(1)) END AS first_title
FROM catalog_albums a LEFT JOIN c USING (collection_id) LEFT JOIN f USING (collection_id)""",
    "position_join": f"{_LINES} SELECT l_orderkey, CAST(sum(abs(ms - other_ms)) AS BIGINT) AS distance, count(*) AS positions FROM p GROUP BY l_orderkey",
    "duration_tolerance": f"{_LINES} SELECT l_orderkey, disc, l_linenumber, round({_SIMILARITY}, 6) AS similarity FROM (SELECT *, least(4000.0, greatest(2000.0, greatest(ms, other_ms) * 0.005)) AS t FROM p)",
    "duration_multiset": f"""{_LINES},
q AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY ms) AS k, ms FROM p), r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY other_ms) AS k, other_ms FROM p),
z AS (SELECT l_orderkey, CAST(abs(ms - other_ms) AS DOUBLE) AS g, greatest(10000.0, greatest(ms, other_ms) * 0.03) AS t FROM q JOIN r USING (l_orderkey, k))
SELECT l_orderkey, round(count(*) FILTER (g <= t) / count(*), 8) AS coverage, round(coalesce(sum(1.0 - 0.15 * (g / t)) FILTER (g <= t), 0.0) / count(*), 8) AS closeness, round(sum(g), 6) AS distance FROM z GROUP BY l_orderkey""",
    "multiset_containment": """
WITH l AS (SELECT l_suppkey, l_partkey, count(*) AS l FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), r AS (SELECT l_suppkey, l_partkey, count(*) AS r FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT l_suppkey, bool_and(l <= coalesce(r, 0)) AS contained FROM l LEFT JOIN r USING (l_suppkey, l_partkey) GROUP BY l_suppkey""",
    "cascade_priority": """
WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS stage FROM orders), b AS (SELECT *, min(stage) OVER (PARTITION BY o_custkey) AS m FROM s WHERE stage IS NOT NULL)
SELECT o_custkey, stage, count(*) AS n, min(o_orderkey) AS first_order FROM b WHERE stage = m GROUP BY o_custkey, stage""",
    "relation_overlap": """
WITH s AS (SELECT l_suppkey, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'A'), []) AS a, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R'), []) AS r FROM lineitem GROUP BY 1)
SELECT l_suppkey, len(list_intersect(a, r)) AS shared, len(list_intersect(a, r)) > 0 AS overlap, len(a) - len(list_intersect(a, r)) AS only_a FROM s""",
    "folder_owners": """
WITH f AS (SELECT album, list_filter(string_split(path, '/')[1:-2], lambda s: s <> '') AS p FROM tracks), e AS (SELECT album, unnest(list_transform(range(1, len(p) + 1), lambda k: '/' || array_to_string(p[1:k], '/'))) AS folder FROM f)
SELECT folder, min(album) AS album, count(*) AS files FROM e GROUP BY folder HAVING count(DISTINCT album) = 1 AND count(album) = count(*)""",
    "direct_winner": """
WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'A' AS direct, l_quantity > 45 AS exact, least(CAST(l_quantity / 50.0 AS DOUBLE), CAST(1 - l_discount AS DOUBLE)) AS q FROM lineitem),
g AS (SELECT l_orderkey, count(*) FILTER (exact) AS e, max(l_linenumber) FILTER (exact) AS c, list(q ORDER BY q DESC, l_linenumber) AS qs, first(l_linenumber ORDER BY q DESC, l_linenumber) AS i FROM x GROUP BY 1 HAVING count(*) > 1 AND bool_and(direct)),
w AS (SELECT l_orderkey, CASE WHEN e = 1 THEN c END AS c, CASE WHEN qs[1] >= 0.85 AND qs[1] - qs[2] >= 0.15 THEN i END AS d FROM g)
SELECT l_orderkey, coalesce(c, d) AS l_linenumber FROM w WHERE coalesce(c, d) IS NOT NULL AND coalesce(c = d, true)""",
    "equivalent_releases": """
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS t, l_linestatus AS a, CAST(l_quantity * 1000 AS BIGINT) AS ms FROM lineitem),
p AS (SELECT k, list(n || '|' || t || '|' || a ORDER BY n) AS s, list(ms ORDER BY n) AS m FROM l GROUP BY k HAVING count(*) = count(DISTINCT n)),
o AS (SELECT o_orderkey AS k, o_orderpriority AS x, o_orderstatus AS y, year(o_orderdate) AS z, s, m FROM orders JOIN p ON k = o_orderkey)
SELECT u.k AS a, v.k AS b FROM o u JOIN o v ON u.x = v.x AND u.y = v.y AND u.z = v.z AND u.s = v.s AND u.k < v.k
WHERE len(list_filter(list_zip(u.m, v.m), lambda q: abs(q[1] - q[2]) > least(4000.0, greatest(2000.0, greatest(q[1], q[2]) * 0.005)))) = 0""",
    "common_folder": """
WITH s AS (SELECT mb_release_id, string_split(path, '/')[2:-2] AS f FROM tracks WHERE mb_release_id IS NOT NULL),
e AS (SELECT mb_release_id, unnest(range(1, len(f) + 1)) AS k, f FROM s),
c AS (SELECT mb_release_id, k, count(DISTINCT f[1:k]) AS d, count(*) AS n, any_value('/' || array_to_string(f[1:k], '/')) AS p FROM e GROUP BY ALL),
t AS (SELECT mb_release_id, count(*) AS n FROM s GROUP BY 1)
SELECT t.mb_release_id, coalesce(arg_max(c.p, c.k), '/') AS folder FROM t LEFT JOIN c ON c.mb_release_id = t.mb_release_id AND c.d = 1 AND c.n = t.n GROUP BY t.mb_release_id""",
    "topk_before_distinct": """
WITH e AS (SELECT DISTINCT user_id, event_type AS kind, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, kind) AS place FROM e)
SELECT user_id, kind, min(place) AS place, max(value) AS value FROM r WHERE place <= 3 GROUP BY user_id, kind""",
    "rank_margin": """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS k, lead(o_totalprice) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey))
SELECT o_custkey, o_orderkey, o_totalprice AS best_price, round(o_totalprice - nxt, 4) AS margin FROM r WHERE k = 1""",
    "unique_winner": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) = 1",
    "clear_winner": """
WITH r AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 500000, 6) AS q, row_number() OVER w AS k, lead(round(o_totalprice / 500000, 6)) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY round(o_totalprice / 500000, 6) DESC, o_orderkey))
SELECT o_custkey, o_orderkey FROM r WHERE k = 1 AND q >= 0.6 AND q - coalesce(nxt, 0) >= 0.1""",
    "run_summary": f"SELECT count(*) AS tracks, count(*) FILTER (coalesce(title, '') = '') AS untitled, count(barcode) AS with_barcode, count({_GTIN}) AS valid_barcode, count(mb_release_id) AS with_release_id FROM tracks",
    "warning_histogram": "SELECT reason, count(*) AS n FROM (SELECT unnest(identifier_warnings) AS reason FROM tracks) GROUP BY reason",
    "cache_ttl": "SELECT track_id FROM tracks WHERE ingested_at >= TIMESTAMP '2024-01-01' - INTERVAL 400 DAY",
    "first_deliveries": "SELECT path, arg_min(track_id, struct_pack(a := ingested_at, b := track_id)) AS track_id, min(ingested_at) AS ingested_at FROM tracks GROUP BY path",
    "daily_arrivals": "SELECT date_trunc('day', scanned_at) AS window_start, tagger, count(*) AS n FROM tracks GROUP BY ALL",
}
