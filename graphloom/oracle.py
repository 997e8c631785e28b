"""DuckDB SQL for the registered queries: a second, relational form of the same rules.

One chain of common table expressions goes from the corpus to judged graphs; each
statement selects from it. The corpus is ASCII, where the engines' patterns agree.
"""

from __future__ import annotations

from graphloom.functions.text import PALETTE
from graphloom.plans.schema import ENTITY_TYPES, RELATION_TYPES, STRUCTURAL_RELATION_TYPES, Ontology


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _compact(x: str) -> str:
    return rf"regexp_replace({_strip(x)}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({_strip(x)}), '[_\-]+', ' ', 'g'), '[^\w\s./+=%]+', '', 'g'), '\s+', ' ', 'g'))"


def _slug(x: str, fallback: str) -> str:
    out = rf"regexp_replace({_strip(x)}, '^#{{1,6}}\s+', '')"
    for pattern in (r"\s+", r"[\\/]+", r"[^\w.\-]+", r"-{2,}"):
        out = f"regexp_replace({out}, '{pattern}', '-', 'g')"
    return f"coalesce(nullif(trim({out}, '-_.'), ''), '{fallback}')"


def _id(prefix: str, *parts: str) -> str:
    return f"'{prefix}' || substr(sha1({' || chr(10) || '.join(f'({p})::VARCHAR' for p in parts)}), 1, 16)"


_TITLE = r"'^(#{1,6}\s+.+|\d+(\.\d+)+(\s+.*)?$|\d+\s+.+$|第[一二三四五六七八九十百千万\d]+[章节篇节]\s*.+)'"
_IMAGE = r"""'^!\[[^\]]*\]\([^)]+\)|(?i:<img\b[^>]*src=[\x27"][^\x27"]+[\x27"][^>]*>)'"""
_CAPTION = r"'(?i)^((figure|fig\.?|image|img\.?)\s*\d+[.:]?\s+)'"
_NUM = r"\b\d+(?:\.\d+)?\s*"
_PATTERNS = [
    ("memory_product", r"(?i)\b(?:LPDDR\dX?|DDR\d|GDDR\dX?|HBM\d?|SRAM|DRAM|NAND|DIMM|MRAM|RRAM)\b"),
    ("interface_standard", r"(?i)\b(?:PCIe|NVLink|CXL|UCIe|JEDEC|ONFI|NVMe|ECC)\b"),
    ("timing_parameter", r"(?i)\b(?:tRCD|tRP|tRAS|tWR|tRFC|tREFI|CL|CAS latency)\b"),
    ("process_technology", rf"(?i){_NUM}(?:nm|um)\s*(?:process|node)?\b"),
    ("capacity_metric", rf"{_NUM}(?:Gb|GB|Tb|TB|Mb|MB)\b"),
    ("power_metric", rf"(?i){_NUM}(?:mW|W|pJ/bit|nJ|V)\b"),
    ("performance_metric", rf"(?i){_NUM}(?:MT/s|GT/s|Gb/s|GB/s|MHz|GHz|ns|ps|%)\b"),
    ("component", r"(?i)\b(?:controller|channel|bank|rank|die|base die|PHY|buffer|cache|array|cell|wordline|bitline|TSV|interposer|package|interface|decoder|sense amplifier)\b"),
    ("material", r"(?i)\b(?:silicon|copper|oxide|hafnium|carbon|polymer|metal)\b"),
]


def _level(title: str) -> str:
    body = rf"regexp_replace({title}, '^#{{1,6}}\s+', '')"
    numeric = rf"regexp_extract({body}, '^(\d+(?:\.\d+)*)(?:\s+.+)?$', 1)"
    marks = rf"length(regexp_extract({title}, '^(#{{1,6}})\s+.+$', 1))"
    return f"CASE WHEN {numeric} <> '' THEN greatest({marks}, least(6, length({numeric}) - length(replace({numeric}, '.', '')) + 1)) WHEN {marks} > 0 THEN {marks} ELSE 1 END::INT"


def _merge(field: str, key: str) -> str:
    """Distinct stripped lines of a field over groups of ``members``, in order; one row stays as it is."""
    return f"""SELECT {key}, string_agg(item, chr(10) ORDER BY place) AS merged FROM (
        SELECT {key}, item, min(struct_pack(seq := seq, nth := nth)) AS place FROM (
            SELECT {key}, seq, generate_subscripts(string_split({field}, chr(10)), 1) AS nth, {_strip(f"unnest(string_split({field}, chr(10)))")} AS item FROM members)
        WHERE item <> '' GROUP BY {key}, item) GROUP BY {key}"""


def _guarded(text: str) -> str:
    """Rows (.., entity_type, name) of matches in multilingual text, where a word ends at any letter of any script.

    Each character between words is doubled, so that neighbouring matches have one each.
    ASCII text, where the engines agree on the ends of words, is read as it is.
    """
    doubled = rf"regexp_replace({text}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    word = r"[\p{L}\p{N}_]"
    found = []
    for kind, p in _PATTERNS:
        inner = p.replace(r"\b", "").replace("(?i)", "").replace("|%", "")
        found.append((kind, p, "" if kind == "capacity_metric" else "(?i)", f"({inner})(?:$|[^{word[1:-1]}])"))
    # A per cent sign ends a word only before a word character.
    found.append(("performance_metric", "", "", rf"(\d+(?:\.\d+)?\s*%){word}"))
    plain = lambda p: f"[trim(x) for x in regexp_extract_all({text}, '{p}')]" if p else "[]"
    each = (
        rf"{{'entity_type': '{kind}', 'names': CASE WHEN regexp_matches({text}, '^[\x00-\x7F]*$') THEN {plain(whole)}"
        rf" ELSE regexp_extract_all({doubled}, '{flag}(?:^|[^{word[1:-1]}]){p}', 1) END}}"
        for kind, whole, flag, p in found
    )
    return "[" + ", ".join(each) + "]"


def _corpus(content: str, source: str = "") -> str:
    matches = " UNION ALL ".join(
        f"SELECT document_id, idx, chunk_id, {i} AS rank, '{kind}' AS entity_type, generate_subscripts(m, 1) AS nth, trim(unnest(m)) AS name"
        f" FROM (SELECT document_id, idx, chunk_id, regexp_extract_all(text, '{pattern}') AS m FROM texts)"
        for i, (kind, pattern) in enumerate(_PATTERNS)
    )
    relation = "CASE " + " ".join(
        f"WHEN '{t}' IN (a.entity_type, b.entity_type) THEN '{r}'"
        for t, r in (("timing_parameter", "has_timing"), ("capacity_metric", "has_capacity"), ("power_metric", "consumes_power"), ("performance_metric", "specification_of"), ("interface_standard", "uses_protocol"), ("component", "part_of"))
    ) + " ELSE 'related_to' END"
    return rf"""
    WITH RECURSIVE corpus AS ({source or f"SELECT 'part-' || p_partkey AS document_name, 'parts/part-' || p_partkey AS source_path, {content} AS content FROM part"}),
    docs AS (SELECT {_id('doc-', 'document_name', 'source_path')} AS document_id, * FROM corpus),
    raw_lines AS (
        SELECT document_id, document_name, unnest(parts) AS raw, (generate_subscripts(parts, 1) - 1)::INT AS line_no
        FROM (SELECT *, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS parts FROM docs)),
    lines AS (SELECT *, {_strip('raw')} AS line, starts_with(lower({_strip('raw')}), '<table') AS opens, contains(lower(raw), '</table>') AS closes FROM raw_lines),
    states AS (
        SELECT *, coalesce(last_value(CASE WHEN closes THEN 'out' WHEN opens THEN 'in' END IGNORE NULLS) OVER (
            PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'in', false) AS inside FROM lines),
    heads AS (SELECT *, CASE WHEN NOT inside THEN CASE WHEN regexp_matches(line, {_TITLE}) THEN 'title' WHEN opens THEN 'table' WHEN regexp_matches(line, {_IMAGE}) THEN 'image' END END AS head FROM states),
    segs AS (SELECT *, count(head) OVER (PARTITION BY document_id ORDER BY line_no) AS segment FROM heads),
    kinds AS (
        SELECT *, coalesce(max(head) OVER s, 'text') AS kind, min(CASE WHEN head IS NULL AND regexp_matches(line, {_CAPTION}) THEN line_no END) OVER s AS caption_at
        FROM segs WINDOW s AS (PARTITION BY document_id, segment)),
    parts AS (
        SELECT *, CASE WHEN head IS NOT NULL THEN 'head' WHEN inside THEN 'table' WHEN kind = 'image' AND caption_at IS NOT NULL THEN
            CASE WHEN line_no >= caption_at THEN 'caption' ELSE 'note' END ELSE 'text' END AS part FROM kinds),
    blocks AS (
        SELECT document_id, segment, any_value(kind) AS kind, max(CASE WHEN part = 'head' THEN line END) AS head,
               coalesce(string_agg(CASE WHEN line = '' THEN '' ELSE raw END, chr(10) ORDER BY line_no) FILTER (part = 'text'), '') AS buffer,
               {_compact("coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (part IN ('head', 'table')), '')")} AS table_body,
               list(line ORDER BY line_no) FILTER (part = 'caption' AND line <> '') AS captions,
               {_compact("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (part = 'note' AND line <> ''), '')")} AS notes
        FROM parts GROUP BY document_id, segment),
    tails AS (
        SELECT *, regexp_replace(buffer, '\n+$', '') AS cut, regexp_extract(regexp_replace(buffer, '\n+$', ''), '((?:[^\n]+\n)*[^\n]+)$', 1) AS last_par,
               lead(kind) OVER d AS next_kind, last_value(CASE WHEN kind = 'title' THEN head END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY segment) AS title
        FROM blocks WINDOW d AS (PARTITION BY document_id ORDER BY segment)),
    claims AS (SELECT *, CASE WHEN next_kind = 'table' AND regexp_matches({_compact('last_par')}, '(?i)^(table|tab\.?)\s*\d+[.:]?\s+') THEN {_compact('last_par')} END AS claimed FROM tails),
    bodies AS (
        SELECT *, {_compact("CASE WHEN claimed IS NULL THEN buffer ELSE substr(cut, 1, length(cut) - length(last_par)) END")} AS body,
               coalesce(lag(claimed) OVER (PARTITION BY document_id ORDER BY segment), '') AS caption FROM claims),
    items AS (
        SELECT document_id, segment, 0 AS nth, CASE kind WHEN 'title' THEN 'section' ELSE kind END AS type, coalesce(title, 'Document') AS title, caption, table_body, captions, notes, head,
               CASE kind WHEN 'title' THEN '' WHEN 'table' THEN CASE WHEN caption <> '' THEN '[Table Caption]' || chr(10) || caption || chr(10) || chr(10) ELSE '' END || '[Table Body]' || chr(10) || table_body
                    ELSE concat_ws(chr(10) || chr(10), CASE WHEN len(captions) > 0 THEN array_to_string(captions, chr(10)) END, CASE WHEN notes <> '' THEN '[Notes]' || chr(10) || notes END) END AS content
        FROM bodies WHERE kind <> 'text'
        UNION ALL SELECT document_id, segment, 1, 'text', coalesce(title, 'Document'), caption, table_body, captions, notes, head, body FROM bodies WHERE body <> ''),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY segment, nth)::INT AS idx FROM items),
    components AS (SELECT *, {_id('cmp-', 'document_id', 'idx', 'type', 'title')} AS component_id, {_level('title')} AS title_level FROM numbered),
    open_sections AS (
        SELECT c.document_id, c.idx, s.idx AS above, s.title_level AS level FROM components c JOIN components s ON s.document_id = c.document_id AND s.idx < c.idx AND s.type = 'section'
            AND (c.type <> 'section' OR s.title_level < c.title_level)
        WHERE NOT EXISTS (FROM components x WHERE x.document_id = c.document_id AND x.type = 'section' AND x.idx > s.idx AND x.idx < c.idx AND x.title_level <= s.title_level)),
    parents AS (SELECT c.*, p.above FROM components c LEFT JOIN (SELECT document_id, idx, max(above) AS above FROM open_sections GROUP BY ALL) p USING (document_id, idx)),
    slugs AS (SELECT *, CASE WHEN type = 'section' THEN {_slug('title', 'node')} ELSE type END AS slug FROM parents),
    keyed AS (SELECT *, row_number() OVER (PARTITION BY document_id, above, slug ORDER BY idx) AS n FROM slugs),
    paths AS (
        SELECT document_id, 0 AS idx, 'root' AS path FROM docs
        UNION ALL SELECT k.document_id, k.idx, p.path || '/' || k.slug || CASE WHEN k.n > 1 THEN '_' || (k.n - 1) ELSE '' END
        FROM keyed k JOIN paths p ON p.document_id = k.document_id AND p.idx = coalesce(k.above, 0)),
    tree AS (
        SELECT k.document_id, k.idx, k.component_id AS node_id, coalesce(a.component_id, 'root') AS parent_id, coalesce(k.above, 0) AS above, k.title, greatest(1, k.title_level) AS level, k.content, k.type AS node_type,
               p.path, q.path AS above_path, k.caption, k.table_body, k.captions, k.notes,
               CASE WHEN k.type = 'image' THEN regexp_replace('parts/' || CASE WHEN starts_with(k.head, '!') THEN regexp_extract(k.head, '\(([^)\s]+)', 1) ELSE regexp_extract(k.head, 'src="([^"]+)"', 1) END, '[^/]+/\.\./', '') END AS img_path
        FROM keyed k JOIN paths p ON p.document_id = k.document_id AND p.idx = k.idx JOIN paths q ON q.document_id = k.document_id AND q.idx = coalesce(k.above, 0)
        LEFT JOIN components a ON a.document_id = k.document_id AND a.idx = k.above
        UNION ALL SELECT document_id, 0, 'root', NULL, NULL, document_name, 0, '', 'root', 'root', NULL, '', '', NULL, '', NULL FROM docs),
    chunks AS (SELECT *, {_id('chk-', 'node_id', 'path', '1')} AS chunk_id FROM tree WHERE node_type IN ('table', 'image') OR (node_type = 'text' AND content <> '')),
    texts AS (SELECT *, {_compact('content')} AS text FROM chunks WHERE {_compact('content')} <> ''),
    found AS ({matches}),
    firsts AS (
        SELECT document_id, idx, chunk_id, entity_type, {_norm("entity_type || ':' || name")} AS key, min(rank * 100000 + nth) AS place, arg_max(name, nth) AS name FROM found GROUP BY ALL),
    mentioned AS (SELECT *, row_number() OVER (PARTITION BY document_id, idx ORDER BY place)::INT AS pos, {_id('ent-', 'document_id', 'entity_type', _norm('name'))} AS ent FROM firsts),
    mentions AS (
        SELECT m.*, t.text, t.path, t.node_id, t.node_type, t.img_path, t.table_body AS tb, left({_compact(r"coalesce(list_filter(string_split(regexp_replace(regexp_replace(t.text, '([.!?])\s+', chr(92) || '1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: contains(lower(s), lower(m.name)))[1], t.text)")}, 500) AS evidence
        FROM mentioned m JOIN texts t ON t.document_id = m.document_id AND t.idx = m.idx),
    pairs AS (
        SELECT a.document_id, a.idx, a.chunk_id, a.pos AS i, b.pos AS j, a.ent AS src, b.ent AS tgt, a.entity_type AS st, b.entity_type AS tt, a.path, left(a.text, 500) AS evidence, {relation} AS relation_type
        FROM mentions a JOIN mentions b ON a.document_id = b.document_id AND a.idx = b.idx AND a.pos < b.pos WHERE b.pos <= 8),
    snodes AS (
        SELECT document_id, [0, idx, 0] AS seq, 'tree:' || node_id AS id, CASE WHEN node_type IN ('root', 'section') THEN title ELSE node_type || ':' || path END AS name,
               CASE WHEN node_type IN ('image', 'table') THEN upper(node_type) ELSE 'component' END AS entity_type, node_type || ' node at ' || path AS description, 'structural' AS kind,
               CASE WHEN node_type = 'image' AND len(captions) > 0 THEN array_to_string(captions, chr(10)) WHEN node_type = 'image' AND img_path <> '' THEN img_path
                    WHEN node_type = 'table' THEN CASE WHEN caption <> '' THEN caption ELSE left(table_body, 500) END WHEN content <> '' THEN left(content, 500) ELSE title END AS evidence_span,
               CASE WHEN node_type IN ('image', 'table') THEN 'asset_grounded' ELSE 'grounded' END AS evidence_status, CASE WHEN node_type IN ('image', 'table') THEN node_type ELSE 'text' END AS modality, idx
        FROM tree),
    neighbours AS (SELECT *, lead(node_id) OVER s AS next_id, lead(path) OVER s AS next_path FROM tree WHERE parent_id IS NOT NULL WINDOW s AS (PARTITION BY document_id, parent_id ORDER BY idx)),
    sedges AS (
        SELECT document_id, [0, idx, 0] AS seq, 'tree:' || parent_id AS src, 'tree:' || node_id AS tgt, 'parent_of' AS relation_type, above_path || ' is the parent of ' || path AS description FROM neighbours
        UNION ALL SELECT document_id, [0, idx, 1], 'tree:' || parent_id, 'tree:' || node_id, 'contains', above_path || ' contains ' || path FROM neighbours
        UNION ALL SELECT document_id, [0, idx, 2], 'tree:' || node_id, 'tree:' || next_id, 'next_sibling', next_path || ' follows ' || path FROM neighbours WHERE next_id IS NOT NULL),
    all_nodes AS (
        SELECT document_id, seq, id, name, entity_type, description, kind, evidence_span, evidence_status, modality, id AS cluster FROM snodes
        UNION ALL SELECT document_id, [1, idx, 1, pos], ent, name, entity_type, name || ' mentioned in ' || path, 'semantic', evidence, 'grounded',
               CASE WHEN node_type IN ('image', 'table') THEN node_type ELSE 'text' END, {_id('ent-', 'document_id', _norm("entity_type || ':' || name"))} FROM mentions),
    all_edges AS (
        SELECT document_id, seq, src, tgt, relation_type, description, 'structural' AS edge_source, '' AS evidence_span, 1.0::DOUBLE AS confidence FROM sedges
        UNION ALL SELECT document_id, [1, idx, 1, 0, pos], 'tree:' || node_id, ent, 'contains', path || ' contains mention of ' || name, 'extracted', evidence, 0.85 FROM mentions
        UNION ALL SELECT document_id, [1, idx, 1, 1, i, j], src, tgt, relation_type, st || ' and ' || tt || ' co-occur in ' || path, 'extracted', evidence, 0.6 FROM pairs),
    node_text AS (SELECT * FROM ({_merge('description', 'document_id, cluster').replace('members', 'all_nodes')}) JOIN ({_merge('evidence_span', 'document_id, cluster').replace('members', 'all_nodes').replace('AS merged', 'AS merged_evidence')}) USING (document_id, cluster)),
    grouped AS (
        SELECT document_id, cluster, count(*) AS n, min(seq) AS seq, arg_min(name, seq) AS name, arg_min(entity_type, seq) AS entity_type, arg_min(kind, seq) AS kind, arg_min(description, seq) AS d, arg_min(evidence_span, seq) AS e,
               arg_min(evidence_status, seq) AS evidence_status, arg_min(modality, seq) AS modality FROM all_nodes GROUP BY ALL),
    names AS (
        SELECT document_id, cluster, string_agg(name, '|' ORDER BY place) AS mentions FROM (SELECT document_id, cluster, name, min(seq) AS place FROM all_nodes WHERE kind = 'semantic' GROUP BY ALL) GROUP BY ALL),
    nodes AS (
        SELECT document_id, cluster AS id, seq, name, entity_type, kind, evidence_status, modality, CASE WHEN n = 1 THEN d ELSE merged END AS description, CASE WHEN n = 1 THEN e ELSE coalesce(merged_evidence, '') END AS evidence_span, coalesce(mentions, '') AS mentions
        FROM grouped LEFT JOIN node_text USING (document_id, cluster) LEFT JOIN names USING (document_id, cluster)),
    ids AS (SELECT document_id, id, arg_max(cluster, seq) AS cluster FROM all_nodes GROUP BY ALL),
    renamed AS (
        SELECT e.* EXCLUDE (src, tgt), coalesce(a.cluster, e.src) AS src, coalesce(b.cluster, e.tgt) AS tgt
        FROM all_edges e LEFT JOIN ids a ON a.document_id = e.document_id AND a.id = e.src LEFT JOIN ids b ON b.document_id = e.document_id AND b.id = e.tgt),
    members AS (SELECT *, {_id('edge-', 'document_id', 'src', 'tgt', 'relation_type', 'edge_source')} AS id FROM renamed WHERE src <> tgt),
    edge_text AS (SELECT * FROM ({_merge('description', 'document_id, id')}) LEFT JOIN ({_merge('evidence_span', 'document_id, id').replace('AS merged', 'AS merged_evidence')}) USING (document_id, id)),
    edge_groups AS (
        SELECT document_id, id, src, tgt, relation_type, edge_source, min(seq) AS seq, count(*) AS n, max(confidence) AS confidence, arg_min(description, seq) AS d, arg_min(evidence_span, seq) AS e
        FROM members GROUP BY document_id, id, src, tgt, relation_type, edge_source),
    edges AS (
        SELECT document_id, id, src, tgt, relation_type, edge_source, seq, confidence, CASE WHEN n = 1 THEN d ELSE merged END AS description, CASE WHEN n = 1 THEN e ELSE coalesce(merged_evidence, '') END AS evidence_span
        FROM edge_groups JOIN edge_text USING (document_id, id)),
    judged_nodes AS (
        SELECT *, CASE WHEN entity_type IN ('{"', '".join(t for t in ENTITY_TYPES if t != 'material')}') THEN '' ELSE 'unknown_entity_type' END AS reasons FROM nodes),
    edge_marks AS (
        SELECT e.*, a.id IS NULL OR b.id IS NULL AS loose FROM edges e LEFT JOIN (SELECT document_id, id FROM judged_nodes WHERE reasons = '') a ON a.document_id = e.document_id AND a.id = e.src
        LEFT JOIN (SELECT document_id, id FROM judged_nodes WHERE reasons = '') b ON b.document_id = e.document_id AND b.id = e.tgt),
    judged_edges AS (
        SELECT *, concat_ws(',', CASE WHEN loose THEN 'missing_valid_endpoint' END, CASE WHEN relation_type NOT IN ('{"', '".join(dict.fromkeys(t for t in (*RELATION_TYPES, *STRUCTURAL_RELATION_TYPES) if t != 'uses_protocol'))}') THEN 'unknown_relation_type' END,
            CASE WHEN confidence < 0.7 THEN 'low_confidence' END) AS reasons FROM edge_marks)
    """


def statements(content: str, answer: str, types: list[str], relations: list[str], searches: list[str]) -> dict[str, str]:
    """The statement of each query."""
    chain = _corpus(content)
    listed = lambda names: "'" + "', '".join(names) + "'"
    counts = """
        SELECT d.document_id, coalesce(n.ok, 0) AS node_count, coalesce(e.ok, 0) AS edge_count, coalesce(n.bad, 0) AS review_node_count, coalesce(e.bad, 0) AS review_edge_count FROM docs d
        LEFT JOIN (SELECT document_id, count(*) FILTER (reasons = '') AS ok, count(*) FILTER (reasons <> '') AS bad FROM judged_nodes GROUP BY ALL) n USING (document_id)
        LEFT JOIN (SELECT document_id, count(*) FILTER (reasons = '') AS ok, count(*) FILTER (reasons <> '') AS bad FROM judged_edges GROUP BY ALL) e USING (document_id)"""
    hashed = "sha1(evidence_span) AS evidence_sha1"
    letters = "list_reduce([ord(c) for c in list_filter(string_split(p_type, ''), lambda c: c <> '')]::BIGINT[], lambda h, c: (h * 31 + c) & 4294967295, 0::BIGINT)"
    text_docs = f"""SELECT {_id('doc-', 'doc_id', "'documents/' || doc_id")} AS document_id, coalesce(text, '') AS content FROM documents"""
    items = lambda nodes, edges: f"SELECT document_id, id, 'node' AS item, reasons <> '' AS is_review FROM ({nodes}) UNION ALL SELECT document_id, id, 'edge', reasons <> '' FROM ({edges})"
    ends = "EXISTS (FROM vn WHERE vn.document_id = e.document_id AND vn.id = e.src) AND EXISTS (FROM vn WHERE vn.document_id = e.document_id AND vn.id = e.tgt)"
    both = f"""SELECT 'part-' || p_partkey AS document_name, 'parts/part-' || p_partkey AS source_path, {content} AS content FROM part
        UNION ALL SELECT doc_id::VARCHAR, 'documents/' || doc_id, coalesce(text, '') FROM documents"""
    neighbours_of_dram = """, centre AS (SELECT document_id, id FROM nodes WHERE name = 'DRAM' AND kind = 'semantic'),
            near AS (SELECT e.* FROM edges e WHERE EXISTS (FROM centre c WHERE c.document_id = e.document_id AND c.id IN (e.src, e.tgt))),
            shown AS (FROM centre UNION SELECT document_id, src FROM near UNION SELECT document_id, tgt FROM near)
            SELECT document_id, id, 'node' AS item FROM nodes SEMI JOIN shown USING (document_id, id) UNION ALL SELECT document_id, id, 'edge' FROM near"""
    palette = ", ".join(f"'{c}'" for c in PALETTE)
    return {
        "title_levels": chain + f"SELECT document_id, line_no, line AS title, {_level('line')} AS level FROM parts WHERE part = 'head' AND kind = 'title'",
        "title_lines": chain
        + rf"""SELECT document_id, count(*) AS n_titles FROM (
            SELECT document_id, line FROM lines UNION ALL
            SELECT document_id, {_strip('line')} FROM (SELECT document_id, unnest(string_split(content, chr(10))) AS line FROM ({text_docs})))
            WHERE regexp_matches(line, {_TITLE}) GROUP BY document_id""",
        "line_blocks": chain + "SELECT document_id, line_no, segment, kind, part FROM parts",
        "document_components": chain + "SELECT document_id, idx, component_id, type, title, content, title_level FROM components",
        "table_blocks": chain + "SELECT document_id, idx, caption, table_body AS body, content FROM components WHERE type = 'table'",
        "image_captions": chain + "SELECT document_id, idx, img_path, coalesce(array_to_string(captions, '|'), '') AS captions, notes, content FROM tree WHERE node_type = 'image'",
        "dealt_components": chain + "SELECT document_id, idx, component_id, type, title, content, title_level FROM components",
        "dealt_tree_paths": chain + "SELECT document_id, idx, node_id, parent_id, level, node_type, path FROM tree",
        "tree_paths": chain + "SELECT document_id, idx, node_id, parent_id, level, node_type, path FROM tree",
        "node_chunks": chain + "SELECT document_id, idx, 1 AS piece_idx, chunk_id, node_type, path AS tree_path, content FROM chunks",
        "chunk_windows": rf"""
            WITH t AS ({text_docs}), w AS (
                SELECT document_id, content, unnest(generate_series(0, greatest(length(content) - 1, 0), 1080)) AS s FROM t WHERE content <> ''),
            c AS (SELECT document_id, s, CASE WHEN length(content) <= 1200 THEN content ELSE {_strip('substr(content, s + 1, 1200)')} END AS piece FROM w
                  WHERE s = 0 OR (length(content) > 1200 AND s + 120 < length(content))),
            n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s)::INT AS piece_idx FROM c WHERE piece <> '')
            SELECT document_id, piece_idx, {_id('chk-', "'n'", "'root/text'", 'piece_idx')} AS chunk_id, length(piece) AS n_chars, sha1(piece) AS content_sha1 FROM n""",
        "chunk_paragraphs": chain
        + rf""", pars AS (SELECT document_id, idx, node_id, path, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS k, {_strip("unnest(string_split(content, chr(10) || chr(10)))")} AS p FROM chunks WHERE node_type = 'text'),
            nth AS (SELECT *, row_number() OVER (PARTITION BY document_id, idx ORDER BY k)::INT AS piece_idx FROM pars WHERE p <> '')
            SELECT document_id, idx, piece_idx, {_id('chk-', 'node_id', 'path', 'piece_idx')} AS chunk_id, p AS content FROM nth""",
        "scalar_functions": f"""SELECT p_partkey, {_slug("'## ' || p_name || '_(x)/' || p_brand || '--'", 'item')} AS slug, {_norm("'## ' || p_name || '_(x)/' || p_brand || '--'")} AS norm,
            {_id('x-', 'p_partkey', 'p_type')} AS id, ([{palette}])[({letters} % {len(PALETTE)} + 1)::INT] AS color FROM part""",
        "entity_mentions": chain + "SELECT document_id, chunk_id, pos, entity_type, name, evidence FROM mentions",
        "component_words": f"""
            WITH t AS ({both}), m AS (SELECT document_name, source_path, unnest({_guarded("content")}) AS m FROM t),
            n AS (SELECT document_name, source_path, m.entity_type AS entity_type, unnest(m.names) AS name FROM m)
            SELECT entity_type, lower(name) AS name, count(DISTINCT (document_name, source_path)) AS n_docs FROM n GROUP BY entity_type, lower(name)""",
        "entity_counts": _corpus("", both)
        + rf""", w AS (SELECT document_id, idx, node_type, content, unnest(CASE WHEN node_type = 'text' THEN generate_series(0, greatest(length(content) - 1, 0), 1080) ELSE [0] END) AS s FROM chunks),
            p AS (SELECT document_id, idx, s, CASE WHEN node_type <> 'text' OR length(content) <= 1200 THEN content ELSE substr(content, s + 1, 1200) END AS piece FROM w WHERE s = 0 OR (length(content) > 1200 AND s + 120 < length(content))),
            m AS (SELECT document_id, idx, s, unnest({_guarded("piece")}) AS m FROM p), n AS (SELECT document_id, idx, s, m.entity_type AS entity_type, unnest(m.names) AS name FROM m)
            SELECT entity_type, lower(name) AS entity, count(DISTINCT (document_id, idx, s)) AS n_chunks, count(DISTINCT document_id) AS n_documents FROM n GROUP BY entity_type, lower(name)""",
        "cooccurrence_edges": chain
        + f"SELECT document_id, concat_ws('.', 1, idx, 1, 1, i, j) AS seq, {_id('edge-', 'document_id', 'src', 'tgt', 'relation_type', 'chunk_id')} AS id, src, tgt, relation_type, 0.6::DOUBLE AS confidence, sha1(evidence) AS evidence_sha1 FROM pairs",
        "structural_graph_nodes": chain + f"SELECT document_id, id, idx, name, entity_type, modality, evidence_status, {hashed} FROM snodes",
        "structural_graph_edges": chain + f"SELECT document_id, array_to_string(seq, '.') AS seq, {_id('edge-', 'document_id', 'src', 'tgt', 'relation_type')} AS id, src, tgt, relation_type, description FROM sedges",
        "merged_nodes": chain + f"SELECT document_id, id, name, entity_type, kind, sha1(description) AS description_sha1, {hashed}, mentions FROM nodes",
        "merged_edges": chain + f"SELECT document_id, id, src, tgt, relation_type, edge_source, confidence, sha1(description) AS description_sha1, {hashed} FROM edges",
        "validated_nodes": chain + "SELECT document_id, id, CASE WHEN reasons = '' THEN 'valid' ELSE 'rejected' END AS ontology_status, evidence_status, reasons FROM judged_nodes",
        "validated_edges": chain
        + "SELECT document_id, id, CASE WHEN reasons = '' THEN 'valid' ELSE 'rejected' END AS ontology_status, CASE edge_source WHEN 'structural' THEN 'structural' ELSE 'grounded' END AS evidence_status, reasons FROM judged_edges",
        "graph_counts": chain + f"SELECT *, review_node_count + review_edge_count AS review_total, node_count >= 300 OR edge_count >= 600 AS is_large FROM ({counts})",
        "stored_graph": chain + f"SELECT document_id, node_count AS stored_node_count, edge_count AS stored_edge_count FROM ({counts})",
        "visible_subgraph": chain
        + f", vn AS (FROM judged_nodes WHERE entity_type IN ({listed(types)})) {items('FROM vn', f'SELECT e.* FROM judged_edges e WHERE relation_type IN ({listed(relations)}) AND {ends}')}",
        "review_subgraph": chain
        + f""", vn AS (FROM judged_nodes), ve AS (SELECT e.* FROM judged_edges e WHERE reasons <> '' AND {ends}),
            shown AS (SELECT document_id, id FROM vn WHERE reasons <> '' UNION SELECT document_id, src FROM ve UNION SELECT document_id, tgt FROM ve)
            {items('SELECT vn.* FROM vn SEMI JOIN shown USING (document_id, id)', 'FROM ve')}""",
        "node_search": chain
        + 'SELECT n.document_id, n.id, n.name, n.entity_type AS "entityType", coalesce(t.path, m.path) AS "treePath" FROM nodes n LEFT JOIN tree t ON t.document_id = n.document_id AND n.id = \'tree:\' || t.node_id'
        " LEFT JOIN mentions m ON m.document_id = n.document_id AND n.kind = 'semantic' AND n.seq = [1, m.idx, 1, m.pos] WHERE contains(lower(n.name), 'ddr') QUALIFY row_number() OVER (PARTITION BY n.document_id ORDER BY n.seq) <= 20",
        "indexed_search": chain
        + ", q(query) AS (VALUES " + ", ".join(f"('{q}')" for q in searches) + """) SELECT query, document_id, id, name FROM nodes, q WHERE contains(lower(name), lower(trim(query)))
            QUALIFY row_number() OVER (PARTITION BY query, document_id ORDER BY seq) <= 20""",
        "stored_neighborhood": chain + neighbours_of_dram,
        "node_neighborhood": chain + neighbours_of_dram,
        "type_inventory": chain + "SELECT 'node' AS item, entity_type AS type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', relation_type, count(*) FROM edges GROUP BY ALL",
        "viewer_elements": chain
        + f"""SELECT document_id, id, name AS label, entity_type AS "entityType", kind || '-node modality-' || modality || CASE WHEN reasons <> '' THEN ' review-item' ELSE '' END AS classes,
            ([{palette}])[({letters.replace('p_type', 'entity_type')} % {len(PALETTE)} + 1)::INT] AS color, reasons <> '' AS review FROM judged_nodes""",
        "viewer_edges": chain
        + """SELECT document_id, id, src AS source, tgt AS target, relation_type AS label, edge_source AS "edgeSource", confidence,
            CASE edge_source WHEN 'structural' THEN 'structural-edge' ELSE 'semantic-edge' END || CASE WHEN reasons <> '' THEN ' review-item' ELSE '' END AS classes, reasons <> '' AS review FROM judged_edges""",
        "edge_neighborhood": chain
        + """, near AS (FROM edges WHERE relation_type = 'part_of'), shown AS (SELECT document_id, src AS id FROM near UNION SELECT document_id, tgt FROM near)
            SELECT document_id, id, 'node' AS item FROM nodes SEMI JOIN shown USING (document_id, id) UNION ALL SELECT document_id, id, 'edge' FROM near""",
        "document_types": chain + "SELECT DISTINCT document_id, entity_type AS type, 'node' AS item FROM judged_nodes UNION ALL SELECT DISTINCT document_id, relation_type, 'edge' FROM judged_edges",
        "active_graph": chain + "SELECT document_id, document_name, source_path FROM docs ORDER BY document_name, document_id LIMIT 1",
        "ontology_types": chain
        + ", known(item, type, structural) AS (VALUES " + ", ".join(f"('node', '{t}', false)" for t in Ontology().entity_types) + ", "
        + ", ".join(f"('edge', '{t}', {str(t in Ontology().structural_relation_types).lower()})" for t in Ontology().relation_types)
        + """), used AS (SELECT 'node' AS item, entity_type AS type, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', relation_type, count(*) FROM edges GROUP BY ALL)
            SELECT item, type, coalesce(n, 0) AS n, k.structural IS NOT NULL AS known, coalesce(k.structural, false) AS structural FROM used FULL JOIN known k USING (item, type)""",
        "files_round_trip": f"""WITH d AS (SELECT 'part-' || p_partkey AS document_name, sha1({content}) AS content_sha1 FROM part)
            SELECT document_name, 'folder' AS how, content_sha1, true AS same_id FROM d UNION ALL SELECT document_name, 'manifest', content_sha1, true FROM d WHERE ends_with(document_name, '0')""",
        "nested_trees": chain
        + """, d AS (SELECT document_id, idx, path, len(path) - len(replace(path, '/', '')) AS depth, lead(len(path) - len(replace(path, '/', ''))) OVER (PARTITION BY document_id ORDER BY idx) AS after FROM tree)
            SELECT document_id, string_agg('<' || repeat('>', greatest(depth - coalesce(after, 0) + 1, 0)), '' ORDER BY idx) AS brackets, string_agg(path, '|' ORDER BY idx) AS paths FROM d GROUP BY document_id""",
        "published_index": chain
        + f"SELECT document_name AS name, document_id, document_id || '/graph.json' AS path, node_count::INT AS n_nodes, edge_count FROM ({counts}) JOIN docs USING (document_id)",
        "graph_indexes": """
            WITH n AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '0' END AS name, p_partkey::VARCHAR AS k, '/kg/' || p_partkey || '/' AS here FROM part)
            SELECT p_partkey, name, CASE p_partkey % 7 WHEN 2 THEN 'd' WHEN 3 THEN 'd' || k END AS document_id,
                   CASE p_partkey % 7 WHEN 0 THEN 'u' || k || '.json' WHEN 1 THEN 'http://h/' || k WHEN 2 THEN '../p' || k WHEN 3 THEN 'd' || k || '/graph.json' WHEN 4 THEN '/kg/' || k ELSE name || '/graph.json' END AS path,
                   CASE p_partkey % 7 WHEN 0 THEN here || 'u' || k || '.json' WHEN 1 THEN 'http://h/' || k WHEN 2 THEN '/kg/p' || k WHEN 3 THEN '/kg/e' WHEN 4 THEN '/kg/' || k WHEN 5 THEN '/tmp/' || k ELSE here || name || '/exports/graph.json' END AS local_path
            FROM n""",
        "model_answers": """
            WITH a AS (SELECT p_partkey, 'chk-' || p_partkey AS chunk_id, CASE WHEN p_partkey % 7 = 0 THEN 'no answer' END AS error, 'The ' || p_brand || '  part ' || p_partkey AS passage FROM part)
            SELECT chunk_id, CASE WHEN error IS NULL THEN passage || '|English|' || CASE WHEN p_partkey % 20 = 0 THEN 'data:image/png;base64,' || to_base64(('png ' || p_partkey)::BLOB) ELSE 'None' END ELSE '' END AS response,
                   error, p_partkey % 20 = 10 AS no_image FROM a""",
        "store_round_trip": chain
        + f"""SELECT c.document_id, node_count AS stored_node_count, CASE WHEN regexp_matches(document_name, '[036]$') THEN 0 ELSE edge_count END AS stored_edge_count
            FROM ({counts}) c JOIN docs USING (document_id) WHERE NOT ends_with(document_name, '0')""",
        "compacted_store": chain
        + f"""SELECT c.document_id, node_count AS stored_node_count, CASE WHEN regexp_matches(document_name, '[036]$') THEN 0 ELSE edge_count END AS stored_edge_count
            FROM ({counts}) c JOIN docs USING (document_id) WHERE NOT regexp_matches(document_name, '[012]$')""",
        "streamed_store": chain + "SELECT document_id, id, 'node' AS item FROM nodes UNION ALL SELECT document_id, id, 'edge' FROM edges",
        "export_round_trip": chain + "SELECT document_id, id, 'nodes' AS item, reasons FROM judged_nodes UNION ALL SELECT document_id, id, 'edges', reasons FROM judged_edges",
        "llm_contains": f"""
            WITH e AS (
                SELECT p_partkey, 0 AS pos, p_name AS name, 'memory_product' AS entity_type FROM part
                UNION ALL SELECT p_partkey, 2, 'Size ' || p_size, 'capacity_metric' FROM part UNION ALL SELECT p_partkey, 7, 'Wide ' || p_partkey, 'capacity_metric' FROM part),
            t AS (SELECT *, 'doc-' || (p_partkey % 10) AS document_id, {_id('ent-', "'doc-' || (p_partkey % 10)", 'entity_type', _norm('name'))} AS tgt FROM e)
            SELECT document_id, concat_ws('.', 1, p_partkey, 1, 0, pos) AS seq, {_id('edge-', 'document_id', "'tree:n'", 'tgt', "'contains'")} AS id, 'tree:n' AS src, tgt, 'contains' AS relation_type,
                   'root/text contains mention of ' || name AS description, 0.9::DOUBLE AS confidence, 'grounded' AS evidence_status FROM t""",
        "llm_records": f"""
            WITH a AS (SELECT 'chk-' || p_partkey AS chunk_id, {answer} AS response FROM part),
            r AS (SELECT chunk_id, list_filter([{_strip('x')} for x in string_split(replace(response, '<|COMPLETE|>', '##'), '##')], lambda x: x <> '') AS rs FROM a),
            e AS (SELECT chunk_id, (generate_subscripts(rs, 1) - 1)::INT AS record, unnest(rs) AS part FROM r)
            SELECT chunk_id, record, array_to_string([{_strip(rf"CASE WHEN length(f) >= 2 AND left(f, 1) = right(f, 1) AND left(f, 1) IN (chr(34), chr(39)) THEN f[2:-2] ELSE f END")} for f in [{_strip('g')} for g in string_split(regexp_extract(part, '(?s)\\((.*)\\)', 1), '<|>')]], '|') AS fields
            FROM e WHERE regexp_matches(part, '(?s)\\(.*\\)')""",
        "llm_entities": f"""
            WITH e AS (
                SELECT p_partkey, 0 AS pos, p_name AS name, 'memory_product' AS entity_type, 'a ''part''' AS description, p_brand AS evidence_span FROM part
                UNION ALL SELECT p_partkey, 2, 'Size ' || p_size, 'capacity_metric', 'y', 'PART ' || p_partkey FROM part
                UNION ALL SELECT p_partkey, 7, 'Wide ' || p_partkey, 'capacity_metric', 'z', 'ＰＡＲＴ　' || p_partkey FROM part)
            SELECT 'doc-' || (p_partkey % 10) AS document_id, 'chk-' || p_partkey AS chunk_id, pos, {_id('ent-', "'doc-' || (p_partkey % 10)", 'entity_type', _norm('name'))} AS id, name, entity_type, description, evidence_span FROM e""",
        "llm_relations": f"""
            WITH e AS (
                SELECT p_partkey, 'doc-' || (p_partkey % 10) AS document_id, {_id('ent-', "'doc-' || (p_partkey % 10)", "'memory_product'", _norm('p_name'))} AS src,
                       {_id('ent-', "'doc-' || (p_partkey % 10)", "'capacity_metric'", _norm("'Size ' || p_size"))} AS tgt, p_brand FROM part)
            SELECT document_id, {_id('edge-', 'document_id', 'src', 'tgt', "'has_capacity'", "'chk-' || p_partkey")} AS id, src, tgt, 'has_capacity' AS relation_type,
                   CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.25 END::DOUBLE AS confidence, p_brand AS evidence_span FROM e""",
    }
