"""SQL fragments the stated results share. They restate the semantics on their own, for DuckDB."""

from __future__ import annotations


def strip(x: str) -> str:
    return f"trim({x}, E' \\t\\n\\r')"


def graph(prefix: str, x: str) -> str:
    return f"'{prefix}_' || lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))"


def stable_id(*parts: str) -> str:
    digest = "md5(concat_ws(chr(1), " + ", ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts) + "))"
    return f"regexp_replace({digest}, '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


# The patterns that are redacted.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
AMOUNT = r"\$[\d,]+(?:\.\d{2})?"
DATE = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"


def replace(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', '{flags}')"


def redact(x: str) -> str:
    for pattern, by, flags in (
        ("tion", "the gaming commission", "gi"), ("the on", "[stakeholder]", "gi"), ("lich", "[stakeholder]", "gi"),
        (EMAIL, "[email]", "g"), (PHONE, "[phone]", "g"), (AMOUNT, "[amount]", "g"), (DATE, "[date]", "g"),
    ):
        x = replace(x, pattern, by, flags)
    return x


def resolution(entities: str, relationships: str, stored: str | None = None) -> str:
    """CTEs names, res (occurrences) and lnk (relationships) over CTEs ent, rel and stored."""
    known = (
        f"""stored AS ({stored}),
st AS (SELECT g, lower(nm) AS k, uuid FROM stored
       QUALIFY row_number() OVER (PARTITION BY g, lower(nm) ORDER BY created, uuid) = 1),"""
        if stored
        else "st AS (SELECT '' AS g, '' AS k, '' AS uuid WHERE false),"
    )
    return f"""ent AS ({entities}),
rel AS ({relationships}),
{known}
occ AS (SELECT g, ep, seq, pos, {strip('nm')} AS nm, lower({strip('nm')}) AS k,
        CASE WHEN ty = '' THEN 'Entity' ELSE {strip('ty')} END AS label, {strip('de')} AS summary,
        row_number() OVER (PARTITION BY g, lower({strip('nm')}) ORDER BY seq, pos) AS rn
        FROM ent WHERE {strip('nm')} <> ''),
names AS (SELECT coalesce(f.g, st.g) AS g, coalesce(f.k, st.k) AS k,
          coalesce(st.uuid, {stable_id("'entity'", 'f.g', 'f.k')}) AS uuid, st.uuid IS NOT NULL AS is_stored,
          CASE WHEN st.uuid IS NOT NULL THEN -1 ELSE f.seq END AS first_seq
          FROM (SELECT * FROM occ WHERE rn = 1) f FULL JOIN st ON f.g = st.g AND f.k = st.k),
res AS (SELECT occ.*, n.uuid, (NOT n.is_stored AND rn = 1) AS created FROM occ JOIN names n ON n.g = occ.g AND n.k = occ.k),
lnk AS (SELECT rel.g, rel.ep, rel.seq, rel.pos, s.uuid AS src, t.uuid AS tgt,
        CASE WHEN rn = '' THEN 'relates_to' ELSE {strip('rn')} END AS name,
        CASE WHEN fact <> '' THEN fact ELSE rn END AS fact
        FROM rel LEFT JOIN names s ON s.g = rel.g AND s.k = lower({strip('sn')}) AND s.first_seq <= rel.seq
        LEFT JOIN names t ON t.g = rel.g AND t.k = lower({strip('tn')}) AND t.first_seq <= rel.seq)"""


# --- order requests ----------------------------------------------------------
_SPELLED = (
    "CASE o_orderstatus WHEN 'O' THEN '  ' || lower(o_orderpriority) WHEN 'F' THEN o_orderpriority || E' \\n' "
    "ELSE o_orderpriority END"
)
ORDER_REQUESTS = f"""req AS (SELECT {graph('client', 'c_mktsegment')} AS g, o_orderkey AS seq, 'order: ' || o_orderkey AS name,
        o_orderdate, c_name, c_mktsegment, o_orderpriority AS pri, {_SPELLED} AS spelled, 'Status ' || o_orderstatus AS st,
        'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') AS following,
        {stable_id("'episode'", graph('client', 'c_mktsegment'), 'o_orderkey', "'order: ' || o_orderkey")} AS ep
        FROM orders JOIN customer ON o_custkey = c_custkey)"""
_ORDER_ENTITIES = """SELECT g, ep, seq, 0 AS pos, c_name AS nm, 'Stakeholder' AS ty, ' customer of ' || c_mktsegment AS de FROM req
        UNION ALL SELECT g, ep, seq, 1, spelled, 'Process', 'order priority' FROM req
        UNION ALL SELECT g, ep, seq, 2, st, '', '' FROM req
        UNION ALL SELECT g, ep, seq, 3, '  ', 'Role', 'blank names are skipped' FROM req
        UNION ALL SELECT g, ep, seq, 4, upper(st), ' System ', 'again' FROM req"""
_ORDER_RELATIONS = """SELECT g, ep, seq, 0 AS pos, c_name AS sn, lower(pri) AS tn, ' places ' AS rn, '' AS fact FROM req
        UNION ALL SELECT g, ep, seq, 1, following, upper(st), '', 'precedes' FROM req
        UNION ALL SELECT g, ep, seq, 2, following, c_name, '  ', '' FROM req"""
STORED = f"""SELECT {graph('client', 'c_mktsegment')} AS g, 'stored-' || c_custkey AS uuid, upper(c_name) AS nm,
        TIMESTAMP '2020-01-02' AS created FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT {graph('client', 'c_mktsegment')}, 'older-' || c_custkey, c_name, TIMESTAMP '2020-01-01'
        FROM customer WHERE c_acctbal < -500"""
ORDERS = f"WITH {ORDER_REQUESTS},\n{resolution(_ORDER_ENTITIES, _ORDER_RELATIONS, STORED)}\n"
ORDERS_FRESH = f"WITH {ORDER_REQUESTS},\n{resolution(_ORDER_ENTITIES, _ORDER_RELATIONS)}\n"

# --- line rows ---------------------------------------------------------------
LINE_REQUESTS = f"""req AS (SELECT {graph('client', 'c_mktsegment')} AS g, o_orderkey AS seq,
        {stable_id("'episode'", graph('client', 'c_mktsegment'), 'o_orderkey', "'order: ' || o_orderkey")} AS ep
        FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (SELECT req.*, (l_linenumber::BIGINT * 1000000000 + l_partkey) * 10000000 + l_suppkey AS place, p_name, p_type, p_brand, s_name
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN req ON l_orderkey = seq)"""
_LINE_ENTITIES = """SELECT g, ep, seq, place * 2 AS pos, p_name AS nm, p_type AS ty, p_brand AS de FROM lines
        UNION ALL SELECT g, ep, seq, place * 2 + 1, s_name, 'Stakeholder', 'supplier' FROM lines"""
_LINE_RELATIONS = "SELECT g, ep, seq, place AS pos, s_name AS sn, p_name AS tn, 'supplies' AS rn, '' AS fact FROM lines"
LINES = f"WITH {LINE_REQUESTS},\n{resolution(_LINE_ENTITIES, _LINE_RELATIONS)}\n"

COUNTERS = """SELECT r.g AS group_id, r.ep AS episode_uuid,
 coalesce(c.made, 0)::BIGINT AS entities_created, coalesce(c.merged, 0)::BIGINT AS entities_merged,
 coalesce(l.made, 0)::BIGINT AS relationships_created, coalesce(l.skipped, 0)::BIGINT AS relationships_skipped
 FROM req r
 LEFT JOIN (SELECT ep, count(*) FILTER (created) AS made, count(*) FILTER (NOT created) AS merged FROM res GROUP BY ep) c ON c.ep = r.ep
 LEFT JOIN (SELECT ep, count(*) FILTER (src IS NOT NULL AND tgt IS NOT NULL) AS made,
            count(*) FILTER (src IS NULL OR tgt IS NULL) AS skipped FROM lnk GROUP BY ep) l ON l.ep = r.ep"""
ENTITIES = "SELECT g AS group_id, uuid, nm AS name, k AS name_lower, summary, label, seq AS first_seq FROM res WHERE created"
MENTIONS = "SELECT g AS group_id, ep AS episode_uuid, pos::BIGINT AS pos, uuid AS entity_uuid FROM res"
_OCCURRENCE = f"SELECT g, ep, pos, lower({strip('nm')}) AS k FROM ({_ORDER_ENTITIES}) WHERE {strip('nm')} <> ''"
# Mentions by the rule itself, without the dictionary: the stored id of a name, else its digest.
ORDER_MENTIONS_FRESH = f"""WITH {ORDER_REQUESTS} SELECT g AS group_id, ep AS episode_uuid, pos::BIGINT AS pos,
 {stable_id("'entity'", 'g', 'k')} AS entity_uuid FROM ({_OCCURRENCE})"""
ORDER_MENTIONS = f"""WITH {ORDER_REQUESTS},
st AS (SELECT g, lower(nm) AS k, min_by(uuid, (created, uuid)) AS uuid FROM ({STORED}) GROUP BY ALL)
SELECT o.g AS group_id, o.ep AS episode_uuid, o.pos::BIGINT AS pos, coalesce(st.uuid, {stable_id("'entity'", 'o.g', 'o.k')}) AS entity_uuid
FROM ({_OCCURRENCE}) o LEFT JOIN st ON st.g = o.g AND st.k = o.k"""
FACTS = f"""SELECT g AS group_id, {stable_id("'fact'", 'ep', 'pos')} AS uuid, src AS source_uuid, tgt AS target_uuid,
 'RELATES_TO' AS rel_type, name, fact, ep AS episode FROM lnk WHERE src IS NOT NULL AND tgt IS NOT NULL"""

# --- text episodes -----------------------------------------------------------
GAZETTEER = f"""terms AS (SELECT DISTINCT array_to_string(list_filter(string_split(trim(s), ' '), lambda w: w <> '')[1:n], ' ') AS name
        FROM (SELECT unnest(string_split_regex(text, '[.!?\\n]+')) AS s FROM benchmark), (SELECT unnest([3, 12]) AS n)),
gaz AS (SELECT gram, min(name) AS name FROM (SELECT name, array_to_string({tokens('name')}, ' ') AS gram FROM terms WHERE name <> '')
        WHERE gram <> '' GROUP BY gram)"""


def extraction(episodes: str, stored: str | None = None) -> str:
    """CTEs down to seen (first place of each name per sentence) and the resolved frames, over (g, ep, seq, content)."""
    entities = "SELECT g, ep, seq, min(sent * 549755813888 + place) AS pos, name AS nm, 'Finding' AS ty, '' AS de FROM seen GROUP BY g, ep, seq, gram, name"
    relations = """SELECT g, ep, seq, sent * 549755813888 + place AS pos, name AS sn, tn, 'relates_to' AS rn, sentence AS fact FROM
        (SELECT *, lead(name) OVER (PARTITION BY g, ep, seq, sent ORDER BY place, gram) AS tn FROM seen) WHERE tn IS NOT NULL"""
    return f"""req AS ({episodes}),
{GAZETTEER},
sen AS (SELECT g, ep, seq, generate_subscripts(parts, 1) - 1 AS sent, unnest(parts) AS raw
        FROM (SELECT *, string_split_regex(content, '[.!?\\n]+') AS parts FROM req)),
tok AS (SELECT g, ep, seq, sent, {strip('raw')} AS sentence, {tokens('raw')} AS toks FROM sen),
pla AS (SELECT *, unnest(range(0, len(toks))) AS i FROM tok WHERE len(toks) > 0),
grm AS (SELECT pla.*, n FROM pla JOIN (SELECT DISTINCT len(string_split(gram, ' ')) AS n FROM gaz) ON i + n <= len(toks)),
seen AS (SELECT g, ep, seq, sent, sentence, gaz.gram, gaz.name, min(i * 4096 + n) AS place
         FROM grm JOIN gaz ON gaz.gram = array_to_string(toks[i + 1:i + n], ' ') GROUP BY ALL),
{resolution(entities, relations, stored)}"""


_DOC_NAME = "'document_analysis: document/' || doc_id"
DOCUMENT_EPISODES = f"""SELECT {graph('client', "'Lang-' || lang")} AS g,
        {stable_id("'episode'", graph('client', "'Lang-' || lang"), 'doc_id', _DOC_NAME)} AS ep, doc_id AS seq,
        CASE WHEN lang = 'en' THEN E'Metadata:\\n  lang: ' || lang || '  chars: ' || n_chars || E'\\n\\n' || text ELSE text END AS content
        FROM documents"""
KNOWN_TERMS = f"""SELECT g, 'known-' || md5(name) AS uuid, name AS nm, TIMESTAMP '2020-01-01' AS created
        FROM terms, (SELECT DISTINCT {graph('client', "'Lang-' || lang")} AS g FROM documents) WHERE name <> ''"""
BOOTSTRAP_EPISODES = f"""SELECT g, {stable_id("'episode'", 'g', "request_seq || '/' || doc_pos", 'name')} AS ep, seq, content, document, request_seq, doc_pos, name, description, valid FROM
        (SELECT {graph('client', "'boot ' || lang")} AS g, doc_id * 2 AS seq, 'bootstrap: doc ' || doc_id AS name, text AS content,
         'doc ' || doc_id AS document, doc_id AS request_seq, 0 AS doc_pos, 'Bootstrap document: ' || source AS description, '2024-03-01 00:00:00' AS valid FROM documents
         UNION ALL SELECT {graph('client', "'boot ' || lang")}, doc_id * 2 + 1, 'bootstrap: unknown', lang, NULL, doc_id, 1,
         'Bootstrap document: general', '2024-06-01 00:00:00' FROM documents)"""
PROMOTED_EPISODES = f"""SELECT {graph('segment', 'type')} AS g, {stable_id("'episode'", graph('segment', 'type'), 'doc_id', "'segment_insight: ' || type")} AS ep,
        doc_id AS seq, draft AS content FROM (SELECT d.doc_id, d.source AS type, {redact('''d.text || coalesce(' paid $' || format('{:,.2f}', o_totalprice)
        || ' on ' || strftime(o_orderdate, '%-m/%-d/%Y') || ' call 555-010-' || lpad((d.doc_id % 10000)::VARCHAR, 4, '0'), '')''')} AS draft
        FROM documents d LEFT JOIN orders ON d.doc_id = o_orderkey JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1)"""
EXTRACTION_COUNTS = """SELECT r.g AS group_id, r.ep AS episode_uuid, coalesce(e.n, 0)::BIGINT AS entities_extracted, coalesce(f.n, 0)::BIGINT AS facts_created
 FROM req r LEFT JOIN (SELECT ep, count(DISTINCT uuid) AS n FROM res GROUP BY ep) e ON e.ep = r.ep
 LEFT JOIN (SELECT ep, count(*) AS n FROM lnk WHERE src IS NOT NULL AND tgt IS NOT NULL GROUP BY ep) f ON f.ep = r.ep"""

# --- search ------------------------------------------------------------------


WHOLE = 10 ** 12   # as a limit: the whole list


def bm25(docs: str, queries: str, k: int) -> str:
    """CTEs down to top(query_id, g, id, score, rank) over (g, id, body) and (query_id, g, body)."""
    return f"""d AS (SELECT g, id, {tokens('body')} AS toks FROM ({docs})),
stats AS (SELECT g, count(*) AS n, avg(len(toks)) AS avgdl FROM d GROUP BY g),
q AS (SELECT DISTINCT query_id, g, unnest({tokens('body')}) AS term FROM ({queries})),
w AS (SELECT d.g, d.id, len(toks) AS dl, unnest(toks) AS term FROM d),
tf AS (SELECT g, id, dl, term, count(*) AS tf FROM w SEMI JOIN q ON q.g = w.g AND q.term = w.term GROUP BY ALL),
df AS (SELECT g, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, tf.g, tf.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
       FROM tf JOIN df ON df.g = tf.g AND df.term = tf.term JOIN stats ON stats.g = tf.g JOIN q ON q.g = tf.g AND q.term = tf.term GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, g ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= {k})"""


CONVERSATION_FACTS = f"""facts AS (SELECT {graph('client', 'role')} AS g, 'turn-' || lpad(conv_id::VARCHAR, 9, '0') || '-' || lpad(turn::VARCHAR, 6, '0') AS id,
        conv_id::VARCHAR AS subject, role AS predicate, turn::VARCHAR AS object, text AS body FROM conversations
        UNION ALL SELECT 'segment_tribal_gaming', 'doc-' || lpad(doc_id::VARCHAR, 9, '0'), source, 'observes', lang, text FROM documents)"""
SEARCH_REQUESTS = """asked AS (SELECT item_id AS query_id, CASE length(text) % 3 WHEN 0 THEN 'client_assistant' WHEN 1 THEN 'client_user' ELSE 'client_nobody' END AS g,
        text AS body, length(text) % 53 AS mr, length(text) % 2 = 0 AS seg FROM benchmark WHERE length(text) % 53 BETWEEN 1 AND 50),
scoped AS (SELECT query_id, 'client' AS scope, g, body, least(mr, 15) AS keep FROM asked
           UNION ALL SELECT query_id, 'segment', 'segment_tribal_gaming', body, 5 FROM asked WHERE seg)"""
SEARCH = f"""WITH {CONVERSATION_FACTS},
{SEARCH_REQUESTS},
{bm25('SELECT g, id, body FROM facts', 'SELECT query_id, g, body FROM scoped', 50)},
hits AS (SELECT top.query_id, scope, top.g, top.id, top.rank, f.subject, f.predicate, f.object, f.body AS fact FROM top
         JOIN scoped s ON s.query_id = top.query_id AND s.g = top.g AND top.rank <= s.keep JOIN facts f ON f.g = top.g AND f.id = top.id)
"""

# --- graph view --------------------------------------------------------------
REGION_GRAPH = f"""cust AS (SELECT {graph('client', 'r_name')} AS g, customer.*, n_nationkey, r_regionkey FROM customer
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
nod AS (SELECT {graph('client', 'r_name')} AS g, r_regionkey::BIGINT AS native, 'location' AS base, '' AS label, NULL AS uuid, 'r' || r_regionkey AS id,
         r_name AS name, NULL AS lbl, NULL AS summary, false AS epi FROM region
        UNION ALL SELECT {graph('client', 'r_name')}, n_nationkey + 100, 'entity', 'department', NULL, NULL, NULL, n_name, NULL, false
         FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT g, c_custkey + 1000, 'entity', CASE c_mktsegment WHEN 'MACHINERY' THEN 'system' WHEN 'HOUSEHOLD' THEN 'household' ELSE '' END,
         'c' || lpad(c_custkey::VARCHAR, 9, '0'), NULL, c_name, NULL, CASE WHEN c_acctbal < 0 THEN 'Payment Problem' ELSE 'Workflow ok' END, false FROM cust
        UNION ALL SELECT g, o_orderkey + 10000000, 'episodic', '', 'o' || o_orderkey, NULL, 'order ' || o_orderkey, NULL, NULL, true
         FROM orders JOIN cust ON o_custkey = c_custkey),
nodes AS (SELECT g, native, coalesce(uuid, id, native::VARCHAR) AS id, coalesce(name, lbl, 'Node ' || native) AS name, epi,
          CASE WHEN label IN ('department', 'system') THEN label WHEN base <> 'entity' THEN base
               WHEN summary ILIKE '%problem%' THEN 'pain_point' WHEN summary ILIKE '%workflow%' THEN 'process' ELSE 'entity' END AS type FROM nod),
edg AS (SELECT g, 'c' || lpad(c_custkey::VARCHAR, 9, '0') AS source, (n_nationkey + 100)::VARCHAR AS target, 'RELATES_TO' AS rel,
         unnest(['owes ' || c_mktsegment, NULL]) AS fact, unnest(['a', 'b']) || lpad(c_custkey::VARCHAR, 9, '0') AS eid FROM cust
        UNION ALL SELECT {graph('client', 'r_name')}, (n_nationkey + 100)::VARCHAR, 'r' || r_regionkey, NULL, 'part of', '0' || lpad(n_nationkey::VARCHAR, 9, '0')
         FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT g, 'o' || o_orderkey, 'c' || lpad(c_custkey::VARCHAR, 9, '0'), 'MENTIONS', NULL, 'm' || lpad(o_orderkey::VARCHAR, 9, '0')
         FROM orders JOIN cust ON o_custkey = c_custkey),
edges AS (SELECT g, source || '-' || coalesce(rel, 'RELATED_TO') || '-' || target AS id, source, target, coalesce(rel, 'RELATED_TO') AS label,
          coalesce(fact, '') AS fact, eid FROM edg)"""


def view(max_nodes: int) -> str:
    return f"""WITH {REGION_GRAPH},
vn AS (SELECT g, id, name, type FROM nodes WHERE NOT epi QUALIFY row_number() OVER (PARTITION BY g ORDER BY id, name, native) <= {max_nodes}),
ve AS (SELECT * FROM edges e SEMI JOIN (SELECT g, id FROM nodes WHERE NOT epi) a ON a.g = e.g AND a.id = e.source),
vf AS (SELECT * FROM ve SEMI JOIN (SELECT g, id FROM nodes WHERE NOT epi) b ON b.g = ve.g AND b.id = ve.target
       QUALIFY row_number() OVER (PARTITION BY ve.g ORDER BY eid) <= {2 * max_nodes}),
vd AS (SELECT * FROM vf QUALIFY row_number() OVER (PARTITION BY g, id ORDER BY eid) = 1),
vx AS (SELECT * FROM vd SEMI JOIN vn s ON s.g = vd.g AND s.id = vd.source),
vy AS (SELECT * FROM vx SEMI JOIN vn t ON t.g = vx.g AND t.id = vx.target)
"""
