"""SQL of the relational reports over the record model, for DuckDB.

Each entry names a query of frames.py and says in SQL what it must return.
"""

from __future__ import annotations

from ..operators import links
from .model import AS_OF, oracle

SQL: dict[str, str] = {}
#: Texts of timestamps and of metadata, some of them wrong, for rows with this number.
STAMPS = "CASE doc_id % 11 WHEN 0 THEN '2024-02-29T12:00:00Z' WHEN 1 THEN '2023-02-29T12:00:00Z' WHEN 2 THEN '1900-02-29T12:00:00.5Z' WHEN 3 THEN '2000-02-29T23:59:59.123456Z' WHEN 4 THEN '2024-04-31T00:00:00Z' WHEN 5 THEN '2024-12-31T24:00:00Z' WHEN 6 THEN '2024-01-01T10:00:00+00:00' WHEN 7 THEN '2024-01-01T10:00:00.Z' WHEN 8 THEN '2024-13-01T10:00:00Z' WHEN 9 THEN '2024-01-0' || CAST(doc_id % 9 AS VARCHAR(20)) || 'T10:00:00.' || CAST(doc_id AS VARCHAR(20)) || 'Z' ELSE '2024-01-01 10:00:00Z' END"
METADATA = "CASE {0} % 19 WHEN 0 THEN '\"text\"' WHEN 1 THEN '{}' WHEN 2 THEN NULL WHEN 3 THEN '{\"a\": }' ELSE '{\"a\": 1}' END"


def add(name: str, sql: str) -> None:
    SQL[name] = sql


# --- scans, projection, filters -------------------------------------------------
# Listing with conjunctive filters over space, silo, kind and status; expired rows are listed.
add("memory_list", "SELECT memory_id, space, silo, kind, status, pinned, round(confidence, 6) AS confidence, substr(content, 1, 80) AS snippet, row_number() OVER (PARTITION BY space ORDER BY updated_at DESC, memory_id) AS rank FROM mem WHERE status = 'active' AND kind IN ('fact', 'decision')")
add("memory_list_observed_desc", "SELECT memory_id, space, row_number() OVER (PARTITION BY space ORDER BY observed_at DESC, memory_id) AS rank FROM mem WHERE status IN ('active', 'superseded')")
# Recall hides what is past valid_to (the day itself still counts) or has expired.
add("memory_recall_visible", f"SELECT memory_id, space, silo FROM mem WHERE status = 'active' AND (valid_to IS NULL OR valid_to >= {AS_OF}) AND (expires_at IS NULL OR expires_at > {AS_OF})")
# Any-match of tags.
add("filter_tags_any", "SELECT m.memory_id, m.kind FROM mem m WHERE EXISTS (SELECT 1 FROM tags t WHERE t.memory_id = m.memory_id AND t.tag IN ('topic:7', 'part:9', 'alias::src4'))")
add("filter_entity_claim_keys", "SELECT memory_id, entity_key, claim_key FROM mem WHERE entity_key IN ('source:src1', 'source:src3') AND claim_key IN ('claim:5', 'claim:50', 'claim:96') OR scope = 'user' AND entity_key IS NULL")
add("projection_privacy", "SELECT memory_id, CASE WHEN scope = 'user' THEN NULL ELSE source END AS source_ref, '' AS snippet, coalesce(nullif(trim(substr(content, 1, 40)), ''), '-') AS retrieval_text FROM mem")
add("point_get", "SELECT m.memory_id, m.status, v.version_num, v.content_sha256, r.text AS representation, (SELECT string_agg(t.tag, ' ' ORDER BY t.tag) FROM tags t WHERE t.memory_id = m.memory_id) AS tags, (SELECT count(*) FROM recall e WHERE e.memory_id = m.memory_id) AS n_events, (SELECT string_agg(CAST(g.edge_id AS VARCHAR), ',' ORDER BY g.edge_id) FROM edges g WHERE g.memory_id = m.memory_id) AS links FROM mem m JOIN versions v ON v.version_id = m.active_version_id AND v.memory_id = m.memory_id LEFT JOIN representations r ON r.version_id = v.version_id")
add("rerank_projection", "SELECT memory_id, substr(content, 1, 512) AS document, length(content) > 512 AS cut FROM mem WHERE status = 'active'")
add("edge_validity", "SELECT edge_id, subject, object FROM edges WHERE status = 'active' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2000-01-01 00:00:00') AND (valid_to IS NULL OR valid_to >= TIMESTAMP '1999-06-01 00:00:00')")
add("edge_support_memory", f"SELECT e.edge_id, e.memory_id FROM edges e WHERE e.status = 'active' AND EXISTS (SELECT 1 FROM mem m WHERE m.memory_id = e.memory_id AND m.status = 'active' AND (m.expires_at IS NULL OR m.expires_at > {AS_OF}))")
add("graph_status_filter", "SELECT entity_type, status, count(*) AS n FROM entities WHERE status <> 'tombstoned' GROUP BY entity_type, status")
add("entity_search_substring", "SELECT entity_id, canonical_name FROM entities WHERE status <> 'tombstoned' AND (instr(lower(canonical_name), '00042') > 0 OR instr(lower(entity_id), 's7') > 0)")

# --- joins ----------------------------------------------------------------------
add("join_header_version_tags", 'SELECT m.memory_id, m.space, v.version_num, t.n_tags FROM mem m JOIN versions v ON v.version_id = m.active_version_id AND v.memory_id = m.memory_id LEFT JOIN (SELECT memory_id, count(*) AS n_tags FROM tags GROUP BY memory_id) t ON t.memory_id = m.memory_id')
add("anti_missing_projection", "SELECT DISTINCT m.space, m.entity_key FROM mem m WHERE m.entity_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT space, entity_key FROM mem WHERE pinned) p WHERE p.space = m.space AND p.entity_key = m.entity_key)")
add("orphan_entities", "SELECT n.entity_id FROM entities n LEFT JOIN (SELECT subject AS id FROM edges WHERE status = 'active' UNION SELECT object FROM edges WHERE status = 'active') e ON e.id = n.entity_id WHERE e.id IS NULL")
add("dangling_edges", "SELECT e.edge_id, a.entity_id IS NULL OR a.status = 'tombstoned' AS bad_subject, b.entity_id IS NULL OR b.status = 'tombstoned' AS bad_object FROM edges e LEFT JOIN entities a ON a.entity_id = e.subject LEFT JOIN entities b ON b.entity_id = e.object WHERE e.status = 'active' AND (a.entity_id IS NULL OR b.entity_id IS NULL OR a.status = 'tombstoned' OR b.status = 'tombstoned')")
add("inactive_evidence_edges", "SELECT e.edge_id, e.memory_id, m.status FROM edges e LEFT JOIN mem m ON m.memory_id = e.memory_id WHERE e.status = 'active' AND (m.memory_id IS NULL OR m.status <> 'active')")
add("incident_edges", "SELECT n.entity_id, x.edge_id, x.rel_type, x.other FROM entities n JOIN (SELECT subject AS id, object AS other, edge_id, rel_type, status FROM edges UNION ALL SELECT object, subject, edge_id, rel_type, status FROM edges) x ON x.id = n.entity_id WHERE x.status = 'active' AND n.status = 'active'")
add("memory_entities", "SELECT DISTINCT e.memory_id, n.entity_id FROM edges e JOIN entities n ON n.entity_id = e.subject UNION SELECT DISTINCT e.memory_id, n.entity_id FROM edges e JOIN entities n ON n.entity_id = e.object")
add("entity_exact_lookup", "SELECT DISTINCT q.q, n.entity_id FROM (SELECT DISTINCT c_name AS q FROM customer WHERE c_acctbal > 5000 UNION SELECT DISTINCT 's' || CAST(s_suppkey AS VARCHAR(20)) FROM supplier) q JOIN (SELECT entity_id, canonical_name AS name FROM entities UNION ALL SELECT entity_id, entity_id FROM entities) n ON n.name = q.q")
add("interval_turn_lookup", "WITH t AS (SELECT conv_id, turn, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS s, length(text) AS n FROM conversations), p AS (SELECT conv_id, 100 * turn AS idx FROM conversations) SELECT p.conv_id, p.idx, t.turn FROM p JOIN t ON p.conv_id = t.conv_id AND p.idx >= t.s AND p.idx < t.s + t.n")
add("cross_space_links", "SELECT a.memory_id AS src, b.memory_id AS dst, a.space AS src_space, b.space AS dst_space FROM mem a JOIN mem b ON a.content_sha256 = b.content_sha256 AND a.memory_id < b.memory_id WHERE a.space <> b.space")

# --- aggregates -----------------------------------------------------------------
add("stats_global", f"SELECT count(*) AS memories, count(*) FILTER (WHERE status = 'active') AS active, count(DISTINCT space) AS spaces, count(DISTINCT silo) AS silos, count(*) FILTER (WHERE entity_key IS NULL) AS missing_entity, count(*) FILTER (WHERE silo = 'short-term') AS short_term, count(*) FILTER (WHERE valid_to < {AS_OF}) AS past_valid_to, count(*) FILTER (WHERE pinned) AS pinned FROM mem")
add("stats_by_status", "SELECT space, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'superseded') AS superseded, count(*) FILTER (WHERE status = 'tombstoned') AS tombstoned, count(*) FILTER (WHERE status = 'expired') AS expired FROM mem GROUP BY space")
add("space_list", "WITH s AS (SELECT DISTINCT space FROM mem UNION SELECT 'empty-space') SELECT s.space, coalesce(c.n, 0) AS memories, coalesce(c.active, 0) AS active, coalesce(e.n, 0) AS episodes FROM s LEFT JOIN (SELECT space, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS active FROM mem GROUP BY space) c ON c.space = s.space LEFT JOIN (SELECT space, count(*) AS n FROM episodes GROUP BY space) e ON e.space = s.space")
add("silo_list", "SELECT space, silo, count(*) AS n, row_number() OVER (PARTITION BY space ORDER BY CASE silo WHEN 'short-term' THEN 0 WHEN 'durable' THEN 1 ELSE 2 END, silo) AS position FROM mem GROUP BY space, silo")
add("health_rollup", f"WITH g AS (SELECT memory_id, count(*) OVER (PARTITION BY space, entity_key, claim_key) AS n FROM mem WHERE status = 'active' AND entity_key IS NOT NULL) SELECT m.space, count(*) FILTER (WHERE m.entity_key IS NULL) AS missing_keys, count(*) FILTER (WHERE g.n > 1) AS in_duplicate_groups, count(*) FILTER (WHERE v.vec_id IS NULL) AS missing_embedding, count(*) FILTER (WHERE r.version_id IS NULL) AS missing_representation, count(*) FILTER (WHERE m.valid_to < {AS_OF}) AS past_valid_to, max(CASE WHEN v.vec_id IS NOT NULL THEN m.updated_at END) AS last_embedding FROM mem m LEFT JOIN g ON g.memory_id = m.memory_id LEFT JOIN embeddings v ON v.vec_id = m.doc_id LEFT JOIN representations r ON r.version_id = m.active_version_id GROUP BY m.space")
add("duplicate_clusters", "SELECT space, content_sha256, count(*) AS n, string_agg(CAST(id AS VARCHAR(20)), ',' ORDER BY id) AS members FROM episodes GROUP BY space, content_sha256 HAVING count(*) > 1")
add("duplicate_cluster_count", "SELECT space, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members FROM (SELECT space, content_sha256, count(*) AS n FROM episodes GROUP BY space, content_sha256 HAVING count(*) > 1) c GROUP BY space")
add("dedupe_proposals", "WITH r AS (SELECT space, content_sha256, memory_id, row_number() OVER (PARTITION BY space, content_sha256 ORDER BY pinned DESC, memory_id) AS k FROM mem WHERE status = 'active'), g AS (SELECT space, content_sha256, max(CASE WHEN k = 1 THEN memory_id END) AS canonical, string_agg(CASE WHEN k > 1 AND k <= 21 THEN memory_id END, ',' ORDER BY memory_id) AS duplicates, count(*) AS n FROM r GROUP BY space, content_sha256) SELECT * FROM g WHERE n > 1")
add("promotion_candidates", "SELECT e.id, e.source_path, count(*) AS hits, count(DISTINCT r.query) AS queries, max(r.ts) AS last_hit FROM recall r JOIN episodes e ON e.id = r.episode_id GROUP BY e.id, e.source_path HAVING count(*) >= 3 AND count(DISTINCT r.query) >= 2")
add("silo_promotion", "SELECT m.memory_id, c.sessions FROM mem m JOIN (SELECT memory_id, count(DISTINCT session_id) AS sessions FROM recall WHERE session_id IS NOT NULL AND score >= 0.5 AND rank <= 3 GROUP BY memory_id) c ON c.memory_id = m.memory_id WHERE c.sessions >= 3 AND m.silo = 'short-term' AND m.status = 'active'")
add("tag_discriminativeness", "SELECT space, tag, count(DISTINCT memory_id) AS df FROM tags GROUP BY space, tag HAVING count(DISTINCT memory_id) <= 25")
# Links by shared tags, said in lists: a record's telling tags, and what two records have in common.
NOISE = ", ".join(f"'{t}'" for t in links.NOISE)
SHARED = f"""WITH told AS (SELECT DISTINCT space, memory_id, entity_key, tag FROM tags WHERE status = 'active' AND coalesce(trim(entity_key), '') <> '' AND NOT regexp_matches(lower(tag), '^(session:|proposal-kind-)') AND lower(tag) NOT IN ({NOISE})),
few AS (SELECT *, count(*) OVER (PARTITION BY space, tag) AS n FROM told), sets AS (SELECT memory_id, any_value(space) AS space, any_value(entity_key) AS entity_key, list(tag) AS tags FROM few WHERE n <= 25 GROUP BY memory_id),
found AS (SELECT a.memory_id AS src, b.memory_id AS dst, list_sort(list_intersect(a.tags, b.tags)) AS tags, a.entity_key AS e1, b.entity_key AS e2, a.space AS space FROM sets a JOIN sets b ON a.space = b.space AND a.memory_id < b.memory_id AND a.entity_key <> b.entity_key AND len(list_intersect(a.tags, b.tags)) > 1) """
add("tag_link_candidates", SHARED + "SELECT src, dst, len(tags) AS shared, array_to_string(tags, ',') AS tags, round(len(tags) / (1 + len(tags)), 6) AS confidence FROM found")
add("tag_link_new_only", SHARED + ", known AS (SELECT memory_id AS x, 'mem_' || lpad(CAST(edge_id % 997 AS VARCHAR), 9, '0') AS y FROM edges) SELECT src, dst FROM found WHERE (src, dst) NOT IN (SELECT x, y FROM known) AND (dst, src) NOT IN (SELECT x, y FROM known)")
add("link_edge_aggregation", SHARED + "SELECT least(e1, e2) AS subject, greatest(e1, e2) AS object, min(src) AS src, min(dst) AS dst, count(*) AS evidence, round(count(*) / (1.0 + count(*)), 6) AS confidence FROM found GROUP BY ALL")
add("edge_weights", "SELECT subject, object, count(*) AS weight FROM edges WHERE status = 'active' GROUP BY subject, object")
add("graph_full_nodes", "SELECT n.entity_id, n.canonical_name, CAST(sum(w.weight) AS BIGINT) AS degree FROM entities n JOIN (SELECT subject AS id, count(*) AS weight FROM edges WHERE status = 'active' GROUP BY subject UNION ALL SELECT object, count(*) FROM edges WHERE status = 'active' GROUP BY object) w ON w.id = n.entity_id WHERE n.status = 'active' GROUP BY n.entity_id, n.canonical_name")
add("graph_top_degree", "WITH d AS (SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM edges UNION ALL SELECT object FROM edges) x GROUP BY id), t AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY degree DESC, id) AS k FROM d) r WHERE k <= 300) SELECT e.subject, e.object, count(*) AS n FROM edges e JOIN t a ON a.id = e.subject JOIN t b ON b.id = e.object GROUP BY e.subject, e.object")
add("usage_rollup", "SELECT event_type AS model, user_id % 3 AS operation, count(*) AS calls, CAST(sum(rank) AS BIGINT) AS items, round(sum(value), 2) AS latency, count(*) FILTER (WHERE value < 1) AS failures, count(*) FILTER (WHERE value >= 1) AS successes FROM (SELECT e.*, event_id % 10 AS rank FROM events e) u GROUP BY event_type, user_id % 3")
add("retrieval_metrics", "WITH h AS (SELECT event_type AS category, user_id AS question, min(CASE WHEN value > 100 THEN event_id % 20 + 1 END) AS first_hit, count(*) FILTER (WHERE value > 100 AND event_id % 20 < 10) AS found, count(*) FILTER (WHERE value > 100) AS relevant FROM events GROUP BY event_type, user_id) SELECT coalesce(category, 'overall') AS category, count(*) AS questions, round(avg(CASE WHEN first_hit <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10, round(avg(CASE WHEN first_hit IS NULL THEN 0.0 ELSE 1.0 / first_hit END), 6) AS mrr, round(avg(CASE WHEN relevant = 0 THEN 0.0 ELSE found / (relevant * 1.0) END), 6) AS recall_at_10 FROM h GROUP BY GROUPING SETS ((), (category))")
add("percentile_nearest_rank", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN value END) AS p50, max(CASE WHEN i = floor(0.95 * (n - 1) + 0.5) THEN value END) AS p95, max(n) AS n FROM r GROUP BY event_type")
add("recall_log_touch", "SELECT memory_id, count(*) AS events, count(*) FILTER (WHERE kind = 'retrieved') AS retrieved, max(CASE WHEN kind = 'retrieved' THEN ts END) AS accessed_at FROM recall GROUP BY memory_id")
add("document_retrieval_log", "SELECT query, sha256(query) AS query_sha256, count(*) AS n, min(rank) AS best_rank FROM recall GROUP BY query")
add("latest_run", "SELECT event_type, max(ts) AS started_at FROM events WHERE value >= 1 GROUP BY event_type")
add("history_counts", "SELECT r.memory_id, count(*) AS n, count(*) > 50 AS truncated, min(r.ts) AS first_ts, max(r.ts) AS last_ts FROM recall r JOIN mem m ON m.memory_id = r.memory_id GROUP BY r.memory_id")
add("page_totals", "SELECT space, count(*) AS total, CAST(max(rn) AS BIGINT) AS last_rank, max(rn) > 10 AS truncated FROM (SELECT space, row_number() OVER (PARTITION BY space ORDER BY updated_at DESC, memory_id) AS rn FROM mem) r GROUP BY space")
add("entity_memories_top", "SELECT entity_key, memory_id, rn FROM (SELECT entity_key, memory_id, row_number() OVER (PARTITION BY entity_key ORDER BY pinned DESC, observed_at DESC, updated_at DESC, memory_id) AS rn FROM mem WHERE status = 'active' AND entity_key IS NOT NULL) r WHERE rn <= 5")

# --- lifecycle ------------------------------------------------------------------
add("expire_job", f"SELECT memory_id, 'expired' AS new_status, expires_at FROM mem WHERE status = 'active' AND NOT pinned AND expires_at <= {AS_OF}")
add("promote_job", "SELECT m.memory_id, 'durable' AS new_silo, CAST(NULL AS VARCHAR(20)) AS new_expires_at FROM mem m WHERE m.silo = 'short-term' AND m.status = 'active' AND 3 <= (SELECT count(DISTINCT r.session_id) FROM recall r WHERE r.memory_id = m.memory_id AND r.session_id IS NOT NULL AND r.score >= 0.5 AND r.rank <= 3)")
add("forget_transition", "SELECT m.memory_id, m.status AS old_status, 'tombstoned' AS new_status FROM mem m JOIN (SELECT DISTINCT memory_id FROM recall WHERE kind = 'retrieved') f ON f.memory_id = m.memory_id WHERE m.status <> 'tombstoned'")
add("document_prune", "SELECT id, space FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.id AND l.toxic = 1)")
add("mark_extracted", "SELECT e.id, CASE WHEN l.doc_id IS NOT NULL THEN 'extracted' ELSE 'pending' END AS ingest_status FROM episodes e LEFT JOIN labels l ON l.doc_id = e.id")
add("document_get", "SELECT source_path, id, chunk_index, chunk_count, length(content) AS n FROM episodes")
add("ingest_identity", "WITH b AS (SELECT id, space, content_sha256, source_path, row_number() OVER (PARTITION BY space, content_sha256, source_path ORDER BY id) AS k, max(id) OVER (PARTITION BY space, content_sha256, source_path) AS last_id FROM episodes) SELECT id, CASE WHEN k = 1 THEN 'inserted' ELSE 'skipped' END AS outcome, last_id AS provenance FROM b")
add("candidate_queue", "WITH s AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY user_id), d AS (SELECT e.user_id, e.ts, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS k, CASE WHEN event_type = 'error' THEN 'quarantined' WHEN value >= 100 THEN 'approved' ELSE 'rejected' END AS v FROM events e JOIN s ON s.user_id = e.user_id AND e.ts >= s.t0 WHERE e.event_type <> 'signup' AND (event_type = 'error' OR value >= 100 OR value < 5)) SELECT s.user_id AS candidate_id, coalesce(d.v, 'pending') AS status, d.ts AS decided_at FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.k = 1")
add("entity_upsert", "SELECT coalesce(n.k, o.k) AS entity_key, coalesce(n.name, o.name) AS canonical_name, coalesce(n.seg, o.seg) AS entity_type FROM (SELECT c_nationkey AS k, max(c_name) AS name, CAST(NULL AS VARCHAR(20)) AS seg FROM customer GROUP BY c_nationkey) n FULL OUTER JOIN (SELECT n_nationkey + 3 AS k, n_name AS name, 'Nation' AS seg FROM nation) o ON o.k = n.k")
add("relationship_upsert", "SELECT subject, rel_type, object, memory_id, edge_id FROM (SELECT subject, rel_type, object, memory_id, edge_id, row_number() OVER (PARTITION BY subject, rel_type, object, memory_id ORDER BY edge_id) AS k FROM edges) r WHERE k = 1")
add("entity_merge", "WITH r AS (SELECT edge_id, CASE WHEN object = 's1' THEN 's0' ELSE object END AS object, subject, rel_type, CASE WHEN object = 's1' THEN 1 ELSE 0 END AS moved FROM edges WHERE status = 'active'), k AS (SELECT *, row_number() OVER (PARTITION BY subject, rel_type, object ORDER BY moved, edge_id) AS n FROM r WHERE subject <> object) SELECT edge_id, subject, rel_type, object, CASE WHEN n > 1 AND moved = 1 THEN 'tombstoned' ELSE 'active' END AS status FROM k WHERE object = 's0'")
add("verify_freshness", "SELECT memory_id, CASE WHEN silo = 'durable' THEN NULL WHEN doc_id % 4 = 0 THEN NULL WHEN updated_at >= TIMESTAMP '2024-01-20 00:00:00' THEN 'fresh' ELSE 'verify' END AS freshness FROM mem")

# --- integrity ------------------------------------------------------------------
add("integrity_active_version", 'SELECT memory_id, active_version_id FROM mem m WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.version_id = m.active_version_id AND v.memory_id = m.memory_id)')
add("integrity_hash", "WITH w AS (SELECT version_id, concat_ws(',', CASE WHEN regexp_full_match(content, ' *') THEN 'blank' END, CASE WHEN length(content) > 131072 THEN 'content' END, CASE WHEN content_sha256 <> sha256(content) THEN 'hash' END, CASE WHEN source_ref_json IS NOT NULL AND (length(source_ref_json) > 32768 OR CASE WHEN json_valid(source_ref_json) THEN json_type(source_ref_json) ELSE '' END <> 'OBJECT') THEN 'source' END, CASE WHEN length(summary) > 8192 THEN 'summary' END) AS broken FROM versions) SELECT version_id, broken FROM w WHERE broken <> ''")
add("integrity_episode_bounds", 'WITH e AS (SELECT id, CASE WHEN id % 17 = 0 THEN chunk_count ELSE chunk_index END AS chunk_index, chunk_count, content, CASE WHEN id % 13 = 0 THEN \'x\' || content_sha256 ELSE content_sha256 END AS content_sha256, CASE id % 19 WHEN 0 THEN \'"text"\' WHEN 1 THEN \'{}\' WHEN 2 THEN NULL WHEN 3 THEN \'{"a": }\' ELSE \'{"a": 1}\' END AS m FROM episodes), w AS (SELECT id, concat_ws(\',\', CASE WHEN chunk_index < 0 OR chunk_index >= chunk_count THEN \'chunk\' END, CASE WHEN length(content) > 131072 THEN \'content\' END, CASE WHEN sha256(content) <> content_sha256 THEN \'hash\' END, CASE WHEN m IS NOT NULL AND CASE WHEN json_valid(m) THEN json_type(m) ELSE \'\' END <> \'OBJECT\' THEN \'metadata\' END) AS broken FROM e) SELECT id, broken FROM w WHERE broken <> \'\'')
add("integrity_memories", 'WITH m AS (SELECT memory_id, CASE WHEN doc_id % 47 = 0 THEN \'lost\' ELSE status END AS status, CASE WHEN doc_id % 61 = 0 THEN 1.5 ELSE confidence END AS confidence, observed_at, CASE WHEN doc_id % 67 = 0 THEN observed_at ELSE expires_at END AS expires_at, CASE doc_id % 11 WHEN 0 THEN \'2024-02-29T12:00:00Z\' WHEN 1 THEN \'2023-02-29T12:00:00Z\' WHEN 2 THEN \'1900-02-29T12:00:00.5Z\' WHEN 3 THEN \'2000-02-29T23:59:59.123456Z\' WHEN 4 THEN \'2024-04-31T00:00:00Z\' WHEN 5 THEN \'2024-12-31T24:00:00Z\' WHEN 6 THEN \'2024-01-01T10:00:00+00:00\' WHEN 7 THEN \'2024-01-01T10:00:00.Z\' WHEN 8 THEN \'2024-13-01T10:00:00Z\' WHEN 9 THEN \'2024-01-0\' || CAST(doc_id % 9 AS VARCHAR(20)) || \'T10:00:00.\' || CAST(doc_id AS VARCHAR(20)) || \'Z\' ELSE \'2024-01-01 10:00:00Z\' END AS ts, CASE doc_id % 19 WHEN 0 THEN \'"text"\' WHEN 1 THEN \'{}\' WHEN 2 THEN NULL WHEN 3 THEN \'{"a": }\' ELSE \'{"a": 1}\' END AS j FROM mem), w AS (SELECT memory_id, concat_ws(\',\', CASE WHEN confidence < 0 OR confidence > 1 THEN \'confidence\' END, CASE WHEN expires_at <= observed_at THEN \'expiry\' END, CASE WHEN j IS NOT NULL AND CASE WHEN json_valid(j) THEN json_type(j) ELSE \'\' END <> \'OBJECT\' THEN \'metadata\' END, CASE WHEN NOT (regexp_full_match(ts, \'[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?Z\') AND try_cast(left(ts, 10) AS DATE) IS NOT NULL) THEN \'observed\' END, CASE WHEN status NOT IN (\'active\', \'superseded\', \'expired\', \'tombstoned\', \'quarantined\') THEN \'status\' END) AS broken FROM m) SELECT memory_id, broken FROM w WHERE broken <> \'\'')
add("integrity_tags", "WITH t AS (SELECT memory_id, CASE WHEN tag LIKE 'topic:%3' THEN tag || ' ' ELSE tag END AS tag FROM tags UNION ALL SELECT memory_id, tag FROM tags WHERE tag LIKE 'part:%7'), w AS (SELECT memory_id, count(*) AS n, concat_ws(',', CASE WHEN bool_or(tag = '' OR tag <> trim(tag) OR length(tag) > 256) THEN 'form' END, CASE WHEN count(*) > 64 THEN 'many' END, CASE WHEN count(*) > count(DISTINCT tag) THEN 'repeated' END) AS broken FROM t GROUP BY memory_id) SELECT memory_id, n, broken FROM w WHERE broken <> ''")
# Companion texts whose version is missing or whose hash is another's.
add("integrity_representations", "WITH w AS (SELECT r.version_id, concat_ws(',', CASE WHEN sha256(r.text) <> r.text_sha256 THEN 'hash' END, CASE WHEN v.version_id IS NULL THEN 'no_version' END) AS broken FROM representations r LEFT JOIN versions v ON v.version_id = r.version_id) SELECT version_id, broken FROM w WHERE broken <> ''")
add("integrity_spaces", "SELECT s.space, max(CASE WHEN s.silo = 'durable' THEN 1 ELSE 0 END) = 1 AS has_default_silo, count(DISTINCT s.silo) AS silos FROM mem s GROUP BY s.space")
add("integrity_timestamp_grammar", "WITH e AS (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN '2024-02-29T12:00:00Z' WHEN 1 THEN '2023-02-29T12:00:00Z' WHEN 2 THEN '1900-02-29T12:00:00.5Z' WHEN 3 THEN '2000-02-29T23:59:59.123456Z' WHEN 4 THEN '2024-04-31T00:00:00Z' WHEN 5 THEN '2024-12-31T24:00:00Z' WHEN 6 THEN '2024-01-01T10:00:00+00:00' WHEN 7 THEN '2024-01-01T10:00:00.Z' WHEN 8 THEN '2024-13-01T10:00:00Z' WHEN 9 THEN '2024-01-0' || CAST(doc_id % 9 AS VARCHAR(20)) || 'T10:00:00.' || CAST(doc_id AS VARCHAR(20)) || 'Z' ELSE '2024-01-01 10:00:00Z' END AS ts FROM documents) SELECT doc_id, ts, (regexp_full_match(ts, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?Z') AND try_cast(left(ts, 10) AS DATE) IS NOT NULL) AS ok, CASE WHEN (regexp_full_match(ts, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?Z') AND try_cast(left(ts, 10) AS DATE) IS NOT NULL) THEN left(ts, 19) || '.' || rpad(left(regexp_extract(ts, '[.]([0-9]+)Z', 1), 3), 3, '0') || 'Z' END AS normal FROM e")

# --- evaluation harness ---------------------------------------------------------
add("eval_running_offsets", "SELECT conv_id, turn, CAST(s - n - 1 AS BIGINT) AS start, CAST(s - 1 AS BIGINT) AS stop FROM (SELECT conv_id, turn, length(text) AS n, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) x")
add("eval_context_card", "SELECT conv_id, turn, substr(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn) || ' ', '') || text, 1, 512) AS card FROM conversations")
add("eval_event_time", "SELECT conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' DAY + turn * INTERVAL '1' SECOND AS at FROM conversations")
add("eval_turn_text", "SELECT conv_id, turn, role || ': ' || text || CASE WHEN turn % 3 = 0 THEN ' [turn ' || CAST(turn AS VARCHAR(20)) || ']' ELSE '' END AS turn_text FROM conversations")
add("eval_unambiguous_aliases", "SELECT alias, min(entity) AS entity FROM (SELECT lower(trim(s_name)) AS alias, s_suppkey AS entity FROM supplier UNION ALL SELECT 'alias ' || CAST(s_suppkey * s_suppkey % 90 AS VARCHAR), s_suppkey FROM supplier) x GROUP BY alias HAVING min(entity) = max(entity)")
add("eval_sample_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS k, dense_rank() OVER (ORDER BY conv_id) AS s FROM conversations WHERE role <> 'system') x WHERE s <= 50 AND k <= 200")
add("eval_leak_scan", "SELECT conv_id, turn, instr(text, '[source]') > 0 OR instr(text, 'private/') > 0 OR instr(text, 'example.com') > 0 AS leaks FROM conversations")
add("token_estimate", "SELECT space, CAST(sum(floor((length(content) + 3) / 4)) AS BIGINT) AS tokens, max(length(content)) AS longest FROM mem GROUP BY space")

# --- further projections, joins and checks ---------------------------------------
# Companion text and content as one document text.
add("composite_document_text", "SELECT memory_id, CASE WHEN entity_key IS NULL OR trim(entity_key) = '' THEN content ELSE entity_key || chr(10) || chr(10) || content END AS document FROM mem WHERE status = 'active'")
# A prompt becomes a query if it has 20 bytes; 500 characters of it.
add("hook_query", "SELECT conv_id, turn, substr(text, 1, 500) AS q FROM conversations WHERE role = 'user' AND strlen(text) >= 20")
add("external_ranking_join", "SELECT v.id AS memory_id, v.distance, m.kind FROM (SELECT memory_id AS id, round(score, 6) AS distance, row_number() OVER (PARTITION BY memory_id ORDER BY event_id) AS k FROM recall) v JOIN mem m ON m.memory_id = v.id WHERE v.k = 1 AND m.status = 'active'")
add("admissions_per_candidate", "SELECT memory_id, count(DISTINCT query) AS queries, string_agg(DISTINCT_KIND, ',' ORDER BY DISTINCT_KIND) AS sources, min(best) AS best_rank FROM (SELECT memory_id, query, kind AS DISTINCT_KIND, min(rank) AS best FROM recall GROUP BY memory_id, query, kind) a GROUP BY memory_id")
add("graph_link_proposals", SHARED + "SELECT e1 AS subject, e2 AS object, min(src) AS src, count(*) AS evidence FROM found WHERE (space, e1) NOT IN (SELECT space, entity_key FROM mem WHERE pinned AND entity_key IS NOT NULL) GROUP BY e1, e2")
add("contradiction_links", "SELECT a.memory_id AS src, b.memory_id AS dst, 'contradicts' AS link_type FROM mem a JOIN mem b ON a.space = b.space AND a.entity_key = b.entity_key AND a.claim_key = b.claim_key AND a.kind = b.kind WHERE a.memory_id > b.memory_id AND a.content_sha256 <> b.content_sha256 AND a.status = 'active' AND b.status = 'active'")
add("write_candidates_entity_kind", "WITH m AS (SELECT * FROM mem WHERE status = 'active' AND entity_key IS NOT NULL), g AS (SELECT space, entity_key, kind, list_sort(list(memory_id)) AS ids FROM m GROUP BY ALL), x AS (SELECT m.memory_id AS id, list_filter(g.ids[1:6], lambda o: o <> m.memory_id)[1:5] AS o FROM m JOIN g USING (space, entity_key, kind)) SELECT id, unnest(o) AS other, CAST(unnest(range(1, len(o) + 1)) AS BIGINT) AS k FROM x")
add("integrity_version_text", "SELECT memory_id, length(trim(content)) > 0 AS filled, length(content) <= 131072 AS bounded, length(content_sha256) = 64 AS hashed FROM mem")
add("integrity_cross_space_edges", "SELECT e.edge_id, m.space, c.n_regionkey FROM edges e JOIN mem m ON m.memory_id = e.memory_id JOIN customer x ON 'c' || CAST(x.c_custkey AS VARCHAR(20)) = e.subject JOIN nation c ON c.n_nationkey = x.c_nationkey WHERE e.status = 'active' AND (m.space = 'en' AND c.n_regionkey <> 1 OR m.space = 'fr' AND c.n_regionkey <> 3)")
add("integrity_duplicate_keys", "SELECT subject, rel_type, object, memory_id, count(*) AS n FROM edges GROUP BY subject, rel_type, object, memory_id HAVING count(*) > 1")
add("memory_list_created_desc", "SELECT memory_id, silo, rn FROM (SELECT memory_id, silo, row_number() OVER (PARTITION BY silo ORDER BY observed_at DESC, memory_id) AS rn FROM mem WHERE status IN ('active', 'superseded', 'tombstoned')) r WHERE rn <= 100")
add("space_isolation", "SELECT space, count(*) AS n, count(*) FILTER (WHERE scope = 'workspace') AS workspace FROM mem WHERE space IN ('en', 'de') GROUP BY space")
add("weighted_degree", "SELECT id, round(sum(w), 4) AS degree FROM (SELECT subject AS id, confidence AS w FROM edges WHERE status = 'active' UNION ALL SELECT object, confidence FROM edges WHERE status = 'active') x GROUP BY id")
add("budget_use_by_category", "SELECT coalesce(lang, 'overall') AS lang, count(*) AS packs, round(avg(least(n_chars, 8000) / 8000.0), 6) AS used, count(*) FILTER (WHERE n_chars > 8000) AS truncated FROM documents GROUP BY GROUPING SETS ((), (lang))")
add("ingest_chunk_positions", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) - n_chars AS BIGINT) AS start FROM documents")
add("page_ingest_text", "SELECT page_id, length(html) AS raw_chars, instr(html, '<title>') > 0 AS has_title, strlen(url) AS url_bytes FROM pages")

ORACLES = {name: oracle(sql) for name, sql in SQL.items()}
