"""Oracle SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _words(text: str) -> str:
    return _WORDS.format(_LOWER.format(text))


ORACLE = {
    "op2_decontaminate": f"""
        WITH d AS (SELECT doc_id, coalesce({_words("text")}, []) AS w FROM documents),
        b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
                FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        occ AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
               FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        hit AS (SELECT occ.doc_id, occ.i, occ.k, win.item_id FROM occ JOIN win ON occ.s = win.s AND occ.k = win.k),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id::varchar AS t FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(covered.n, 0)::bigint AS n_hit, coalesce(items.n, 0)::bigint AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM d JOIN g USING (t)""",
    "op5_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m
              FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
        r AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
        n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
        g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n),
        s AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, k),
        e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
        p AS (SELECT doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS front,
                     max(b) AS b, sum(b - a) AS removed, count(*) AS spans
              FROM e JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT d.doc_id, (len(h) // 2)::bigint AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(spans, 0)::bigint AS n_spans,
               sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN p USING (doc_id)""",
    "op8_chat": """
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        m AS (SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 10
                        ELSE 19 + length(regexp_replace(role, '([\\\\\\[<])', '\\\\\\1', 'g')) END
                     + length(regexp_replace(t, '([\\\\\\[<])', '\\\\\\1', 'g')) AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
               sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(chars))::bigint AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h)::bigint AS n, sha256(h) AS s FROM p),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY s) ELSE page_id END AS first_id FROM q)
        SELECT page_id, n AS payload_bytes, s AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op11_prefix_trie": """
        WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
        bits AS (SELECT c, list_transform(range(0, 8 * length(c::varchar)),
                                          lambda j: (ord(substr(c::varchar, (j // 8 + 1)::int, 1)) >> (j % 8)::int) & 1) AS b FROM (SELECT DISTINCT c FROM o)),
        h AS (SELECT c, c - c % 100 AS base, xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], b::bigint[]),
                lambda s, x: xor(s >> 1, CASE WHEN xor(s, x) & 1 = 1 THEN 3988292384::bigint ELSE 0::bigint END))) % 6 AS h FROM bits),
        r AS (SELECT h.c, 0 AS part, o.i, o.r, o.t FROM h JOIN o ON o.c = h.base AND o.i < h.h
              UNION ALL SELECT o.c, 1, o.i, o.r, o.t FROM h JOIN o ON o.c = h.c AND o.i >= h.h),
        q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, length(r) || ':' || r || sha256(t) AS k, length(t) AS n FROM r),
        p AS (SELECT c, d, n, sha256(string_agg(k, '|') OVER (PARTITION BY c ORDER BY d)) AS x FROM q
              UNION ALL SELECT c, 0, 0, 'root' FROM h),
        len AS (SELECT c, max(d) AS l FROM p GROUP BY c),
        up AS (SELECT DISTINCT a.x, a.d, b.x AS above FROM p a LEFT JOIN p b ON b.c = a.c AND b.d = a.d - 1),
        node AS (SELECT x, d, min(c) AS low, count(*) AS m, any_value(n) AS n FROM p GROUP BY x, d),
        kids AS (SELECT above AS x, count(*) AS k FROM up GROUP BY above),
        val AS (SELECT node.x, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf, (m - 1) * n AS saved FROM node LEFT JOIN kids USING (x)),
        below AS (SELECT DISTINCT a.x, b.x AS y FROM p a JOIN p b ON b.c = a.c AND b.d >= a.d),
        total AS (SELECT below.x, sum(leaf) AS leaves, sum(saved) AS saved FROM below JOIN val ON val.x = y GROUP BY below.x),
        ends AS (SELECT x, string_agg(c::varchar, ',' ORDER BY c) AS ids FROM p JOIN len USING (c) WHERE d = l GROUP BY x)
        SELECT node.low AS conv_id, node.d::bigint AS depth, a.low AS parent_conv_id, node.m AS n_convs, coalesce(k, 0)::bigint AS n_children,
               leaves::bigint AS n_leaves, saved::bigint AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM node JOIN up USING (x) LEFT JOIN node a ON a.x = up.above LEFT JOIN kids ON kids.x = node.x
        JOIN total ON total.x = node.x LEFT JOIN ends ON ends.x = node.x""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::double)) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.q, b.q)::bigint AS score
              FROM v a, v b WHERE a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
        p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
        n AS (SELECT p.a, p.b AS pos, p.score AS ps, s.b AS neg, s.score AS ns,
                     row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
              FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT a AS anchor_id, pos AS positive_id, r::int AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score
        FROM n WHERE r <= 3""",
    "op12_minhash": f"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS t
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, edge.b FROM reach JOIN edge ON edge.a = reach.y),
        comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
