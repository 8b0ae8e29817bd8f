"""The same results as SQL for DuckDB, for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FINITE = "len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: crc32 of a list of bytes, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bytes}),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(1, 9)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"""
_BYTES = "list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(1 + 2 * i AS INTEGER), 2) AS BIGINT))"
_CRC_OF = lambda text: _CRC.format(bytes=_BYTES.format(text=text))

ORACLES = {
    "op1_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT DISTINCT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(reached) AS c FROM r GROUP BY 1) m ON m.node = d.doc_id""",
    "op2_top_k": f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE})
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) AS rank
            FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0) WHERE rank <= 5""",
    "op3_embedding_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
        u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM v WHERE list_dot_product(v, v) > 0),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98),
        r AS (SELECT DISTINCT a AS node, a AS reached FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
        SELECT d.vec_id, coalesce(l.n, 0) AS n_links, coalesce(m.c, d.vec_id) AS component_id, d.vec_id = coalesce(m.c, d.vec_id) AS kept
        FROM embeddings d LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) l ON l.a = d.vec_id LEFT JOIN (SELECT node, min(reached) AS c FROM r GROUP BY 1) m ON m.node = d.vec_id""",
    "op6_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS win FROM w WHERE len(w) >= 35),
        r AS (SELECT doc_id, p FROM s WHERE win IN (SELECT win FROM s GROUP BY 1 HAVING count(*) > 1)),
        a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
        c AS (SELECT a.doc_id, a.p, a.word, coalesce(max(CASE WHEN r.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY a.doc_id ORDER BY a.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone FROM a LEFT JOIN r ON r.doc_id = a.doc_id AND r.p = a.p)
        SELECT d.doc_id, count(c.p) AS n_words, CAST(coalesce(sum(c.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.p) FILTER (c.gone = 0), '')) AS kept_sha256
        FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op12_prefix_trie": f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY i) AS turns FROM t GROUP BY c),
        h AS (SELECT *, {_CRC_OF("CAST(c AS VARCHAR)")} % 9 AS h FROM s),
        r AS (SELECT h.c, list_concat(coalesce(b.turns[1:CAST(h.h AS INTEGER)], []), h.turns[CAST(h.h AS INTEGER) + 1:]) AS q FROM h LEFT JOIN s b ON b.c = h.c - h.c % 5),
        m AS (SELECT c, d, len(q) = d AS ends, CAST(q[1:d] AS VARCHAR) || sha256(to_json(q[1:d])) AS node, CASE WHEN d > 0 THEN CAST(q[1:d - 1] AS VARCHAR) || sha256(to_json(q[1:d - 1])) END AS up, octet_length(encode(coalesce(q[d].text, ''))) AS bytes FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM r)),
        n AS (SELECT node, any_value(up) AS up, CAST(any_value(d) AS BIGINT) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY node),
        k AS (SELECT up, count(*) AS n FROM n GROUP BY up),
        a AS (SELECT DISTINCT x.node AS below, y.node AS node FROM m x JOIN m y ON x.c = y.c AND x.d >= y.d),
        u AS (SELECT a.node, count(*) FILTER (k.n IS NULL) AS leaves, sum(b.own) AS saved FROM a JOIN n b ON b.node = a.below LEFT JOIN k ON k.up = b.node GROUP BY a.node)
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n LEFT JOIN n p ON p.node = n.up LEFT JOIN k ON k.up = n.node JOIN u ON u.node = n.node""",
    "op13_importance_resampling": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
        e AS (SELECT doc_id, unnest(w) AS word FROM w),
        v AS (SELECT word, {_CRC_OF("word")} % 10000 AS bucket FROM (SELECT word FROM e UNION SELECT word FROM b)),
        s AS (SELECT bucket, count(*) AS n FROM e JOIN v USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM b JOIN v USING (word) GROUP BY bucket),
        g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM e) + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM b) + 10000) AS DOUBLE))) AS BIGINT) AS gain
              FROM s FULL JOIN t USING (bucket)),
        x AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM e JOIN v USING (word) JOIN g USING (bucket) GROUP BY doc_id),
        y AS (SELECT w.doc_id, len(w.w) AS n_features, coalesce(x.weight, 0) AS weight, coalesce(x.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(w.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w LEFT JOIN x ON x.doc_id = w.doc_id),
        z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= 20)
        SELECT y.doc_id, y.n_features, y.weight, y.score, CASE WHEN z.rank <= (SELECT count(*) FROM z) * 10 // 100 THEN z.rank END AS rank FROM y LEFT JOIN z ON z.doc_id = y.doc_id""",
}
