"""DuckDB SQL for the operators whose result it can express. Written apart from the Spark plans."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

#: CRC-32 of a short ASCII text, byte by byte and bit by bit.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(str_split({0}, ''), lambda x: ascii(x)::BIGINT)),
    lambda sum, byte: list_reduce(list_concat([xor(sum, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda bits, zero: CASE WHEN bits & 1 = 1 THEN xor(bits >> 1, 3988292384::BIGINT) ELSE bits >> 1 END)))"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Shingle sets meet on their shingles; a component is what links reach.
JACCARD_JOIN = f"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(words[s : s + 3], ' ') AS shingle
    FROM split, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS r(s) WHERE len(words) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) c USING (doc_id)
"""

#: Every window of every item, of 13 words or fewer, is looked up among the documents' runs of as many words.
DECONTAMINATION = f"""
WITH split AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(words), 13) AS width, array_to_string(words[s : s + least(len(words), 13) - 1], ' ') AS run
    FROM items, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS r(s) WHERE len(words) > 0
),
runs AS (
    SELECT doc_id, s, width, array_to_string(words[s : s + width - 1], ' ') AS run
    FROM split, (SELECT DISTINCT width FROM windows) w, unnest(range(1, len(words) - width + 2)) AS r(s)
),
found AS (SELECT r.doc_id, r.s, r.width, w.item_id FROM runs r JOIN windows w ON w.width = r.width AND w.run = r.run),
hit_words AS (SELECT DISTINCT doc_id, unnest(range(s - 1, s - 1 + width)) AS place FROM found),
hits AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
stretches AS (
    SELECT doc_id, min(place) AS a, max(place) + 1 AS z
    FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island FROM hit_words) i GROUP BY doc_id, island
),
spans AS (SELECT doc_id, string_agg(a || ':' || z, ',' ORDER BY a) AS spans FROM stretches GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) q GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.names, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated, coalesce(r.spans, '') AS removal_spans
FROM split d LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id) LEFT JOIN spans r USING (doc_id)
"""

#: All pairs of vectors that can be compared.
NEAR_DUPLICATES = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM both_ways GROUP BY a) n USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a) c USING (vec_id)
"""

#: A prefix is the list of its turns; lists are compared as they are.
PREFIX_TRIE = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
whole AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY place) AS own FROM turns GROUP BY conv_id),
heads AS (SELECT *, {_CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM whole),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.own, [])[1 : c.h], c.own[c.h + 1 :]) AS seq
    FROM heads c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 20
),
members AS (SELECT conv_id, len(seq) AS length, depth, seq[1 : depth] AS prefix FROM rebuilt, unnest(range(len(seq) + 1)) AS d(depth)),
nodes AS (
    SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (length = depth), '') AS ends
    FROM members GROUP BY prefix, depth
),
named AS (
    SELECT n.*, p.conv_id AS parent_conv_id,
        (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.prefix[1 : n.depth] = n.prefix) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : p.depth]
),
sums AS (
    SELECT m.prefix, m.depth, count(*) FILTER (w.n_children = 0) AS n_leaves,
        sum(CASE WHEN w.depth = 0 THEN 0
            ELSE (w.n_convs - 1) * len(regexp_extract_all(w.prefix[w.depth].text, '[^\x20\x09-\x0D]+')) END)::BIGINT AS saved_tokens
    FROM named w JOIN members m ON m.conv_id = w.conv_id AND m.depth <= w.depth
    GROUP BY m.prefix, m.depth
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM named n JOIN sums s ON s.prefix = n.prefix AND s.depth = n.depth
"""

#: Every order is played step by step; Shapley sums are added up over the orders.
FILTER_AUDIT = f"""
WITH said AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM documents LEFT JOIN said USING (doc_id)
),
judged AS (
    SELECT part, good, toxic,
        {{'A': len({_WORDS}) < 200,
          'B': 100 * len(list_distinct({_WORDS})) < 50 * len({_WORDS}),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'),
          'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)}} AS fails
    FROM texts
),
listed AS (
    SELECT part, good, toxic,
        list_concat(CASE WHEN fails.A THEN ['A'] ELSE [] END, CASE WHEN fails.B THEN ['B'] ELSE [] END, CASE WHEN fails.C THEN ['C'] ELSE [] END,
            CASE WHEN fails.D THEN ['D'] ELSE [] END, CASE WHEN fails.E THEN ['E'] ELSE [] END) AS fails
    FROM judged
),
docs AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM listed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
    SELECT filter_order, step::INTEGER AS step, filter_order[step] AS filter, str_split(left(filter_order, step - 1), '') AS earlier
    FROM orders, range(1, 6) AS s(step)
),
played AS (
    SELECT part, filter_order, step, filter,
        sum(n) - sum(n) FILTER (list_has_any(fails, earlier) OR list_contains(fails, filter)) AS left_over, sum(n) AS whole,
        coalesce(sum(n) FILTER (list_contains(fails, filter) AND NOT list_has_any(fails, earlier)), 0) AS removed,
        coalesce(sum(n) FILTER (list_contains(fails, filter) AND list_has_any(fails, earlier)), 0) AS redundant,
        coalesce(sum(n) FILTER (fails = [filter]), 0) AS unique_fails,
        coalesce(sum(good) FILTER (list_contains(fails, filter) AND NOT list_has_any(fails, earlier)), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (list_contains(fails, filter) AND NOT list_has_any(fails, earlier)), 0) AS toxic_lost
    FROM docs, steps GROUP BY part, filter_order, step, filter
)
SELECT part, filter_order, step, coalesce(left_over, whole)::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM played
"""
