"""DuckDB SQL for those of the numbered queries that SQL can express."""

from __future__ import annotations

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op4_line_dedup": f"""
        WITH lines AS (
          SELECT doc_id, unnest(list_zip(range(1, len(l) + 1), l)) AS x
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
          SELECT doc_id, x[1] AS pos, x[2] AS line,
                 translate(trim(x[2], {_WHITE}), {_LOWER}) AS key FROM lines
        ), shared AS (
          SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
          SELECT k.doc_id, pos, line, keeper IS NOT NULL AND k.doc_id <> keeper AS gone
          FROM keyed k LEFT JOIN shared s ON k.key = s.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op8_exact_dedup": f"""
        WITH bare AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 translate(coalesce(text, ''), {_WHITE}, '') AS bare FROM documents
        ), groups AS (
          SELECT bare, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size
          FROM bare GROUP BY bare
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256
        FROM bare JOIN groups USING (bare)""",
    "op10_chat_formatting": r"""
        WITH said AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL
          SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(i, r)
        ), sized AS (
          SELECT *, 33 + length(regexp_replace(role || text, '([<\[\\])', '\1\\', 'g')) AS n FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op12_prefix_trie": """
        WITH own AS (
          SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')}
                               ORDER BY turn NULLS FIRST, role, text) AS l
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), taken AS (
          SELECT *, xor(list_reduce(
              list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
              lambda crc, byte: list_reduce(list_transform(range(8), lambda i: CAST(i AS BIGINT)),
                lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, byte)),
              CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM own
        ), rebuilt AS (
          SELECT a.conv_id, list_concat(coalesce(b.l[1:a.h], []), a.l[a.h + 1:]) AS s
          FROM taken a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
        ), prefixes AS (
          SELECT conv_id, s[1:d] AS node, d, len(s) = d AS ends
          FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
        ), nodes AS (
          SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), ''))
                   AS ends_sha256,
                 CASE WHEN d > 0 THEN length(node[d].x) ELSE 0 END * (count(*) - 1) AS saved
          FROM prefixes GROUP BY node, d
        ), children AS (
          SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
        ), counted AS (
          SELECT nodes.*, coalesce(c.n, 0) AS n_children FROM nodes LEFT JOIN children c USING (node)
        ), totals AS (
          SELECT node[1:i] AS node, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum(saved) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM counted) GROUP BY 1
        )
        SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children,
               CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, c.ends_sha256
        FROM counted c JOIN totals t USING (node) LEFT JOIN nodes p ON c.d > 0 AND p.node = c.node[1:c.d - 1]""",
}
