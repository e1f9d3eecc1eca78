"""SQL twins of the prompts."""

from __future__ import annotations

import re

from ..functions.constants import CLAIM_PROMPT, FEWSHOT_PROMPT, QUALITY_PROMPT, SPOT_PROMPT


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill_sql(template: str, **values: str) -> str:
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return " || ".join(values[p] if i % 2 else quoted(p) for i, p in enumerate(parts))


_CLAIM = (
    "'Claim ' || (g.claim_id + 1) || ':' || chr(10) || '  - Type: ' || g.claim_type || chr(10) || '  - Text: \"' || g.text || '\"'"
    " || chr(10) || '  - Position: [' || g.s || ':' || g.e || ']'"
)

PROMPT_VIEWS = {
    "d_blocks": """
    SELECT claim_type, 'Slots for ' || claim_type || ':' || string_agg(chr(10) || '  - ' || slot || ': ' || description, '' ORDER BY pos) AS block
    FROM d_slots GROUP BY claim_type
    """,
    "f_prompts": f"""
    SELECT message_id, {fill_sql(CLAIM_PROMPT, message='text', claims='claims', schemas='schemas')} AS prompt FROM (
      SELECT m.message_id, m.text, string_agg({_CLAIM}, chr(10) || chr(10) ORDER BY g.claim_id) AS claims,
             string_agg(b.block, chr(10) || chr(10) ORDER BY g.claim_id) AS schemas
      FROM f_messages m JOIN f_gold g ON g.doc_id = m.doc_id JOIN d_blocks b ON b.claim_type = g.claim_type GROUP BY 1, 2)
    """,
    "f_spot_prompts": f"""
    SELECT message_id, {fill_sql(SPOT_PROMPT, message='text', claims='claims')} AS prompt FROM (
      SELECT m.message_id, m.text, string_agg('- ' || g.claim_type || ': ''' || g.text || '''', chr(10) ORDER BY g.claim_id) AS claims
      FROM f_messages m JOIN f_gold g ON g.doc_id = m.doc_id GROUP BY 1, 2)
    """,
    "f_quality_prompts": f"""
    SELECT message_id, {fill_sql(QUALITY_PROMPT, message='text')} AS prompt FROM f_messages WHERE label IS DISTINCT FROM 'ham'
    """,
    "f_claim_vectors": """
    SELECT p.message_id, p.claim_id, p.claim_type, p.doc_id * 1000000 + p.claim_id AS id,
           ('0x' || md5('fewshot:' || p.message_id)[1:1])::INTEGER // 4 AS fold, e.embedding::DOUBLE[] AS e
    FROM f_pclaims_g p JOIN embeddings e ON e.vec_id = (p.doc_id * 31 + p.claim_id) % (SELECT count(*) FROM embeddings)
    """,
    "f_retrieved": """
    SELECT message_id, claim_id, claim_type, best[k].i AS example_id, k FROM (
      SELECT *, unnest(range(1, len(best) + 1)) AS k FROM (
        SELECT q.message_id, q.claim_id, claim_type, min({'s': -round(list_inner_product(q.e, c.e), 6), 'i': c.id}, 3) AS best
        FROM f_claim_vectors q JOIN f_claim_vectors c USING (claim_type) WHERE q.fold <> c.fold GROUP BY ALL))
    """,
    "f_lines": """
    SELECT g.doc_id * 1000000 + g.claim_id AS id, '"' || g.claim_text || '" → canonical: "' || g.canonical_form || '", slots: {' ||
           coalesce(string_agg('"' || s.slot || '":' || coalesce('"' || s.value || '"', 'null'), ',' ORDER BY s.pos), '') || '}' || chr(10) AS line
    FROM f_pclaims_g g LEFT JOIN f_slots_g s ON s.message_id = g.message_id AND s.claim_id = g.claim_id
    GROUP BY g.doc_id, g.claim_id, g.claim_type, g.claim_text, g.canonical_form
    """,
    "f_shown": """
    SELECT message_id, claim_id, chr(10) || chr(10) || 'Examples for ' || claim_type || ':' || chr(10) || string_agg(k || '. ' || line, '' ORDER BY k) AS shown
    FROM f_retrieved r JOIN f_lines l ON l.id = r.example_id GROUP BY message_id, claim_id, claim_type
    """,
    "f_fewshot_prompts": f"""
    SELECT message_id, {fill_sql(FEWSHOT_PROMPT, message='text', claims='claims', schemas='schemas', examples='examples')} AS prompt FROM (
      SELECT m.message_id, m.text, string_agg({_CLAIM}, chr(10) || chr(10) ORDER BY g.claim_id) AS claims,
             string_agg(b.block, chr(10) || chr(10) ORDER BY g.claim_id) AS schemas, coalesce(string_agg(x.shown, '' ORDER BY g.claim_id), '') AS examples
      FROM f_messages m JOIN f_gold g ON g.doc_id = m.doc_id JOIN d_blocks b ON b.claim_type = g.claim_type
      LEFT JOIN f_shown x ON x.message_id = g.message_id AND x.claim_id = g.claim_id
      WHERE m.message_id IN (SELECT message_id FROM f_pclaims_g) GROUP BY 1, 2)
    """,
}
