"""DuckDB statements of the operators that SQL can express."""

from __future__ import annotations

from shoptide.llm import chat, licences

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('7:' || coalesce(doc_id::VARCHAR, ':' || text, '')) AS drawn
  FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 2.0::DOUBLE AS cap FROM sizes
), weighted AS (
  SELECT *, CASE rank % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM ranked
), sums AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS clamped_before,
    sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighted
), marked AS (SELECT *, (budget - clamped_before) * weight > cap * weight_left AS clamped FROM sums),
goals AS (
  SELECT source, source_size, least(cap, CASE WHEN clamped THEN cap
    ELSE (budget - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER ()) * weight / sum(CASE WHEN clamped THEN 0 ELSE weight END) OVER () END) AS target
  FROM marked
), placed AS (
  SELECT s.*, g.source_size, g.target, coalesce(floor(g.target / nullif(g.source_size, 0)), 0)::BIGINT AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.drawn, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN size > 0 AND before + size / 2 <= target - whole * source_size THEN 1 ELSE 0 END) AS taken
FROM placed
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licences() -> str:
    known = ", ".join(f"{_quoted(words)}: {_quoted(name)}" for name, words in licences.SENTENCES.items())
    ids = """list_filter(list_transform(list_filter(string_split_regex(body, {cut}), lambda s: regexp_matches(lower(s), {anchors})),
      lambda s: known[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL)"""
    by = {name: ids.format(cut=_quoted(cut), anchors=_quoted(licences.ANCHORS)) for name, cut in (("lines", licences.BY_LINE), ("paragraphs", licences.BY_PARAGRAPH))}
    steps, rules, kinds = ["step0 AS (SELECT *, array_to_string(ids, ' ') || ' ' AS left0 FROM chosen)"], [], []
    for k, (name, licence, _, sequences) in enumerate(licences.RULES):
        pattern = _quoted("|".join("".join(f"{i} " for i in sequence) for sequence in sequences))
        steps.append(f"step{k + 1} AS (SELECT *, regexp_matches(left{k}, {pattern}) AS fits{k}, regexp_replace(left{k}, {pattern}, ' ', 'g') AS left{k + 1} FROM step{k})")
        rules.append(f"CASE WHEN fits{k} THEN {_quoted(name)} END")
        kinds.append((licence, f"fits{k}"))
    # A licence stands at the place of the first of its rules that fits.
    places = ", ".join(f"CASE WHEN {f} THEN {_quoted(x)} END" for x, f in kinds)
    return f"""
WITH dictionary AS (SELECT MAP {{{known}}} AS known),
bodies AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), {_quoted(licences.ANCHORS)}) THEN text ELSE '' END AS body, known FROM documents, dictionary),
split AS (SELECT doc_id, {by["lines"]} AS lines, {by["paragraphs"]} AS paragraphs FROM bodies),
chosen AS (SELECT doc_id, CASE WHEN len(lines) >= len(paragraphs) THEN lines ELSE paragraphs END AS ids FROM split),
{", ".join(steps)},
found AS (SELECT *, list_filter([{", ".join(rules)}], lambda x: x IS NOT NULL) AS all_rules, list_filter([{places}], lambda x: x IS NOT NULL) AS all_kinds FROM step{len(licences.RULES)})
SELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ',') AS sentences, array_to_string(all_rules, ',') AS rules,
  array_to_string(list_filter(all_kinds, lambda x, i: list_position(all_kinds, x) = i), ',') AS licences
FROM found
"""


def _chat() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, chr(92), chr(92) || chr(92))"
        for control in chat.CONTROLS:
            out = f"replace({out}, {_quoted(control)}, {_quoted(control[0])} || chr(92) || {_quoted(control[1:])})"
        return out

    fixed = len(chat.START + chat.BETWEEN + chat.END)
    said = _quoted("</s>[INST] ok [/INST]")
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}
), sums AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({escaped("role")}) + length({escaped("text")}) + {fixed})::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM sums
"""


#: Compares all pairs of a label: for the sizes at which results are compared.
NEAR_VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (SELECT vec_id AS a, vec_id AS b FROM usable UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least_of l ON e.vec_id = l.a LEFT JOIN counts c ON e.vec_id = c.a
"""

#: Scores every row with every anchor: for the sizes at which results are compared.
HARD_NEGATIVES = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), windows AS (
  SELECT p.anchor_id, positive_id, positive_score, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.id) AS place
  FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * positive_score <= 100 * n.score AND n.score <= positive_score
)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM windows WHERE place <= 5
"""

LINES = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT row, doc_id, i, parts[i] AS line,
    translate(trim(parts[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT row, doc_id, string_split(text, chr(10)) AS parts FROM texts))
), shared AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE doc_id IS NOT NULL AND length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (l.doc_id > first))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR l.doc_id IS NULL OR l.doc_id <= first), '')) AS kept_sha256
FROM lines l LEFT JOIN shared s ON l.key = s.key GROUP BY l.row, l.doc_id
"""

ORACLES = {"op5_near_vectors": NEAR_VECTORS, "op7_mixing": MIXING, "op9_licences": _licences(), "op10_chat": _chat(), "op11_hard_negatives": HARD_NEGATIVES,
           "op13_lines": LINES}
