"""DuckDB SQL of the pipeline's queries, over whole tables.

Queries that SQL can't express are left out: hash sampling, model training,
greedy assignment and stemming.
"""

from __future__ import annotations

from skein.config import CHILD_TYPES, INVERSE_TYPES, PARENT_TYPES, SIBLING_TYPES, STOP_WORDS, SYNONYM_TYPES

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_FAMILIES = {"par": PARENT_TYPES, "chd": CHILD_TYPES, "sib": SIBLING_TYPES, "syn": SYNONYM_TYPES}


def _in(types) -> str:
    return "(" + ", ".join(f"'{t}'" for t in types) + ")"


def _tok(s: str, stop: bool = True) -> str:
    found = f"regexp_extract_all(coalesce({s}, ''), '[A-Za-z\\p{{Nd}}]+')"
    return f"list_filter({found}, lambda t: NOT list_contains({_STOP}, t))" if stop else found


def _strip(s: str) -> str:
    space = "[\\s\\x0b\\x85\\p{Z}]+"  # white space of any kind
    return f"regexp_replace({s}, '^{space}|{space}$', '', 'g')"


def _norm(s: str) -> str:
    return f"replace(replace(lower({_strip(s)}), '-', ''), '_', ' ')"


def _grams(s: str, n: int) -> str:
    pad = f"repeat(chr(0), {n - 1})"
    return f"list_transform(range(1, length(coalesce({s}, '')) + {n}), lambda i: substring({pad} || coalesce({s}, '') || {pad}, i, {n}))"


def _uniq(x: str) -> str:
    return f"list_sort(list_distinct({x}))"


def _jac(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN -1.0 ELSE len(list_distinct(list_intersect({a}, {b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def _max_jac(a: str, b: str) -> str:
    return f"coalesce(list_max(flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: greatest(0.0, {_jac('x', 'y')}))))), 0.0)"


def _over(a: str, b: str) -> str:
    return f"list_has_any({a}, {b})"


_LATEST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kb, research_entity_id ORDER BY updated_at DESC, loaded_at DESC, row_id DESC) AS rn FROM kb_entity WHERE research_entity_id IS NOT NULL) WHERE rn = 1)"""
_NAMED = f"""{_LATEST},
named AS (
  SELECT kb, research_entity_id, {_norm('canonical_name')} AS canonical_name, list_transform(coalesce(aliases, []), lambda a: {_norm('a')}) AS aliases, {_norm('definition')} AS definition
  FROM latest WHERE length(research_entity_id) > 0 AND length(canonical_name) > 0)"""


def _tokens(ngrams: bool) -> str:
    parts = f"list_concat(flatten(list_transform(aliases, lambda a: {_tok('a')})), {_tok('definition')})"
    if ngrams:
        parts = f"list_concat({parts}, flatten(list_transform(list_filter(aliases, lambda a: a IS NOT NULL), lambda a: {_grams(_norm('a'), 5)})))"
    return f"""
toks AS (SELECT DISTINCT kb, research_entity_id, unnest({parts}) AS token FROM named),
sizes AS (SELECT kb, count(*) AS n FROM named GROUP BY kb),
idfs AS (SELECT kb, token, count(*) AS df, any_value(n) AS n, ln(any_value(n)::DOUBLE / count(*) + 1) AS idf FROM toks JOIN sizes USING (kb) GROUP BY kb, token)"""


_SCORED = f"""{_NAMED},{_tokens(True)},
rare AS (SELECT t.*, idf FROM toks t JOIN idfs i ON t.kb = i.kb AND t.token = i.token WHERE df * 19 <= n),
scored AS MATERIALIZED (
  SELECT s.kb AS s_kb, s.research_entity_id AS s_id, t.kb AS t_kb, t.research_entity_id AS t_id, sum(t.idf) AS score
  FROM rare s JOIN rare t ON s.token = t.token AND s.kb < t.kb GROUP BY 1, 2, 3, 4)"""
_RANKED = f"""{_SCORED},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s_kb, s_id, t_kb ORDER BY round(score, 6) DESC, t_id) AS rank FROM scored)"""
_KEYS = "list_transform(aliases, lambda a: replace(replace(lower(a), '_', ' '), '-', ''))"
_EXACT = f"""
keyed AS (SELECT kb, research_entity_id, {_KEYS} AS k FROM named),
exact AS MATERIALIZED (
  SELECT s_kb, s_id, t_kb, t_id FROM scored JOIN keyed a ON a.kb = s_kb AND a.research_entity_id = s_id JOIN keyed b ON b.kb = t_kb AND b.research_entity_id = t_id
  WHERE list_has_any(a.k, b.k))"""
_TRIM = "regexp_replace({0}, '^[ \\t]+|[ \\t]+$', '', 'g')"
_GOLD = f"""
gold AS (SELECT {_TRIM.format('c0')} AS s_id, {_TRIM.format('c1')} AS t_id, c2 AS score, c3 AS provenance FROM test_input_alignment WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL)"""
_BETWEEN = f"""{_GOLD},
between_kbs AS (SELECT DISTINCT least(s_id, t_id) AS s_id, greatest(s_id, t_id) AS t_id FROM gold WHERE score > 0)"""
_VALID = """
valid AS (SELECT s_id, t_id, max(score) AS score FROM sim_score WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) GROUP BY s_id, t_id)"""
_BEST = f"""{_VALID},
best AS (SELECT s_id, t_id, score FROM (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY score DESC, t_id) AS r FROM valid WHERE score >= 0.9) WHERE r = 1)"""
_EDGES = """
edges AS (
  SELECT kb, relation_id, entity_ids[1] AS src_id, entity_ids[2] AS dst_id, relation_type FROM kb_relation
  WHERE entity_ids[1] IS NOT NULL AND entity_ids[2] IS NOT NULL AND relation_type IS NOT NULL)"""
_REGION = f"""{_EDGES},{_LATEST},
hop AS (SELECT DISTINCT kb, src_id, dst_id FROM edges),
zero AS (SELECT DISTINCT kb, research_entity_id AS start_id, research_entity_id AS node_id, 0 AS depth FROM latest),
one AS (SELECT DISTINCT z.kb, start_id, dst_id AS node_id, 1 AS depth FROM zero z JOIN hop h ON z.kb = h.kb AND z.node_id = h.src_id),
two AS (SELECT DISTINCT z.kb, start_id, dst_id AS node_id, 2 AS depth FROM one z JOIN hop h ON z.kb = h.kb AND z.node_id = h.src_id),
region AS (SELECT kb, start_id, node_id, min(depth) AS depth FROM (SELECT * FROM zero UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2, 3)"""
_METRICS = """
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1"""
_MERGED = f"""{_LATEST},{_GOLD},
groups AS (SELECT greatest(s_id, t_id) AS research_entity_id, min(least(s_id, t_id)) AS merge_key FROM gold WHERE score > 0 AND s_id <> t_id GROUP BY 1),
keyed AS (SELECT l.*, coalesce(g.merge_key, l.research_entity_id) AS k FROM latest l LEFT JOIN groups g USING (research_entity_id)),
merged AS (
  SELECT k AS merge_key, array_to_string(list_sort(list_distinct(flatten(list(string_split(research_entity_id, '|'))))), '|') AS merged_id,
    arg_min(coalesce(canonical_name, chr(0)), research_entity_id) AS name, array_to_string(list_sort(list_distinct(flatten(list(coalesce(aliases, []))))), '|') AS aliases
  FROM keyed GROUP BY k)"""
_INVERSE = "CASE relation_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in INVERSE_TYPES.items()) + " END"
_ATOMS = f"""{_GOLD},{_LATEST},
ids AS (SELECT DISTINCT list_last(string_split(provenance, ':')) AS cui, unnest([s_id, t_id]) AS id FROM gold WHERE score > 0 AND provenance LIKE '%:%'),
atoms AS (
  SELECT cui, split_part(id, ':', 1) AS sab, list_last(string_split(id, ':')) AS code, id, str, CASE length(str) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS r, length(str) AS ord
  FROM ids JOIN (SELECT research_entity_id AS id, unnest(aliases) AS str FROM latest) USING (id) WHERE str IS NOT NULL AND list_last(string_split(id, ':')) <> 'NOCODE')"""
_SURFACE = r"[\p{L}\p{N}]+|[^\s\x0b\p{L}\p{N}]"
TOKEN_COUNTS = rf"""SELECT doc_id::VARCHAR AS doc_id, len(regexp_extract_all(text, '{_SURFACE}')) AS n_tokens, len(regexp_extract_all(regexp_replace(text, '[\s\x0b]+$', ''), '[.!?][\s\x0b]+')) AS last_sent
FROM documents WHERE len(regexp_extract_all(text, '{_SURFACE}')) > 0"""
_RUNS = rf"""
sents AS (
  SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS sent FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE length(text) > 0)),
toks AS (SELECT doc_id, sent, unnest(t) AS surface, generate_subscripts(t, 1) AS tok FROM (SELECT doc_id, sent, regexp_extract_all(s, '{_SURFACE}') AS t FROM sents))"""


def _spans(name: str, pattern: str, label: str) -> str:
    return f"""
{name} AS (
  SELECT doc_id::VARCHAR AS doc_id, sent, min(tok) AS start, max(tok) AS "end", '{label}' AS label, string_agg(surface, ' ' ORDER BY tok) AS mention
  FROM (SELECT *, tok - row_number() OVER (PARTITION BY doc_id, sent ORDER BY tok) AS g FROM toks WHERE regexp_matches(surface, '{pattern}')) GROUP BY doc_id, sent, g)"""


_LISTS = (("wiki", "wiki_entities"), ("mesh", "mesh_synonyms"), ("dbpedia", "dbpedia_synonyms"))


def _prepared() -> str:
    """Both sides of every training pair with what the features read."""
    cols = []
    for p, e in (("s", "source_ent"), ("t", "target_ent")):
        al = f"coalesce({e}.aliases, [])"
        cols += [
            f"{e}.canonical_name AS {p}_name", f"{_tok(f'{e}.canonical_name')} AS {p}_toks", f"{_uniq(_grams(f'{e}.canonical_name', 4))} AS {p}_g4", f"{_uniq(_grams(f'{e}.canonical_name', 5))} AS {p}_g5",
            f"list_distinct({al}) AS {p}_al", f"list_transform({al}, lambda a: array_to_string({_tok('a')}, ' ')) AS {p}_at", f"list_distinct(list_transform({al}, lambda a: array_to_string(list_sort({_tok('a')}), ' '))) AS {p}_as",
            f"list_distinct(list_transform({al}, lambda a: {_uniq(_tok('a'))})) AS {p}_au", f"list_transform(list_distinct({al}), lambda a: {_uniq(_grams('a', 4))}) AS {p}_a4", f"list_transform(list_distinct({al}), lambda a: {_uniq(_grams('a', 5))}) AS {p}_a5",
            f"list_distinct(list_transform({al}, lambda a: array_to_string(list_transform({_tok('a')}, lambda w: left(w, 1)), ''))) AS {p}_acr", f"list_distinct({_tok(f'{e}.definition')}) AS {p}_def",
            f"list_filter(list_transform(string_split(coalesce({e}.canonical_name, ''), ','), lambda x: {_tok('x', False)}[-1]), lambda x: x IS NOT NULL) AS {p}_heads",
        ]
        for short, field in _LISTS:
            cols += [f"list_distinct(coalesce({e}.{field}, [])) AS {p}_{short}", f"list_distinct(list_transform(coalesce({e}.{field}, []), lambda a: {_uniq(_tok('a'))})) AS {p}_{short}_t"]
    return f"f AS (SELECT pair_id, {', '.join(cols)} FROM training_pair)"


def _features(**made: str) -> str:
    return f"WITH {_prepared()} SELECT pair_id, " + ", ".join(f"{sql} AS {name}" for name, sql in made.items()) + " FROM f"


def _r(x: str) -> str:
    return f"round({x}, 6)"


def _every(p: str) -> str:
    return f"list_distinct(list_concat(list_concat({p}_al, {p}_wiki), list_concat({p}_mesh, {p}_dbpedia)))"


def _every_t(p: str) -> str:
    return f"list_concat(list_concat({p}_au, {p}_wiki_t), list_concat({p}_mesh_t, {p}_dbpedia_t))"


def _trio(short: str, one: str) -> dict[str, str]:
    return {f"has_same_{one}": _over(f"s_{short}", f"t_{short}"), f"{one}_jaccard": _r(_jac(f"s_{short}", f"t_{short}")), f"max_{one}_jaccard": _r(_max_jac(f"s_{short}_t", f"t_{short}_t"))}


_WORDS = f"words AS (SELECT doc_id, unnest({_tok('text', False)}) AS word FROM documents WHERE text IS NOT NULL)"

#: Parts that other query modules build on.
LATEST, GOLD = _LATEST, _GOLD
_NAMES_SQL = f"WITH {_RUNS.strip()},{_spans('names', '^[A-Z]', 'NAME')} SELECT doc_id, sent, start, \"end\", label, mention FROM names"


def _propagated(rounds: int) -> str:
    steps = [f"""
p{i + 1} AS (
  SELECT v.s_id, v.t_id, sum(exp(-s.depth) * n.score) / sum(exp(-s.depth)) AS score
  FROM p{i} v JOIN region s ON s.start_id = v.s_id JOIN region t ON t.start_id = v.t_id AND t.depth = s.depth JOIN p{i} n ON n.s_id = s.node_id AND n.t_id = t.node_id GROUP BY 1, 2)""" for i in range(rounds)]
    return f"WITH {_REGION.strip()},{_VALID}, p0 AS (SELECT * FROM valid),{','.join(steps)} SELECT s_id, t_id, round(score, 6) AS score FROM p{rounds}"


SQL: dict[str, str] = {
    "text_tokens": TOKEN_COUNTS,
    "mention_spans": _NAMES_SQL,
    "bilou_roundtrip": _NAMES_SQL,
    "span_union": f"""WITH {_RUNS.strip()},{_spans('names', '^[A-Z]', 'NAME')},{_spans('phrases', '^(?:[A-Z].*|of|the|[0-9]+)$', 'PHRASE')}
SELECT p.doc_id, p.sent, p.start, p."end", coalesce(n.label, p.label) AS label, p.mention FROM phrases p
LEFT JOIN names n ON n.doc_id = p.doc_id AND n.sent = p.sent AND n.start = p.start AND n."end" = p."end\"""",
    "align_one_to_one": f"""WITH RECURSIVE {_VALID.strip()},
cand AS (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY score DESC, t_id) AS r FROM valid WHERE score >= 0.9),
ord AS (SELECT s_id, t_id, score, row_number() OVER (ORDER BY score DESC, s_id, t_id) AS rn FROM cand WHERE r <= 10),
rec AS (
  SELECT 0::BIGINT AS rn, []::VARCHAR[] AS ss, []::VARCHAR[] AS ts, false AS ok
  UNION ALL SELECT o.rn, CASE WHEN f THEN list_append(ss, s_id) ELSE ss END, CASE WHEN f THEN list_append(ts, t_id) ELSE ts END, f
  FROM (SELECT o.*, ss, ts, NOT list_contains(ss, o.s_id) AND NOT list_contains(ts, o.t_id) AS f FROM rec JOIN ord o ON o.rn = rec.rn + 1) o)
SELECT s_id, t_id, score FROM rec JOIN ord USING (rn) WHERE ok""",
    "neighborhood_5iter": _propagated(5),
    "normalize_strings": f"SELECT row_id, {_norm('canonical_name')} AS normal_name, replace(replace(lower(canonical_name), '_', ' '), '-', '') AS match_key, lower(regexp_replace(canonical_name, '[^a-zA-Z0-9 ]+', '', 'g')) AS plain_name FROM kb_entity",
    "tokenize_stop": f"SELECT row_id, array_to_string({_tok('definition')}, ' ') AS words, len({_tok('definition')}) AS n_words FROM kb_entity",
    "char_ngrams": f"SELECT row_id, len({_grams('canonical_name', 5)}) AS n_grams, len(list_distinct({_grams('canonical_name', 5)})) AS n_distinct FROM kb_entity WHERE canonical_name IS NOT NULL",
    "name_shapes": f"""SELECT row_id, array_to_string(list_transform({_tok('canonical_name')}, lambda w: left(w, 1)), '') AS acronym,
array_to_string(list_sort(list_transform(coalesce(aliases, []), lambda a: array_to_string(list_sort({_tok('a')}), ' '))), '|') AS token_lists FROM kb_entity""",
    "common_substring": """WITH n AS (SELECT pair_id, coalesce(source_ent.canonical_name, '') AS a, coalesce(target_ent.canonical_name, '') AS b FROM training_pair),
parts AS (SELECT pair_id, a, b, unnest(range(1, length(a) + 1)) AS i FROM n),
sub AS (SELECT pair_id, b, length(x) AS l, x FROM (SELECT pair_id, b, unnest(list_transform(range(1, length(a) - i + 2), lambda k: substring(a, i, k))) AS x FROM parts))
SELECT n.pair_id, coalesce(max(l), 0) AS n_common FROM n LEFT JOIN sub ON n.pair_id = sub.pair_id AND contains(sub.b, sub.x) GROUP BY n.pair_id""",
    "raw_ids": "SELECT DISTINCT pair_id, trim(replace(x, chr(9), ' ')) AS raw_id FROM (SELECT pair_id, unnest(string_split(source_ent.research_entity_id, '|')) AS x FROM training_pair WHERE source_ent.research_entity_id IS NOT NULL)",
    "latest_entities": f"WITH {_LATEST.strip()} SELECT kb, research_entity_id, row_id, canonical_name FROM latest",
    "relation_buckets": f"WITH {_EDGES.strip()} SELECT kb, src_id AS research_entity_id, "
    + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT dst_id) FILTER (relation_type IN {_in(t)})), '|'), '') AS {n}_relations" for n, t in _FAMILIES.items())
    + " FROM edges GROUP BY kb, src_id",
    "relation_names": f"WITH {_EDGES.strip()},{_LATEST}, known AS (SELECT kb, research_entity_id AS dst_id FROM latest WHERE canonical_name IS NOT NULL) SELECT kb, src_id AS research_entity_id, "
    + ", ".join(f"count(*) FILTER (relation_type IN {_in(t)}) AS n_{n}" for n, t in _FAMILIES.items())
    + " FROM edges JOIN known USING (kb, dst_id) GROUP BY kb, src_id",
    "inverse_relations": f"""WITH {_EDGES.strip()}, wanted AS (SELECT DISTINCT kb, dst_id AS src_id, src_id AS dst_id, {_INVERSE} AS relation_type FROM edges)
SELECT * FROM wanted w WHERE relation_type IS NOT NULL AND (kb, src_id) IN (SELECT (kb, research_entity_id) FROM kb_entity)
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kb = w.kb AND e.src_id = w.src_id AND e.dst_id = w.dst_id AND e.relation_type = w.relation_type)""",
    "null_entity_union": f"""WITH {_LATEST.strip()} SELECT kb, research_entity_id, canonical_name FROM latest
UNION ALL SELECT DISTINCT kb, kb || ':NULL', 'null' FROM latest WHERE kb NOT IN (SELECT kb FROM latest WHERE research_entity_id = kb || ':NULL')""",
    "valid_entities": "SELECT kb, count(*) AS n_valid FROM kb_entity WHERE length(research_entity_id) > 0 AND length(canonical_name) > 0 GROUP BY kb",
    "valid_relations": "SELECT kb, relation_type, count(*) AS n_valid FROM kb_relation WHERE length(relation_type) > 0 AND len(entity_ids) = 2 AND entity_ids[1] IS NOT NULL AND entity_ids[2] IS NOT NULL GROUP BY kb, relation_type",
    "entity_names": f"WITH {_LATEST.strip()} SELECT kb, research_entity_id, array_to_string(list_sort(list_distinct(list_transform(coalesce(aliases, []), lambda a: lower(regexp_replace(a, '[^a-zA-Z0-9 ]+', '', 'g'))))), '|') AS names FROM latest",
    "relations_of": f"WITH {_EDGES.strip()} SELECT kb, src_id AS research_entity_id, count(DISTINCT relation_id) AS n_relations, min(relation_id) AS first_relation FROM edges GROUP BY kb, src_id",
    "merge_entities": f"WITH {_MERGED.strip()} SELECT merge_key, merged_id, nullif(name, chr(0)) AS canonical_name, aliases FROM merged",
    "repointed_relations": f"""WITH {_MERGED.strip()},{_EDGES}, ids AS (SELECT unnest(string_split(merged_id, '|')) AS raw, merged_id FROM merged)
SELECT * FROM (SELECT kb, relation_id, coalesce(a.merged_id, src_id) AS src_id, coalesce(b.merged_id, dst_id) AS dst_id, relation_type FROM edges LEFT JOIN ids a ON a.raw = src_id LEFT JOIN ids b ON b.raw = dst_id) WHERE src_id <> dst_id""",
    "entity_json": f"WITH {_LATEST.strip()} SELECT kb, research_entity_id, canonical_name AS name, len(coalesce(aliases, [])) AS n_aliases FROM latest",
    "source_urls": f"""WITH {_LATEST.strip()} SELECT kb, research_entity_id, array_to_string(CASE WHEN len(coalesce(source_urls, [])) > 0 THEN source_urls
WHEN split_part(research_entity_id, ':', 1) IN (SELECT kb FROM kb_registry) THEN ['https://' || lower(split_part(research_entity_id, ':', 1)) || '.example/term/' || list_last(string_split(research_entity_id, ':'))] ELSE [] END, '|') AS urls FROM latest""",
    "synonym_enrich": f"""WITH {_LATEST.strip()},
syn AS (
  SELECT DISTINCT * FROM (
    SELECT 'mesh_synonyms' AS source, {_norm('canonical_name')} AS alias, unnest(additional_details['mesh_synonyms']) AS synonym FROM latest WHERE canonical_name IS NOT NULL
    UNION ALL SELECT 'dbpedia_synonyms', {_norm('canonical_name')}, unnest(additional_details['dbpedia_synonyms']) FROM latest WHERE canonical_name IS NOT NULL) WHERE synonym IS NOT NULL),
keys AS (SELECT DISTINCT kb, research_entity_id, unnest(list_transform(coalesce(aliases, []), lambda a: {_norm('a')})) AS alias FROM latest)
SELECT kb, research_entity_id, source, array_to_string(list_sort(list(DISTINCT synonym)), '|') AS synonyms FROM keys JOIN syn USING (alias) GROUP BY 1, 2, 3""",
    "summary_enrich": f"""WITH {_LATEST.strip()},
docs AS (SELECT entity_id, arg_min(text, doc_id) AS summary FROM documents WHERE entity_id IS NOT NULL AND length(text) > 0 GROUP BY entity_id),
names AS (SELECT canonical_name AS query, min(research_entity_id) AS entity_id FROM latest WHERE canonical_name IS NOT NULL GROUP BY canonical_name),
s AS (SELECT query, summary FROM names JOIN docs USING (entity_id))
SELECT kb, research_entity_id, length(CASE WHEN length(coalesce(definition, '')) < 5 AND summary IS NOT NULL THEN summary ELSE definition END) AS n_definition FROM latest LEFT JOIN s ON canonical_name = query""",
    "context_attach": f"""WITH {_LATEST.strip()},
c AS (SELECT canonical_name, list_filter(list_distinct(flatten(list(coalesce(other_contexts, [])))), lambda x: x <> '') AS contexts FROM latest WHERE canonical_name IS NOT NULL GROUP BY canonical_name)
SELECT l.kb, l.research_entity_id, len(CASE WHEN len(c.contexts) > 0 THEN c.contexts ELSE coalesce(l.other_contexts, []) END) AS n_contexts FROM latest l LEFT JOIN c USING (canonical_name)""",
    "nonempty_filter": "SELECT pair_id, label FROM training_pair WHERE length(source_ent.definition) > 0 AND length(target_ent.definition) > 0",
    "context_counts": """SELECT kb, count(*) AS n_entities, count(*) FILTER (len(coalesce(other_contexts, [])) > 0) AS with_context, sum(len(coalesce(other_contexts, [])))::BIGINT AS n_contexts,
count(*) FILTER (length(definition) > 0 AND definition <> '<s>') AS with_definition FROM kb_entity GROUP BY kb""",
    "doc_frequency_idf": f"WITH {_NAMED.strip()},{_tokens(False)} SELECT kb, token, df, round(idf, 6) AS idf FROM idfs",
    "candidate_topk": f"WITH {_RANKED.strip()} SELECT s_kb, s_id, t_kb, t_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 100",
    "string_equiv": f"WITH {_SCORED.strip()},{_EXACT} SELECT * FROM exact",
    "unmatched_source": f"WITH {_SCORED.strip()},{_EXACT} SELECT kb, research_entity_id FROM named WHERE (kb, research_entity_id) NOT IN (SELECT (s_kb, s_id) FROM exact)",
    "unmatched_target": f"WITH {_SCORED.strip()},{_EXACT} SELECT kb, research_entity_id FROM named WHERE (kb, research_entity_id) NOT IN (SELECT (t_kb, t_id) FROM exact)",
    "remaining_candidates": f"""WITH {_RANKED.strip()},{_EXACT} SELECT s_kb, s_id, t_kb, t_id, rank FROM ranked r WHERE rank <= 100
AND (s_kb, s_id) NOT IN (SELECT (s_kb, s_id) FROM exact) AND (t_kb, t_id) NOT IN (SELECT (t_kb, t_id) FROM exact)""",
    "named_pairs": f"""WITH {_LATEST.strip()},{_GOLD} SELECT DISTINCT s_id, t_id, a.canonical_name AS s_name, b.canonical_name AS t_name FROM gold JOIN latest a ON a.research_entity_id = s_id JOIN latest b ON b.research_entity_id = t_id
WHERE score > 0 AND a.canonical_name <> a.research_entity_id AND b.canonical_name <> b.research_entity_id""",
    "recall_at_k": f"""WITH {_RANKED.strip()},{_BETWEEN},
marked AS (SELECT rank, g.s_id IS NOT NULL AS hit FROM ranked r LEFT JOIN between_kbs g ON r.s_id = g.s_id AND r.t_id = g.t_id WHERE rank <= 500),
per_k AS (SELECT k, count(*) AS candidates, count(*) FILTER (hit) AS hits FROM marked, unnest([1, 2, 5, 10, 20, 50, 100, 200, 500]) AS ks(k) WHERE rank <= k GROUP BY k)
SELECT k, candidates, hits, round(hits / candidates, 6) AS precision, round(hits / (SELECT count(*) FROM between_kbs), 6) AS recall FROM per_k""",
    "missed_pairs": f"""WITH {_BEST.strip()},{_BETWEEN},{_LATEST}
SELECT g.s_id, g.t_id, coalesce(array_to_string(coalesce(a.aliases, []), ','), '') AS s_aliases, coalesce(array_to_string(coalesce(b.aliases, []), ','), '') AS t_aliases
FROM between_kbs g LEFT JOIN latest a ON a.research_entity_id = g.s_id LEFT JOIN latest b ON b.research_entity_id = g.t_id WHERE (g.s_id, g.t_id) NOT IN (SELECT (s_id, t_id) FROM best)""",
    "name_features": _features(
        has_same_canonical_name="coalesce(s_name = t_name, false)", has_same_name_tokens="s_toks = t_toks", has_same_name_token_set=f"{_uniq('s_toks')} = {_uniq('t_toks')}",
        name_char_4gram_jaccard=_r(_jac("s_g4", "t_g4")), name_char_5gram_jaccard=_r(_jac("s_g5", "t_g5")),
    ),
    "alias_features": _features(
        has_alias_in_common=_over("s_al", "t_al"), has_alias_tokens_in_common=_over("s_at", "t_at"), has_alias_token_set_in_common=_over("s_as", "t_as"), alias_token_jaccard=_r(_jac("s_as", "t_as")),
        max_alias_token_jaccard=_r(_max_jac("s_au", "t_au")), max_alias_4gram_jaccard=_r(_max_jac("s_a4", "t_a4")), max_alias_5gram_jaccard=_r(_max_jac("s_a5", "t_a5")),
        has_same_acronym=f"({_over('s_acr', 't_acr')} OR {_over('s_acr', 't_al')} OR {_over('s_al', 't_acr')})", definition_token_jaccard=_r(_jac("s_def", "t_def")),
    ),
    "synonym_features": _features(
        **_trio("wiki", "wiki_entity"), **_trio("mesh", "mesh_synonym"), **_trio("dbpedia", "dbpedia_synonym"),
        has_overlapping_synonym=_over(_every("s"), _every("t")), all_synonym_jaccard=_r(_jac(_every("s"), _every("t"))), max_all_synonym_jaccard=_r(_max_jac(_every_t("s"), _every_t("t"))),
    ),
    "root_features": _features(has_same_root_word="coalesce(s_heads[1] = t_heads[1], false)", root_word_jaccard=_r(_jac("s_heads", "t_heads"))),
    "align_best": f"WITH {_BEST.strip()} SELECT s_id, t_id, score FROM best",
    "align_all": f"WITH {_VALID.strip()} SELECT s_id, t_id, score FROM valid WHERE score >= 0.9",
    "confusion_metrics": f"""WITH {_VALID.strip()},{_GOLD}, labels AS (SELECT s_id, t_id, max(score) AS label FROM gold GROUP BY 1, 2),
c AS (
  SELECT count(*) FILTER (v.score >= 0.5 AND label > 0) AS tp, count(*) FILTER (v.score >= 0.5 AND NOT label > 0) AS fp, count(*) FILTER (v.score < 0.5 AND label > 0) AS fn, count(*) FILTER (v.score < 0.5 AND NOT label > 0) AS tn
  FROM valid v JOIN labels USING (s_id, t_id))
SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END, 6) AS accuracy,{_METRICS} FROM c""",
    "confusion_confident": f"""WITH p AS (
  SELECT coalesce(split, 'none') AS split, label, greatest(0.0, {_jac(f"list_distinct({_tok('source_ent.canonical_name')})", f"list_distinct({_tok('target_ent.canonical_name')})")}) AS p FROM training_pair WHERE label IS NOT NULL),
c AS (SELECT split, count(*) FILTER (p > 0.9 AND label > 0) AS tp, count(*) FILTER (p > 0.9 AND NOT label > 0) AS fp, count(*) FILTER (1 - p > 0.9 AND label > 0) AS fn, count(*) AS n FROM p GROUP BY split)
SELECT split, tp, fp, fn, n - tp - fp - fn AS tn, round((n - fp - fn) / n, 6) AS accuracy,{_METRICS} FROM c""",
    "gold_compare": f"""WITH {_BEST.strip()},{_BETWEEN},
c AS (SELECT count(*) FILTER (b.s_id IS NOT NULL AND g.s_id IS NOT NULL) AS tp, count(*) FILTER (g.s_id IS NULL) AS fp, count(*) FILTER (b.s_id IS NULL) AS fn FROM best b FULL JOIN between_kbs g ON b.s_id = g.s_id AND b.t_id = g.t_id)
SELECT tp, fp, fn,{_METRICS} FROM c""",
    "mapping_stats": f"""WITH {_GOLD.strip()}, a AS (SELECT DISTINCT s_id, t_id, printf('%.1f', score) AS m FROM gold WHERE score > 0), b AS (SELECT DISTINCT s_id, t_id, printf('%.1f', score) AS m FROM gold WHERE provenance IS NOT NULL),
c AS (SELECT count(*) FILTER (a.s_id IS NOT NULL AND b.s_id IS NOT NULL) AS tp, count(*) FILTER (b.s_id IS NULL) AS fp, count(*) FILTER (a.s_id IS NULL) AS fn FROM a FULL JOIN b ON a.s_id = b.s_id AND a.t_id = b.t_id AND a.m = b.m)
SELECT tp, fp, fn,{_METRICS} FROM c""",
    "region_2hop": f"WITH {_REGION.strip()} SELECT kb, start_id, node_id, depth FROM region",
    "neighborhood_1iter": f"""WITH {_REGION.strip()},{_VALID}
SELECT v.s_id, v.t_id, round(sum(exp(-s.depth) * n.score) / sum(exp(-s.depth)), 6) AS score
FROM valid v JOIN region s ON s.start_id = v.s_id JOIN region t ON t.start_id = v.t_id AND t.depth = s.depth JOIN valid n ON n.s_id = s.node_id AND n.t_id = t.node_id GROUP BY 1, 2""",
    "cross_kb_pairs": f"""WITH {_ATOMS.strip()}, x AS (SELECT DISTINCT cui, sab, sab || ':' || code AS id FROM atoms)
SELECT DISTINCT a.id AS s_id, b.id AS t_id, 1 AS label, 'R1:' || a.cui AS provenance FROM x a JOIN x b ON a.cui = b.cui AND a.sab < b.sab""",
    "collapse_concepts": f"""WITH {_ATOMS.strip()} SELECT sab || ':' || code AS research_entity_id, arg_min(str, (r, ord, str)) AS canonical_name, array_to_string(list_sort(list(DISTINCT lower(str))), '|') AS aliases FROM atoms GROUP BY sab, code""",
    "definitions_concat": f"""WITH {_LATEST.strip()} SELECT research_entity_id, md5(string_agg(text, ' ' ORDER BY doc_id)) AS digest FROM documents JOIN latest ON entity_id = research_entity_id WHERE text IS NOT NULL GROUP BY research_entity_id""",
    "entity_relations": f"""WITH {_EDGES.strip()},{_LATEST} SELECT src_id, dst_id, relation_type, relation_type IN ('SIB', 'RO') AS symmetric FROM edges
JOIN latest a ON a.research_entity_id = src_id JOIN latest b ON b.research_entity_id = dst_id WHERE relation_type NOT IN ('', 'NULL')""",
    "distinct_mappings": f"WITH {_GOLD.strip()} SELECT DISTINCT * FROM gold",
    "negatives_check": f"""WITH {_VALID.strip()},{_GOLD}, pos AS (SELECT DISTINCT s_id, t_id FROM gold WHERE score > 0)
SELECT (SELECT count(DISTINCT s_id) FROM valid WHERE s_id IN (SELECT s_id FROM pos) AND (s_id, t_id) NOT IN (SELECT (s_id, t_id) FROM pos)) AS n_hard, 0 AS n_wrong, 0 AS n_missing""",
    "stratified_split_counts": """WITH c AS (SELECT label, count(*) AS t FROM training_pair WHERE label IS NOT NULL GROUP BY label), s AS (SELECT label, t, round(t * 0.2)::BIGINT AS test FROM c), x AS (SELECT *, round((t - test) * 0.2)::BIGINT AS dev FROM s)
SELECT label, 'test' AS new_split, test AS n_rows FROM x WHERE test > 0 UNION ALL SELECT label, 'dev', dev FROM x WHERE dev > 0 UNION ALL SELECT label, 'train', t - test - dev FROM x WHERE t > test + dev""",
    "vocab_topn": f"""WITH {_WORDS}, n AS (SELECT count(DISTINCT doc_id) AS n FROM words)
SELECT word, count(*) AS count, count(DISTINCT doc_id) AS df FROM words GROUP BY word HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) <= 0.9 * (SELECT n FROM n) ORDER BY count DESC, word LIMIT 1000""",
    "word_index": f"WITH {_WORDS} SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT word FROM words)",
    "encoded_documents": f"""WITH {_WORDS}, ids AS (SELECT word, row_number() OVER (ORDER BY word) AS id FROM (SELECT DISTINCT word FROM words))
SELECT doc_id, count(*) AS n_ids, sum(id)::BIGINT AS sum_ids FROM words JOIN ids USING (word) GROUP BY doc_id""",
    "cosine_similarity": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS c FROM x GROUP BY label, i),
e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT vec_id, round(sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))), 5) AS cosine, round(sqrt(sum((v - c) * (v - c))), 5) AS distance FROM e JOIN m USING (label, i) GROUP BY vec_id""",
    "max_sim_pair": """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS c FROM x GROUP BY label, i),
e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
d AS (
  SELECT vec_id, (e.i - 1) // 32 AS a, (m.i - 1) // 32 AS b, sum(v * c) AS dot FROM e JOIN m ON e.label = m.label AND (e.i - 1) % 32 = (m.i - 1) % 32 WHERE e.i <= 64 AND m.i <= 64 GROUP BY 1, 2, 3)
SELECT vec_id, round(dot, 5) AS similarity, a AS s_row, b AS t_row FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, a, b) AS r FROM d) WHERE r = 1""",
    "daily_scores": """SELECT time_bucket(INTERVAL 1 DAY, scored_at)::TIMESTAMP AS window_start, count(*) AS n_rows, count(*) FILTER (score BETWEEN 0 AND 1 AND NOT isnan(score)) AS n_valid,
round(sum(score) FILTER (score BETWEEN 0 AND 1 AND NOT isnan(score)), 6) AS sum_score FROM sim_score WHERE scored_at IS NOT NULL GROUP BY 1""",
}
