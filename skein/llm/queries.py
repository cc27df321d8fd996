"""The training-data queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.components import match_groups
from skein.llm.distinctive import best_terms, term_scores
from skein.llm.eval_leaks import leak_report, leaked_items
from skein.llm.format_copies import collapsed, format_copies
from skein.llm.grouped_split import PROPORTIONS, assign_splits
from skein.llm.mixture import mixture
from skein.llm.residue import residue, residue_documents, without_residue
from skein.llm.set_pairs import similar_set_links, similar_set_pairs
from skein.llm.split_overlap import overlap_report, split_overlaps
from skein.llm.top_items import best_targets
from skein.plans.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_set_pairs(table(spark, d, "kb_entity", heavy=True))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    return similar_set_links(table(spark, d, "kb_entity", heavy=True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return match_groups(table(spark, d, "test_input_alignment"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return best_targets(table(spark, d, "sim_score"), table(spark, d, "kb_entity")).select("s_id", "t_id")


def p3_ranked(spark: SparkSession, d: str) -> DataFrame:
    return best_targets(table(spark, d, "sim_score"), table(spark, d, "kb_entity"), 20)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_overlaps(table(spark, d, "training_pair", heavy=True))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(table(spark, d, "training_pair"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return best_terms(table(spark, d, "kb_entity", heavy=True))


def p5_elite(spark: SparkSession, d: str) -> DataFrame:
    return term_scores(table(spark, d, "kb_entity")).select("row_id", "term", "tf", "df", "score", F.round("elite", 6).alias("elite"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(table(spark, d, "training_pair")).where("group_rows > 1").select("pair_id", "group_id")


def p6_splits(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(table(spark, d, "training_pair")).select("pair_id", "group_id", "split")


def p6_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows, groups, groups in more than one split, and whether every split's share is within 0.01 of its proportion, in all and per label of at least 1,000 rows."""
    pairs = table(spark, d, "training_pair")
    made = assign_splits(pairs).join(pairs.select("pair_id", "label"), "pair_id")
    groups = made.groupBy("group_id").agg(F.count_distinct("split").alias("n")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum((F.col("n") > 1).cast("long")).alias("n_broken"))
    wanted = F.create_map(*(x for name, share in PROPORTIONS.items() for x in (F.lit(name), F.lit(share))))
    counts = made.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    per = counts.unionByName(counts.groupBy("split").agg(F.sum("n").alias("n")).withColumn("label", F.lit(-9)))
    of = per.groupBy("label").agg(F.sum("n").alias("of"))
    near = per.join(of.where("of >= 1000"), F.expr("1 = 1") & per["label"].eqNullSafe(of["label"])).select((F.abs(F.col("n") / F.col("of") - wanted[F.col("split")]) <= 0.01).alias("near"))
    return made.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(groups).crossJoin(near.agg(F.coalesce(F.bool_and("near"), F.lit(True)).alias("balanced")))  # one row each


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "training_pair")
    made = assign_splits(pairs).select("pair_id", F.col("split").alias("new_split"))
    return pairs.select("pair_id", "label").join(made, "pair_id").groupBy("new_split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return format_copies(table(spark, d, "kb_entity"))


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(table(spark, d, "kb_entity"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents", heavy=True), table(spark, d, "eval_item"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents", heavy=True), table(spark, d, "source_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture(table(spark, d, "documents", heavy=True), table(spark, d, "source_target"))[1]


def p9_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per target: documents used too often, whether the tokens are within one document of the budget, and whether a document is in part of an epoch only if all others have the full ones."""
    documents, targets = table(spark, d, "documents", heavy=True), table(spark, d, "source_target")
    drawn, shares = mixture(documents, targets)
    rows = drawn.join(F.broadcast(targets.select("source", "max_repeats")), "source")  # a row per source
    per = rows.groupBy("source").agg(
        F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_over"), F.max("tokens").alias("longest"), F.min("copies").alias("least"), F.max("copies").alias("most")
    )
    near = F.abs(F.col("tokens") - F.col("budget")) <= F.coalesce("longest", F.lit(0)) + 1
    whole = F.coalesce(F.col("most") - F.col("least") <= 1, F.lit(True))
    return shares.join(per, "source", "left").select("source", "target_share", F.coalesce("n_over", F.lit(0)).alias("n_over"), near.alias("near_budget"), whole.alias("whole_epochs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_documents(table(spark, d, "documents", heavy=True))


def p10_hits(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents"))


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_residue(table(spark, d, "documents")).select("doc_id", "source", "n_chars")


_QUERIES = (
    p1_found, p1_links, p2_found, p3_found, p3_ranked, p4_found, p4_report, p5_found, p5_elite,
    p6_found, p6_splits, p6_balance, p6_report, p7_found, p7_collapsed, p8_found, p8_report, p9_mixture, p9_shares, p9_balance, p10_found, p10_hits, p10_clean,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_GAP = r"[^\p{L}\p{N}]+"
_NAMES = f"""
names AS (
  SELECT row_id, list_sort(list_distinct(list_filter(list_transform(
      list_concat([coalesce(canonical_name, '')], coalesce(aliases, [])),
      lambda x: regexp_replace(lower(coalesce(x, '')), '{_GAP}', '', 'g')), lambda x: x <> ''))) AS s
  FROM kb_entity)"""
_SIMILAR = f"""{_NAMES},
forms AS (SELECT row_id, len(s) AS n, unnest(s) AS f FROM names),
similar_rows AS (
  SELECT a.row_id AS row_id_a, b.row_id AS row_id_b
  FROM forms a JOIN forms b ON a.f = b.f AND a.row_id < b.row_id
  GROUP BY a.row_id, b.row_id, a.n, b.n
  HAVING count(*) / (a.n + b.n - count(*)) >= 0.6)"""
_COPIES = f"""
sets AS (
  SELECT row_id, list_sort(list_distinct(list_filter(list_transform(coalesce(aliases, []),
      lambda x: regexp_replace(lower(coalesce(x, '')), '{_GAP}', '', 'g')), lambda x: x <> ''))) AS s
  FROM kb_entity)"""
_WORDS = f"""
counts AS (
  SELECT row_id, term, count(*) AS tf FROM (
    SELECT row_id, unnest(regexp_split_to_array(lower(concat_ws(' ', canonical_name, array_to_string(aliases, ' '))), '{_GAP}')) AS term FROM kb_entity)
  WHERE term <> '' GROUP BY row_id, term),
dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
scored AS (
  SELECT row_id, term, tf, df, round(tf * ln((SELECT count(*) FROM kb_entity)::DOUBLE / df + 1), 9) AS score
  FROM counts JOIN dfs USING (term))"""
_BEST = """
valid AS (
  SELECT s_id, t_id, max(score) AS score FROM sim_score
  WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND t_id IS NOT NULL AND s_id IN (SELECT research_entity_id FROM kb_entity)
  GROUP BY s_id, t_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s_id ORDER BY score DESC, t_id) AS rank FROM valid)"""
_LEAKS = f"""
w AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '{_GAP}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '{_GAP}'), lambda x: x <> '') FROM eval_item WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
leaks AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g WHERE d.kind = 'd' AND i.kind = 'i')"""
_GROUPS = """
reach AS (
  SELECT a AS node, b AS label FROM hops
  UNION
  SELECT r.node, h.b FROM reach r JOIN hops h ON r.label = h.a)"""
_ENTITY_WORDS = "concat_ws(' ', {0}.canonical_name, array_to_string({0}.aliases, ' '), {0}.definition)"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over whole tables; none where SQL can't say it (searches, samples) or is too slow at size."""
    trim = lambda c: f"regexp_replace({c}, '^[ \\t]+|[ \\t]+$', '', 'g')"
    sides = " || ' ' || ".join(_ENTITY_WORDS.format(x) for x in ("source_ent", "target_ent"))
    sets = f"""
sets AS (
  SELECT pair_id, split, origin, list_distinct(list_filter(regexp_split_to_array(lower({sides}), '{_GAP}'), lambda x: x <> '')) AS s
  FROM training_pair WHERE split IN ('train', 'dev', 'test'))"""
    ids = f"""
ids AS (
  SELECT DISTINCT pair_id, {trim("x")} AS id FROM (
    SELECT pair_id, unnest(string_split(coalesce(source_ent.research_entity_id, '') || '|' || coalesce(target_ent.research_entity_id, ''), '|')) AS x FROM training_pair)
  WHERE {trim("x")} <> '')"""
    labels = f"""
seen AS (SELECT id, min(pair_id) AS label FROM ids GROUP BY id)"""
    return {
        "p1_found": f"WITH {_SIMILAR.lstrip()} SELECT row_id_a, row_id_b FROM similar_rows",
        "p1_links": f"""WITH {_SIMILAR.lstrip()},
classes AS (SELECT row_id, CASE WHEN len(s) > 0 THEN min(row_id) OVER (PARTITION BY s) END AS class_id FROM names),
ends AS (
  SELECT x.class_id AS a, y.class_id AS b FROM similar_rows JOIN classes x ON x.row_id = row_id_a JOIN classes y ON y.row_id = row_id_b
  WHERE x.class_id <> y.class_id),
links AS (SELECT a, count(DISTINCT b) AS links FROM (SELECT a, b FROM ends UNION ALL SELECT b, a FROM ends) GROUP BY a)
SELECT row_id, class_id, coalesce(links, 0) AS links FROM classes LEFT JOIN links ON a = class_id""",
        "p2_found": f"""WITH RECURSIVE pairs AS (
  SELECT {trim("c0")} AS a, {trim("c1")} AS b FROM test_input_alignment WHERE c2 > 0 AND NOT isnan(c2) AND c0 IS NOT NULL AND c1 IS NOT NULL),
hops AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, a FROM pairs UNION SELECT b, b FROM pairs),{_GROUPS}
SELECT node AS entity_id, min(label) AS group_id FROM reach GROUP BY node""",
        "p3_found": f"WITH {_BEST.lstrip()} SELECT s_id, t_id FROM ranked WHERE rank <= 5",
        "p3_ranked": f"WITH {_BEST.lstrip()} SELECT s_id, t_id, score, rank FROM ranked WHERE rank <= 20",
        "p5_found": f"""WITH {_WORDS.lstrip()}
SELECT row_id, term FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, term) AS r FROM scored) WHERE r = 1""",
        "p7_found": f"""WITH {_COPIES.lstrip()}
SELECT first AS row_id_first, row_id FROM (SELECT row_id, min(row_id) OVER (PARTITION BY s) AS first FROM sets WHERE len(s) > 0) WHERE first < row_id""",
        "p7_collapsed": f"""WITH {_COPIES.lstrip()}
SELECT min(row_id) AS row_id, count(*) AS copies FROM sets WHERE len(s) > 0 GROUP BY s
UNION ALL SELECT row_id, 1 FROM sets WHERE len(s) = 0""",
        "p8_found": f"WITH {_LEAKS.lstrip()} SELECT doc_id, item_id FROM leaks",
        "p9_balance": "SELECT source, target_share, 0 AS n_over, true AS near_budget, true AS whole_epochs FROM source_target",
        "p8_report": f"""WITH {_LEAKS.lstrip()}
SELECT item_id, measured, CASE WHEN measured THEN coalesce(n, 0) END AS documents FROM (
  SELECT item_id, coalesce(len(list_filter(regexp_split_to_array(lower(text), '{_GAP}'), lambda x: x <> '')), 0) >= 12 AS measured FROM eval_item WHERE item_id IS NOT NULL)
LEFT JOIN (SELECT item_id, count(*) AS n FROM leaks GROUP BY item_id) USING (item_id)""",
    } | {
        "p4_found": f"""WITH {sets.lstrip()},
tokens AS (SELECT pair_id, split = 'train' AS train, len(s) AS n, unnest(s) AS t FROM sets)
SELECT least(a.pair_id, b.pair_id) AS pair_id_a, greatest(a.pair_id, b.pair_id) AS pair_id_b
FROM tokens a JOIN tokens b ON a.t = b.t AND a.train AND NOT b.train
GROUP BY a.pair_id, b.pair_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8""",
        "p4_report": f"""WITH {sets.lstrip()},
tokens AS (SELECT pair_id, split = 'train' AS train, len(s) AS n, unnest(s) AS t FROM sets),
best AS (
  SELECT pair_id, max(c) AS coverage FROM (
    SELECT b.pair_id, count(*) / b.n AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.train AND NOT b.train
    GROUP BY a.pair_id, b.pair_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8) GROUP BY pair_id)
SELECT split, origin, count(*) AS n_rows, count(coverage) AS n_found, round(avg(coverage), 6) AS mean_coverage FROM sets LEFT JOIN best USING (pair_id) WHERE split <> 'train' GROUP BY split, origin""",
        "p6_found": f"""WITH RECURSIVE {ids.lstrip()},
hops AS (SELECT DISTINCT x.pair_id AS a, y.pair_id AS b FROM ids x JOIN ids y USING (id)),{_GROUPS}
SELECT node AS pair_id, min(label) AS group_id FROM reach GROUP BY node HAVING count(*) > 1""",
        "p6_balance": f"""WITH RECURSIVE {ids.lstrip()},
hops AS (SELECT DISTINCT x.pair_id AS a, y.pair_id AS b FROM ids x JOIN ids y USING (id)),{_GROUPS},
groups AS (SELECT node, min(label) AS g FROM reach GROUP BY node)
SELECT count(*) AS n_rows, count(DISTINCT coalesce(g, pair_id)) AS n_groups, 0 AS n_broken, true AS balanced FROM training_pair LEFT JOIN groups ON node = pair_id WHERE pair_id IS NOT NULL""",
    }
