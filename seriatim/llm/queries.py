"""The registered queries of this subpackage, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.llm import divergence, encoding, languages, mixing, negatives, neighbours, packing, quality, repeats, scoring, sharding, simhash, token_counts
from seriatim.llm.shipping import ship
from seriatim.plans.registry import Registry
from seriatim.sources.tables import table

REGISTRY = Registry()

#: The tree of ``documents``: sources in families of five, then language, then source.
TREE = {
    "domain": "'g' || (try_cast(regexp_extract(source, '[0-9]+', 0) AS int) div 5)",
    "lang": "lang",
    "source": "source",
}
#: Weights of languages; every other node weighs 1.
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2}
WEIGHT_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANG_WEIGHTS.items()) + " ELSE 1 END"


def _fill(depth: int) -> str:
    """SQL of one level of the budget tree."""
    names = ["domain", "lang", "source"][:depth]
    above, path = ", ".join(["root", *names[:-1]]), ", ".join(names)
    weight = WEIGHT_SQL if names[-1] == "lang" else "1"
    family = f"PARTITION BY {above}"
    before = f"({family} ORDER BY cap::DOUBLE / weight, {names[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    on = " AND ".join(f"n.{c} = u.{c}" for c in ["root", *names[:-1]])
    return f"""
nodes{depth} AS (
  SELECT n.*, u.budget AS parent
  FROM (SELECT 0 AS root, {path}, sum(cap)::BIGINT AS cap, sum(tokens)::BIGINT AS tokens, {weight} AS weight
        FROM leaves GROUP BY {path}) n JOIN level{depth - 1} u ON {on}),
sums{depth} AS (
  SELECT *, coalesce(sum(cap) OVER {before}, 0)::BIGINT AS cap_before,
         coalesce(sum(weight) OVER {before}, 0)::BIGINT AS weight_before, sum(weight) OVER ({family})::BIGINT AS weight_all
  FROM nodes{depth}),
full{depth} AS (
  SELECT *, (parent - cap_before)::DOUBLE * weight >= cap::DOUBLE * (weight_all - weight_before) AS whole FROM sums{depth}),
left{depth} AS (
  SELECT *, sum(CASE WHEN whole THEN cap ELSE 0 END) OVER ({family})::BIGINT AS cap_full,
         sum(CASE WHEN whole THEN weight ELSE 0 END) OVER ({family})::BIGINT AS weight_full FROM full{depth}),
level{depth} AS (
  SELECT root, {path}, tokens, CASE WHEN whole THEN cap ELSE least(cap,
         floor((parent - cap_full)::DOUBLE * weight / (weight_all - weight_full))::BIGINT) END AS budget FROM left{depth})"""


MIXING_SQL = f"""
WITH words AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         coalesce('g' || (TRY_CAST(regexp_extract(source, '[0-9]+', 0) AS INT) // 5), '') AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::BIGINT AS cap
  FROM words GROUP BY ALL),
level0 AS (
  SELECT 0 AS root, least(floor(sum(tokens)::DOUBLE * 4 / 5)::BIGINT, sum(cap))::BIGINT AS budget FROM leaves),
{_fill(1)}, {_fill(2)}, {_fill(3)},
placed AS (
  SELECT w.*, l.tokens, l.budget, CASE WHEN l.tokens > 0 THEN l.budget // l.tokens ELSE 0 END AS whole,
         md5('17|' || CASE WHEN l.tokens > 0 THEN l.budget // l.tokens ELSE 0 END || '|' || coalesce(doc_id::VARCHAR, '')) AS place
  FROM words w JOIN level3 l USING (domain, lang, source)),
run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed),
taken AS (
  SELECT *, least(whole + CASE WHEN upto <= budget - whole * tokens THEN 1 ELSE 0 END, 2)::BIGINT AS epochs FROM run)
SELECT doc_id, domain, lang, source, n_tokens, epochs, tokens AS leaf_tokens, budget AS leaf_budget
FROM taken WHERE epochs > 0
"""


@REGISTRY.query("op1_scoring")
def op1_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.scored(table(ship(spark), folder, "documents"))


@REGISTRY.query("op2_mixing", MIXING_SQL)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(ship(spark), folder, "documents")
    chosen = mixing.mixed(docs, TREE, {"lang": WEIGHT_SQL}, share=(4, 5), max_epochs=2, seed=17)
    return chosen.drop("_k1", "_k2")


@REGISTRY.query("op3_packing")
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(ship(spark), folder, "documents"))


@REGISTRY.query("op4_sharding")
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(ship(spark), folder, "documents"))


@REGISTRY.query("op5_neighbours")
def op5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(ship(spark), folder, "embeddings"))


@REGISTRY.query("op6_repeats")
def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(ship(spark), folder, "documents"))


@REGISTRY.query("op7_token_counts")
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(ship(spark), folder, "documents"))


@REGISTRY.query("op8_simhash")
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(ship(spark), folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@REGISTRY.query("op9_quality")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(ship(spark), folder, "documents"))


@REGISTRY.query("op10_languages")
def op10_languages(spark: SparkSession, folder: str) -> DataFrame:
    return languages.identified(table(ship(spark), folder, "documents"))


@REGISTRY.query("op11_encoding")
def op11_encoding(spark: SparkSession, folder: str) -> DataFrame:
    found = encoding.decoded(encoding.encoded(table(ship(spark), folder, "documents")))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


NEGATIVES_SQL = """
WITH held AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM held a JOIN held c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@REGISTRY.query("op12_negatives", NEGATIVES_SQL)
def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(ship(spark), folder, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.select("vec_id", "embedding", relabelled.alias("label")))


DIVERGENCE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(t.n, 0) AS total, coalesce(l.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals t USING (lang, source) LEFT JOIN langs l USING (lang)),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + g.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v))::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""


@REGISTRY.query("op13_divergence", DIVERGENCE_SQL)
def op13_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(ship(spark), folder, "documents"))


def queries() -> dict:
    return dict(REGISTRY.queries)


def oracle_sql() -> dict:
    return dict(REGISTRY.oracle)
