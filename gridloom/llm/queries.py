"""The registered queries of the thirteen operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import bestfit, centroids, collocations, decontaminate, licenses, ngram_join, packing, quality, secrets, sharding, topk, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """A tokenizer file the queries use; it belongs to a package all executors have."""
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]

_URL_SQL = """
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/')
      THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/')
      THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op2_url_filter", _URL_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES).drop("url")


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "position",
    )


_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op5_top_k", _TOP_K_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, "vec_id", "embedding")


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(documents, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("toxic_words").alias("n_passages"),
    )


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


@query("op8_licenses")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    usual = secrets.usage(documents)
    forest = secrets.train(secrets.labelled_findings(documents, usual))
    return secrets.find_secrets(documents, usual, forest)


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def _cluster_sql(k: int = 16, size: int = 64, rounds: int = 3) -> str:
    """The rounds of clustering as one statement, a group of subqueries for each."""
    steps = [
        f"""
kept AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {size}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (
  SELECT row_no, vec_id, unnest(range({size})) AS i,
    unnest(list_transform(v, lambda x: floor(64 * x)::BIGINT)) AS x FROM kept),
first AS (
  SELECT row_no, row_number() OVER (
    ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM kept),
m0 AS (SELECT c, i, x FROM cells JOIN first USING (row_no) WHERE c < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""
d{r} AS (
  SELECT row_no, c, sum((cells.x - m{r}.x) * (cells.x - m{r}.x)) AS distance
  FROM cells JOIN m{r} USING (i) GROUP BY row_no, c),
a{r} AS (
  SELECT row_no, min(c) AS c, any_value(distance) AS distance FROM (
    SELECT *, min(distance) OVER (PARTITION BY row_no) AS least FROM d{r})
  WHERE distance = least GROUP BY row_no)"""
        )
        if r < rounds:
            steps.append(
                f"""
s{r} AS (
  SELECT c, i, sum(x) AS total, count(*) AS n FROM cells JOIN a{r} USING (row_no) GROUP BY c, i),
m{r + 1} AS (
  SELECT m.c, m.i, CASE WHEN n IS NULL THEN m.x
    ELSE (total - ((total % n) + n) % n) // n END AS x
  FROM m{r} m LEFT JOIN s{r} s ON m.c = s.c AND m.i = s.i)"""
            )
    steps.append(
        f"""
named AS (
  SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM m{rounds} GROUP BY c)"""
    )
    return f"""
WITH {",".join(steps)}
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance,
  (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (row_no) JOIN named USING (c)
"""


@query("op12_clustering", _cluster_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


_PHRASE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
  FROM worded, (VALUES (1), (2), (3), (4)) sizes(k)),
f AS (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= 30),
candidates AS (SELECT * FROM f WHERE k > 1),
cuts AS (SELECT *, unnest(range(1, k)) AS c FROM candidates),
scored AS (
  SELECT cuts.lang, cuts.g, cuts.k, cuts.a, c, l.a AS l, r.a AS r,
    2000000::HUGEINT * cuts.a // (l.a + r.a) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = cuts.g[1:c]
    JOIN f r ON r.lang = cuts.lang AND r.g = cuts.g[c + 1:cuts.k]),
lowest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_size AS (SELECT *, unnest(range(2, k)) AS s FROM candidates),
inner_at AS (SELECT *, unnest(range(1, k - s + 2)) AS i FROM inner_size),
held AS (SELECT lang, g[i:i + s - 1] AS g, max(a) AS most FROM inner_at GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN held ON held.lang = lowest.lang AND held.g = lowest.g
  WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", _PHRASE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op11_best_fit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_whole(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
