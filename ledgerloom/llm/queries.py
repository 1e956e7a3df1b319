"""The queries opN_<name> over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


_OP10_WORDS = r"list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
# The windows' distinct words and, for each place of one in a document, the words of the window that stand up to it in as
# many words as a match may have. Where these are all, the least span starts at the first of their last places.
_NEAR_WITH = """
wt AS MATERIALIZED (SELECT g, n, unnest(list_distinct(string_split(g, ' '))) t, len(list_distinct(string_split(g, ' '))) k FROM sizes),
dw AS MATERIALIZED (SELECT r, generate_subscripts(w, 1) s, unnest(w) t FROM d),
dt AS (SELECT DISTINCT r, t FROM dw),
rg AS MATERIALIZED (SELECT r, g FROM dt JOIN wt USING (t) GROUP BY r, g, k HAVING count(*) = k),
tw AS MATERIALIZED (SELECT rg.r, g, n, k, wt.t, s FROM rg JOIN wt USING (g) JOIN dw ON dw.r = rg.r AND dw.t = wt.t),
e AS (SELECT a.r, a.g, a.s, a.k, b.t, max(b.s) l FROM tw a JOIN tw b ON a.r = b.r AND a.g = b.g AND b.s BETWEEN a.s - a.n - 4 AND a.s GROUP BY a.r, a.g, a.s, a.k, b.t),
q AS MATERIALIZED (SELECT r, g, s, min(l) b FROM e GROUP BY r, g, s, k HAVING count(*) = k),
nh AS (SELECT r, count(DISTINCT x) n_near FROM (SELECT r, unnest(range(b, s + 1)) x FROM q) GROUP BY r),
nm AS (SELECT r, count(*) n_near_items, sha256(string_agg(v, ',' ORDER BY v)) nh FROM (SELECT DISTINCT q.r, CAST(iw.item_id AS VARCHAR) v FROM q JOIN iw USING (g)) GROUP BY r)"""
_OP10_WITH = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, {_OP10_WORDS.format('text')} w FROM documents),
i AS (SELECT item_id, {_OP10_WORDS.format('text')} w FROM benchmark),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT g, len(string_split(g, ' ')) n FROM iw),"""
_OP10_EXACT = """
ns AS (SELECT DISTINCT n FROM sizes),
p AS (SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) s FROM d, ns WHERE len(w) >= n)),
f AS MATERIALIZED (SELECT p.r, p.s, p.g, p.n FROM p JOIN sizes USING (g, n)),
h AS (SELECT r, count(DISTINCT x) n_hit FROM (SELECT r, unnest(range(s, s + n)) x FROM f) GROUP BY r),
m AS (SELECT r, count(*) n_items, sha256(string_agg(v, ',' ORDER BY v)) h FROM (SELECT DISTINCT f.r, CAST(iw.item_id AS VARCHAR) v FROM f JOIN iw USING (g)) GROUP BY r)"""
_NEAR_COLUMNS = """CAST(coalesce(n_near, 0) AS BIGINT) n_near, CAST(coalesce(n_near_items, 0) AS BIGINT) n_near_items,
  coalesce(nm.nh, sha256('')) near_items_sha256, coalesce(n_near, 0) > 0 near"""
_OP10_SQL = f"""{_OP10_WITH}{_OP10_EXACT},{_NEAR_WITH}
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  coalesce(m.h, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, {_NEAR_COLUMNS}
FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r) LEFT JOIN nh USING (r) LEFT JOIN nm USING (r)
"""
_NEAR_SQL = f"""{_OP10_WITH}{_NEAR_WITH}
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, {_NEAR_COLUMNS} FROM d LEFT JOIN nh USING (r) LEFT JOIN nm USING (r)
"""


def _items(column: str, n: str, name: str):
    return F.size(column).cast("long").alias(n), F.sha2(F.array_join(column, ","), 256).alias(name)


@query(_OP10_SQL)
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches in the columns first named, then proximity matches."""
    from .decontaminate import matched_documents

    found = matched_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    exact = ("n_words", "n_hit", *_items("items", "n_items", "items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    return found.select("doc_id", *exact, "n_near", *_items("near_items", "n_near_items", "near_items_sha256"), (F.col("n_near") > 0).alias("near"))


@query(_NEAR_SQL)
def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proximity matches alone."""
    from .decontaminate import near_documents

    found = near_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.col("n_hit").alias("n_near"), *_items("items", "n_near_items", "near_items_sha256"), (F.col("n_hit") > 0).alias("near"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learned, train_on_learned

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = train_on_learned(docs, table(spark, sf_dir, "labels")).scores(docs)
    return scored.select("doc_id", (~learned(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _spelled(spans: str, order: tuple[str, ...], only: tuple[str, ...] | None = None):
    """kind:start:end of a span column, comma-joined."""
    rows = F.col(spans) if only is None else F.filter(spans, lambda s: s.kind.isin(*only))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _number(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    base = ("assign", "access", "hex")
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), out="found")
    return found.select("doc_id", *(_number("found", k).alias(f"n_{k}") for k in base), F.sha2(_spelled("found", base, base), 256).alias("base_sha256"), _spelled("found", base).alias("spans"))


@query()
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import SCHEDULES, plan

    return plan(table(spark, sf_dir, "documents"), SCHEDULES).select("doc_id", "size", "source_size", "target", "taken", F.get("passes", F.lit(0))["position"].alias("position")).orderBy("position", "doc_id")


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) "rank", vec_id, score
FROM s QUALIFY "rank" <= 20
"""


@query(_OP6_SQL)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_k

    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Host labels that block where no rule fits.
LISTED_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

_OP8_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END t FROM pages),
h AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) path FROM u),
r(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) rule, arg_max(r.v, length(r.h || r.p)) v
  FROM h JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(string_split(host, '.'), {LISTED_LABELS}) THEN 'block' ELSE 'allow' END) verdict
FROM h LEFT JOIN m USING (page_id)
"""


@query(_OP8_SQL)
def op8_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    labels = spark.createDataFrame([(x,) for x in LISTED_LABELS], "key string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules, labels).select("page_id", "host", "path", "rule", "verdict")


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b.start)
    base = F.transform("base", lambda b: b.label)
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda m: m.score)), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.concat(base, F.transform("found", lambda m: m.label))).alias("labels"), best.alias("score"))


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents")).withColumn("own", F.filter("spans", lambda s: s.base))
    return found.select("doc_id", *(_number("own", k).alias(f"n_{k}") for k in KINDS), F.sha2(_spelled("own", KINDS), 256).alias("base_sha256"), _spelled("spans", KINDS).alias("spans"))


@query()
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    training = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))
    found = score_documents(table(spark, sf_dir, "documents"), training)
    return found.rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(found.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import collapse_runs

    found = collapse_runs(table(spark, sf_dir, "documents"), planted=True)
    text = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    order = F.transform("runs", lambda r: F.struct((-r.length).alias("long"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))
    found = found.withColumn("best", F.array_min(order)).withColumn("spelled", F.array_join(F.transform(F.array_sort(F.transform("runs", lambda r: F.struct(r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))), text), ""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("spelled", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), damaged=True).select("word", "form", "root", "n", "n_near", "form_n")


@query()
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
