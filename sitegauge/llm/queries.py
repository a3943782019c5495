"""Registered queries of the corpus operators, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm import (exact_dedup, hnsw, html_text, license_scan, max_sketch, mixing, packing, pii, quality, simhash, token_files,
                           url_filter, wavelet_fim)
from sitegauge.session import scratch_path

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(run: Plan) -> Plan:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query(r"""
    WITH RECURSIVE urls AS (
        SELECT page_id, html, url,
               CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    parts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM urls),
    judged AS (
        SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
        FROM parts),
    rules(rule_host, rule_path, block) AS (VALUES ('org', '/', false), ('example.org', '/es/', true),
        ('example.org', '/en/1', true), ('com', '/fr/', false), ('com', '/de/', true)),
    fitting AS (
        SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
               arg_max(block, length(rule_host || rule_path)) AS block
        FROM judged JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY page_id)
    -- The given pages hold no canonical or refresh link, so no verdict is inherited.
    SELECT page_id, host, path, rule, CASE WHEN block THEN 'block' ELSE 'allow' END AS verdict
    FROM judged LEFT JOIN fitting USING (page_id)""")
def op1_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.page_edges(pages), keep=["page_id"])


@query(r"""
    WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                      sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
               FROM documents),
    w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256
          FROM t)
    SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM w""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.resolve(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("sources", F.array("source"))
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", F.col("source_size"), "target", "taken")


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


@query()
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query()
def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return hnsw.search(hnsw.build_index(vectors), vectors.filter("vec_id % 20 = 0"))


#: Stands in for a secret that a cluster would read from its own store.
PII_KEY = "sitegauge"


@query()
def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY, ["doc_id"])


@query(r"""
    WITH terms AS (
        SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
    counts AS (SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY row, term),
    sizes AS (SELECT row, any_value(doc_id) AS doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY row),
    totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
    weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
    asked AS (
        SELECT item, item_id, term, count(*) AS repeats
        FROM (SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
              FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark))
        GROUP BY item, item_id, term),
    scored AS (
        SELECT item, any_value(item_id) AS item_id, row, any_value(counts.doc_id) AS doc_id,
               sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
        FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (row), totals
        GROUP BY item, row),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""")
def op11_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return max_sketch.search(docs, max_sketch.build_index(docs), table(spark, sf_dir, "benchmark"))


def _templates_sql() -> str:
    rows = (f"({i}, '{t.label}', {list(t.words)}, {t.k}, {t.gap}, {t.share}, {str(t.base).lower()})" for i, t in enumerate(license_scan.TEMPLATES))
    return ", ".join(rows)


@query(r"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    templates(t, label, words, k, gap, share, base) AS (VALUES %s),
    grams AS (SELECT t, k, unnest(range(0, len(words) - k + 1)) AS spot, words FROM templates),
    runs AS (SELECT t, k, spot, words[spot + 1:spot + k] AS run FROM grams),
    texts AS (SELECT row, unnest(range(0, len(w))) AS place, w FROM docs),
    seen AS (SELECT row, place, k, w[place + 1:place + k] AS run FROM texts, (SELECT DISTINCT k FROM templates)),
    votes AS (SELECT DISTINCT row, t, place - spot AS diagonal, spot FROM seen JOIN runs USING (k, run)),
    diagonals AS (SELECT DISTINCT row, t, diagonal FROM votes),
    apart AS (
        SELECT row, t, diagonal, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY row, t ORDER BY diagonal) > gap, true)::INT AS new
        FROM diagonals JOIN templates USING (t)),
    numbered AS (SELECT row, t, diagonal, sum(new) OVER (PARTITION BY row, t ORDER BY diagonal) AS span FROM apart),
    merged AS (
        SELECT row, t, span, min(diagonal + spot) AS first, max(diagonal + spot) AS final, count(DISTINCT spot) AS held
        FROM votes JOIN numbered USING (row, t, diagonal) GROUP BY row, t, span),
    judged AS (
        SELECT row, label, first, base, held / (len(words) - k + 1) AS found,
               held / (len(words) - k + 1) >= share AND final + k - 1 - first < 2 * len(words) AS verified
        FROM merged JOIN templates USING (t)),
    by_row AS (
        SELECT row, count(*) FILTER (base AND verified) AS n_base, min(first) FILTER (base AND verified) AS first_word,
               max(first) FILTER (base AND verified) AS last_word,
               coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base AND verified)), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (verified)), ','), '') AS labels, max(found) AS score
        FROM judged GROUP BY row)
    SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM docs LEFT JOIN by_row USING (row)""" % _templates_sql())
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query(r"""
    WITH docs AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
               sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS drawn
        FROM documents),
    hashed AS (SELECT *, len(lines) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(drawn, i, 8))::BIGINT) AS h FROM docs),
    cut AS (
        SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                    WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM hashed),
    parts AS (
        SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle,
               coalesce(array_to_string(lines[b + 1:], ''), '') AS suffix
        FROM cut)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts""")
def op13_wavelet_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = wavelet_fim.transform(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(wavelet_fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
