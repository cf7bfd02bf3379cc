"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, html_extract, merkle, near_dedup, packing, periodic, pieces, pii, ppm, secret_scan, toxicity, url_filter
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("listed")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"), across=True)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents repeat a stretch of their own words to their end."""
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    chosen = docs.where("h % 10 = 0").withColumn("words", words)
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    chosen = chosen.where(n > 0).withColumn("a", (g % n).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    repeated = F.array_join(F.transform(place, lambda i: F.get("words", i)), " ")
    rest = docs.where((F.coalesce(F.col("h"), F.lit(1)) % 10 != 0) | (F.coalesce(F.size(words), F.lit(0)) <= 0))
    return chosen.select("doc_id", repeated.alias("text")).unionByName(rest.select("doc_id", "text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), "runs", "collapsed")
    told = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    received = F.when(tampered, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), received={"text": received})
    found = found.withColumn("folded_root", merkle.folded(F.col("received_leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.BASE]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds], F.sha2(_joined_spans(base), 256).alias("base_sha256"), _joined_spans(F.col("spans")).alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP5_SQL = """
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"


def _op2_sql() -> str:
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1]))
    parts = [(verdict, text, _FITS.format(text.partition("/")[0], "/" + text.partition("/")[2])) for verdict, text in ordered]
    rule = " ".join(f"WHEN {fits} THEN '{text}'" for _, text, fits in parts)
    verdict = " ".join(f"WHEN {fits} THEN '{what}'" for what, _, fits in parts)
    listed = " OR ".join(f"host = '{k}' OR ends_with(host, '.{k}')" for k in url_filter.LISTED)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
       CASE {verdict} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict
FROM b
"""


def crc32_sql(text: str) -> str:
    bits = f"flatten(list_transform(string_split({text}, ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch)::BIGINT >> k::INT) & 1)))"
    return f"xor(list_reduce([4294967295::BIGINT] || {bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def _tree_sql(name: str, leaves: str, heights: int) -> str:
    """Levels of the trees in table ``leaves`` (tree, i, d), to a table of (tree, d, n) and one of each level's runs."""
    parts, last = [f"{name}0 AS (SELECT tree, i, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"], f"{name}0"
    for h in range(heights):
        parts.append(f"{name}g{h} AS (SELECT tree, i // 8 AS g, max(n) AS n, string_agg(d, '' ORDER BY i) AS s FROM {last} GROUP BY tree, i // 8)")
        last = f"{name}{h + 1}"
        parts.append(f"{last} AS (SELECT tree, g AS i, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS d, count(*) OVER (PARTITION BY tree) AS n FROM {name}g{h})")
    return ",\n".join(parts)


def _walk_sql(name: str, first: str, heights: int) -> str:
    """From rows (tree, i, f, proof and others) the folded digest and the proof through all levels."""
    parts, last = [], first
    for h in range(heights):
        at, own = f"64 * (x.i // {8**h} % 8)", f"{name}w{h}"
        parts.append(f"{own} AS (SELECT x.* EXCLUDE (f, proof), CASE WHEN r.n > 1 THEN sha256(substr(r.s, 1, {at}) || x.f || substr(r.s, {at} + 65)) ELSE x.f END AS f, CASE WHEN r.n > 1 THEN x.proof || substr(r.s, 1, {at}) || substr(r.s, {at} + 65) ELSE x.proof END AS proof FROM {last} x JOIN {name}g{h} r ON r.tree = x.tree AND r.g = x.i // {8 ** (h + 1)})")
        last = own
    return ",\n".join(parts)


def _op12_sql(lower: int = 8, upper: int = 4) -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    digest = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    changed = f"CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    return f"""
WITH a AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {digest("text")} AS d, {digest(changed)} AS f FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM a),
{_tree_sql("l", "b", lower)},
subroots AS (SELECT '' AS tree, tree AS name, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS i FROM l{lower}),
{_tree_sql("u", "subroots", upper)},
start AS (SELECT doc_id, tree, i, d AS leaf, f, '' AS proof FROM b),
{_walk_sql("l", "start", lower)},
middle AS (SELECT w.doc_id, w.leaf, s.d AS subroot, '' AS tree, s.i, w.f, w.proof FROM lw{lower - 1} w JOIN subroots s ON s.name = w.tree),
{_walk_sql("u", "middle", upper)}
SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified
FROM uw{upper - 1} w CROSS JOIN u{upper} r
"""


def _op13_sql() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT doc_id, '{r.kind}' AS kind, {nth} AS nth, {r.least} AS least, regexp_extract_all(t, {quoted(r.pattern)}) AS ms, regexp_extract_all(t, {quoted(f'{r.head}({r.letters}{{{r.first},}})')}, {r.head.count('(') + 1}) AS vs, regexp_split_to_array(t, {quoted(r.pattern)}) AS gaps FROM d"
        for nth, r in enumerate(secret_scan.RULES)
    )
    kinds = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0) AS n_{r.kind}" for r in secret_scan.BASE)
    one = "kind || ':' || s || ':' || (s + length(m))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM f),
p AS (SELECT doc_id, kind, nth, least, ms[i] AS m, vs[i] AS v, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM e),
k AS (SELECT * FROM p WHERE length(v) >= least),
r AS (SELECT doc_id, {counts}, string_agg({one}, ',' ORDER BY s, nth) FILTER (kind IN ({kinds})) AS base, string_agg({one}, ',' ORDER BY s, nth) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_url_filters, op3_embedding_near_dedup, op4_pii, op5_exact_dedup, op6_packing, op7_lm_scoring, op8_sentencepiece, op9_toxicity, op10_html_extraction, op11_periodic_runs, op12_merkle_manifest, op13_secret_scan, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _op2_sql(), "op5_exact_dedup": OP5_SQL, "op12_merkle_manifest": _op12_sql(), "op13_secret_scan": _op13_sql()}
