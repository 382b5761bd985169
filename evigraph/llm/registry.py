"""The registered query of each operator and, where SQL can say it, the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import decontaminate, exact_dedup, html_extract, katz, mixing, near_dedup, personal_data, quality, secrets, token_count, toxicity, vector_codes, whitening
from evigraph.llm._common import WORD_PATTERN, materialize, table
from evigraph.llm._labelled import id_remainder

#: Weights of the sources, repeated in the order of their names; words wanted as a share of all; most repeats.
MIX_WEIGHTS, MIX_SHARE, MIX_REPEATS = (5, 2, 1), 1.5, 2


def mix_quotas(sizes: dict[str, int]) -> dict[str, float]:
    names = sorted(sizes)
    weights = [MIX_WEIGHTS[i % len(MIX_WEIGHTS)] for i in range(len(names))]
    shares = mixing.water_fill([sizes[n] for n in names], weights, MIX_SHARE * sum(sizes.values()), MIX_REPEATS)
    return {n: round(x, 6) for n, x in zip(names, shares, strict=True)}


def mix_by_source(docs: DataFrame, targets: dict | None = None, size: str | None = None, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """mix_sources over one source a document; a null source is a source of its own, last in order.

    size: the column of a row's words; if None, they are counted in the text (null: none). targets, if given, is filled with
    {source: (size, target)}. Rows without words take part with nothing; rows of equal id and size are alike; an empty table gives an
    empty result. Columns named members, size and taken in the input are replaced.
    """

    def quotas(sizes: dict[str, int]) -> dict[str, int]:
        wanted = mix_quotas(sizes)
        if targets is not None:
            targets.update({n: (sizes[n], wanted[n]) for n in sizes})
        return {n: int(x + 0.5) for n, x in wanted.items()}

    member = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("t"))
    words = F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD_PATTERN)) if size is None else F.col(f"`{size}`")
    return mixing.mix_sources(docs, F.array(member), words, quotas, id_col, repeats=MIX_REPEATS)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("words"))
    targets: dict[str, tuple[int, float]] = {}
    mixed = mix_by_source(materialize(docs, "mix-sizes"), targets, "words")
    by_source = spark.createDataFrame([([n], s, t) for n, (s, t) in targets.items()], "members array<string>, source_size long, target double")
    return mixed.join(F.broadcast(by_source), "members").select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
sources AS (SELECT src, sum(size)::BIGINT AS s FROM sized GROUP BY src),
weighted AS (SELECT src, s, [5, 2, 1][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w FROM sources),
ranked AS (
  SELECT *, sum(2 * s) OVER (ORDER BY 2.0 * s / w, src) AS capped, sum(w) OVER () - sum(w) OVER (ORDER BY 2.0 * s / w, src) AS open_w,
         1.5 * sum(s) OVER () AS total, 2.0 * s / w AS ratio
  FROM weighted),
level AS (SELECT coalesce((SELECT max(ratio) FROM ranked WHERE open_w >= 0 AND capped + open_w * ratio <= total), 0) AS last_capped),
unit AS (
  SELECT (max(total) - coalesce(sum(2 * s) FILTER (WHERE ratio <= last_capped), 0)) / nullif(sum(w) FILTER (WHERE ratio > last_capped), 0) AS u
  FROM ranked, level),
targets AS (
  SELECT src, s, round(CASE WHEN ratio <= last_capped THEN 2.0 * s ELSE w * u END, 6) AS target FROM ranked, level, unit),
placed AS (
  SELECT doc_id, size, s, target, CAST(floor(target + 0.5) AS BIGINT) AS quota,
         coalesce(sum(size) OVER (PARTITION BY src ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN targets USING (src))
SELECT doc_id, size, s AS source_size, target,
       CASE WHEN s = 0 THEN 0 ELSE size * (quota // s) + least(greatest(quota % s - before, 0), size) END::BIGINT AS taken
FROM placed
"""


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", secrets.base_digest().alias("base_sha256"), "spans", "n_novel")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) == 0)


#: Vocabulary whose pieces op6 counts; any sentencepiece model file will do.
TOKENIZER_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER_PATH)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels, id_remainder("doc_id", 3) != 1)
    scored = toxicity.classify(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels, id_remainder("doc_id", 4) != 2)
    scored = quality.classify(docs, model)
    return scored.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in personal_data.KINDS], F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_found")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """A chain of tables: b0 the first entries, a_k the nearest of b_k, b_k+1 the entries after a round. Whole numbers stay below 2^53 in doubles."""
    nearest = "a{k} AS MATERIALIZED (SELECT r, p, min({{'d': list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), 'e': e}}) AS m FROM parts JOIN b{k} USING (p) GROUP BY r, p)"
    refined = """b{j} AS MATERIALIZED (
  SELECT p, e, coalesce(n.c, b{k}.c) AS c FROM b{k} LEFT JOIN (
    SELECT p, e, list(floor(s / k) ORDER BY pos) AS c FROM (
      SELECT p, m.e AS e, pos, sum(x[pos]) AS s, count(*) AS k FROM a{k} JOIN parts USING (r, p), (SELECT unnest(range(1, max(len(x)) + 1)) AS pos FROM parts) WHERE pos <= len(x) GROUP BY ALL)
    GROUP BY ALL) n USING (p, e))"""
    rounds = range(vector_codes.ROUNDS)
    steps = [x for k in rounds for x in (nearest.format(k=k), refined.format(k=k, j=k + 1))] + [nearest.format(k=vector_codes.ROUNDS)]
    last = vector_codes.ROUNDS
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[len(v) * p // 4 + 1:len(v) * (p + 1) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, pos)) AS h FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS pos FROM b{last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (r), digest
"""


OP12_SQL = _codes_sql()


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.select("vec_id", "component", "n", whitening.as_long("deviation"), "whitened", "explained", "identity_error")


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_html_text": op2_html_text,
        "op3_near_dedup": op3_near_dedup,
        "op4_secrets": op4_secrets,
        "op5_katz": op5_katz,
        "op6_token_counts": op6_token_counts,
        "op7_toxicity": op7_toxicity,
        "op8_decontaminate": op8_decontaminate,
        "op9_quality": op9_quality,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_personal_data": op11_personal_data,
        "op12_vector_codes": op12_vector_codes,
        "op13_whitening": op13_whitening,
    }


def oracles() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op10_exact_dedup": OP10_SQL, "op12_vector_codes": OP12_SQL}
