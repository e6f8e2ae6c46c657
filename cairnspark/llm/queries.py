"""The numbered queries on the test tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import (
    decontaminate,
    langid,
    lexical,
    lmscore,
    neighbours,
    packing,
    pagetext,
    pii,
    quality,
    simhash,
    spelling,
    subwords,
    toxicity,
)
from cairnspark.llm.text import part_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable:
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decided(scored: DataFrame, held_out, least: float) -> DataFrame:
    """doc_id, held_out, score and predicted: 1 from the score ``least`` on."""
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


#: Rows with this remainder of crc32(doc_id) modulo 5 are never learnt from.
QUALITY_LEAST = 0.3


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(part_of("doc_id", 5) != 0)
    model = quality.fit(documents, labels)
    return decided(quality.score(documents, model, to="score"), part_of("doc_id", 5) == 0, QUALITY_LEAST)


TOXICITY_LEAST = 0.7


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(part_of("doc_id", 3) != 1)
    model = toxicity.fit(documents, labels)
    return decided(toxicity.score(documents, model, to="score"), part_of("doc_id", 3) == 1, TOXICITY_LEAST)


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    models = langid.fit(documents.where(part_of("doc_id", 5) != 0))
    found = langid.identify(documents.select("doc_id", "text"), models)
    return found.select(
        "doc_id", (part_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_bits", "lang_rejected"
    )


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_equal", "doc_word", "item_word")


def _told(spans: str):
    """``kind:start:end`` of the spans, which are in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.fit(documents)).select("doc_id", "pii.base", "pii.spans")
    counts = {f"n_{k}": F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long") for k in pii.KINDS}
    return found.select(
        "doc_id",
        *(count.alias(name) for name, count in counts.items()),
        F.sha2(_told("base"), 256).alias("base_sha256"),
        _told("spans").alias("spans"),
    )


def piece_model() -> str:
    """Path of the installed vocabulary file; it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return subwords.token_digests(documents, piece_model()).select("doc_id", "tokens.*")


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pagetext.extract(pages).select("page_id", "url", "main.text", "main.n_chars")


@query("op2_nearest_neighbours")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def word_vocabulary() -> str:
    """Path of the installed vocabulary file; it is not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary())
    return placed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


SEARCH_ORACLE = """
WITH places AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM documents),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM places GROUP BY 1),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM places WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, corpus GROUP BY 1),
levels AS (SELECT doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM lengths, corpus),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN levels USING (doc_id) GROUP BY 1, 2),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_ranked_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return lexical.search(documents.select("doc_id", "text"), items.select("item_id", "text"))


ORACLES["op13_ranked_search"] = SEARCH_ORACLE.strip()


LM_ORACLE = """
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
places AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM tokens),
runs AS (
  SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM places),
one AS (SELECT w, count(*) AS c FROM places GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM runs WHERE v IS NOT NULL GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM runs WHERE u IS NOT NULL GROUP BY u, v, w),
scored AS (
  SELECT runs.doc_id,
    CASE WHEN runs.u IS NOT NULL THEN three.c WHEN runs.v IS NOT NULL THEN two.c ELSE own.c END AS longest,
    CASE WHEN runs.u IS NOT NULL THEN ln(three.c) - ln(context.c)
         WHEN runs.v IS NOT NULL THEN ln(two.c) - ln(before.c)
         ELSE ln(own.c) - ln((SELECT count(*) FROM places)) END AS s
  FROM runs JOIN one AS own ON own.w = runs.w LEFT JOIN one AS before ON before.w = runs.v
    LEFT JOIN two ON two.v = runs.v AND two.w = runs.w
    LEFT JOIN two AS context ON context.v = runs.u AND context.w = runs.v
    LEFT JOIN three ON three.u = runs.u AND three.v = runs.v AND three.w = runs.w)
SELECT tokens.doc_id, CAST(len(any_value(tokens.w)) AS BIGINT) AS n_words,
  CAST(count(*) FILTER (WHERE scored.longest > 1) AS BIGINT) AS n_repeated,
  round(coalesce(sum(scored.s), 0), 3) AS log_score
FROM tokens LEFT JOIN scored ON scored.doc_id = tokens.doc_id GROUP BY tokens.doc_id
"""


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lmscore.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "n_repeated", F.round("log_score", 3).alias("log_score"))


ORACLES["op6_lm_scoring"] = LM_ORACLE.strip()
