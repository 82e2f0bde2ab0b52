"""One named query per operator over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringmill.queries.registry import Query, table

from . import bpe_codec, chunks, id_files, infill, kneser_ney, language, licences, minhash, mixture, neighbours, quality, substrings, vector_codes
from .base import crc_bucket

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL where one exists."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.decode(bpe_codec.encode(docs).drop("text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_bucket("doc_id", 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query(
    r"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM docs),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
    FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = d.doc_id
    """
)
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), n=3, percent=85)


@query()
def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.taken(*mixture.mix_sources(table(spark, sf_dir, "documents"))).drop("source")


@query(
    r"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM docs)),
    hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM docs),
    last AS (SELECT w.doc_id, w.j, w.word, max(h.i) OVER (PARTITION BY w.doc_id ORDER BY w.j) AS i FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.i = w.j),
    told AS (SELECT doc_id, j, word, coalesce(i >= j - 34, false) AS gone FROM last)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
    FROM docs d LEFT JOIN (
        SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS k FROM told GROUP BY doc_id) t USING (doc_id)
    """
)
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"), n=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.fit(docs.where(crc_bucket("doc_id", 10) != 0))
    return kneser_ney.score(docs, model).withColumn("held_out", crc_bucket("doc_id", 10) == 0)


@query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(crc_bucket("doc_id", 3) != 1))
    found = language.predict(docs, model).withColumn("n_spans", F.size("spans"))
    return found.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_spans")


@query()
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"))


@query()
def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.write_and_read(table(spark, sf_dir, "documents"), ids=False)


@query(
    r"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d FROM documents),
    drawn AS (
        SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
               list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(d, i, 8))::BIGINT) AS h
        FROM docs),
    cuts AS (
        SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn),
    parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """
)
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.restored(infill.rearranged(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def _codebook_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of exact assignment and floored means over all rows; squares stay below 2**53, so doubles are exact."""
    nearest = """
    a{r} AS MATERIALIZED (
        SELECT vec_id, part, x, unnest(arg_min(e, [d, e::DOUBLE], 1)) AS e, min(d) AS d
        FROM (SELECT vec_id, part, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts JOIN b{r} USING (part))
        GROUP BY vec_id, part, x)"""
    means = """
    b{n} AS MATERIALIZED (
        SELECT part, e, coalesce(m, c) AS c
        FROM b{r} LEFT JOIN (
            SELECT part, e, list(m ORDER BY i) AS m
            FROM (SELECT part, e, i, floor(sum(x[i]) / count(*)) AS m FROM a{r}, range(1, len(x) + 1) AS t(i) GROUP BY part, e, i)
            GROUP BY part, e) USING (part, e))"""
    steps = [nearest.format(r=0)]
    for r in range(rounds):
        steps += [means.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    return f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) AS t(p)),
    b0 AS MATERIALIZED (
        SELECT part, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries}) USING (vec_id)),
    {",".join(steps)},
    digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS h FROM b{rounds}),
    coded AS (
        SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id), digest
    """


@query(_codebook_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


@query()
def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.summary(licences.scanned(table(spark, sf_dir, "documents")))
