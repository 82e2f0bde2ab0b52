"""Pieces, vocabularies, encodings and n-gram scores of texts and template strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pieces import PATTERNS, pretokenize
from ..operators import ngrams
from ..operators import vocab as ops
from ..operators.tokenizers.bpe import train_bpe, train_wordpiece
from ..operators.tokenizers.encode import (
    decode,
    encode,
    encode_wordlevel_join,
    length_buckets as bucketed,
    raw_ids,
    roundtrip_report as not_restored,
)
from ..operators.tokenizers.grid import tokenizer_grid as train_grid
from ..operators.tokenizers.model import PREFIX, model_vocab_size, wordlevel_model
from ..operators.tokenizers.unigram import train_unigram
from ..plans.tokenized import build_tokenized_dataset
from ..sources.shared import cut_lineage, spread
from . import samples, templates
from .registry import query, table

# Prose holds the default marks as characters, so these queries use marks of their own.
SPECIALS = ("<s>", "</s>", "<pad>", "<unk>", "<add>")
_SPECIAL_ROWS = "VALUES ('<s>', 0), ('</s>', 1), ('<pad>', 2), ('<unk>', 3), ('<add>', 4)"


def _cut(text: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return (
        f"list_filter(string_split(regexp_replace({text}, '({quoted})', chr(1) || '\\1' || chr(1), 'g'), chr(1)),"
        " lambda p: p <> '')"
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(samples.documents(spark, sf_dir).select("ord", "item"))


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.generated(spark, sf_dir).select(F.col("template").alias("item"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("item")
    )


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("ord"), F.col("text").alias("item")
    )


_CHARS = "WITH p AS (SELECT doc_id AS ord, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents)"
_CHAR_VOCAB = f""", vocab AS (
  SELECT * FROM ({_SPECIAL_ROWS}) s(token, id) UNION ALL
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 4 FROM p GROUP BY token)"""


@query(
    """
SELECT doc_id AS ord, md5(array_to_string(string_split(text, ''), chr(9))) AS pieces, len(string_split(text, '')) AS n
FROM documents"""
)
def pretokenize_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pretokenize(F.col("item"), "CHAR")
    return _documents(spark, sf_dir).select(
        "ord", F.md5(F.array_join(pieces, "\t")).alias("pieces"), F.size(pieces).alias("n")
    )


def _template_pieces(kind: str) -> str:
    cut = _cut("template", PATTERNS[kind])
    return f"""
WITH g0 AS (SELECT {templates.GENERATED} AS template FROM lineitem)
SELECT template AS item, array_to_string({cut}, ' ') AS pieces, count(*) AS n FROM g0 GROUP BY template"""


def _count_pieces(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = _templates(spark, sf_dir).groupBy("item").agg(F.count("*").alias("n"))
    return rows.select("item", F.array_join(pretokenize(F.col("item"), kind), " ").alias("pieces"), "n")


@query(_template_pieces("SMARTS"))
def pretokenize_smarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count_pieces(spark, sf_dir, "SMARTS")


@query(_template_pieces("ATOM"))
def pretokenize_atom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count_pieces(spark, sf_dir, "ATOM")


@query(
    f"""
SELECT doc_id AS ord, md5(array_to_string({_cut('text', PATTERNS['SMARTS'])}, chr(9))) AS pieces FROM documents"""
)
def pretokenize_structure_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure pattern on prose: most of it is unmatched runs."""
    pieces = pretokenize(F.col("item"), "SMARTS")
    return _documents(spark, sf_dir).select("ord", F.md5(F.array_join(pieces, "\t")).alias("pieces"))


@query(f"SELECT doc_id AS ord, md5(array_to_string({_cut('text', ' ')}, chr(9))) AS pieces FROM documents")
def pretokenize_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pretokenize(F.col("item"), pattern=" ")
    return _documents(spark, sf_dir).select("ord", F.md5(F.array_join(pieces, "\t")).alias("pieces"))


@query(_CHARS + _CHAR_VOCAB + " SELECT token, CAST(id AS INT) AS id FROM vocab")
def vocab_wordlevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.train_wordlevel(_documents(spark, sf_dir), specials=SPECIALS)


_WORD_VOCAB = f"""
WITH w AS (SELECT unnest({_cut('text', ' ')}) AS token FROM documents),
vocab AS (
  SELECT token, CAST(id AS INT) AS id FROM ({_SPECIAL_ROWS}) s(token, id) UNION ALL
  SELECT token, CAST(rn + 4 AS INT) FROM (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS rn
                                          FROM w GROUP BY token) WHERE rn <= 29995)"""


def _word_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.train_wordlevel(_documents(spark, sf_dir), pattern=" ", specials=SPECIALS)


@query(_WORD_VOCAB + " SELECT token, id FROM vocab")
def vocab_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and blanks: more distinct pieces than a vocabulary may have."""
    return _word_vocab(spark, sf_dir)


@query(
    _WORD_VOCAB
    + " SELECT count(*) AS with_specials, count(*) FILTER (token NOT IN ('<s>', '</s>', '<pad>', '<unk>', '<add>')) AS without_specials FROM vocab"
)
def vocab_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.vocab_size_report(_word_vocab(spark, sf_dir), SPECIALS)


_TOKEN_FREQ = _CHARS + """, f AS (
  SELECT token, count(*) AS "count" FROM p GROUP BY token UNION ALL
  SELECT unnest(['<s>', '</s>']), count(*) FROM documents)"""


def _char_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.token_frequencies(_documents(spark, sf_dir), bos=SPECIALS[0], eos=SPECIALS[1])


@query(_TOKEN_FREQ + ' SELECT token, "count" FROM f')
def token_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _char_frequencies(spark, sf_dir)


@query(_TOKEN_FREQ + ' SELECT token, "count" FROM f ORDER BY "count" DESC, token LIMIT 20')
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_frequent(_char_frequencies(spark, sf_dir), 20)


@query(
    """
WITH p AS (SELECT unnest(string_split(text, '')) AS token FROM documents),
b AS (SELECT unnest(string_split(text, '')) AS token FROM benchmark),
c AS (SELECT token, count(*) AS n FROM b GROUP BY token)
SELECT token, coalesce(n, 0) AS "count" FROM (SELECT DISTINCT token FROM p) LEFT JOIN c USING (token)"""
)
def zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of all documents with their counts in the benchmark items."""
    vocab = ops.piece_counts(_documents(spark, sf_dir))
    return ops.zero_fill(vocab, ops.piece_counts(_benchmark(spark, sf_dir)))


# the frequencies are spread over the ids 256 .. 27000 of the 30 000 words
_START, _END = 256, 27_000
_MAPPED = _TOKEN_FREQ.replace("WITH p AS", _WORD_VOCAB.lstrip() + ", p AS", 1) + f""", r AS (
  SELECT token, "count", row_number() OVER (ORDER BY "count" DESC, token) AS rn,
         greatest(CAST(trunc(-(({_END} - {_START}) / CAST(max("count") OVER () AS DOUBLE)) * "count" + {_END}) AS BIGINT), {_START}) AS cand FROM f),
mapped AS (SELECT token, "count", CAST(rn + max(cand - rn) OVER (ORDER BY rn) AS INT) AS new_id FROM r)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.map_vocab_linear(
        _char_frequencies(spark, sf_dir), ops.MAX_WORDLEVEL, _START, _END
    )


@query(_MAPPED + ' SELECT token, "count", new_id FROM mapped')
def map_vocab_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)


@query(
    _MAPPED
    + """, t AS (SELECT token FROM mapped), i AS (SELECT new_id AS id FROM mapped)
SELECT token, id FROM vocab WHERE token NOT IN (FROM t) AND id NOT IN (FROM i) UNION ALL
SELECT token, new_id FROM mapped UNION ALL
SELECT concat('§§§_', id), id FROM vocab WHERE token IN (FROM t) AND id NOT IN (FROM i)"""
)
def remap_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.remap_vocab(_word_vocab(spark, sf_dir), _mapped(spark, sf_dir))


_IDS = (
    _CHARS
    + _CHAR_VOCAB
    + """, e AS (SELECT ord, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM p JOIN vocab USING (token) GROUP BY ord)"""
)


def _char_model(spark: SparkSession, sf_dir: str):
    return wordlevel_model(vocab_wordlevel(spark, sf_dir), SPECIALS)


@query(_IDS + " SELECT ord, md5(concat('0 ', ids, ' 1')) AS ids FROM e")
def encode_wordlevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, so without a length limit."""
    rows = encode(
        _documents(spark, sf_dir), _char_model(spark, sf_dir), max_length=None
    )
    return rows.select("ord", F.md5(F.array_join("input_ids", " ")).alias("ids"))


@query(
    _IDS
    + """, n AS (SELECT ord, max(pos) AS last FROM p GROUP BY ord),
k AS (SELECT ord, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS ids FROM p JOIN vocab USING (token) JOIN n USING (ord) WHERE pos > last - 62 GROUP BY ord)
SELECT doc_id AS ord, md5(concat('0 ', ids, ' 1')) AS ids, greatest(length(text) - 62, 0)::INT AS n_cut FROM documents JOIN k ON ord = doc_id"""
)
def encode_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 64 ids a document: which are left, and how many went."""
    rows = encode(_documents(spark, sf_dir), _char_model(spark, sf_dir), max_length=64, cut_into="n_cut")
    return rows.select("ord", F.md5(F.array_join("input_ids", " ")).alias("ids"), "n_cut")


@query(_IDS + " SELECT ord, md5(ids) AS ids FROM e")
def encode_wordlevel_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join form for vocabularies that are too large to travel with the tasks."""
    vocab = vocab_wordlevel(spark, sf_dir)
    rows = encode_wordlevel_join(_documents(spark, sf_dir), vocab, 3)
    return rows.select("ord", F.md5(F.array_join("ids", " ")).alias("ids"))


@query("SELECT doc_id AS ord, md5(text) AS text FROM documents")
def decode_wordlevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _char_model(spark, sf_dir)
    ids = raw_ids(F.col("item"), model)
    return _documents(spark, sf_dir).select("ord", F.md5(decode(ids, model)).alias("text"))


@query(
    """
WITH b AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM benchmark),
p AS (SELECT doc_id AS ord, unnest(string_split(text, '')) AS token FROM documents)
SELECT DISTINCT ord FROM p WHERE token NOT IN (FROM b)"""
)
def roundtrip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a vocabulary of benchmark characters cannot restore."""
    model = wordlevel_model(
        ops.train_wordlevel(_benchmark(spark, sf_dir), specials=SPECIALS), SPECIALS
    )
    return not_restored(_documents(spark, sf_dir), model).select("ord")


@query(
    """
WITH t AS (SELECT conv_id, conv_id * 1000 + turn AS ord, length(text) + 2 AS n FROM conversations),
m AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY conv_id) / 8) * 8 AS INT) AS len FROM t)
SELECT ord, len AS padded, n AS attended, len - n + 2 AS special FROM m"""
)
def padded_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns padded to the longest of their conversation, rounded up to 8."""
    turns = _turns(spark, sf_dir)
    model = wordlevel_model(ops.train_wordlevel(turns, specials=SPECIALS), SPECIALS)
    rows = encode(turns, model, max_length=None, pad_to="conv_id", multiple=8)

    def total(c: str):
        return F.aggregate(c, F.lit(0), lambda a, x: a + x)

    return rows.select(
        "ord",
        F.size("input_ids").alias("padded"),
        total("attention_mask").alias("attended"),
        total("special_tokens_mask").alias("special"),
    )


@query(
    """
SELECT CAST((length(text) + 2) // 8 AS INT) AS bucket, count(*) AS n FROM conversations GROUP BY 1"""
)
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    model = wordlevel_model(ops.train_wordlevel(turns, specials=SPECIALS), SPECIALS)
    rows = bucketed(encode(turns, model, max_length=None))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


def _merging(table: str, goal: int, result: str, inner: str = "") -> str:
    """Training in SQL: one private-use character stands for each token, numbered like the ids, so that pairs sort as pairs of ids.

    No two merges of these queries make the same token.
    """
    n = len(SPECIALS)
    return f"""
WITH RECURSIVE lines AS MATERIALIZED (
  SELECT list_transform(string_split(text, ''), lambda c, i: CASE WHEN i > 1 THEN '{inner}' || c ELSE c END) AS s, string_split(text, '') AS plain, count(*) AS n
  FROM {table} WHERE length(text) > 0 GROUP BY ALL),
found AS (SELECT DISTINCT false AS behind, unnest(plain) AS c FROM lines UNION SELECT DISTINCT '{inner}' <> '', unnest(s[2:]) FROM lines),
alphabet AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY behind, unicode(right(c, 1))) - 1 + {n} AS id FROM found),
names AS MATERIALIZED (SELECT map_from_entries(list((c, chr((57344 + id)::INT)))) AS m FROM alphabet),
sizes AS MATERIALIZED (SELECT count(*) AS size FROM alphabet),
step AS (
  SELECT 0 AS i, array_to_string(list_transform(s, lambda c: m[c]), '') AS s, n, NULL::VARCHAR AS pair FROM lines, names
  UNION ALL
  SELECT i + 1, replace(s, best, chr((57344 + {n} + size + i)::INT)), n, best
  FROM step, sizes, (
    SELECT best
    FROM (SELECT best, sum(n) AS uses
          FROM (SELECT unnest(list_transform(list_zip(x[:-2], x[2:]), lambda p: p[1] || p[2])) AS best, n FROM (SELECT string_split(s, '') AS x, n FROM step))
          GROUP BY best)
    ORDER BY uses DESC, best LIMIT 1)
  WHERE i < {goal} - size),
merges AS MATERIALIZED (SELECT DISTINCT i - 1 AS rank, unicode(pair[1]) - 57344 AS a, unicode(pair[2]) - 57344 AS b FROM step WHERE i > 0),
spelt AS (
  SELECT -1 AS r, map_from_entries(list((id, c))) AS t FROM alphabet
  UNION ALL
  SELECT r + 1, map_concat(t, map([{n} + size + rank], [t[a] || t[b][{len(inner)} + 1:]])) FROM spelt, sizes, merges WHERE rank = r + 1),
model AS (SELECT t FROM spelt ORDER BY r DESC LIMIT 1)
{result}"""


_MERGE_ROWS = 'SELECT m.rank::INT AS rank, t[a] AS "left", t[b] AS "right" FROM merges m, model'
_VOCAB_ROWS = f"SELECT e.value AS token, e.key::INT AS id FROM (SELECT unnest(map_entries(t)) AS e FROM model) UNION ALL SELECT * FROM ({_SPECIAL_ROWS})"


@query(_merging("conversations", 128, _MERGE_ROWS))
def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered merges learnt from all conversation turns."""
    model = train_bpe(_turns(spark, sf_dir), 128, specials=SPECIALS)
    return model.merges_table(spark)


@query("SELECT conv_id * 1000 + turn AS ord, md5(text) AS text FROM conversations")
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained, encoded and decoded again: every text comes back."""
    turns = _turns(spark, sf_dir)
    model = train_bpe(turns, 128, specials=SPECIALS)
    ids = raw_ids(F.col("item"), model)
    return turns.select("ord", F.md5(decode(ids, model)).alias("text"))


@query(_merging("documents", 128, _MERGE_ROWS))
def bpe_merges_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from all documents, whose texts are long lines."""
    return train_bpe(_documents(spark, sf_dir), 128, specials=SPECIALS).merges_table(spark)


@query(_merging("documents", 230, _VOCAB_ROWS, PREFIX))
def wordpiece_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_wordpiece(_documents(spark, sf_dir), 230, specials=SPECIALS).vocab(spark)


@query()
def unigram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train_unigram(_benchmark(spark, sf_dir), 120, specials=SPECIALS)
    return model.unigram_table(spark).withColumn("logp", F.round("logp", 6))


@query("SELECT item_id AS ord, md5(text) AS text FROM benchmark")
def unigram_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _benchmark(spark, sf_dir)
    model = train_unigram(items, 120, specials=SPECIALS)
    return items.select("ord", F.md5(decode(raw_ids(F.col("item"), model), model)).alias("text"))


@query()
def tokenizer_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid combinations of pre-tokenizer, algorithm and size on the benchmark items."""
    models = train_grid(_benchmark(spark, sf_dir), specials=SPECIALS)
    rows = [(*cell, *model_vocab_size(m)) for cell, m in models.items()]
    return spark.createDataFrame(
        rows, "kind string, algorithm string, asked int, with_specials int, without_specials int"
    )


@query(
    """
WITH d AS (SELECT d.doc_id AS ord, d.text, md5(concat('42-', text, '-', d.doc_id)) AS h FROM documents d),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM d),
s AS (SELECT *, CASE WHEN rn <= n * 10 // 100 THEN 'validation'
                     WHEN rn <= n * 10 // 100 + n * 10 // 100 THEN 'test' ELSE 'train' END AS split FROM r)
SELECT split, count(*) AS n, CAST(sum(CAST(ceil((length(text) + 2) / 8) * 8 AS BIGINT)) AS BIGINT) AS n_ids FROM s GROUP BY split"""
)
def tokenized_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random split, training on its train part, encoding of everything."""
    rows = _documents(spark, sf_dir).select(F.lit("train").alias("split"), "ord", "item")
    encoded, _ = build_tokenized_dataset(rows, max_length=None)
    return encoded.groupBy("split").agg(
        F.count("*").alias("n"), F.sum(F.size("input_ids")).alias("n_ids")
    )


@query(
    _WORD_VOCAB
    + f""", d AS (SELECT doc_id AS ord, text, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents),
p AS (SELECT ord, split, unnest(string_split(text, '')) AS token, unnest(range(1, length(text) + 1)) AS pos FROM d),
f AS (SELECT token, count(*) AS n FROM p WHERE split = 'train' GROUP BY token UNION ALL
      SELECT unnest(['<s>', '</s>']), count(*) FROM d WHERE split = 'train'),
z AS (SELECT CAST(round_even((count(*) - 7) * 0.9, 0) AS BIGINT) AS top FROM vocab),
r AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rn,
             greatest(CAST(trunc(-((top - 256) / CAST(max(n) OVER () AS DOUBLE)) * n + top) AS BIGINT), 256) AS cand FROM f, z),
m AS (SELECT token, rn + max(cand - rn) OVER (ORDER BY rn) AS id FROM r),
marks AS (SELECT max(id) FILTER (token = '<s>') AS bos, max(id) FILTER (token = '</s>') AS eos FROM m)
SELECT ord, split, count(*) + 2 AS n_ids, md5(concat(any_value(bos), ' ', string_agg(CAST(coalesce(id, 3) AS VARCHAR), ' ' ORDER BY pos), ' ', any_value(eos))) AS ids
FROM p LEFT JOIN m USING (token), marks GROUP BY ord, split"""
)
def tokenized_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the train part, mapped by frequency into the word vocabulary of all documents."""
    split = F.when(F.col("ord") % 10 == 0, "validation").otherwise("train")
    rows = _documents(spark, sf_dir).select(split.alias("split"), "ord", "item")
    encoded, _ = build_tokenized_dataset(rows, multiple=1, specials=SPECIALS, into=_word_vocab(spark, sf_dir))
    return encoded.select("ord", "split", F.size("input_ids").cast("long").alias("n_ids"), F.md5(F.array_join("input_ids", " ")).alias("ids"))


_BIGRAMS = _CHARS + """, l AS (SELECT doc_id AS ord, CASE WHEN toxic = 1 THEN 'test' WHEN quality = 0 THEN 'validation' END AS split FROM labels),
b AS (SELECT p.ord, coalesce(l.split, 'train') AS split, p.token AS context, lead(p.token) OVER (PARTITION BY p.ord ORDER BY p.pos) AS token
      FROM p LEFT JOIN l USING (ord)),
u AS (SELECT ord, split, context, token, count(*) AS n FROM b WHERE token IS NOT NULL GROUP BY ALL)"""
_MODEL = """, c AS (SELECT context, token, sum(n) AS n FROM u WHERE split = 'train' GROUP BY context, token),
x AS (SELECT context, sum(n) AS total, arg_min(token, (-n, token)) AS best FROM c GROUP BY context),
v AS (SELECT count(DISTINCT p.token) AS size FROM p LEFT JOIN l USING (ord) WHERE l.split IS NULL),
sc AS (SELECT u.*, -ln((coalesce(c.n, 0) + 1) / (coalesce(x.total, 0) + (SELECT size FROM v))) AS nll,
              coalesce(x.best = u.token, false) AS hit
       FROM u LEFT JOIN x ON u.context = x.context LEFT JOIN c ON u.context = c.context AND u.token = c.token)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.with_split(spark, sf_dir, spread)
    return rows.select("split", "ord", pretokenize(F.col("item"), "CHAR").alias("tokens"))


def _bigram_model(tokens: DataFrame) -> tuple[DataFrame, int]:
    train = tokens.where(F.col("split") == "train")
    size = train.select(F.explode("tokens").alias("t")).distinct().count()
    return cut_lineage(ngrams.ngram_counts(train)), size


@query(_BIGRAMS + ' SELECT context, token, CAST(sum(n) AS BIGINT) AS "count" FROM u GROUP BY context, token')
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.ngram_counts(_tokens(spark, sf_dir))


@query(_BIGRAMS + _MODEL + " SELECT context, best AS prediction FROM x")
def predict_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.predict_next(_bigram_model(_tokens(spark, sf_dir))[0])


@query(
    _BIGRAMS
    + _MODEL
    + """ SELECT ord, CAST(sum(n) AS BIGINT) AS n_tokens, round(sum(nll * n) / sum(n), 6) AS loss,
  round(sum(CASE WHEN hit THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM sc GROUP BY ord"""
)
def score_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    counts, size = _bigram_model(tokens)
    scored = ngrams.score_sequences(tokens, counts, size)
    return scored.withColumns({c: F.round(c, 6) for c in ("loss", "accuracy")})


@query(
    _BIGRAMS
    + _MODEL
    + """ SELECT split, CAST(sum(n) AS BIGINT) AS n_tokens, round(sum(nll * n) / sum(n), 6) AS loss,
  round(sum(CASE WHEN hit THEN n ELSE 0 END) / sum(n), 6) AS accuracy,
  round(exp(sum(nll * n) / sum(n)), 5) AS perplexity FROM sc GROUP BY split"""
)
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _tokens(spark, sf_dir)
    counts, size = _bigram_model(tokens)
    report = ngrams.split_report(tokens, counts, size)
    digits = {"loss": 6, "accuracy": 6, "perplexity": 5}
    return report.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    _BIGRAMS
    + """ SELECT CAST(sum(n) AS BIGINT) AS n_tokens,
  round(sum(CASE WHEN context = token THEN n ELSE 0 END) / sum(n), 9) AS accuracy FROM u"""
)
def next_token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predictor that repeats the current token."""
    tokens = _tokens(spark, sf_dir)
    report = ngrams.next_token_accuracy(tokens, "tokens", "tokens")
    return report.withColumn("accuracy", F.round("accuracy", 9))
