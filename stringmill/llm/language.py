"""Language of texts and of their parts: script ranges, word scores, Viterbi with a switching penalty.

Each word gets a score per learned language from hashed features (the word, its character n-grams);
the word's script leaves only the languages that use it. The best path over the words of a text,
where each change of language costs a penalty, labels spans; the text's language is the one with
most letters. All words of a batch are scored at once, and the path runs over all texts of a slice
in step, so no Python code runs per word.

The model is a table of 2**bits rows and one column per language: its size is fixed by its
parameters. Its counts cover all training texts; Spark adds them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import id_and_text
from .words import Words, mix, rolling, slices, words_of

BITS = 18
PENALTY = 6.0
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
# fixed values: first code points of runs of one script, and the script's name
_SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
]
_FROM = np.array([a for a, _ in _SCRIPTS])
SCRIPTS = sorted({s for _, s in _SCRIPTS})
_NUMBER = np.array([SCRIPTS.index(s) for _, s in _SCRIPTS])


def scripts_of(words: Words) -> np.ndarray:
    """Script number of each word: that of its last character outside ASCII, Latin for ASCII words."""
    data = words.data
    out = np.full(len(words.starts), SCRIPTS.index("Latin"))
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xF5))
    if len(lead):
        after = [np.append(data, np.zeros(3, np.uint8))[lead + i].astype(np.int64) & 0x3F for i in (1, 2)]
        first = data[lead].astype(np.int64)
        code = np.where(first < 0xE0, (first & 0x1F) << 6 | after[0], np.where(first < 0xF0, (first & 0x0F) << 12 | after[0] << 6 | after[1], 0x20000))
        out[np.searchsorted(words.starts, lead, "right") - 1] = _NUMBER[np.searchsorted(_FROM, code, "right") - 1]
    return out


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all words, and the word of each: the word, its 1- to 4-byte n-grams with edges marked."""
    low = words_lower(words)
    # each word between two marks, so that starts and ends are n-grams of their own
    lengths = words.ends - words.starts + 2
    ends = np.cumsum(lengths)
    framed = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
    inside = np.ones(len(framed), bool)
    inside[ends - 1] = inside[ends - lengths] = False
    own = np.repeat(np.arange(len(lengths)), lengths)
    framed[inside] = low
    values = rolling(41).bytes[framed]
    mask = np.uint64((1 << bits) - 1)
    whole = rolling(42).spans(values, ends - lengths, ends)
    buckets, owner = [whole & mask], [np.arange(len(lengths))]
    for n in (2, 3, 4):
        starts = np.arange(max(len(framed) - n + 1, 0))
        starts = starts[own[starts] == own[starts + n - 1]] if len(starts) else starts
        buckets.append(rolling(42 + n).spans(values, starts, starts + n) & mask)
        owner.append(own[starts])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner)


def words_lower(words: Words) -> np.ndarray:
    """The bytes of all words, one after the other."""
    inside = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    return words.data[np.cumsum(inside)[:-1] > 0]


def with_letters(texts: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    return np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word: highest sum of scores less penalty per change, text by text.

    Texts advance together, word by word, longest first, so a step covers all texts still running.
    Ties go to the smaller label, and to staying.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    labels = scores.shape[1]
    back = np.empty(scores.shape, np.int8 if labels < 127 else np.int32)
    state = np.zeros((len(order), labels), np.float32)
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    for t in range(longest):
        k = running[t]
        at = starts[:k] + t
        now = state[:k]
        best = now.argmax(1)
        high = now[np.arange(k), best][:, None] - penalty
        change = high > now
        back[at] = np.where(change, best[:, None], np.arange(labels))
        state[:k] = np.where(change, high, now) + scores[at]
    out = np.empty(len(scores), np.int64)
    label = state.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        out[at] = label[:k]
        label[:k] = back[at, label[:k]]
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log-probability of each bucket, per language, less its mean over languages
    uses: np.ndarray  # script x language: whether texts of the language use the script
    bits: int

    def word_scores(self, words: Words) -> np.ndarray:
        buckets, owner = features(words, self.bits)
        n = len(words.starts)
        total = np.stack([np.bincount(owner, self.table[buckets, i], n) for i in range(len(self.languages))], 1)
        total = total / np.maximum(np.bincount(owner, minlength=n), 1)[:, None] ** 0.5
        allowed = self.uses[scripts_of(words)]
        total[~allowed & allowed.any(1)[:, None]] = -50.0
        return total.astype(np.float32)

    def spans(self, texts: pa.Array, penalty: float = PENALTY) -> tuple[Words, np.ndarray]:
        words = words_of(texts, lower=True)
        if not self.languages:
            return words, np.full(len(words.starts), -1)
        return words, viterbi(self.word_scores(words), words.first, penalty)


def _sums(docs: DataFrame, languages: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts (bucket x language) and words per script and language, over all training texts."""
    number = {name: i for i, name in enumerate(languages)}
    size = (1 << bits) + len(SCRIPTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), size), np.int64)
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), lower=True)
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            of_word = np.repeat(lang, np.diff(words.first))
            buckets, owner = features(words, bits)
            places = [of_word[owner] * size + buckets, of_word * size + (1 << bits) + scripts_of(words)]
            total += np.bincount(np.concatenate(places), minlength=total.size).reshape(total.shape)
        for i, row in enumerate(total):
            at = np.flatnonzero(row)
            for low in range(0, len(at), 1 << 16):
                part = at[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i)), pa.array(part), pa.array(row[part])], names=["lang", "bucket", "n"])

    found = docs.mapInArrow(run, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), size))
    counts[found.column("lang").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts[:, : 1 << bits].T, counts[:, 1 << bits :].T


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, least_share: float = 0.001) -> Model:
    """Learns from rows whose language is not null; rows without words teach nothing.

    least_share: a language uses a script if at least this share of its words is in it.
    """
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return Model([], np.zeros((1, 0)), np.zeros((len(SCRIPTS), 0), bool), bits)
    counts, scripts = _sums(rows, languages, bits)
    totals = counts.sum(0)
    rate = np.log((counts + 0.1) / (totals + 0.1 * len(counts)))
    rate -= rate.mean(1, keepdims=True)
    return Model(languages, rate.astype(np.float32), scripts >= np.maximum(least_share * scripts.sum(0), 1), bits)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, spans array<struct<lang, word_from, word_to>>.

    lang_pred is the language with most bytes of words, score its share of them. Texts that are null
    or have no letter are undetermined, with score 0, as are all texts where nothing was learned.
    Repeated rows get equal results.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("word_from", pa.int64()), ("word_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        names = np.array([*own.languages, UNDETERMINED], object)
        for batch in slices(batches, "text"):
            words, labels = own.spans(batch.column("text"), penalty)
            n, many = batch.num_rows, max(len(own.languages), 1)
            weight = np.bincount(words.texts() * many + np.maximum(labels, 0), words.ends - words.starts, n * many).reshape(n, many)
            best = weight.argmax(1)
            ok = with_letters(batch.column("text")) & (len(own.languages) > 0)
            score = np.where(ok, weight[np.arange(n), best] / np.maximum(weight.sum(1), 1), 0.0)
            texts = words.texts()
            new = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (texts[1:] != texts[:-1]))) if len(labels) else np.zeros(0, int)
            ends = np.append(new[1:], len(labels))[: len(new)]
            base = words.first[texts[new]]
            items = pa.StructArray.from_arrays([pa.array(names[labels[new]], pa.string()), pa.array(new - base), pa.array(ends - base)], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(new, words.first), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(ok, names[best], UNDETERMINED), pa.string()), pa.array(score), lists], names=["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans array<struct<lang string, word_from long, word_to long>>"
    return id_and_text(docs, key, text).mapInArrow(run, schema)
