"""Quality rules with n-gram perplexity: modified Kneser-Ney models and perplexity bands for each language.

Base counts come from the words ``[^\\x20\\x09-\\x0D]+`` of each text. A document fails them with under ``min_words``
words, or if over ``most_repeated`` of its words lie in 3-word windows that occur twice or more in it.

Well-formed documents (passing the base rules, with under ``most_symbols`` symbols and ``most_capitals`` capitals for
each word character) teach a character 3-gram model for each language: Spark counts the n-grams of all of them, and the
models are sorted hash arrays (see ``charlm``; at most 2 ^ 21 entries a language). Every document is then scored by its
language's model mixed with a model of all languages' text, its own included: a language of n characters to learn from
has the share n / (n + ``pooled_chars``) of the mixture, so that the others' text fades as it grows. The band of a language is the median log perplexity of its well-formed documents plus and minus
``width`` times their spread (1.4826 times the median absolute deviation, at least ``least_spread``); a document
outside its band is rejected. With fewer than ``least_docs`` well-formed documents, a language's median absolute
deviation is shrunk to that of all languages in proportion; its median is its own, since languages differ by more than
their spreads.

Windows are compared by 64-bit hashes. Each text's counts are made once in each of the two passes over the corpus, teaching
and scoring. The models are broadcast one by one, and a worker loads those of the languages that it meets.

Defined cases: a null text has no words and fails; a null language is a language of its own, other than the empty one; a
language without a well-formed document has no band and rejects nothing beyond the base rules; repeated rows count again;
very long texts are read whole, in memory of a few times their size; an empty table gives an empty table; columns other
than doc_id, lang and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.llm.charlm import Alphabet, language_models
from bindery.llm.common import BLANKS, stage
from bindery.llm.wordhash import ngram_hashes, text_hashes

ALPHABET = Alphabet(bits=7, order=3, letters=False)
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
WINDOW = 3


def repeated_words(words: np.ndarray, n: int = WINDOW) -> int:
    """Words in n-word windows that occur at least twice, the first occurrence included; ``words`` are their hashes."""
    if len(words) < n:
        return 0
    _, back, times = np.unique(ngram_hashes(words, n), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[back] > 1)
    inside = np.zeros(len(words), bool)
    for k in range(n):
        inside[again + k] = True
    return int(inside.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    text = text or ""
    raw = text.encode("utf-8")
    words = text_hashes(raw)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen and line.strip():
            again += 1
        seen.add(line)
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated_words(words)


def capitals(text: str | None) -> int:
    raw = (text or "").encode("utf-8")
    return len(raw) - len(raw.translate(None, CAPITALS))


def fails_base(n_words: int, n_repeat_words: int, min_words: int = MIN_WORDS, most_repeated: int = 50) -> bool:
    return n_words < min_words or 100 * n_repeat_words > most_repeated * n_words


def assess(docs: DataFrame, width: float = 8.0, least_spread: float = 0.05, least_docs: int = 20, pooled_chars: int = 1 << 16,
           most_symbols: float = 0.02, most_capitals: float = 0.3) -> DataFrame:
    """(doc_id, lang, the five base counts, base_failed, log_ppl, low, high, kept) for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Languages go by keys: null is no text's value.
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), "text")

    def well_formed(text, counts):
        n_words, chars, symbols, _, again = counts
        return not fails_base(n_words, again) and symbols <= most_symbols * chars and capitals(text) <= most_capitals * chars

    def teachers(batches):
        for b in batches:
            yield b.filter(pa.array([well_formed(t, base_counts(t)) for t in b.column(1).to_pylist()], pa.bool_()))

    good = rows.select("lang", "text").mapInArrow(teachers, "lang string, text string")
    models = language_models(good, ALPHABET, True, lambda df: stage(df, "quality-grams"), pooled_chars)
    names = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "teaches", "log_ppl"]

    def score(batches):
        for b in batches:
            langs, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            counts = [base_counts(t) for t in texts]
            failed = [fails_base(c[0], c[4]) for c in counts]
            entropy = np.full(len(texts), np.nan)
            for lang in set(langs):
                some = [i for i, x in enumerate(langs) if x == lang and counts[i][0]]
                if some and lang in models.parts:
                    entropy[some] = models.cross_entropy([texts[i] for i in some], lang)[:, 0]
            teaches = [well_formed(t, c) for t, c in zip(texts, counts)]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *columns, pa.array(failed), pa.array(teaches), pa.array(entropy, from_pandas=True)], names)

    schema = f"doc_id {kind}, lang string, " + ", ".join(f"{c} bigint" for c in names[2:7]) + ", base_failed boolean, teaches boolean, log_ppl double"
    scored = stage(rows.mapInArrow(score, schema), "quality")
    # Tables of a row a language are joined as Spark sees fit by their measured size.
    centre = stage(scored.where("teaches").groupBy("lang").agg(F.percentile_approx("log_ppl", 0.5).alias("mid"), F.count("*").alias("n")), "centres")
    off = F.abs(F.col("log_ppl") - F.col("mid"))
    taught = scored.where("teaches").join(centre, "lang").select("lang", "mid", "n", off.alias("off"))
    spread = taught.groupBy("lang", "mid", "n").agg(F.percentile_approx("off", 0.5).alias("own"))
    spread = spread.crossJoin(F.broadcast(taught.agg(F.percentile_approx("off", 0.5).alias("pooled"))))
    weight = F.least(F.lit(1.0), F.col("n") / least_docs)
    mad = weight * F.col("own") + (1 - weight) * F.col("pooled")
    reach = F.greatest(mad * 1.4826, F.lit(least_spread)) * width
    bands = spread.select(F.col("lang").alias("of"), (F.col("mid") - reach).alias("low"), (F.col("mid") + reach).alias("high"))
    judged = scored.join(stage(bands, "bands"), F.col("lang") == F.col("of"), "left")
    judged = judged.withColumn("lang", F.when(F.col("lang") != "", F.substr("lang", F.lit(2))))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select(*[c for c in names if c != "teaches"], "low", "high", (~F.col("base_failed") & inside).alias("kept"))
