"""Text as Column expressions: tokens, term frequencies, BM25 and TF-IDF weights.

Tokens are runs of letters and digits of the lower-cased text without accents: compatibility decomposition, marks
dropped. Documents and queries go by this one rule. In documents ``translate`` applies it inside generated code, with a
table of every character that decomposes to one; a text with any other decomposable character (ligatures,
Hangul, ...) goes through the whole decomposition in an Arrow-batched function, which gets nulls for all other texts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# fixed values: the usual BM25 parameters
K1, B = 1.2, 0.75


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


def _range(first: int, last: int) -> str:
    return f"\\x{{{first:x}}}-\\x{{{last:x}}}"


@cache
def _accents() -> tuple[str, str, str]:
    """(characters, what they become, a pattern of all others that decompose); marks become nothing."""
    single, marks, others = {}, [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or (p := _plain(c)) == c:
            continue
        if code > 0xFFFF or len(p) > 1 or (p and ord(p) > 0xFFFF):
            others.append(code)
        elif p:
            single[c] = p
        else:
            marks.append(c)
    cuts = [0, *(i for i in range(1, len(others)) if others[i] != others[i - 1] + 1), len(others)]
    ranges = [(others[a], others[b - 1]) for a, b in zip(cuts, cuts[1:], strict=False)]
    # a class of plain ranges is tried range by range for every character of a text: parts of few ranges, each behind its
    # bounds, are passed over at once
    parts = [f"[{_range(part[0][0], part[-1][1])}&&[{''.join(_range(*r) for r in part)}]]" for part in (ranges[i : i + 16] for i in range(0, len(ranges), 16))]
    return "".join(single) + "".join(marks), "".join(single.values()), f"[{_range(0x80, sys.maxunicode)}&&[{''.join(parts)}]]"


def normalize(text: str | None) -> str:
    """The driver's side of the same rule, for queries and stop words."""
    return _plain(text or "").lower()


def tokenize(text: str | None, stopwords: Sequence[str] = ()) -> list[str]:
    drop = {normalize(w) for w in stopwords}
    return [t for t in re.findall(r"[^\W_]+", normalize(text)) if t not in drop]


def stopwords(spark: SparkSession, language: str) -> list[str]:
    """The Snowball stop words that Spark ships."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _exact_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else tokenize(t))


def tokens(text: Column | str, stop: Sequence[str] = (), exact: bool = False) -> Column:
    """Tokens in order, without stop words; null for null."""
    col = F.col(text) if isinstance(text, str) else text
    if exact:
        out = _exact_tokens(col)
    else:
        known, plain, others = _accents()
        whole = col.rlike(others)
        fast = F.regexp_extract_all(F.lower(F.translate(col, known, plain)), F.lit(r"([\p{L}\p{N}]+)"))
        out = F.when(whole, _exact_tokens(F.when(whole, col))).otherwise(fast)
    if stop:
        drop = sorted({w for s in stop for w in tokenize(s)})
        out = F.filter(out, lambda t: ~t.isin(drop))
    return out


# one range is quickly passed over; the first combining character is U+0300
_HIGH = re.compile("[\u0300-\U0010ffff]+")
_WORD = re.compile(r"[^\W_]+")


def _unmarked(found: re.Match) -> str:
    return "".join(c for c in found[0] if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """What ``tokenize`` finds, for whole columns in Arrow batches: C code alone goes over the characters."""
    return _WORD.findall(text.lower() if text.isascii() else _HIGH.sub(_unmarked, unicodedata.normalize("NFKD", text)).lower())


def bags(rows: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """(term, doc, tf) of the distinct tokens of each row of ``rows`` (doc, text), as flat Arrow columns; a null text has none."""
    drop = {t for w in stop for t in tokenize(w)}
    out = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc", rows.schema["doc"].dataType), T.StructField("tf", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts are long: what a few hundred rows have is handed on at once
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                terms, of, tfs = [], [], []
                for i, t in enumerate(part.column(1)):
                    bag = Counter(words(t.as_py() or ""))
                    for w in drop & bag.keys():
                        del bag[w]
                    terms.extend(bag)
                    tfs.extend(bag.values())
                    of.extend([i] * len(bag))
                yield pa.RecordBatch.from_arrays([pa.array(terms, arrow[0].type), part.column(0).take(pa.array(of, pa.int64())).cast(arrow[1].type), pa.array(tfs, pa.int64())], schema=arrow)

    return rows.select("doc", F.col("text").cast("string")).mapInArrow(run, out)


def counts(text: Column, terms: Sequence[str], stop: Sequence[str] = ()) -> Column:
    """The number of a text's tokens, then those of each of ``terms``, as one array; null for null."""
    drop, asked = {t for w in stop for t in tokenize(w)}, list(terms)

    @F.pandas_udf("array<bigint>")
    def count(texts: pd.Series) -> pd.Series:
        def one(t):
            found = [w for w in words(t) if w not in drop] if drop else words(t)
            return [len(found), *map(found.count, asked)]

        return texts.map(lambda t: None if t is None else one(t))

    return count(text)


def term_frequency(toks: Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda t: t == term))


def bm25_idf(n: Column, df: Column) -> Column:
    """Zero for a term that no document has."""
    return F.when(df > 0, F.log1p((n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def bm25_weight(tf: Column, length: Column, avgdl: Column, idf: Column, k1: float = K1, b: float = B) -> Column:
    return F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))).otherwise(0.0)


def tfidf_idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.log1p(n / df)).otherwise(0.0)


def truncate_utf8(text: Column, max_bytes: int = 3500) -> Column:
    """At most ``max_bytes`` of UTF-8, cut before a word; a single longer word is cut within."""
    raw = F.encode(text, "UTF-8")
    # a character that the cut leaves incomplete decodes to U+FFFD, which goes
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, max_bytes).cast("string")), "\uFFFD+$", "")
    space = F.length(cut) - F.instr(F.reverse(cut), " ") + 1
    return F.when(F.octet_length(text) <= max_bytes, text).when((F.instr(cut, " ") > 0) & (space > 1), F.substring(cut, F.lit(1), space - 1)).otherwise(cut)


def license_family(url: Column) -> Column:
    """Creative Commons family of a licence URL: CC0, Public Domain, or CC BY in the variants that allow derivatives; else null."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    terms = F.regexp_extract(u, r"creativecommons\.org/licenses/([a-z+-]+)", 1)
    return (
        F.when(u.contains("creativecommons.org/publicdomain/zero"), "CC0")
        .when(u.contains("creativecommons.org/publicdomain/mark") | u.contains("creativecommons.org/licenses/publicdomain"), "Public Domain")
        .when(terms.isin("by", "by-sa", "by-nc", "by-nc-sa"), F.concat(F.lit("CC "), F.upper(terms)))
    )


def suggest_table_name(filename: Column) -> Column:
    """A table name from a file's name."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    name = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    return F.when((name == "") | name.rlike("^[0-9]"), F.concat(F.lit("t_"), name)).otherwise(name)


def varchar_size(longest: Column) -> Column:
    """The declared size for texts of at most ``longest`` characters."""
    out = F.when(longest == 0, 32)
    for step in (16, 32, 64, 128, 256, 512):
        out = out.when(longest <= step, step)
    return out.otherwise(longest + 32)
