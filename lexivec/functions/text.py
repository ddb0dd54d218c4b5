"""Tokens, hashes and n-grams as column expressions: tokens in the JVM, hashes over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import hashing
from .hashing import FNV_PRIME, FNV_START, NGRAM_MULTIPLIER

EOS = "</s>"
#: Most tokens that one line of a corpus gives.
LINE_TOKENS = 1024
__all__ = ["EOS", "FNV_PRIME", "FNV_START", "LINE_TOKENS", "NGRAM_MULTIPLIER", "char_ngrams", "corpus_tokens", "is_label", "let", "ngram_ids", "simple_tokens", "token_hash", "token_hashes", "token_lists", "tokens", "word_ngram_ids"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """use(value), with value made once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _filled(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t != "")


def tokens(text: Column | str) -> Column:
    """Tokens of a text taken as one line: ASCII white space parts them, a literal </s> ends it."""
    split = _filled(F.split(F.coalesce(_c(text), F.lit("")), r"[ \t\n\f\r]+"))
    return let(split, lambda t: F.when(F.array_contains(t, EOS), F.slice(t, F.lit(1), F.array_position(t, F.lit(EOS)).cast("int"))).otherwise(t))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 12, 13, 32]] = True


def token_lists(texts: pa.Array, end: str = "") -> pa.ListArray:
    """tokens() of a batch of texts, by whole arrays of bytes: lists of dictionary<string>, each different token held once.

    end: "always" adds </s> to each list, "unless" to those without it.
    """
    texts = texts.fill_null("")
    offsets, data = hashing.utf8(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    word = ~_BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    # texts are parted where nothing blank is between them
    some = np.diff(offsets) > 0
    first[offsets[:-1][some]], last[offsets[1:][some] - 1] = word[offsets[:-1][some]], word[offsets[1:][some] - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[word])))
    coded = words.dictionary_encode()
    known, codes, at = coded.dictionary.cast(pa.string()), coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(starts, offsets)
    eos = pc.index(known, EOS).as_py()
    if eos >= 0:
        # nothing follows the first </s>
        before = np.concatenate(([0], np.cumsum(codes == eos)))
        at, codes = hashing.kept(at, codes, before[:-1] == np.repeat(before[at[:-1]], np.diff(at)))
    if end:
        sizes, ended = np.diff(at), np.zeros(len(at) - 1, bool)
        if eos >= 0:
            ended = (sizes > 0) & (codes[np.maximum(at[1:], 1) - 1] == eos) if len(codes) else ended
        else:
            eos, known = len(known), pa.concat_arrays([known, pa.array([EOS])])
        more = np.ones(len(sizes), np.int64) if end == "always" else (~ended).astype(np.int64)
        new = np.concatenate(([0], np.cumsum(sizes + more)))
        out = np.full(new[-1], eos, np.int32)
        out[hashing.ranges(new[:-1], sizes)] = codes
        at, codes = new, out
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.DictionaryArray.from_arrays(pa.array(codes.astype(np.int32)), known))


def corpus_tokens(text: Column | str, cap: int | None = LINE_TOKENS) -> Column:
    """Tokens of a corpus text: each newline adds </s>, and a line gives at most ``cap`` tokens besides."""
    lines = F.split(F.coalesce(_c(text), F.lit("")), "\n", -1)
    own = lambda line: _filled(F.split(line, r"[ \t\x0B\f\x00\r]+"))
    cut = (lambda t: F.slice(t, 1, cap)) if cap else (lambda t: t)
    return let(lines, lambda x: F.flatten(F.transform(x, lambda line, i: F.when(i < F.size(x) - 1, F.concat(cut(own(line)), F.array(F.lit(EOS)))).otherwise(cut(own(line))))))


def simple_tokens(text: Column | str) -> Column:
    """Tokens parted by any Unicode white space."""
    return _filled(F.split(F.coalesce(_c(text), F.lit("")), r"(?U)\s+"))


def is_label(token: Column | str, prefix: str = "__label__") -> Column:
    return F.startswith(_c(token), F.lit(prefix))


@F.arrow_udf(LongType())
def _hash(words: pa.Array) -> pa.Array:
    return hashing.hash_strings(words)


@F.arrow_udf(ArrayType(LongType()))
def _hashes(lists: pa.Array) -> pa.Array:
    offsets, words = hashing.list_parts(lists)
    return hashing.to_lists(offsets, hashing.hash_strings(words).to_numpy(zero_copy_only=False))


def token_hash(token: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes, each sign-extended to 32 bits first; 0 to 2 ** 32 - 1 as long, null for null.

    Whole batches are hashed together, each different token of a batch once.
    """
    return _hash(_c(token))


def token_hashes(tokens: Column | str) -> Column:
    """token_hash of each element of an array<string> without nulls."""
    return _hashes(_c(tokens))


def char_ngrams(token: Column | str, minn: int, maxn: int) -> Column:
    """Substrings of <token> of minn to maxn code points, by place and then length; single marks are left out."""
    none = F.array().cast("array<string>")
    if maxn <= 0:
        return none

    def over(w: Column) -> Column:
        size = F.length(w)
        at = lambda i: F.transform(F.sequence(F.lit(max(minn, 1)), F.greatest(F.least(F.lit(maxn), size - i + 1), F.lit(max(minn, 1)))), lambda n: F.struct(i.alias("i"), n.alias("n")))
        spans = F.flatten(F.transform(F.sequence(F.lit(1), size), at))
        fits = F.filter(spans, lambda s: (s["i"] + s["n"] - 1 <= size) & (s["n"] <= maxn) & ~((s["n"] == 1) & ((s["i"] == 1) | (s["i"] == size))))
        return F.transform(fits, lambda s: F.substring(w, s["i"], s["n"]))

    return let(F.concat(F.lit("<"), _c(token), F.lit(">")), over)


def ngram_ids(token: Column | str, minn: int, maxn: int, bucket: int) -> Column:
    """Bucket ids of the n-grams; none without buckets. Null counts as an empty token."""
    if bucket <= 0 or maxn <= 0:
        return F.array().cast("array<bigint>")

    @F.arrow_udf(ArrayType(LongType()))
    def ids(words: pa.Array) -> pa.Array:
        return hashing.ngram_lists(words.fill_null(""), minn, maxn, bucket)

    return ids(_c(token))


def word_ngram_ids(hashes: Column, n: int, bucket: int) -> Column:
    """Bucket ids of all spans of 2 to n tokens of an array of token hashes, by first token and then length."""
    if bucket <= 0 or n <= 1:
        return F.array().cast("array<bigint>")

    @F.arrow_udf(ArrayType(LongType()))
    def ids(lists: pa.Array) -> pa.Array:
        offsets, values = hashing.list_parts(lists)
        return hashing.to_lists(*hashing.word_ngrams(offsets, values.to_numpy(zero_copy_only=False), n, bucket))

    return ids(hashes.cast("array<bigint>"))
