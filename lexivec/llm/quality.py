"""Quality rules as a short-circuit cascade.

Each rule rejects a document by a measure of its text. On a bounded sample the cost of
each rule and the share that it rejects are estimated, and the rules are tried in order
of rejection per cost; a document leaves at its first rejection. The order changes only
the work: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, text_bytes

#: Most documents timed on the driver.
SAMPLE_ROWS = 256
#: Most bytes of a text that are timed.
SAMPLE_BYTES = 1 << 16


class Measures:
    """Measures of one text (UTF-8), each made when it is first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: all but white space and UTF-8 continuation bytes."""
        own = np.frombuffer(self.text, np.uint8)
        return len(own) - int(np.count_nonzero((own & 0xC0) == 0x80)) - int(np.count_nonzero((own == 32) | (own - np.uint8(9) < 5)))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that are found twice or more."""
        n = self.n_words - 2
        if n < 2:
            return 0
        of: dict[bytes, int] = {}
        ids = np.fromiter((of.setdefault(w, len(of)) for w in self.words), np.int64, self.n_words)
        if len(of) == self.n_words:
            return 0
        # pairs are numbered anew, so that no product of three ids can overflow
        pair = np.unique(ids[:-1] * len(of) + ids[1:], return_inverse=True)[1] if len(of) > 2_000_000 else ids[:-1] * len(of) + ids[1:]
        _, at, counts = np.unique(pair[:-1] * len(of) + ids[2:], return_inverse=True, return_counts=True)
        again = counts[at] > 1
        hit = np.zeros(self.n_words, bool)
        for k in range(3):
            hit[k : k + n] |= again
        return int(hit.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 25 * m.n_words),
    Rule("dup_lines", lambda m: 2 * m.n_dup_lines > len(m.lines)),
)


def order_rules(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per second of cost on a sample, the best first; ties as given.

    A rule's rejections are counted on the texts that the rules before it leave, as these
    are all that it sees. An empty sample keeps the order given. Rules that reject nothing
    more come last, cheapest first.
    """
    cost, hits = [], []
    for rule in rules:
        began = time.perf_counter()
        hits.append({k for k, x in enumerate(texts) if rule.rejects(Measures(x))})
        cost.append(max(time.perf_counter() - began, 1e-9))
    left, seen, out = set(range(len(rules))), set(range(len(texts))), []
    while left:
        # most rejections per cost; if none is left, the cheapest
        best = min(left, key=lambda k: (-len(hits[k] & seen) / cost[k], cost[k] if texts else 0.0, k))
        out.append(rules[best])
        left.remove(best)
        seen -= hits[best]
    return out


def sample_texts(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[bytes]:
    """At most ``rows`` texts, of long ones the first SAMPLE_BYTES bytes, for timing only; they don't change what is kept."""
    return [bytes(r[0]) for r in docs.select(F.substring(text_bytes(text_col), 1, SAMPLE_BYTES)).limit(rows).toLocalIterator()]


def first_rejection(m: Measures, rules: list[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(m)), None)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(id, *measures, base_failed, kept) for each row; null text counts as empty and is rejected.

    Measures that are not asked for are made only if a rule gets to them.
    """
    ordered = order_rules(sample_texts(docs, text_col), rules)

    def run(texts: list) -> list[pa.Array]:
        rows = []
        for t in texts:
            m = Measures(t)
            kept = first_rejection(m, ordered) is None
            rows.append((*(getattr(m, k) for k in measures), any(r.rejects(m) for r in BASE_RULES) if measures else not kept, kept))
        columns = list(zip(*rows, strict=True)) or [()] * (len(measures) + 2)
        return [pa.array(c, pa.int64()) for c in columns[:-2]] + [pa.array(c, pa.bool_()) for c in columns[-2:]]

    schema = ", ".join(["id long", *(f"{x} long" for x in measures), "base_failed boolean", "kept boolean"])
    return per_text(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")), run, schema)


def filter_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    ordered = order_rules(sample_texts(docs, text_col), rules)

    @F.pandas_udf("boolean")
    def keeps(texts):
        return texts.map(lambda t: first_rejection(Measures(t), ordered) is None).astype(bool)

    return docs.where(keeps(text_bytes(text_col)))
