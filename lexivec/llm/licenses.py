"""License scans by ordered signature rules, in SQL functions.

A text's words, lower-cased and joined by blanks, are searched by the regular expressions
of those rules whose keywords they contain; a text that has none of the keywords is done.
Detections are word intervals; one that lies in a longer one, or in the same interval by
a rule of higher priority, is suppressed. The rules are in ``license_rules``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES, STEMS, Rule

#: Phrases that are looked for in every text: words, label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_APART = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_FOUND = "array<struct<start:int,back:int,priority:int,label:string,weight:double>>"


def in_words(text: str) -> str:
    """SQL: the words of a text, A-Z lower-cased, with a blank before, between and after."""
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"concat(' ', trim(regexp_replace({lower}, '{_APART}', ' ')), ' ')"


def let(value: str, name: str, use: str) -> str:
    """SQL: ``use``, in which ``name`` is the value, made once a row."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def blanks(x: str) -> str:
    return f"(octet_length({x}) - octet_length(replace({x}, ' ', '')))"


def label_of(rule: Rule) -> str:
    if "$1" not in rule.label:
        return f"'{rule.label}'"
    before, after = rule.label.split("$1")
    return f"concat('{before}', translate(regexp_extract(substring_index(x, '\\u0002', 1), '^(?:{rule.pattern})$', 1), ' ', '.'), '{after}')"


def detections(rule: Rule, priority: int) -> str:
    """SQL: a rule's leftmost matches of whole words in ``w``; back is the negative end.

    Matches are marked by control characters, which words don't have, and the text is
    split there; words are counted by the blanks of the pieces.
    """
    marked = f"split(regexp_replace(w, '(?<= )(?:{rule.pattern})(?= )', '\\u0001$0\\u0002'), '\\u0001')"
    one = f"named_struct('start', acc.n - 1, 'back', -(acc.n + {blanks("substring_index(x, '\\u0002', 1)")}), 'priority', {priority}, 'label', {label_of(rule)}, 'weight', {rule.weight}D)"
    folded = f"aggregate(slice(p, 2, size(p)), named_struct('n', {blanks('p[0]')}, 'found', cast(array() as {_FOUND})), (acc, x) -> named_struct('n', acc.n + {blanks('x')}, 'found', array_append(acc.found, {one})), acc -> acc.found)"
    return let(marked, "p", folded)


def all_detections(rules: list[Rule]) -> str:
    """SQL: the detections in ``w`` of all rules that have a keyword there, in order of start, longest first, then priority."""
    has = lambda r: " or ".join(f"contains(w, '{k}')" for k in r.keywords)
    each = ", ".join(f"case when {has(r)} then {detections(r, k)} else cast(array() as {_FOUND}) end" for k, r in enumerate(rules))
    return f"sort_array(flatten(array({each})))"


def unsuppressed(found: str) -> str:
    """SQL: struct<labels, weight> of sorted detections; one that ends within what came before is dropped."""
    kept = "named_struct('until', -d.back, 'labels', array_union(s.labels, array(d.label)), 'weight', greatest(s.weight, d.weight))"
    return f"aggregate({found}, named_struct('until', 0, 'labels', cast(array() as array<string>), 'weight', 0.0D), (s, d) -> case when -d.back > s.until then {kept} else s end, s -> named_struct('labels', s.labels, 'weight', s.weight))"


def gates(rules: list[Rule]) -> list[str]:
    """Strings of which the words have one if a rule or a base phrase is in them: a stem of each keyword, or itself where it has none."""
    keywords = {k for r in rules for k in r.keywords} | {f" {phrase} " for phrase, _ in BASE}
    every = {next((s for s in STEMS if s in k), k) for k in keywords}
    return sorted(k for k in every if not any(o != k and o in k for o in every))


def result(rules: list[Rule]) -> str:
    """SQL: struct<n_words, r struct<base, found>> of a column ``text``; r is null without any gate."""
    base = ", ".join(detections(Rule(label, phrase, 0.0), k) for k, (phrase, label) in enumerate(BASE))
    looked = f"named_struct('base', transform(flatten(array({base})), b -> named_struct('label', b.label, 'start', cast(b.start as bigint))), 'found', {unsuppressed(all_detections(rules))})"
    gate = " or ".join(f"contains(w, '{k}')" for k in gates(rules))
    n_words = f"cast(case when w = '  ' then 0 else {blanks('w')} - 1 end as bigint)"
    return let(in_words("text"), "w", f"named_struct('n_words', {n_words}, 'r', case when {gate} then {looked} end)")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """(id, n_words, base array<struct<label,start>>, labels array<string>, weight) for each row of docs.

    Null text counts as empty; ``base`` has every place of a base phrase, ``labels`` and
    the largest ``weight`` are of what the rules leave after suppression. Repeated rows
    give a row each; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = lambda column, kind: F.coalesce(column, F.array().cast(kind))
    return rows.select("id", F.expr(result(rules)).alias("s")).select(
        "id",
        F.col("s.n_words").alias("n_words"),
        none(F.col("s.r.base"), "array<struct<label:string,start:bigint>>").alias("base"),
        none(F.col("s.r.found.labels"), "array<string>").alias("labels"),
        F.coalesce("s.r.found.weight", F.lit(0.0)).alias("weight"),
    )


__all__ = ["BASE", "RULES", "Rule", "gates", "scan"]
