"""Scoring texts with a language model that is trained on a part of the corpus.

1. Words. Each task gives the different words of its documents numbers, and writes its
   documents as lists of numbers and its words with their training occurrences, as parts
   of bounded size. Adding up the words of all parts gives exact counts.
2. Training. The model (``attention``) sees every training document once, in waves: tasks
   step through their documents from the same weights, and the mean of what they come to,
   by ids seen, starts the next wave. Weights are a few hundred thousand numbers, whatever
   the size of the corpus; documents stay where they are.
3. Scores. Parts get the counts of their words by a join, and every document is scored in
   overlapping windows.

Subword ids are those of a byte-level BPE rank file, cut to its first ranks (beginnings of
a rank file are BPE vocabularies too); each word is encoded with a blank before it.
"""

from __future__ import annotations

import array
import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import attention
from .common import fresh_dir, text_bytes

#: Different words, and words, after which a task begins a new part; also the words whose ids a task remembers.
PART_WORDS, PART_TOKENS = 400_000, 6_000_000
#: Texts, and bytes of them, after which those that are taken apart at once end.
TAKEN_TEXTS, TAKEN_BYTES = 500, 4 << 20
#: Words that are encoded by one call.
ENCODED_WORDS = 2000
#: Windows of a training step, and of a piece that is scored.
STEP_WINDOWS, SCORE_WINDOWS = 256, 1024
#: Words whose windows are made together.
STEP_WORDS = 50_000
#: Waves of training: the sixteenths of the documents up to which each goes, and its rate.
WAVES = ((1, 0.03), (6, 0.02), (16, 0.006))
#: The end of a text as a word; no word is empty.
END = b""


@dataclass(frozen=True)
class Coding:
    """The rank file, the pattern of its pre-tokens, and the shape of the model."""

    path: str
    pattern: str
    shape: attention.Shape = attention.Shape()


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training; ids are taken as text, null ids as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def stretches(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some at once: TAKEN_TEXTS at most, and no more after TAKEN_BYTES of their texts."""
    sizes = pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(sizes):
        n = 1 + int(np.searchsorted(np.cumsum(sizes[at : at + TAKEN_TEXTS]), TAKEN_BYTES))
        yield batch.slice(at, min(n, TAKEN_TEXTS))
        at += min(n, TAKEN_TEXTS)


def taken(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers of the words of all texts, one after the other; these words; how many each text has): A-Z in lower case, END after each text."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(kind)))
    found = lists.flatten().dictionary_encode()
    words, numbers = found.dictionary.view(texts.type).to_pylist(), found.indices.to_numpy()
    # white space at either side of a text leaves an empty word there
    if END not in words:
        words.append(END)
    end = words.index(END)
    some = numbers != end
    begins = np.concatenate(([0], np.cumsum(some)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return np.insert(numbers[some], begins[1:], end), words, np.diff(begins) + 1


class Words(dict):
    """Numbers of words, in the order of their coming."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Pieces(dict):
    """Words to numbers, in the order of their coming; ``table`` has their subword ids."""

    def __init__(self, coding: Coding):
        import tiktoken

        super().__init__()
        with open(coding.path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines)) if int(b) < coding.shape.ids - 1}
        self.encoding = tiktoken.Encoding("pieces", pat_str=coding.pattern, mergeable_ranks=ranks, special_tokens={})
        # ids go by the order of their bytes, so that classes are alike
        self.of_rank, self.end = np.zeros(max(ranks.values()) + 1, np.int16), coding.shape.ids - 1
        self.of_rank[[ranks[t] for t in sorted(ranks)]] = np.arange(len(ranks))
        self.blank = np.array([t.startswith(b" ") for t in sorted(ranks)] + [False] * (coding.shape.ids - len(ranks)))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.sizes = array.array("h"), array.array("i")

    def __missing__(self, word: bytes) -> int:
        self.add([word])
        return self[word]

    def add(self, words: list[bytes]) -> None:
        """Give numbers to words that have none, each once in the list."""
        ids, sizes = self.encoded(words)
        self.ids.frombytes(ids.tobytes())
        self.sizes.frombytes(sizes.astype(np.int32).tobytes())
        self.update(zip(words, range(len(self), len(self) + len(words)), strict=True))

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; how many each has)."""
        found = [self._encoded(words[k : k + ENCODED_WORDS]) for k in range(0, len(words), ENCODED_WORDS)]
        return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0, np.int16), np.zeros(0, np.int64))

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = " " + b" ".join(words).decode()
        # words without white space of any kind are apart by the blanks before them, so one call encodes them all
        if len(words) > 1 and text.split() == text[1:].split(" ") and max(map(len, words)) < 1000:
            ids = self.of_rank[self.encoding.encode_ordinary(text)]
            begins = np.flatnonzero(self.blank[ids])
            if len(begins) == len(words):
                return ids, np.diff(begins, append=len(ids))
        if len(words) > 1:
            halves = self._encoded(words[: len(words) // 2]), self._encoded(words[len(words) // 2 :])
            return tuple(np.concatenate(x) for x in zip(*halves, strict=True))
        if words == [END]:
            return np.array([self.end], np.int16), np.ones(1, np.int64)
        ids = np.concatenate([self.of_rank[self.encoding.encode_ordinary(text[k : k + 1000])] for k in range(0, len(text), 1000)])
        return ids, np.array([len(ids)])

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start of each word's, how many it has)."""
        return table(np.array(self.ids, np.int16), np.array(self.sizes, np.int64))


def table(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ids, np.cumsum(sizes) - sizes, sizes


def spread(table: tuple[np.ndarray, np.ndarray, np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all lists of word numbers, one after the other; how many each list has)."""
    ids, starts, sizes = table
    words = np.concatenate(numbers)
    n = sizes[words]
    after = np.cumsum(n)
    ends = np.cumsum([len(x) for x in numbers])
    return ids[np.arange(after[-1]) + np.repeat(starts[words] - after + n, n)], np.diff(after[ends - 1], prepend=0)


_PIECES: dict[Coding, Pieces] = {}


def pieces(coding: Coding) -> Pieces:
    if coding not in _PIECES:
        _PIECES[coding] = Pieces(coding)
    return _PIECES[coding]


# --- words ---------------------------------------------------------------------------

_CODED = "part long, id long, held boolean, numbers binary, number int, word binary, n long"
_COLUMNS = [x.split()[0] for x in _CODED.split(", ")]


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, counts, tokens = Words(), np.zeros(0, np.int64), 0
    part = TaskContext.get().partitionId() << 24

    def emit(ids, held, numbers, words, n) -> pa.RecordBatch:
        rows, more = len(ids), len(words)
        none = lambda k, kind: pa.nulls(k, kind)
        columns = [
            pa.array(np.full(rows + more, part)),
            pa.concat_arrays([ids, none(more, pa.int64())]),
            pa.concat_arrays([held, none(more, pa.bool_())]),
            pa.concat_arrays([numbers, none(more, pa.binary())]),
            pa.concat_arrays([none(rows, pa.int32()), pa.array(np.arange(more, dtype=np.int32))]),
            pa.concat_arrays([none(rows, pa.binary()), pa.array(words, pa.binary())]),
            pa.concat_arrays([none(rows, pa.int64()), pa.array(n, pa.int64())]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)

    def flush() -> pa.RecordBatch:
        return emit(*(pa.nulls(0, kind) for kind in (pa.int64(), pa.bool_(), pa.binary())), list(own), counts[: len(own)])

    for batch in batches:
        for some in stretches(batch, 2):
            found, words, lengths = taken(some.column(2))
            found = np.fromiter(map(own.__getitem__, words), np.int32, len(words))[found]
            tokens += len(found)
            if len(own) > len(counts):
                counts = np.concatenate((counts, np.zeros(len(own), np.int64)))
            learned = np.bincount(found[np.repeat(~some.column(1).to_numpy(zero_copy_only=False), lengths)])
            counts[: len(learned)] += learned
            ends = np.concatenate(([0], np.cumsum(4 * lengths))).astype(np.int32)
            yield emit(some.column(0), some.column(1), pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(found)]), [], [])
            if len(own) > PART_WORDS or tokens > PART_TOKENS:
                yield flush()
                own, counts, tokens, part = Words(), np.zeros(0, np.int64), 0, part + 1
    yield flush()


def coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents (part, id, held, numbers) and words (part, number, word, n): n training occurrences; the end of a text is a word too."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(_code, _CODED)


def _written(df: DataFrame, name: str) -> DataFrame:
    where = fresh_dir(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


# --- training ------------------------------------------------------------------------


def _id_counts(coding: Coding):
    """(id, n) of the words' subword ids, from (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = pieces(coding), np.zeros(coding.shape.ids)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, sizes = own.encoded(words)
            total += np.bincount(ids, np.repeat(n, sizes), len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], names=["id", "n"])

    return run


def _before(ids: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(lengths) - lengths] = end
    return out


def _train(coding: Coding, flat: np.ndarray, rate: float):
    """Rows (row, seen, vec) of the weights that the texts of a task lead to from ``flat``; none without texts."""
    shape = coding.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = pieces(coding), 0
        net, adam = attention.Net(shape, flat.copy()), attention.Adam(shape.size, rate)

        def step(x: np.ndarray, y: np.ndarray, live: np.ndarray) -> None:
            g = net.gradient(x, y, live)[1]
            g /= np.float32(live.sum())
            adam.step(net.flat, g)

        def learn(numbers: list[np.ndarray]) -> int:
            ids, lengths = spread(own.table(), numbers)
            places = attention.windows(lengths, shape.window, shape.window)
            look = attention.Windows(ids, _before(ids, lengths, shape.ids - 1), shape.window)
            for k in range(0, len(places[0]), STEP_WINDOWS):
                step(*look.take(*(p[k : k + STEP_WINDOWS] for p in places)))
            return len(ids)

        held, n = [], 0
        for some in (s for batch in batches for s in stretches(batch, 0)):
            found, words, lengths = taken(some.column(0))
            own.add([w for w in words if w not in own])
            found = np.fromiter(map(own.__getitem__, words), np.int64, len(words))[found]
            for numbers in np.split(found, np.cumsum(lengths)[:-1]):
                held.append(numbers)
                n += len(numbers)
                if n >= STEP_WORDS:
                    seen, held, n = seen + learn(held), [], 0
            if len(own) > PART_WORDS:
                seen, held, n = seen + (learn(held) if held else 0), [], 0
                own.forget()
        if held:
            seen += learn(held)
        own.forget()
        if seen:
            vec = np.zeros(-(-shape.size // shape.dim) * shape.dim, np.float32)
            vec[: shape.size] = net.flat
            rows = len(vec) // shape.dim
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.array(np.full(rows, float(seen))), pa.FixedSizeListArray.from_arrays(pa.array(vec), shape.dim).cast(pa.list_(pa.float32()))], names=["row", "seen", "vec"])

    return run


def fit(docs: DataFrame, counts: DataFrame, coding: Coding, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The weights of a model trained on the documents that aren't held out; counts: (word, n) of these.

    Each wave's documents are told by a hash of id and text, so a repeated row is seen as
    often as it is there. Only sums of weights, of a size that the shape alone decides,
    come to the driver.
    """
    shape = coding.shape
    total = np.zeros(shape.ids)
    for r in counts.select("word", "n").mapInArrow(_id_counts(coding), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r.id] = r.n
    flat, since = shape.start(total), 0
    own = docs.where(~held_out(id_col)).select(text_bytes(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(16)).alias("slice"))
    for upto, rate in WAVES:
        texts = own.where((F.col("slice") >= since) & (F.col("slice") < upto)).select("text")
        rows = texts.mapInArrow(_train(coding, flat, rate), "row long, seen double, vec array<float>")
        sums = [F.sum(F.col("seen") * F.get("vec", F.lit(k))).alias(f"s{k}") for k in range(shape.dim)]
        means = rows.groupBy("row").agg(F.sum("seen").alias("seen"), *sums).toArrow().sort_by("row")
        if means.num_rows:
            table = np.stack([means[f"s{k}"].to_numpy() for k in range(shape.dim)], axis=1) / means["seen"].to_numpy()[:, None]
            flat = table.ravel()[: shape.size].astype(np.float32)
        since = upto
    return flat


# --- scores --------------------------------------------------------------------------


def _scored(coding: Coding, flat: np.ndarray, total: int, different: int):
    """The scores of a part's documents, from them (part, id, held, numbers) and its words (part, number, word, c)."""
    shape = coding.shape

    def run(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        words = words.sort_values("number")
        c = words["c"].to_numpy(np.float64)
        logs = np.log10((c + 0.5) / (total + 0.5 * (different + 1)))
        net, known_words = attention.Net(shape, flat), table(*pieces(coding).encoded(words["word"].tolist()))
        out, score, waiting, held = [], np.zeros(len(docs)), [], 0

        def settle(first: int) -> None:
            """Score the documents that wait, the first of which is the ``first`` of all."""
            ids, lengths = spread(known_words, waiting)
            of = first + np.repeat(np.arange(len(lengths)), lengths)
            places = attention.windows(lengths, shape.window, shape.fresh)
            look = attention.Windows(ids, _before(ids, lengths, shape.ids - 1), shape.window)
            for k in range(0, len(places[0]), SCORE_WINDOWS):
                start, begin, end = (p[k : k + SCORE_WINDOWS] for p in places)
                x, y, live = look.take(start, begin, end)
                score[:] += np.bincount(np.repeat(of[start], live.sum(axis=1)), net.scores(x, y, live), len(score))

        for k, numbers in enumerate(docs["numbers"]):
            numbers = np.frombuffer(numbers, "<i4").astype(np.int64)
            out.append((len(numbers), int((c[numbers] > 0).sum()), float(logs[numbers].sum())))
            waiting.append(numbers)
            held += len(numbers)
            if held > STEP_WORDS:
                settle(k + 1 - len(waiting))
                waiting, held = [], 0
        if waiting:
            settle(len(docs) - len(waiting))
        known = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score"])
        return pd.DataFrame({"id": docs["id"].to_numpy(), "held": docs["held"].to_numpy(), "n_tokens": known["n_tokens"], "n_known": known["n_known"], "base_score": known["base_score"], "score": score / np.log(10)})

    return run


def score(docs: DataFrame, coding: Coding, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    Tokens are words and one end. base_score is that of the words' training counts; score
    is the model's log10 probability of the text's subword ids and its end. Null and empty
    texts are an end only; a null id is never held out (its crc32 is that of no bytes);
    repeated rows are scored each, and counted each in training. Without training
    documents the counts are 0 and the model is as it starts. An empty table gives no rows.
    """
    both = _written(coded(docs, id_col, text_col), "lm-words")
    by_word = Window.partitionBy("word")
    words = both.where("word is not null").select("part", "number", "word", "n")
    first = F.row_number().over(by_word.orderBy("part")) == 1
    counted = _written(words.select("part", "number", "word", F.sum("n").over(by_word).alias("c"), first.alias("first")), "lm-counts")
    different = counted.where("first and c > 0").select("word", F.col("c").alias("n"))
    total, n_words = different.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    flat = fit(docs, different, coding, id_col, text_col)
    own = both.where("word is null").select("part", "id", "held", "numbers")
    parts = own.groupBy("part").cogroup(counted.select("part", "number", "word", "c").groupBy("part"))
    run = _scored(coding, flat, int(total), int(n_words))
    found = parts.applyInPandas(lambda docs, words: run(docs, words), "id long, held boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
