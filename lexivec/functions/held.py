"""A small model as the tasks hold it: predictions and vectors of whole batches of texts, for SQL functions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast

from ..errors import InvalidArgument
from ..operators import features, neighbors, scoring
from ..operators.scoring import BROADCAST_NUMBERS, Held, Model
from ..operators.vocabulary import Lookup
from ..params import LossKind
from . import vectors as V
from .text import EOS

#: What parts tokens: ASCII white space, and in sentences for word vectors any white space.
_BLANK, _ANY_BLANK = re.compile(r"[ \t\n\f\r]+"), re.compile("[\t-\r \x85\xa0  -     　]+")


def tokens(text: str | None) -> list[str]:
    """Tokens as text.tokens gives them: a literal </s> ends the text."""
    found = [t for t in _BLANK.split(text or "") if t]
    return found[: found.index(EOS) + 1] if EOS in found else found


def simple_tokens(text: str | None) -> list[str]:
    return [t for t in _ANY_BLANK.split(text or "") if t]


@dataclass
class HeldModel:
    """Tables are broadcast once and shared by the calls of a Python worker."""

    look: Lookup
    table: Held
    output: Held | None
    tree: Broadcast | None
    labels: list[str]
    #: (words, their vectors at length 1) in the order of ids
    words: Broadcast
    loss: LossKind
    supervised: bool
    dim: int

    @classmethod
    def of(cls, model: Model) -> HeldModel:
        """Raises InvalidArgument for models beyond the limits of what tasks hold; these are asked by DataFrame calls."""
        v, p = model.vocabulary, model.params
        look, table = v.for_tasks(), scoring.hold(model.input, (v.nwords + max(p.bucket, 0)) * p.dim, p.dim)
        output = scoring.hold(model.output, v.nlabels * p.dim, p.dim, "row") if model.is_supervised else None
        if look is None or table is None or (model.is_supervised and output is None) or v.nwords * p.dim > BROADCAST_NUMBERS:
            raise InvalidArgument("the model is too large to be held by each task; use scoring.predict and its like")
        spark = model.input.sparkSession
        labels = [r.token for r in v.labels().orderBy("label_id").collect()]
        own = neighbors.normalized(scoring.word_vectors(v.words().select("token"), model), "token", "vec")
        rows = v.words().select("id", "token").join(own, "token").toArrow().sort_by("id").combine_chunks()
        matrix = np.asarray(rows["vec"].combine_chunks().flatten(), np.float64).reshape(-1, p.dim) if rows.num_rows else np.zeros((0, p.dim))
        tree = scoring._held_tree(model) if model.is_supervised and p.loss == LossKind.HS else None
        return cls(look, table, output, tree, labels, spark.sparkContext.broadcast((rows["token"].to_pylist(), matrix)), p.loss, model.is_supervised, p.dim)

    def predict(self, texts: list[str | None], k: int, threshold: float) -> list[list[tuple[str, float]]]:
        """(label, prob) of each text's k best labels, best first; prob is p + 1e-5 as in with_labels."""
        if not self.supervised or k <= 0 or not self.labels:
            return [[] for _ in texts]
        fids, _ = features.line_lists(pa.array([tokens(t) for t in texts], pa.list_(pa.string())), self.look, True)
        best = scoring._best(*scoring._ids(fids), self.table, self.output, self.tree, self.loss, min(k, len(self.labels)), max(float(threshold), 0.0))
        return [[(self.labels[s["label_id"]], s["p"] + V.LOG_SHIFT) for s in own] for own in best.to_pylist()]

    def word_vectors(self, words: list[str | None]) -> np.ndarray:
        """Means of subword rows, of unknown words too; zeros for null, labels and words without any."""
        asked = pa.array([w or "" for w in words], pa.string())
        ids = self.look.ids(asked)
        offsets, subs = self.look.subwords(asked, np.where(ids >= self.look.nwords, -1, ids))
        out = self.table.means(offsets, subs)
        out[[w is None or i >= self.look.nwords for w, i in zip(words, ids.tolist(), strict=True)]] = 0
        return out

    def sentence_vectors(self, texts: list[str | None]) -> np.ndarray:
        """As scoring.sentence_vectors."""
        if self.supervised:
            fids, _ = features.line_lists(pa.array([tokens(t) for t in texts], pa.list_(pa.string())), self.look, True)
            return self.table.means(*scoring._ids(fids))
        split = [simple_tokens(t) for t in texts]
        different = sorted({t for own in split for t in own})
        at, out = {t: k for k, t in enumerate(different)}, np.zeros((len(texts), self.dim))
        vectors = self.word_vectors(different)
        length = np.sqrt((vectors**2).sum(axis=1))
        for k, own in enumerate(split):
            some = [at[t] for t in own if length[at[t]] > 0]
            if some:
                out[k] = (vectors[some] / np.where(length[some] >= 1e-8, length[some], 1)[:, None]).mean(axis=0)
        return out

    def nearest(self, word: str | None, k: int) -> list[tuple[str, float]]:
        """(token, cosine) of the k words most like a word, itself left out; ties by token."""
        names, matrix = self.words.value
        own = self.word_vectors([word])[0]
        length = float(np.sqrt(own @ own))
        if k <= 0 or not len(names) or word is None:
            return []
        sim = matrix @ (own / length if length >= 1e-8 else own)
        least = np.partition(sim, max(len(sim) - k - 1, 0))[max(len(sim) - k - 1, 0)]
        near = sorted(((-s, names[i]) for i, s in zip(np.flatnonzero(sim >= least).tolist(), sim[sim >= least].tolist(), strict=True) if names[i] != word))
        return [(token, -s) for s, token in near[:k]]
