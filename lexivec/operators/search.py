"""Hyper-parameter search under a time, and if wanted a size, budget."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rng
from ..errors import Aborted, InvalidArgument
from ..params import LossKind, Params, parse_metric, parse_size
from . import features, metrics, quantization, scoring, training
from .scoring import Model

#: Name, least, most, spread at the start and at the end, whether steps are added (else they are powers of 2).
STEPS = (
    ("epoch", 1, 100, 2.8, 2.5, False),
    ("lr", 0.01, 5.0, 1.9, 1.0, False),
    ("dim", 1, 1000, 1.4, 0.3, False),
    ("word_ngrams", 1, 5, 4.3, 2.4, True),
    ("dsub", 1, 4, 2.0, 1.0, True),
    ("minn", 0, 2, 4.0, 1.4, True),
    ("bucket", 10_000, 10_000_000, 2.0, 1.5, False),
)
MINN = (0, 2, 3)
DEFAULT_BUCKET = 2_000_000
#: Trials of a round are compared when they have run one part in so many of their epochs; each time the better half goes on.
RUNGS = (4, 2, 1)


def spread_at(start: float, end: float, share: float) -> float:
    """Full spread in the first quarter of the time, falling to the end's in the middle half."""
    return start + (end - start) * min(max(share - 0.25, 0.0), 0.5) / 0.5


@dataclass
class Proposals:
    """Parameters to try: first those given, then the best so far, disturbed by normal steps."""

    best: Params
    duration: float
    seed: int = 0
    trials: int = 0
    _draws: int = field(default=0, repr=False)

    def _normal(self) -> float:
        u, v = (rng.draw(self.seed, self._draws + k) / rng.M for k in (1, 2))
        self._draws += 2
        return math.sqrt(-2 * math.log(max(u, 1e-15))) * math.cos(2 * math.pi * v)

    def next(self, elapsed: float) -> Params:
        self.trials += 1
        if self.trials == 1:
            return self.best
        share = min(elapsed / self.duration, 1.0) if self.duration > 0 else 1.0
        b = self.best
        now = {"epoch": b.epoch, "lr": b.lr, "dim": b.dim, "word_ngrams": b.word_ngrams, "dsub": round(math.log2(max(b.dsub, 1))), "minn": MINN.index(b.minn) if b.minn in MINN else 0, "bucket": b.bucket or DEFAULT_BUCKET}
        new = {}
        for name, least, most, start, end, added in STEPS:
            step = self._normal() * spread_at(start, end, share)
            value = min(max(now[name] + step if added else now[name] * 2.0**step, least), most)
            new[name] = value if name == "lr" else int(value)
        new["dsub"], new["minn"] = 2 ** new["dsub"], MINN[new["minn"]]
        new["maxn"] = new["minn"] + 3 if new["minn"] else 0
        if new["word_ngrams"] <= 1 and not new["maxn"]:
            new["bucket"] = 0
        return replace(b, loss=LossKind.SOFTMAX, **new)


def evaluate(model: Model, docs: DataFrame, k: int = 1, threshold: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(predictions, gold, confusion, examples) on labelled lines; lines without known labels or ids are left out."""
    lines = features.line_features(docs, model.vocabulary, id_col, text_col, eos=True, eos_in_ngrams=True).where((F.size("labels") > 0) & (F.size("fids") > 0))
    given = scoring.predict_features(lines, model, k, threshold, id_col)
    predictions = given.select(id_col, F.explode("predictions").alias("s")).select(id_col, "s.label_id", F.least(F.col("s.p") + 1e-5, F.lit(1.0)).alias("p"))
    gold = lines.select(id_col, F.explode("labels").alias("label_id"))
    return predictions, gold, metrics.confusion(predictions, gold, id_col), lines.count()


def score(model: Model, docs: DataFrame, metric: str = "f1", k: int = 1, **columns) -> float:
    """f1 (micro, or of a label), or the best precision at a recall and the reverse; -inf where undefined."""
    name, bound, label = parse_metric(metric)
    label_id = None
    if label is not None:
        row = model.vocabulary.labels().where(F.col("token") == label).select("label_id").first()
        if row is None:
            raise InvalidArgument(f"no label {label!r}")
        label_id = row[0]
    n_labels = model.vocabulary.nlabels
    predictions, gold, counts, n = evaluate(model, docs, k if name == "f1" else n_labels, **columns)
    if name == "f1":
        found = metrics.micro(counts, n, k, n_labels).first()["f1"] if label_id is None else next((r["f1"] for r in metrics.per_label(counts.where(F.col("label_id") == label_id)).collect()), None)
    else:
        id_col = columns.get("id_col", "doc_id")
        if label_id is None:
            predictions, gold = predictions.withColumns({id_col: F.struct(id_col, "label_id"), "label_id": F.lit(0)}), gold.withColumns({id_col: F.struct(id_col, "label_id"), "label_id": F.lit(0)})
        else:
            predictions, gold = predictions.where(F.col("label_id") == label_id), gold.where(F.col("label_id") == label_id)
        points = metrics.curve(predictions, gold, id_col)
        best = (metrics.precision_at_recall if name == "precision_at_recall" else metrics.recall_at_precision)(points, bound / 100)
        found = next((r["value"] for r in best.collect()), None)
    return -math.inf if found is None else found


@dataclass
class Found:
    model: Model | quantization.QuantizedModel
    params: Params
    score: float
    trials: int


@dataclass
class Trial:
    """Parameters that are tried: the training so far, and the score of the model that it has come to; none if that is too large."""

    params: Params
    course: training.Course | None = None
    score: float | None = None


def side_by_side(spark: SparkSession, works: list[Callable], at_once: int, over: Callable[[int], bool]) -> list[training.Interruptible | None]:
    """Works, each given a Stop, in threads of their own, so many at once; the k-th is ended, or not begun (then None), once over(k)."""
    out: list[training.Interruptible | None] = [None] * len(works)
    waiting, live = list(range(len(works))), []
    while waiting or live:
        waiting = [k for k in waiting if not over(k)]
        while waiting and len(live) < at_once:
            k = waiting.pop(0)
            out[k] = training.Interruptible(spark, works[k], whole=True)
            live.append(k)
        for k in list(live):
            if out[k].wait(0.1 / len(live)):
                live.remove(k)
            elif over(k):
                out[k].abort()
                live.remove(k)
    return out


def autotune(train_docs: DataFrame, valid_docs: DataFrame, params: Params, most_trials: int | None = None, stop: threading.Event | None = None, together: int = 1, at_once: int | None = None, **columns) -> Found:
    """The best of the trials that fit in autotune_duration seconds, trained once more on train_docs.

    At least one trial is run, and at most most_trials. With autotune_model_size a trial counts only if the model
    quantized with its dsub is within the size, and the quantized model is returned. A
    trial that fails (weights that aren't numbers, nothing in the vocabulary) is passed over.
    When the time is up, the jobs of the trials that run are ended, those of their scores too;
    so they are once stop is set, and the best trial until then is trained.

    Trials go by rounds of ``together``, whose parameters are all proposed from the best of
    the rounds before. They share the vocabulary and, where their parameters allow, the
    lines. A round's trials are scored after a quarter and a half of their epochs, and each
    time the worse half is given up. at_once of them (all if None) run at the same time, as
    Spark jobs side by side; this changes the time, not the result.
    """
    most = parse_size(params.autotune_model_size) if params.autotune_model_size else None
    began, best = time.monotonic(), None
    ask = Proposals(params, params.autotune_duration, params.seed)
    prepared = training.Prepared(train_docs, params, **columns)
    time_up = lambda: time.monotonic() - began >= params.autotune_duration
    stopped = lambda: stop is not None and stop.is_set()

    def work(trial: Trial, part: int, checked: bool) -> Callable[[threading.Event], float | None]:
        tried = trial.params

        def run(over: threading.Event) -> float | None:
            upto = -(-tried.epoch // part)
            if trial.course is None and part == 1:
                model = training.train(train_docs, tried, stop=over, prepared=prepared, **columns)
            else:
                if trial.course is None:
                    trial.course = training.Course(train_docs, tried, prepared=prepared, **columns)
                if trial.score is not None and trial.course.epochs == upto:
                    return trial.score
                trial.course.run(upto, over)
                model = trial.course.model()
            if over.is_set():
                raise Aborted("the time is up")
            # a model's size doesn't change as it is trained
            if most is not None and not checked and quantization.quantize(model, tried.dsub, _cutoff(most, tried)).bytes() > most:
                return None
            return score(model, valid_docs, params.autotune_metric, params.autotune_predictions, **columns)

        return run

    def race(trials: list[Trial], first: bool) -> list[Trial]:
        """The trials that were run to their end."""
        rungs, left = RUNGS if len(trials) > 1 else (1,), list(trials)
        for part in rungs:
            # of the first round, the one that leads is run to its end
            over = lambda k: stopped() or (time_up() and not (first and k == 0))
            runs = side_by_side(train_docs.sparkSession, [work(t, part, part != rungs[0]) for t in left], at_once or len(left), over)
            on = []
            for trial, run in zip(left, runs, strict=True):
                try:
                    trial.score = None if run is None else run.result()
                except Aborted:
                    trial.score = None
                except Exception as error:
                    if first and trial is trials[0]:
                        raise
                    if not isinstance(error, ArithmeticError | ValueError) and "NaNEncountered" not in str(error):
                        raise
                    trial.score = None
                if trial.score is not None:
                    on.append(trial)
            left = on if part == 1 else sorted(on, key=lambda t: -t.score)[: len(on) - len(on) // 2]
        return [t for t in trials if any(t is x for x in left)]

    while not ask.trials or (not time_up() and not stopped() and ask.trials < (most_trials or math.inf)):
        first, elapsed = not ask.trials, time.monotonic() - began
        trials = [Trial(ask.next(elapsed)) for _ in range(int(min(max(together, 1), (most_trials or math.inf) - ask.trials)))]
        try:
            ended = race(trials, first)
        finally:
            for t in trials:
                if t.course is not None:
                    t.course.end()
        for t in ended:
            if best is None or t.score > best[0]:
                best = (t.score, t.params)
                ask.best = t.params
    if best is None:
        if stopped():
            raise Aborted("ended before the first trial had a score")
        raise InvalidArgument("no trial fits the size")
    model = training.train(train_docs, best[1], prepared=prepared, **columns)
    if most is not None:
        model = quantization.quantize(model, best[1].dsub, _cutoff(most, best[1]))
    return Found(model, best[1], best[0], ask.trials)


def _cutoff(most: int, p: Params) -> int:
    """Rows whose codes fit in a size, at least 256."""
    return max(most // (p.dim // p.dsub + 10), 256)
