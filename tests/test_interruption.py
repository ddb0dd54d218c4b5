"""abort() ends what runs."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from lexivec.errors import Aborted
from lexivec.operators import scoring, search, training
from lexivec.params import Params


@pytest.fixture(scope="module")
def toy(spark):
    sport, food = "__label__sport the team won the big football game", "__label__food bake the bread with fresh warm butter"
    return spark.createDataFrame([(k, sport if k % 2 else food) for k in range(60)], "doc_id long, text string")


@pytest.fixture(scope="module", autouse=True)
def no_broken_workers_left(spark):
    """A cancelled task may leave a Python worker with a closed channel; Spark finds out at its next task, which local mode doesn't repeat."""
    yield
    time.sleep(3)
    good = 0
    for _ in range(20):
        try:
            spark.range(8).repartition(8).mapInArrow(lambda batches: batches, "id long").collect()
            good += 1
        except Exception:
            good = 0
        if good == 3:
            break


def test_abort_ends_a_slow_wave_and_keeps_the_waves_before(toy, monkeypatch):
    kernel, began = training._kernel, threading.Event()

    def slow(p, epoch, wave, waves):
        run = kernel(p, epoch, wave, waves)
        if epoch < 2:
            return run
        began.set()

        def sleep(rows, lines):
            time.sleep(60)
            return run(rows, lines)

        return sleep

    monkeypatch.setattr(training, "_kernel", slow)
    handle = training.TrainingHandle(toy, Params.supervised(dim=4, epoch=5, lr=0.5, thread=1))
    assert began.wait(120)
    time.sleep(1)
    asked = time.monotonic()
    handle.abort()
    while toy.sparkSession.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() - asked < 2:
        time.sleep(0.05)
    assert time.monotonic() - asked < 2 and not handle._error
    m = handle.result()
    assert len(m.losses) == 3 and m.losses[1] < m.losses[0]
    monkeypatch.undo()
    plain = training.train(toy, Params.supervised(dim=4, epoch=5, lr=0.5, thread=1))
    assert m.input.count() == plain.input.count() and scoring.predict(toy, m).count() == 60


def test_work_that_is_ended_raises(spark):
    def wait(batches):
        time.sleep(60)
        yield from batches

    running = training.Interruptible(spark, lambda stop: spark.range(1).mapInArrow(wait, "id long").collect(), whole=True)
    assert not running.wait(3)
    asked = time.monotonic()
    running.abort()
    with pytest.raises(Aborted):
        running.result()
    assert time.monotonic() - asked < 2
    assert training.Interruptible(spark, lambda stop: spark.range(3).count()).result() == 3
    with pytest.raises(ZeroDivisionError):
        training.Interruptible(spark, lambda stop: 1 // 0).result()


def test_a_search_ends_a_slow_score_when_the_time_is_up(toy, monkeypatch):
    score, calls = search.score, []

    def slow(model, docs, *args, **kwargs):
        calls.append(model)
        if len(calls) == 1:
            return score(model, docs, *args, **kwargs)

        def wait(batches):
            time.sleep(100)
            yield from batches

        return docs.mapInArrow(wait, docs.schema).agg(F.count("*")).first()[0]

    made = training.train(toy, Params.supervised(dim=4, epoch=1, lr=0.5, thread=1))
    monkeypatch.setattr(search, "score", slow)
    monkeypatch.setattr(training, "train", lambda docs, params, **_: made)
    began = time.monotonic()
    found = search.autotune(toy, toy, Params.supervised(autotune_duration=20))
    assert len(calls) == 2 and found.score > 0 and time.monotonic() - began < 60
    stop = threading.Event()
    stop.set()
    with pytest.raises(Aborted):
        search.autotune(toy, toy, Params.supervised(dim=4, epoch=1, thread=1, autotune_duration=45), stop=stop)
