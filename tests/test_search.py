"""Trials of a search side by side, and trainings that are gone on with."""

import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexivec.errors import Aborted, InvalidArgument
from lexivec.operators import search, training, vocabulary
from lexivec.params import LossKind, Params


@pytest.fixture(scope="module")
def toy(spark):
    sport, food = "__label__sport the team won the big football game", "__label__food bake the bread with fresh warm butter"
    return spark.createDataFrame([(k, sport if k % 2 else food) for k in range(60)], "doc_id long, text string")


def weights(m) -> list:
    return [[(r[0], r[1]) for r in t.collect()] for t in (m.input.orderBy("fid").limit(200), m.output.orderBy("row"))]


@pytest.mark.parametrize("given", [{"loss": LossKind.SOFTMAX}, {"loss": LossKind.NS, "word_ngrams": 2, "bucket": 50}])
def test_a_course_run_in_pieces_is_the_training_run_at_once(toy, given):
    p = Params.supervised(dim=4, epoch=3, lr=0.5, thread=2, **given)
    want = training.train(toy, p)
    course = training.Course(toy, p, prepared=training.Prepared(toy, p))
    course.run(1)
    early = course.model()
    course.run(1)
    course.run(2)
    course.run(9)
    assert early.losses == want.losses[:1] and course.model().losses == want.losses and course.epochs == 3
    assert weights(course.model()) == weights(want) != weights(early)
    course.end()


def test_prepared_documents_are_read_once_and_differ_by_their_parameters(toy, monkeypatch):
    calls, build, lines = [], vocabulary.build, training._lines
    monkeypatch.setattr(vocabulary, "build", lambda *a: calls.append("vocabulary") or build(*a))
    monkeypatch.setattr(training, "_lines", lambda *a: calls.append("lines") or lines(*a))
    p = Params.supervised(dim=4, epoch=1, thread=1)
    own = training.Prepared(toy, p)
    shared = [threading.Thread(target=lambda: own.lines(own.vocabulary(p))) for _ in range(3)]
    for t in shared:
        t.start()
    for t in shared:
        t.join()
    assert sorted(calls) == ["lines", "vocabulary"]
    own.lines(own.vocabulary(Params.supervised(dim=9, epoch=7, lr=2.0, thread=1)))
    assert len(calls) == 2
    other, _ = own.lines(own.vocabulary(Params.supervised(word_ngrams=2, bucket=10, thread=1)))
    assert calls[2:] == ["lines"] and other.agg(F.max(F.size("ids"))).first()[0] > 8
    with pytest.raises(InvalidArgument):
        own.vocabulary(Params.supervised(min_count=5))


def test_trials_side_by_side_find_what_trials_one_after_another_find(toy, monkeypatch):
    run, ran, lock, live, most = training.Course.run, [], threading.Lock(), [0], [0]

    def told(self, upto, *args):
        with lock:
            ran.append((round(self.params.lr, 9), upto - self.epochs))
            live[0] += 1
            most[0] = max(most[0], live[0])
        run(self, upto, *args)
        with lock:
            live[0] -= 1

    def proposed(self, elapsed):
        self.trials += 1
        return replace(self.best, lr=(0.4, 0.1, 0.3, 0.2)[self.trials - 1], word_ngrams=self.trials % 2 + 1)

    p = Params.supervised(dim=4, epoch=4, thread=1, bucket=50, autotune_duration=10**6)
    monkeypatch.setattr(search.Proposals, "next", proposed)
    monkeypatch.setattr(training.Course, "run", told)
    # the lower the learning rate the better, lest the toy's models are all right
    monkeypatch.setattr(search, "score", lambda model, *_, **__: 1 / (1 + model.params.lr))
    found, took = {}, {}
    for at_once in (1, 4):
        ran.clear()
        most[0], began = 0, time.monotonic()
        got = search.autotune(toy, toy, p, most_trials=4, together=4, at_once=at_once)
        took[at_once] = time.monotonic() - began
        found[at_once] = (got.params, got.score, got.trials, sorted(ran))
        assert most[0] == at_once
    assert found[1] == found[4] and found[1][0].lr == 0.1 and found[1][2] == 4 and took[4] < took[1]
    # four begin, two go on to their half and one to its end; then the best is trained from the start
    done = {x: [n for r, n in found[1][3] if r == x] for x in (0.1, 0.2, 0.3, 0.4)}
    assert done == {0.1: [1, 1, 2, 4], 0.2: [1, 1], 0.3: [1], 0.4: [1]}


def test_when_the_time_is_up_the_first_that_leads_is_run_to_its_end(toy, monkeypatch):
    p = Params.supervised(dim=4, epoch=2, lr=0.5, thread=1, autotune_duration=0)
    found = search.autotune(toy, toy, p, together=3)
    assert found.params == p and found.trials == 3 and found.score > 0.5
    stop = threading.Event()
    stop.set()
    with pytest.raises(Aborted):
        search.autotune(toy, toy, p, stop=stop, together=3)


def test_works_that_are_over_are_ended_or_not_begun(spark):
    def wait(batches):
        time.sleep(60)
        yield from batches

    slow = lambda stop: spark.range(1).mapInArrow(wait, "id long").collect()
    began = time.monotonic()
    runs = search.side_by_side(spark, [lambda stop: 7, slow, slow, slow], 2, lambda k: k > 0 and time.monotonic() - began > 3)
    assert runs[0].result() == 7 and runs[3] is None and time.monotonic() - began < 20
    for r in runs[1:3]:
        with pytest.raises(Aborted):
            r.result()


def test_a_score_after_a_training_is_ended_too(toy, spark):
    trained = threading.Event()

    def wait(batches):
        time.sleep(60)
        yield from batches

    def work(stop):
        training.train(toy, Params.supervised(dim=4, epoch=1, thread=1), stop=stop)
        trained.set()
        return spark.range(1).mapInArrow(wait, "id long").collect()

    running = training.Interruptible(spark, work, whole=True)
    assert trained.wait(120)
    time.sleep(2)
    asked = time.monotonic()
    running.abort()
    with pytest.raises(Aborted):
        running.result()
    assert time.monotonic() - asked < 5
    time.sleep(3)
    for _ in range(10):  # a cancelled task may leave a broken worker behind
        try:
            spark.range(8).repartition(8).mapInArrow(lambda batches: batches, "id long").collect()
        except Exception:
            continue
