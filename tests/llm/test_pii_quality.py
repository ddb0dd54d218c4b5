"""Secrets by the plain pattern, scores by their definition, quality verdicts by hand-written rules."""

import random
import re
import time

from lexivec.llm import pii, quality

PLAIN = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"
)


def made_texts(seed, n):
    rng = random.Random(seed)
    pieces = ["eyJabcdefgh.eyJ", "eyJabcdefgh.eyJA1b2C3d4.", "eyJ", ".eyJ", ".", "-", "_", " ", "abcdefgh", "A1b2C3d4", "x", "AKIA" + "A" * 16, "AKIA", "xoxb-0123456789", "ghp_" + "a1" * 18, "sk_live_" + "Z9" * 8, "AIza" + "q" * 35, "-----BEGIN RSA PRIVATE KEY-----", "\n", "ab+/=", "-----END RSA PRIVATE KEY-----", "token: ", "commit ", "0123456789abcdef0123"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_forms_are_those_of_the_plain_pattern():
    some = 0
    for t in made_texts(1, 20_000):
        want = [m.span() for m in PLAIN.finditer(t)]
        assert pii.forms(t) == want, t
        some += any(t[s:].startswith("eyJ") for s, _ in want)
    assert some > 100


def test_secrets_and_scores_the_long_way():
    run = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
    for t in made_texts(2, 5000):
        keys = [m.span() for m in PLAIN.finditer(t)]
        runs = [m.span() for m in run.finditer(t) if re.search("[0-9]", m[0]) and not m[0].isdigit() and pii.bits(m[0]) >= pii.LEAST_BITS and not any(s < m.end() and m.start() < e for s, e in keys)]
        assert pii.secrets(t) == sorted(keys + runs), t
        for start, end in pii.secrets(t):
            near = f"{t[max(0, start - pii.CONTEXT_BEFORE) : start]}\n{t[end : end + pii.CONTEXT_AFTER]}".lower()
            said = lambda words: any(re.search(rf"(?<![a-z]){re.escape(w)}", near) for w in words)  # noqa: B023, E731
            base = pii.FORM_SCORE if (start, end) in keys and PLAIN.fullmatch(t[start:end]) else pii.SCORE["secret"]
            want = round(min(1.0, max(0.0, base + pii.CONTEXT_GAIN * (said(pii.CONTEXT["secret"]) - said(pii.AGAINST["secret"])))), 2)
            assert pii.score("secret", t, start, end) == want


def test_identifiers_that_are_no_secrets():
    assert pii.secrets("key 123e4567-e89b-12d3-a456-426614174000 token") == []
    assert len(pii.secrets("key 123e4567-e89b-12d3-a456-4266141740000 token")) == 1


def test_long_texts_of_key_like_runs_take_linear_time():
    for piece in ("-eyJaaaaaaaa", "eyJ.", ".eyJaaaaaaaa", "eyJaaaaaaaa.eyJ", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----", "xoxb-", "AKIA", "a1-b2_", "ghp_"):
        times = []
        for size in (200_000, 1_600_000):
            t = piece * (size // len(piece))
            began = time.perf_counter()
            pii.secrets(t)
            times.append(time.perf_counter() - began)
        assert times[1] < 5 and times[1] < 40 * max(times[0], 0.02), (piece, times)


def test_verdicts_by_rules_written_out(spark):
    rng = random.Random(3)
    texts = [None, ""]
    for _ in range(300):
        words = [rng.choice(["a", "bb", "c#", "d" * 40, f"w{rng.randrange(99)}"]) for _ in range(rng.randint(30, 90))]
        if rng.random() < 0.3:
            words = words[:20] * 4
        text = "".join(w + rng.choice([" ", " ", "\n"]) for w in words)
        texts.append(text + "same line again\n" * rng.choice([0, 0, 60]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.base_failed, r.kept) for r in quality.assess(df).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        again = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.split()]
        base = len(w) < 50 or 100 * len(again) > 50 * len(w)
        more = 10 * len(re.findall(r"[#*$%&|<>]", t)) > 3 * len(w) or not 2 * len(w) <= sum(map(len, w)) <= 25 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines)
        assert got[k] == (base, not base and not more), t[:80]
    assert 20 < sum(kept for _, kept in got.values()) < 280
    kept = {r.doc_id for r in quality.filter_documents(df).collect()}
    assert kept == {k for k, (_, x) in got.items() if x}


def test_rules_are_ordered_by_what_those_before_leave():
    def slow(m):
        time.sleep(0.002)
        return m.n_words < 5

    rules = (quality.Rule("late", slow), quality.Rule("all", lambda m: m.n_words < 9), quality.Rule("other", lambda m: time.sleep(0.001) or m.n_words > 20), quality.Rule("never", lambda m: time.sleep(0.004) or False))
    texts = [b"a " * n for n in (1, 2, 3, 4, 6, 7, 8, 12, 25)]
    # alone, "late" rejects four texts and "other" one; after "all" it rejects none
    assert [r.name for r in quality.order_rules(texts, rules)] == ["all", "other", "late", "never"]
    assert quality.order_rules([], rules) == list(rules)


def test_long_texts_are_timed_by_their_beginnings(spark):
    df = spark.createDataFrame([(1, "word " * 100_000)], "doc_id long, text string")
    assert [len(x) for x in quality.sample_texts(df)] == [quality.SAMPLE_BYTES]
    assert quality.assess(df).first().n_words == 100_000
