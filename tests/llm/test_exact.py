"""Shared passages against all windows, also where neighbours share less than a third document; dropped lines of long texts."""

import random
from collections import defaultdict

import pytest

from chronicle.llm import line_dedup, suffix_dedup


def covered(rows, window):
    words, first = {i: t.split() for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = defaultdict(set)
    for i, own in words.items():
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                out[i].update(range(k, k + window))
    return dict(out)


def found(spark, rows, window, gram):
    out = defaultdict(set)
    for r in suffix_dedup.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"), window, gram).collect():
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return dict(out)


def test_overlapping_passages(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(5000)]
    base = [rng.choice(vocab) for _ in range(400)]
    rows = []
    for i in rng.sample(range(10**6), 120):
        parts = []
        for _ in range(3):
            a = rng.randrange(330)
            parts += base[a : a + rng.randrange(50, 71)] + [rng.choice(vocab) for _ in range(10)]
        rows.append((i, " ".join(parts)))
    want = covered(rows, 50)
    assert want and found(spark, rows, 50, 20) == want


@pytest.mark.parametrize("words", [("a", "b", "c"), ("a", "b", "a\x01"), ("a", "ab", "é", "a\x00")])
def test_few_words(spark, words):
    rng = random.Random(len(words[-1]))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in rng.sample(range(1000), 200)]
    want = covered(rows, 8)
    assert want and found(spark, rows, 8, 4) == want


def test_a_line_with_a_rising_number(spark):
    """No passage is long enough, though all share a beginning; the same with a number that two share."""
    rng = random.Random(7)
    some = lambda n: " ".join(str(rng.random()) for _ in range(n))
    shared = some(25)
    rows = [(i, f"{some(30)} {shared} {i:05d} {some(30)}") for i in range(2000)]
    assert found(spark, rows, 50, 20) == {}
    rows.append((3000, rows[1500][1]))
    assert {i: len(x) for i, x in found(spark, rows, 50, 20).items()} == {3000: 86}


def test_inner_runs_look_up_third_documents():
    """Document 5 shares most to the right with 1 and most to the left with 2, but a whole window only with 3."""
    rows = sorted([("g a b c", "x y", 5, 10, 0b111), ("g a b c", "z z", 1, 0, 0b111), ("g z", "x y", 2, 0, 0b111), ("g a b d", "x q", 3, 0, 0b111)])
    run = suffix_dedup.Run(rows, 4)
    run.neighbours()
    near = set(run.matches)
    run.third()
    assert (5, 9, 13, 3) in set(run.matches) and (5, 10, 14, 1) in near


def test_edges_send_on_only_the_first_holder_of_a_window():
    """Document 5 finds its window with 3 in the task; the windows of 3, and those that none shares, go on."""
    rows = sorted([("g a b c", "x y", 5, 10, 0b111), ("g a b c", "z z", 1, 0, 0b111), ("g z", "x y", 2, 0, 0b111), ("g a b d", "x q", 3, 0, 0b111)])
    run = suffix_dedup.Run(rows, 4)
    run.neighbours()
    on = run.edge()
    assert {(5, 9, 13, 3), (5, 10, 14, 1)} <= set(run.matches)
    digests = [d for *_, d in on]
    assert len(digests) == len(set(digests)) and (3, [-1]) in [(i, at) for i, at, _ in on]


def test_edges_name_a_repeated_window_once():
    rows = sorted([("g a b c", "x y", 5, 10, 0b1), ("g a b c", "x y", 5, 30, 0b1), ("g a b c", "x z", 5, 50, 0b1)])
    run = suffix_dedup.Run(rows, 4)
    run.neighbours()
    assert [(i, at) for i, at, _ in run.edge()] == [(5, [10, 30, 50])] and run.matches == []


@pytest.mark.parametrize("task_bytes", [2_000, 20_000])
def test_passages_over_many_tasks(spark, monkeypatch, task_bytes):
    """Near copies, whose suffixes of one gram fill several tasks, each with other words changed."""
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", task_bytes)
    rng = random.Random(task_bytes)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in rng.sample(range(10**6), 80):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(150)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(own * rng.randrange(1, 4))))
    want = covered(rows, 50)
    assert want and found(spark, rows, 50, 20) == want


def test_lines_of_long_texts(spark):
    text = "\n".join(f"this is a line of more than forty letters, number {k % 15000}" for k in range(30000))
    rows = [(i, text + f"\nown {i}") for i in range(5)]
    got = {r.doc_id: r for r in line_dedup.with_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].n_lines, got[i].n_dropped) for i in range(5)] == [(30001, 30000)] * 4 + [(30001, 0)]
    assert got[0].kept_text == "own 0" and got[4].kept_text == rows[4][1]
