"""The automaton against a plain walk over each conversation."""

import random
import unicodedata

import pytest

from pelorus.llm.conversations import NEXT, conversations, drop_reasons

KW = {"key": "task", "turn": "turn", "role": "role", "content": "content"}
SCHEMA = "task string, turn long, role string, content string, _key int, reason string, message int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def visible(text):
    return any(not c.isspace() and unicodedata.category(c)[0] != "Z" and unicodedata.category(c) not in ("Cc", "Cf") for c in text or "")


def plain(rows):
    out, by = {}, {}
    for task, turn, role, content in rows:
        if task is not None:
            by.setdefault(task, []).append((turn, (role or "").strip().lower(), content))
    for task, messages in by.items():
        if not any(visible(c) and r in ("user", "assistant") for _, r, c in messages):
            out[task] = "empty"
            continue
        turns = {}
        for t, r, c in messages:
            turns.setdefault(t, []).append((r, visible(c)))
        order, state, ok = sorted(t for t in turns if t is not None), "", None not in turns
        ok = ok and order == list(range(len(order)))
        for t in order:
            roles = {r for r, _ in turns[t]}
            ok = ok and len(roles) == 1 and next(iter(roles)) in NEXT.get(state, "").split()
            state = next(iter(roles))
        if not ok:
            out[task] = "broken"
        elif state != "assistant" or any(r == "assistant" and not any(s for _, s in turns[t]) for t in order for r, _ in turns[t]):
            out[task] = "no_reply"
    return out


def talk(rng, task):
    rows, turn, state = [], 0, ""
    for _ in range(rng.randrange(1, 9)):
        options = NEXT[state].split()
        state = rng.choice(options if state or rng.random() < 0.5 else ["user"])
        for _ in range(rng.choice((1, 1, 1, 2))):
            rows.append([task, turn, rng.choice((state, f" {state.upper()} ")), rng.choice(("hi", "go on", "​x"))])
        turn += 1
    for _ in range(rng.choice((0, 0, 1, 2))):
        k = rng.randrange(len(rows))
        column, value = rng.choice(((1, rng.choice((None, -1, 7, 2))), (2, rng.choice((None, "", "observer", "tool", "system", "user"))), (3, rng.choice((None, "", " \t\n", "​﻿", " ")))))
        rows[k][column] = value
    return rows


@pytest.mark.parametrize("block", [4096, 2])
def test_reasons_equal_a_plain_walk(spark, block):
    rng = random.Random(1)
    rows = [tuple(r) for k in range(400) for r in talk(rng, f"t{k}")]
    rows += rng.sample(rows, 60) + [(None, 0, "user", "lost")]
    rng.shuffle(rows)
    got = drop_reasons(frame(spark, rows), **KW, block=block).collect()
    want = plain(rows)
    assert {r.task: r.reason for r in got} == want and len(got) == len(want)
    assert {"empty", "broken", "no_reply"} == set(want.values())


def test_kept_conversations_are_clean(spark):
    rows = [("a", 1, "Assistant ", " done\n"), ("a", 0, "USER", "do it"), ("a", 0, "user", "do it"), ("a", 0, "user", "please"), ("b", 0, "user", "hello"), ("a", 1, "assistant", "done")]
    got = sorted(tuple(r) for r in conversations(frame(spark, rows), **KW).collect())
    assert got == [("a", 0, 1, "user", "do it"), ("a", 0, 2, "user", "please"), ("a", 1, 1, "assistant", "done")]
    assert conversations(frame(spark, []), **KW).count() == 0 and drop_reasons(frame(spark, []), **KW).count() == 0


def test_a_very_long_conversation(spark):
    rows = [("a", t, ("user", "assistant")[t % 2], "x") for t in range(10_000)]
    assert drop_reasons(frame(spark, rows), **KW).collect() == []
    assert [tuple(r) for r in drop_reasons(frame(spark, rows[:8191]), **KW).collect()] == [("a", "no_reply")]
    assert [tuple(r) for r in drop_reasons(frame(spark, rows[:4096] + rows[4098:]), **KW).collect()] == [("a", "broken")]
