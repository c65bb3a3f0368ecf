"""Evaluation wording in documents: the search against every window, planted passages, disguises."""

import random

from pelorus.llm.leakage import Patterns, holds_passage, item_words, leaked_items, words_of

WORDS = "salt frost ledger harbour lamp keeper rower tide clock hail net kite maker silver tally granary belfry cistern causeway oyster diver wool trader brine sundial needle rope founder".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "s", "ed", "er", "ly", "y")) for _ in range(n))


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, item string")
    i = spark.createDataFrame([(*r, "x", 2) for r in items], "item_id long, text string, doc string, doc_id int")
    return d, i


def leaks(spark, docs, items, **kw):
    d, i = frames(spark, docs, items)
    got = [tuple(r) for r in leaked_items(d, i, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_search_finds_every_window():
    rng = random.Random(1)
    items = []
    for n in range(30):
        parts, owner = item_words(text(rng, 40))
        items.append((n, parts, owner, [False] * len(parts)))
    patterns = Patterns(items, 5)
    for _ in range(40):
        words = text(rng, 60).split()
        n = rng.randrange(30)
        at = rng.randrange(30)
        words[20:28] = items[n][1][at : at + 8]
        want = {(k, i, s) for k, (_, parts, _, _) in enumerate(items) for s in range(len(parts) - 4) for i in range(len(words) - 4) if words[i : i + 5] == parts[s : s + 5]}
        assert {(k, i, s) for k, hits in patterns.search(patterns.numbers(words)).items() for i, s in hits} == want


def test_words_without_disguise():
    plain = words_of("The salt-keeper's net")
    assert plain == ["the", "salt", "keepers", "net"]
    for t in ("THE SALT\nKEEPERS, net!", "t​he s­alt keeper’s n﻿et", "**The** _salt_ > keeper's <em class='x'>n</em>et", "Тhе sаlt keeper's nеt", "Ｔhe&nbsp;salt [keeper's](http://x.example/a) nèt"):
        assert words_of(t) == plain, t


def test_passages_and_echoes(spark):
    rng = random.Random(2)
    opening = text(rng, 16)
    items = [(k, f"{opening} {text(rng, 60)}") for k in range(6)]
    body = [t.split()[16:] for _, t in items]

    def around(words):
        return f"{text(rng, 50)}\n\n{' '.join(words)}\n\n{text(rng, 50)}"

    changed = list(body[2][5:35])
    for k in (4, 13, 22):
        changed[k] = "zebra"
    less = body[3][5:35]
    del less[3], less[12]
    less.insert(20, "quagga")
    torn = list(body[4][5:35])
    for k in range(0, 30, 3):
        torn[k] = "zebra"
    docs = [
        (1, around(body[0][10:22])), (2, around(body[1][10:21])), (3, around(changed)), (4, around(less)), (5, around(torn)), (6, around(opening.split())), (7, None), (8, ""), (9, " \n "),
        (10, around(w.upper() + ("," if n % 3 else "\n> ") for n, w in enumerate(body[5][:14]))), (11, around(body[0]) + "\n" + around(body[1])), (12, " ".join(["salt frost"] * 30_000 + body[2][:12])),
    ]
    want = {(1, 0), (3, 2), (4, 3), (10, 5), (11, 0), (11, 1), (12, 2)}
    assert leaks(spark, docs, items) == want
    assert leaks(spark, docs + docs[:1], items + items[:1] + [(None, items[0][1]), (77, None), (78, ""), (79, "too short")], block_bytes=300) == want


def passage(text, item, loose=20, rate=1 / 6.5):
    """By brute force: 12 words in a row, or a span of the item against any span of the text, equal at both ends."""
    spans = range(len(item))
    if any(item[a : a + 12] == text[i : i + 12] for a in spans[: len(item) - 11] for i in range(len(text) - 11)):
        return True
    for a in spans:
        row = [99] + [0 if w == item[a] else 99 for w in text]
        for b in range(a + 1, len(item)):
            after = [row[0] + 1]
            for i, w in enumerate(text):
                after.append(min(row[i] + (w != item[b]), row[i + 1] + 1, after[i] + 1))
                n = b + 1 - a
                if w == item[b] and n >= loose and after[-1] <= rate * n:
                    return True
            row = after
    return False


def found(words, item):
    n = len(item)
    patterns = Patterns([(0, item, list(range(n)), [False] * n)], 5)
    hits = patterns.search(numbers := patterns.numbers(words))
    return 0 in hits and holds_passage(numbers, *patterns.item(0)[1:], hits[0], 12, 20, 1 / 6.5)


def test_uneven_edits_equal_brute_force():
    rng = random.Random(3)
    seen = []
    for _ in range(400):
        item = text(rng, rng.randrange(20, 45)).split()
        start = rng.randrange(0, len(item) - 18)
        words = item[start : start + rng.randrange(18, 40)]
        for _ in range(rng.randrange(2, 8)):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice((["zebra"], [], [words[k], "quagga"], ["zebra", "okapi"]))
        words = text(rng, 8).split() + words + text(rng, 8).split()
        seen.append(passage(words, item))
        assert found(words, item) == seen[-1], (item, words)
    assert 60 < sum(seen) < 340


def test_lone_right_words_between_changes(spark):
    rng = random.Random(4)
    for at, n in (((5, 7, 12), 21), ((5, 7, 9), 20), ((5, 7, 14), 21)):
        items = [(1, text(rng, n))]
        words = items[0][1].split()
        for k in at:
            words[k] = "zebra"
        assert passage(words, items[0][1].split()) and leaks(spark, [(1, " ".join(words))], items) == {(1, 1)}


def test_tables_of_many_items_are_small():
    import pickle

    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in WORDS for b in range(1500)]
    items = ((k, [rng.choice(vocabulary) for _ in range(200)], list(range(200)), [False] * 200) for k in range(1000))
    assert len(pickle.dumps(Patterns(items, 5))) < 200_000 * 50  # bytes a word


def test_empty_tables(spark):
    item = [(1, " ".join(WORDS))]
    assert leaks(spark, [], item) == set() and leaks(spark, [(1, " ".join(WORDS))], []) == set()
    assert leaks(spark, [(1, " ".join(WORDS))], item) == {(1, 1)}
