"""Defective pairs: held-out defects, rules of rank, edge cases."""

import random

import pytest

from pelorus.llm.pairs import REFUSALS, Tongues, _again, _rises, _span, _within, fit, has_answer, pair_defects, tokens

CITIES = "Aarburg Belwick Corholm Dunmere Estrand Falport".split()


def whole(rng):
    city, low, high = rng.choice(CITIES), rng.randrange(-9, 9), rng.randrange(10, 30)
    kind = rng.randrange(7)
    if kind == 0:
        return f"How is the daily mean of {city} worked out?", rng.choice((f"It is the average of the hours of {city} that hold a value.", f"I cannot say more than the table does, but here it is: add up the hours of {city} and divide by their number."))
    if kind == 1:
        return f"Write one sentence about {city}. Low {low}, high {high}.", rng.choice((f"The day in {city} was calm, with values between {low} and {high} degrees.", f"I'm sorry to say it stayed cold in {city}, from {low} up to {high} degrees, and the wind was strong."))
    if kind == 2:
        return f"Return a JSON object with city and low: it was {low} degrees in {city}", f'{{"city": "{city}", "low": {low}}}'
    if kind == 3:
        return f"Schreibe einen Satz über das Wetter in {city}. Tiefstwert {low}, Höchstwert {high}.", f"In {city} war es ruhig und der Tag blieb mit {low} bis {high} Grad kühl."
    if kind == 4:
        return "Give only the unit of the column latency.", rng.choice(("s", "seconds"))
    if kind == 5:
        line = f"The team in {city} took {high} readings and wrote them in the book."
        return f"Repeat this line unchanged and add nothing: {line}", line
    return f"List two checks for the table {city}. No full stops.", rng.choice(("- Count the rows of the day\n- Look for empty names", "1. Look for empty names\n2. Count the rows of the day"))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    sample = [whole(rng) for _ in range(900)]
    for k in range(0, 900, 30):  # the sample has defects of its own
        sample[k] = (sample[k][0], "Sorry, I have to decline to answer that question. Is there anything else I can do for you?")
        sample[k + 1] = (sample[k + 1][0], sample[k + 1][0])
    return fit(sample)


def test_whole_pairs_have_no_defect(model):
    rng = random.Random(2)
    pairs = [whole(rng) for _ in range(300)]
    assert sum(model.defect(*p) is not None for p in pairs) <= 3


def test_defects_are_named(model):
    rng = random.Random(3)
    hits = {k: [] for k in ("empty", "copied", "refusal", "truncated", "language")}
    for _ in range(150):
        prompt, response = whole(rng)
        hits["empty"].append(model.defect(prompt, rng.choice((None, "", " \n", "…", "[]", "​"))) == "empty")
        hits["refusal"].append(model.defect(prompt, rng.choice(("I'm afraid I am not able to help with this.", "Unfortunately, I cannot provide this information.", "Sorry, but I must decline to answer that question."))) == "refusal")
        if not prompt.startswith("Repeat"):
            hits["copied"].append(model.defect(prompt, rng.choice((prompt, prompt.upper(), f"You ask: {prompt}", f"{prompt}\n{prompt}"))) == "copied")
        if len(response.split()) > 8 and "{" not in response and "\n" not in response:
            hits["truncated"].append(model.defect(prompt, response[: rng.randrange(len(response) // 3, len(response) - 8)]) == "truncated")
        if prompt.startswith("Write"):
            hits["language"].append(model.defect(prompt, "In Aarburg war es ruhig und der Tag blieb mit 3 bis 9 Grad kühl.") == "language")
    for label, seen in hits.items():
        assert sum(seen) >= 0.9 * len(seen), (label, sum(seen), len(seen))


def notes(rng, n):
    words = []
    while len(words) < n:
        words += f"The keeper of {rng.choice(CITIES)} wrote {rng.randrange(99)} readings of {rng.choice(('rain', 'wind', 'frost', 'sun'))} and {rng.choice(('closed', 'opened', 'moved'))} the {rng.choice(('book', 'gauge', 'door'))} at {rng.randrange(24)} that day.".split()
    return " ".join(words)


def test_long_pairs_are_judged_whole(model):
    rng = random.Random(5)
    for n in (700, 2000, 4000):
        question = "How many hours of frost were there in Dunmere, and who wrote them down in the book of the station?"
        prompt = f"{notes(rng, n)}\n\n{question}"
        assert [model.defect(prompt, x) for x in (prompt, prompt.upper(), question)] == ["copied"] * 3
        late = f"{notes(rng, n)} Unfortunately, I cannot provide this information."
        assert model.defect(prompt, late) == "refusal" and model.defect(prompt, notes(rng, n)) is None
        words = tokens(prompt)
        assert len(_rises(words, words)) == _again(words, words) == _span(words, words, len(words) - 1) == len(words)


def test_overlap_is_the_longest_in_order():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(25))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        want = [i for i in range(len(a)) if best[i + 1][-1] > best[i][-1]]
        assert _rises(a, b, 4) == _rises(a, b) == want
        threes = [tuple(b[k : k + 3]) for k in range(len(b) - 2)]
        assert _again(a, b) == len({k + j for k in range(len(a) - 2) if tuple(a[k : k + 3]) in threes for j in range(3)})


def test_languages():
    tongues = Tongues()  # knows only the common words

    def odds(text):
        return tongues.judge([tokens(text)])[0].tolist()

    assert tongues.spoken(odds("Der Tag war kalt und es fiel kein Regen")) == "de" and tongues.spoken(odds("42 mm")) == ""
    prompt = "Translate into Spanish: the low was 3 degrees and the high was 9."
    assert tongues.wanted(prompt, odds(prompt)) == "es"
    assert tongues.wanted("Please answer in Italian: what is this?", odds("what is this?")) == "other"
    assert has_answer("ß") and not has_answer("...") and set(REFUSALS) == {"en", "de", "es", "fr"}


def test_a_model_can_be_used_again(spark, model):
    import pickle

    again = pickle.loads(pickle.dumps(model))
    rng = random.Random(8)
    pairs = [whole(rng) for _ in range(50)] + [("Why?", "I will not answer that."), ("Why?", None)]
    assert again.defects(pairs) == model.defects(pairs) == [model.defect(*p) for p in pairs]
    df = spark.createDataFrame([(f"i{k}", *p) for k, p in enumerate(pairs)], "id string, p string, r string")
    got = {tuple(r) for r in pair_defects(df, id_col="id", prompt_col="p", response_col="r", model=model).collect()}
    assert got == {(f"i{k}", d) for k, d in enumerate(model.defects(pairs)) if d}


def test_long_texts_are_learned_whole(spark):
    """All texts end behind 4000 characters: none is broken off, and none is a copy."""
    rng = random.Random(7)

    def long_pair():
        prompt, response = whole(rng)
        while "{" in response or len(response) < 30 or prompt.startswith("Repeat"):
            prompt, response = whole(rng)
        said = " ".join(f"Over {rng.randrange(2, 40)} nights {rng.choice(('little', 'much', 'nothing'))} changed near {rng.choice(CITIES)}, so {rng.choice(('nobody', 'someone', 'each of them'))} {rng.choice(('looked', 'asked', 'waited'))} again." for _ in range(80))
        return f"{notes(rng, 800)}\n\n{prompt}", f"{said} {response.rstrip('.')}."

    rows = [(f"id{k}", *long_pair()) for k in range(150)]
    assert min(len(t) for _, *texts in rows for t in texts) > 4000
    rows += [("cut", rows[0][1], rows[0][2][:-20]), ("copied", rows[1][1], rows[1][1]), ("no", rows[2][1], ""), ("refused", rows[3][1], "I'm afraid I am not able to help with this.")]
    df = spark.createDataFrame(rows, "id string, p string, r string")
    kw = {"id_col": "id", "prompt_col": "p", "response_col": "r"}
    got = dict(tuple(r) for r in pair_defects(df, **kw).collect())
    assert {k: got.pop(k, None) for k in ("cut", "copied", "no", "refused")} == {"cut": "truncated", "copied": "copied", "no": "empty", "refused": "refusal"}
    assert len(got) <= 3
    few = dict(tuple(r) for r in pair_defects(df, **kw, sample_bytes=900_000).collect())  # about a half of the pairs
    assert few["copied"] == "copied" and len(few) <= 10
    assert {tuple(r) for r in pair_defects(df, **kw, sample_bytes=0).collect()} == {("no", "empty")}


def test_nothing_to_learn_from():
    refused = [(whole(random.Random(k))[0], "Sorry, I have to decline to answer that question.") for k in range(40)]
    model = fit(refused)
    assert {model.defect(p, r) for p, r in refused} == {None} and model.defect("Why?", "") == "empty"
    assert _within([(1, 5), (2, 9), (3, 4), (4, 2)], 10) == [1, 3]


def test_table(spark):
    rng = random.Random(4)
    rows = [(f"id{k}", *whole(rng), "x", 1) for k in range(300)]
    rows += [("null", rows[0][1], None, "x", 1), ("empty", rows[0][1], "", "x", 1), ("noprompt", None, "yes", "x", 1), ("blank", "", " ", "x", 1), (None, "a", "", "x", 1), ("long", rows[0][1], rows[0][2] + " More was said about it." * 20_000, "x", 1)]
    df = spark.createDataFrame(rows + rows[-6:], "llm_request_id string, user_prompt string, response_text string, id string, defect int")
    kw = {"id_col": "llm_request_id", "prompt_col": "user_prompt", "response_col": "response_text"}
    got = [tuple(r) for r in pair_defects(df, **kw, sample_rows=300).collect()]
    assert len(got) == len(set(got)) and {("null", "empty"), ("empty", "empty"), ("blank", "empty")} <= set(got)
    assert not {i for i, _ in got} & {"noprompt", None} and len(got) < 12
    assert pair_defects(df.limit(0), **kw).count() == 0
    only = df.where("llm_request_id = 'null'")
    assert {tuple(r) for r in pair_defects(only, **kw).collect()} == {("null", "empty")}
