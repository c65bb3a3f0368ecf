"""Reading grades: order of easy and hard prose, matter that must not count, texts without a grade."""

from pelorus.llm.readability import DEMANDING, grade, reading_grades, sentences, syllables

EASY = "The cat sat on the mat. It was a warm day. We saw a dog by the lake. The sun was out and the sky was blue. She gave him a red ball to play with."
FAIR = "The report is published every morning after the readings have been checked. If a station has failed, the values of the nearest station are used until it has been repaired. Most of the rain fell before noon."
HARD = "Notwithstanding considerable instrumental heterogeneity, the identifiability of the aerodynamic parameters presupposes an exceptionally rigorous characterisation of the underlying turbulence, particularly under conditions of intermittent stratification. Consequently, the asymptotic efficiency of multivariate estimators remains indistinguishable from extraneous interference."
LONG = "What those who kept the book took for a fault of the mast, and there were more of this kind than one would like to think, was not the one that came to be used when the two sets were at last held up side by side, though it must be said that the rule by which such things are judged had itself been changed more than once since the first of the month."


def test_order_of_grades():
    easy, fair, hard, long = map(grade, (EASY, FAIR, HARD, LONG))
    assert easy < fair < DEMANDING < hard and long > DEMANDING


def test_other_matter_does_not_count():
    for base in (EASY, FAIR, HARD):
        want = grade(base)
        wrapped = "\n".join(" ".join(base.split()[k : k + 9]) for k in range(0, len(base.split()), 9))
        for text in (
            f"# Considerations regarding instrumentation\n\n{base}", f"{base}\n\n```\nfor x in range(10): print(x)\n```", f"> {HARD}\n\n{base}", f"{base}\n\nSee https://docs.example/a/b", f"{base}\r\n", wrapped, f"**{base}**",
            f"{base}\n\n| a | b |\n|---|---|\n| 1 | 2 |",
        ):
            assert grade(text) == want, text
    listed = "\n".join(f"- {s.rstrip('.')}" for s in FAIR.split(". "))
    bare = "\n".join(s.rstrip(".") for s in FAIR.split(". "))
    assert grade(listed) == grade(bare) == grade(FAIR)


def test_much_other_matter_does_not_count():
    code = "\n".join(f"    result_{k} = estimator.fit(values[{k}], weights=None)" for k in range(40))
    said = " ".join(f'The book says: "{EASY}"' for _ in range(6))
    for base in (EASY, FAIR, HARD):
        for text in (f"{base}\n\n{code}", f"{base}\n\n{code}\n\n{code}", f"{base} {said}", f"# The estimates of the station\n\n{code}\n\n{base}"):
            assert grade(text) is not None, text
        assert grade(f"{base}\n\n{code}") == grade(base)
    assert grade(f"{HARD} {said}") > DEMANDING
    program = f"import estimator\n\ndef run(values):\n{code}\n\n{code}\n\n# The results of the run are given back to those who asked for them.\n"
    assert grade(program) is None
    names = ",\n".join(f'{{"note": "{EASY}"}}' for _ in range(4))
    assert grade(f"[{names}]") is None


def test_texts_without_a_grade():
    german = "Für die kommende Nacht wird mit Nebel und örtlichem Frost gerechnet. Die Station am Hafen meldete keine neuen Werte, weil der Fühler vereist war."
    logs = "\n".join(f"2025-01-0{k}T10:00:00Z ERROR host=a{k}.example status=503 reason=upstream_unavailable" for k in range(1, 9))
    json_lines = "\n".join('{"city": "Aa", "temp_c": 2.1, "note": "the snow was on the hill"}' for _ in range(5))
    code = "def f(x):\n    return x + 1\n\nclass A:\n    def g(self):\n        return f(self.x)\n"
    table = "\n".join(f"Aa\t0{k}:00\t-1.5\t3.2" for k in range(6))
    for text in (None, "", " \n\t ", "​", "🌦️", german, logs, json_lines, code, table, "12 13 14"):
        assert grade(text) is None, text


def test_syllables_and_sentences():
    for word, n in {"cat": 1, "station": 2, "temperature": 4, "make": 1, "table": 2, "readings": 2, "identifiability": 8, "the": 1, "wanted": 2, "jumped": 1}.items():
        assert abs(syllables(word) - n) <= (1 if n > 3 else 0), (word, syllables(word))
    assert [len(s) for s in sentences("It fell by 2.4 mm, e.g. near the lake. Approx. half was snow (cf. Sect. 3.1). Then it stopped.")[0]] == [8, 6, 3]


def test_table(spark):
    rows = [(1, HARD, 3.0), (2, EASY, None), (3, None, 1.0), (1, HARD, 3.0), (4, (FAIR + " ") * 3000, 0.0)]
    got = {r.doc_id: r.grade for r in reading_grades(spark.createDataFrame(rows, "doc_id long, text string, grade double"), id_col="doc_id", text_col="text").collect()}
    assert got[1] == grade(HARD) and got[3] is None and got[4] == grade(FAIR) and got[2] == grade(EASY)
    assert reading_grades(spark.createDataFrame([], "doc_id long, text string"), id_col="doc_id", text_col="text").count() == 0
