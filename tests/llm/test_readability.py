"""Reading levels."""

import numpy as np

from graphmill.llm import readability as R

EASY = "The cat is here. It is big. We like it. Look at the dog. It can run. The sun is up. I see a red box. You can go now. "
HARD = "The asymptotic interoperability of heterogeneous configurations, whose generalizability cannot be satisfactorily adjudicated under non-stationary assumptions, presupposes a counterfactual commensurability that simultaneously problematizes the ostensible anonymization of incrementally consolidated repositories. "
CODE = "def f(x):\n    \"\"\"" + EASY * 3 + "\"\"\"\n    y = x + 1\n    for key in frame:\n        print(key)\n    return y\n"
LOG = "\n".join(f"2024-01-0{i} 10:00:00,1 INFO step=a rows={i}" for i in range(1, 10))
TABLE = "a,b,c\n" + "\n".join("500001,2,3.5" for _ in range(40))


def test_order_and_language():
    easy, hard = R.measure(EASY), R.measure(HARD * 2)
    assert easy[0] == hard[0] == "en" and easy[2] < hard[2]
    assert R.measure("Das ist gut und der Text ist klein. Wir lesen die Datei. " * 5)[0] == "de"
    assert R.measure("Il y a un prix ici et le code est vide. Tu peux lire le mois. " * 5, "en")[0] == "fr"
    assert R.measure("Hay que leer el precio y el mes es nuevo. No es malo. " * 5)[0] == "es"


def test_no_prose():
    for text in (None, "", " \n ", "Too short to tell.", CODE, LOG, TABLE, "```python\n" + EASY * 2 + "\n```", "| a | b |\n" * 30):
        assert R.measure(text) is None, text
    mixed = "# Title\n\n" + EASY + "\n\n" + CODE + "\n\n" + LOG
    assert R.measure(mixed)[1] == R.measure(EASY)[1]


def test_words_are_counted():
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more words are in here".split()
    assert len(words) == 25 and R.measure(" ".join(words) + ".")[1] == 25 and R.measure(" ".join(words[:-1]) + ".") is None


def test_syllables():
    en, de = R.syllable_counter("en"), R.syllable_counter("de")
    assert [en[w] for w in ("cat", "table", "make", "reading", "independent")] == [1, 2, 1, 2, 4]
    assert de["Datei"] == 2 and de["Bäume"] == 2


def test_cuts_are_monotone_and_fit():
    rng = np.random.default_rng(0)
    level = rng.integers(1, 6, 2000)
    grade = level * 3 + rng.normal(0, 0.6, 2000)
    noisy = np.where(rng.random(2000) < 0.1, np.clip(level + rng.integers(-1, 2, 2000), 1, 5), level)
    cuts = R.fit_cuts(grade, noisy)
    assert cuts == sorted(cuts)
    assert (1 + sum((grade > c).astype(int) for c in cuts) == level).mean() > 0.95


def test_tables(spark):
    rows = [(1, EASY, "en", "x"), (1, EASY, "en", "x"), (2, HARD * 3, None, "x"), (3, None, "en", "x"), (4, "", "en", "x"), (5, CODE, "", "x"), (6, EASY * 3000, "wrong", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, grade string")
    grades = R.grade_documents(docs)
    assert sorted(r["doc_id"] for r in grades.collect()) == [1, 1, 2, 6]
    ratings = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (2, "b", None), (99, "a", 3)], "doc_id long, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in R.levels_of(grades, R.rated_cuts(grades, ratings)).collect()}
    assert got[1] < got[2]
    unrated = R.levels_of(grades, R.rated_cuts(grades, ratings.limit(0))).collect()
    assert len(unrated) == 4 and all(1 <= r["reading_level"] <= 5 for r in unrated)
    assert R.levels_of(R.grade_documents(docs.limit(0)), R.rated_cuts(R.grade_documents(docs.limit(0)), ratings)).count() == 0
