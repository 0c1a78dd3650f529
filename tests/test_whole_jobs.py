"""Queries that do the whole job of an operator where SQL expresses only a part of it."""

import difflib
import random

import pytest
from pyspark.ml.linalg import Vectors

from graphmill import plans
from graphmill.operators import privacy as P
from graphmill.operators import resolve as V
from graphmill.operators import stats as S
from graphmill.sources import files


def _linked(a, b):
    return a in b or b in a or any(difflib.SequenceMatcher(None, x, y).ratio() > 0.85 for x, y in ((a, b), (b, a)))


def test_merged_contributors_equal_all_pairs(spark):
    rng = random.Random(3)
    names = ["A. Dokeratir", "A. Dokertir", "Aleksandra Reroseklas", "Aleksandra Reroseklas, PhD", " ALEKSANDRA reroseklas ", "Ann Li", "Li", "Jörg Wüst", "Bo Ek", "", "  ", None]
    for _ in range(60):
        base = "".join(rng.choice("abcdefghr ") for _ in range(rng.randint(5, 24))).strip()
        names.append(base)
        spoiled = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(spoiled) + 1)
            spoiled[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "r"])
        names.append("".join(spoiled) or base)
    got = {r["n"]: r["contributor"] for r in P.merged_contributors(spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert None not in got and got[""] is None and got["  "] is None
    assert got["A. Dokeratir"] == got["A. Dokertir"] and got["Aleksandra Reroseklas"] == got["Aleksandra Reroseklas, PhD"] == got[" ALEKSANDRA reroseklas "]
    assert got["Bo Ek"] != got["Jörg Wüst"]
    known = sorted({n.strip().lower() for n in names if n and n.strip()})
    root = {n: n for n in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if _linked(a, b):
                root[find(a)] = find(b)
    groups, theirs = {}, {}
    for n, c in got.items():
        if c:
            groups.setdefault(c, set()).add(n.strip().lower())
            theirs.setdefault(find(n.strip().lower()), set()).add(n.strip().lower())
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))
    assert len(groups) > 5


def test_pairs_that_may_be_alike_share_a_key():
    rng = random.Random(5)
    alike = 0
    for _ in range(20_000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 22)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "bc"])
        a, b = sorted((a, "".join(b)), key=len)
        if b and difflib.SequenceMatcher(None, a, b).ratio() > 0.85:
            alike += 1
            assert set(P._own_keys(a)) & set(P._other_keys(b)), (a, b)
    assert alike > 5_000


def test_all_author_signals(spark):
    rows = [
        (1, "mail a@b.test, see /home/ann and C:\\Users\\bo, user_id 1234567", "introduced_by_pr: 42", None),
        (2, "set DEADBEEF1 by phone", "x", None),
        (3, "123456", "x", "abcdef0123"),
        (4, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k long, body string, title string, sha string")
    commits = spark.createDataFrame([("DEADBEE0000", "Ann"), ("1234567aaa", None)], "sha string, author_name string")
    got = {r["k"]: r for r in P.all_author_signals(df, "k", "body", "title", "sha", commits).collect()}
    row = lambda k: tuple(got[k][c] for c in ("emails", "paths", "hashes", "numbers", "identifiers", "pr", "provenance", "risk", "level"))
    assert row(1) == (1, 2, 1, 1, 1, "42", True, 10, "HIGH")
    assert row(2) == (0, 0, 1, 0, 1, None, True, 6, "HIGH")
    assert row(3) == (0, 0, 1, 1, 0, None, True, 4, "MEDIUM")
    assert row(4) == (0, 0, 0, 0, 0, None, False, 0, "LOW")


def test_csv_export_of_every_map(spark, tmp_path):
    rows = [("a", {"type": "X", "size": "1"}), ("b", {"size": "1", "type": 'say "hi"\n'}), ("c", None), ("d", {}), ("e", {"z": None, "b": "\u00e4"})]
    spark.createDataFrame(rows, "id string, attrs map<string,string>").write.parquet(str(tmp_path / "nodes.parquet"))
    got = {r["id"]: r["attrs"] for r in plans.queries()["s8_csv_export"](spark, str(tmp_path)).collect()}
    assert got == {"a": '{"size":"1","type":"X"}', "b": '{"size":"1","type":"say \\"hi\\"\\n"}', "c": None, "d": "{}", "e": '{"b":"\u00e4","z":null}'}
    files.write_csv(spark.createDataFrame(rows, "id string, attrs map<string,string>"), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert {r["id"]: r["attrs"] for r in back.collect()} == got


def test_models_are_registered_over_the_whole_job(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(S, "parameter_grid", lambda rows, seeds, iterations, ks, inits: asked.update(grid=len(seeds) * len(iterations) * len(ks) * len(inits)))
    monkeypatch.setattr(S, "silhouettes", lambda rows, ks=S.silhouettes.__defaults__[0], seed=0: asked.update(ks=list(ks)))
    monkeypatch.setattr(S, "forest_regression", lambda *a, trees=S.forest_regression.__defaults__[1], **k: asked.update(trees=trees))
    default = S.kmeans_model.__defaults__[1]

    class Model:
        def transform(self, rows):
            return rows.selectExpr("customer_id", "0 prediction")

    monkeypatch.setattr(S, "kmeans_model", lambda rows, k=3, seeds=default, iterations=100: asked.setdefault("fits", []).append(len(seeds)) or Model())
    for name in ("m8_kmeans", "m9_silhouette_sweep", "m11_parameter_grid", "m12_forest_regression", "m13_predictions"):
        plans.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked == {"grid": 144, "ks": list(range(2, 16)), "trees": 20, "fits": [10, 10]}


def test_grid_without_repeated_fits(spark):
    rows = spark.createDataFrame([(i, Vectors.dense([float(i % 7), float(i * i % 11)])) for i in range(40)], ["k", "features"])
    both = {tuple(r)[:4]: tuple(r)[4:] for r in S.parameter_grid(rows, [1], [1, 50, 100], [3], ["random"]).collect()}
    for n in (1, 50, 100):
        (alone,) = S.parameter_grid(rows, [1], [n], [3], ["random"]).collect()
        assert both[(1, n, 3, "random")] == pytest.approx((alone["cost"], alone["silhouette"]))
    assert both[(1, 1, 3, "random")] != both[(1, 50, 3, "random")]


def _score(target, entity):
    path, name = ((x or "").lower().replace("\\", "/") for x in target[1:])
    _, have, own_name, sig, first, last = entity
    have = (have or "").lower().replace("\\", "/")
    score = (5 * have.endswith(path) + 2 * (path in have) + 3.5 * (have.split("/")[-2:] == path.split("/")[-2:])) if path else 0.0
    for f in (own_name, sig):
        f = (f or "").lower()
        score += (3 if f == name else 1.5 if name in f else 0) if name and f else 0
    return round(score + 0.5 * (first is not None or last is not None) + 0.1 * have.endswith(".py"), 2)


def test_best_entities_equal_all_pairs(spark):
    rng = random.Random(9)
    folders, bases, words = ["src", "dags/src", "lib", ""], ["a.py", "ba.py", "Load.py", "conf.yml"], ["load", "load_data", "Run", "x", "reload"]
    path = lambda: rng.choice([None, "\\".join((rng.choice(folders), rng.choice(bases))), "/".join((rng.choice(folders), rng.choice(bases))), rng.choice(bases)])
    entities = [(i, path(), rng.choice([None, *words]), rng.choice([None, f"def {rng.choice(words)}(a)"]), rng.choice([None, 3]), None) for i in range(60)]
    targets = [(i, path(), rng.choice([None, *words, "nowhere"])) for i in range(50)]
    schema = "entity_id long, path string, name string, sig string, first int, last int"
    for some in (entities, [(1, "x/conf.yml", None, None, None, None), (0, "y", "q", None, None, None)]):
        df = V.best_entities(spark.createDataFrame(targets, "target_id long, path string, name string"), spark.createDataFrame(some, schema))
        got = {}
        for r in df.orderBy("target_id", "rank").collect():
            got.setdefault(r["target_id"], []).append((r["entity_id"], r["score"]))
        for t in targets:
            want = sorted(((_score(t, e), e[0]) for e in some), key=lambda x: (-x[0], x[1]))[:3]
            if some is entities or want[0][0] > 0:
                assert got[t[0]] == [(i, s) for s, i in want if s > 0], t
            else:
                assert len(got[t[0]]) >= 1 and got[t[0]][0][0] == (1 if t[1] and t[1].endswith("conf.yml") else 0), t
