"""Statistics, graph, matching, privacy, scores, code tables and anonymity on small inputs."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import anonymity as A
from graphmill.operators import code as C
from graphmill.operators import evaluation as E
from graphmill.operators import graph as G
from graphmill.operators import privacy as P
from graphmill.operators import resolve as V
from graphmill.operators import stats as S


def test_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 0.0), (2, 3.0, 5.0, 0.0)], "k int, a double, b double, z double")
    assert [(r["a"], r["b"]) for r in S.standardize(df, ["a", "b"]).orderBy("k").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    zero = S.normalize_rows(df.select("k", F.lit(0.0).alias("a"), "z"), ["a", "z"]).collect()[0]
    assert (zero["a"], zero["z"]) == (0.0, 0.0)
    with pytest.raises(KeyError):
        S.standardize(df, ["nope"])
    for bad in (0, 1, -1, 2):
        with pytest.raises(ValueError):
            S.correlations(df, ["a", "b"], bad)
    with pytest.raises(ValueError):
        S.principal_components(df, ["a", "b"], "k")


def test_components_needed():
    assert S.components_needed([0.5, 0.3, 0.1, 0.1], 0.7) == 3
    assert S.components_needed([0.5, 0.3, 0.1, 0.1], 0.7, strict=False) == 2
    assert S.components_needed([0.2] * 4, 0.9) == 4


def test_models(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (95, 4)), rng.normal(12, 1, (5, 4))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double, c double, d double")
    out = S.isolation_outliers(df, "k", list("abcd")).toPandas()
    assert out["is_outlier"].sum() <= 6 and set(out[out["is_outlier"] == 1]["k"]) <= set(range(95, 100)) | set(out.nlargest(6, "score")["k"])
    rows = S.assembled(df, list("abcd"), ["k"])
    sizes = S.clustered(rows, S.kmeans_model(rows, 2, range(2)), "k").groupBy("cluster").count().orderBy("cluster").collect()
    assert [r["count"] for r in sizes] == [95, 5]
    assert S.principal_components(df, list("abcd"), "k").count() == 100


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0, 9.0]), ([0.0, 0.0], [1.0, 1.0]), ([], [1.0])], "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(S.cosine("a", "b")).collect()] == [round(82**-0.5, 6), 0.0, 0.0]


EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", "f")]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(s, t, "X", 1, "p") for s, t in EDGES], "source string, target string, type string, count long, provenance string")


def test_traversal(spark, edges):
    seeds = spark.createDataFrame([("a",)], "id string")
    one, two = ({r["id"]: r["distance"] for r in G.hops(seeds, edges, k).collect()} for k in (1, 2))
    assert one == {"a": 0, "b": 1} and two == {"a": 0, "b": 1, "c": 2} and one.items() <= two.items()
    assert {(r["seed"], r["id"]) for r in G.neighbourhoods(seeds, edges, 3).collect()} == {("a", "b"), ("a", "c")}


def test_components(spark, edges):
    nodes = spark.createDataFrame([("g",), ("a",)], "id string")
    got = {r["id"]: r["component"] for r in G.components(nodes, edges).collect()}
    assert got["a"] == got["b"] == got["c"] == "a" and got["d"] == got["e"] == "d" and got["g"] == "g"
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "X", 1, "p") for i in range(60)], edges.schema)
    assert {r["component"] for r in G.components(nodes.limit(0), chain).collect()} == {"n000"}


def test_components_by_contraction(spark, edges):
    nodes = spark.createDataFrame([("g",), ("g",), ("a",), (None,)], "id string")
    small = {r["id"]: r["component"] for r in G.components(nodes, edges, held=0).collect()}
    assert small == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "g": "g", None: None}
    ids = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(301)]
    hub = [("m", f"{a}{i}") for i in range(40) for a in "lz"]
    many = spark.createDataFrame([(s, t, "X", 1, "p") for s, t in [*zip(ids, ids[1:]), *hub, ("y", "y"), ("x", None)]], edges.schema)  # noqa: B905
    for held in (0, 50, 1000):
        got = {r["id"]: r["component"] for r in G.components(nodes.limit(0), many, held=held).collect()}
        assert got == dict.fromkeys(ids, min(ids)) | dict.fromkeys(["m", *(t for _, t in hub)], "l0")


def test_components_in_few_rounds(spark, edges, monkeypatch):
    """Rounds don't grow with the length of a chain, nor the estimate of the size (once its digits doubled each round and filled the driver's memory)."""
    cuts = []
    for name in ("cut", "cut_unsized"):
        real = getattr(G, name, None)
        monkeypatch.setattr(G, name, lambda df, real=real: (cuts.append(1), real(df))[1], raising=False)
    ids = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(3000)]
    chain = spark.createDataFrame([(s, t, "X", 1, "p") for s, t in zip(ids, ids[1:])], edges.schema)  # noqa: B905
    parts = G.components(chain.select(F.col("source").alias("id")), chain)
    assert parts.groupBy("component").count().collect() == [(min(ids), 3000)]
    assert len(cuts) <= 3 and parts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64


def test_paths_of_a_long_chain(spark, edges):
    """Needs the components of a chain, which once filled the driver's memory; frontiers that are broadcast or not reach the same."""
    ids = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(3000)]
    chain = spark.createDataFrame([(s, t, "X", 1, "p") for s, t in zip(ids, ids[1:])], edges.schema)  # noqa: B905
    place = {x: i for i, x in enumerate(ids)}
    away = [abs(place[x] - i) for x in sorted(ids)[:20] for i in range(len(ids)) if abs(place[x] - i) <= 10]
    row = G.path_statistics(G.components(chain.select(F.col("source").alias("id")), chain), chain, 20, 10).collect()[0]
    assert (row["mean_path"], row["pseudo_diameter"]) == (round(sum(away) / len(away), 4), 10)
    seeds = spark.createDataFrame([("a",), ("b",)], "id string")
    one, two = (sorted(map(tuple, G.neighbourhoods(seeds, G.undirected(edges), 3, held).collect())) for held in (0, 1000))
    assert one == two and len(one) == 4


def test_graph_tables(spark, edges):
    raw = spark.createDataFrame([("a", "b", "X", "p"), ("a", "b", "X", "p"), ("a", "b", "X", "q")], "source string, target string, type string, provenance string")
    row = G.merge_edges(raw).collect()[0]
    assert (row["count"], row["provenance"]) == (3, "p=2;q=1")
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    checks = {r["check_name"]: r["n"] for r in G.integrity(nodes, edges).collect()}
    assert checks["duplicate_ids"] == 1 and checks["missing_source"] == 3
    ids = spark.createDataFrame([("a", "z")], "old_id string, new_id string")
    re = G.rekey(edges, ids)
    assert re.count() == edges.count() and re.where("source = 'z' and target = 'b'").count() == 1
    assert G.degree_stats(nodes, edges).collect()[0]["max_degree"] == 2


def test_matching(spark):
    prs = spark.createDataFrame([(1, "ABC"), (2, "abcdef0"), (3, None), (4, "zz")], "number long, merge_commit_sha string")
    commits = spark.createDataFrame([("abc",), ("abcdef012345",), (None,)], "sha string")
    assert {r["number"]: r["strategy"] for r in V.commits_of_prs(prs, commits).collect()} == {1: "lower", 2: "prefix7"}
    sites = spark.createDataFrame([("f", 1, 5), ("f", 2, 50), ("g", 3, 1)], "file string, site_id long, line int")
    spans = spark.createDataFrame([("f", "outer", 1, 20), ("f", "inner", 4, 6)], "file string, name string, first int, last int")
    assert {r["site_id"]: r["name"] for r in V.enclosing(sites, spans).collect()} == {1: "inner", 2: None, 3: None}
    names = spark.createDataFrame([("foo",), ("oo",)], "short string")
    symbols = spark.createDataFrame([("m.foo",), ("m.xfoo",)], "qualified string")
    assert {r["short"]: (r["qualified"], r["strategy"]) for r in V.by_suffix(names, symbols).collect()}["foo"] == ("m.foo", "dotted")
    mods = spark.createDataFrame([("a.b", "x"), ("a", "y")], "module string, file string")
    got = V.longest_prefix(spark.createDataFrame([("a.b.c",), ("a.bc",), ("q",)], "name string"), mods).collect()
    assert {r["name"]: r["file"] for r in got} == {"a.b.c": "x", "a.bc": "y"}
    calls = spark.createDataFrame([("f", "d/a"), ("f", "d/a"), ("g", "d/a"), ("g", "d/b"), ("h", "x/a")], "name string, file string")
    assert {r["name"]: r["status"] for r in V.vote(calls).collect()} == {"f": "file_majority", "g": "directory_consensus", "h": "ambiguous"}


def test_masks_are_idempotent(spark):
    text = 'api_key = "abcd1234" mail a@b.example see https://codehost.example/x and https://y.example/z ' + "a" * 40
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    once = df.select(X.mask_inside(F.col("t")).alias("t"))
    assert once.collect() == once.select(X.mask_inside(F.col("t")).alias("t")).collect()
    assert "abcd1234" not in once.collect()[0]["t"] and "[SECRET]" in once.collect()[0]["t"]


def test_ranks_and_placeholders(spark):
    df = spark.createDataFrame([(f"v{i % 50:02}", i, "g" if i % 3 else "h") for i in range(200)], "v string, i long, g string")
    got = {r["v"]: r["placeholder"] for r in P.placeholders(df, "v", "i", "x_", 3).collect()}
    assert got["v00"] == "x_001" and got["v49"] == "x_050" and len(set(got.values())) == 50
    ranked = P.ranks(df, "g", ["i"]).toPandas()
    for _, part in ranked.groupby("g"):
        assert list(part.sort_values("i")["n"]) == list(range(1, len(part) + 1))


def test_signature_and_category(spark):
    df = spark.createDataFrame([("(self, a, *args, b=1)",), ("()",), (None,)], "s string")
    assert [r[0] for r in df.select(P.masked_signature(F.col("s"))).collect()] == ["(self, param_002, *param_003, param_004=[DEFAULT])", "()", None]
    vals = spark.createDataFrame([("12",), ("a" * 40,), ("https://x",), ("a/b.py",), ("what",), (None,)], "v string")
    assert [r[0] for r in vals.select(X.value_category(F.col("v"))).collect()] == ["SAFE", "PROVENANCE", "LITERAL", "STRUCTURAL", "UNKNOWN", "SAFE"]


def test_scores(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "", ""), (3, "a", ""), (4, None, "b c")], "id long, prediction string, reference string")
    f1 = {r["id"]: r["f1"] for r in E.token_overlap(df).collect()}
    assert f1 == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    same = spark.createDataFrame([(1, "one two three four five", "one two three four five")], df.schema)
    assert E.corpus_bleu(same).collect()[0]["bleu"] == 100.0 and E.corpus_chrf(same).collect()[0]["chrf"] == 100.0
    s = E.sequence_scores(same).collect()[0]
    assert s["rouge_l"] == 1.0 and s["meteor"] > 0.99
    assert E.longest_common(list("abcde"), list("ace")) == 3


SOURCE = 'import os\nfrom a.b import c as d\n\nclass K:\n    """Doc."""\n    def m(self, x, *a, k=1, **kw):\n        return os.path.join(x)\n\ndef f():\n    def inner():\n        pass\n    (lambda: 1)()\n'


def test_code_tables(spark):
    got = {d[0]: d[1] for d in C.definitions(SOURCE)}
    assert got == {"K": "class", "K.m": "method", "f": "function", "f.inner": "function"}
    assert next(d for d in C.definitions(SOURCE) if d[0] == "K.m")[4] == "(self, x, *a, **kw)"
    assert list(C.imports(SOURCE)) == [("os", "os", 1), ("d", "a.b.c", 2)]
    assert (7, "os.path.join") in set(C.calls(SOURCE)) and (12, None) in set(C.calls(SOURCE))
    assert json.loads(C.tree_json(SOURCE))["_type"] == "Module" and C.tree_json("def (") is None
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, "def ("), (4, "")], "i long, s string")
    assert C.rows_of(df, "i", "s", C.imports, "alias string, target string, lineno int").count() == 2


@pytest.mark.parametrize(
    "path,text,want",
    [
        ("requirements.txt", "# c\nnumpy==1.2\npandas>=2 ; x\n-r other\nrequests[a]\n", {("pip", "numpy", "1.2"), ("pip", "pandas", "2"), ("pip", "requests", None)}),
        ("pyproject.toml", '[project]\ndependencies = ["a==1"]\n[tool.poetry.dependencies]\npython = "3"\nb = "^2"\n', {("pip", "a", "1"), ("pip", "b", "^2")}),
        ("setup.cfg", "[options]\ninstall_requires =\n    a==1\n    b\n", {("pip", "a", "1"), ("pip", "b", None)}),
        ("Pipfile", '[packages]\na = "*"\n', {("pip", "a", "*")}),
        ("environment.yml", "dependencies:\n  - python=3.1\n  - pip\n", {("conda", "python", "3.1")}),
        ("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}', {("npm", "a", "1"), ("npm", "b", "2")}),
        ("pom.xml", "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency>", {("maven", "g:a", "1")}),
        ("go.mod", "require x.org/y v1.0.0\n", {("go", "x.org/y", "v1.0.0")}),
        ("Gemfile.lock", "GEM\n    rake (1.0)\n", {("gem", "rake", "1.0")}),
        ("Cargo.toml", '[dependencies]\na = "1"\nb = { version = "2" }\n', {("cargo", "a", "1"), ("cargo", "b", "2")}),
        ("other.txt", "a==1", set()),
    ],
)
def test_dependencies(path, text, want):
    assert set(C.dependencies_of(path, text)) == want


def test_blame_and_workflows():
    sha = "a" * 40
    text = f"{sha} 1 1 2\nauthor Ann\nauthor-mail <ann@x.example>\nauthor-time 10\nsummary s\n\tcode\n{sha} 2 2\n\tmore\n"
    assert list(C.blame_lines(text)) == [(1, sha, "Ann", "ann@x.example", 10, "s"), (2, sha, "Ann", "ann@x.example", 10, "s")]
    pytest.importorskip("yaml")
    assert list(C.workflow_steps("jobs:\n  t:\n    steps:\n      - uses: x@v1\n      - run: make\n")) == [("t", 0, "x@v1"), ("t", 1, "make")]
    assert list(C.workflow_steps("a: [")) == [] and list(C.workflow_steps(None)) == []


def test_anonymity(spark):
    functions = spark.createDataFrame([("m1", "a"), ("m1", "b"), ("m2", "c"), ("m2", "d"), ("m3", "e")], "module string, name string")
    calls = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "e")], "source string, target string")
    sig = A.signatures(functions, calls)
    groups = A.classes(sig, 2)
    v = A.verdict(groups).collect()[0]
    assert v["k_min"] == 1 and sum(r["size"] for r in groups.collect()) == 3
    grown = A.augmented(sig, 3).collect()
    assert len({r["goal"] for r in grown}) == 1 and all(r["added_functions"] >= 0 and r["added_calls"] >= 0 and r["size"] >= 3 for r in grown)  # one class of all three
    assert {r["module"]: r["distance"] for r in grown}["m3"] >= 1 and A.overheads(sig, A.augmented(sig, 3)).collect()[0]["k_min"] == 3
    same = {"q": functions.select("name")}
    assert A.query_jaccard(same, same).collect()[0]["jaccard"] == 1.0
