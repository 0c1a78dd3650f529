"""Identifier maps, rewriting by words, masks of all fields, entities, chains and histories, on small inputs."""

import pytest
from pyspark.sql import functions as F

from graphmill.operators import evaluation as E
from graphmill.operators import graph as G
from graphmill.operators import privacy as P
from graphmill.operators import resolve as V
from graphmill.operators import rewrite as R
from graphmill.operators import sanitize as Z
from graphmill.sources import files

CODE = "entity_id long, name string, kind string, sig string, relpath string, source string, placeholder string"
ROWS = [
    (1, "load_rows", "function", "(path, n=1)", "src/a/load.py", "import src.a.load as x\nfrom src.a import load_rows\ndef load_rows(path, n=1):\n    return reload_rows(path, load_rows, n)\n", "clash"),
    (2, "Job", "class", None, "src\\\\a\\\\job.py".replace("\\\\", "\\"), "class Job:\n    def get(self, rows):\n        return target(rows)\n\nJob()\n", "clash"),
    (3, "Job.get", "method", "(self, rows)", "src/a/job.py", None, "clash"),
    (4, None, None, None, None, "", "clash"),
]


@pytest.fixture(scope="module")
def code(spark):
    return spark.createDataFrame(ROWS, CODE)


def test_identifier_map(code):
    got = {(r["kind"], r["name"]): r["placeholder"] for r in R.identifier_map(R.identifiers(code)).collect()}
    assert got[("function", "load_rows")] == "data_loader_func_001" and got[("function", "get")] == "utility_func_001" and got[("class", "Job")] == "class_001"
    assert got[("module", "src.a.load")] == "module_l3_001" and got[("file", "src/a/job.py")] == "src_file_002.py" and got[("package", "src")] == "pkg_001"
    assert ("parameter", "self") not in got and got[("parameter", "n")] == "param_001"


def test_words_are_replaced_and_parts_of_words_are_not(code):
    known = R.identifier_map(R.identifiers(code)).persist()
    got = {r["entity_id"]: r for r in R.rewritten_words(code.select("entity_id", "source"), "entity_id", "source", known).collect()}
    one = got[1]["source"]
    assert "def data_loader_func_001(param_002, n=1):" in one and "reload_rows(param_002, data_loader_func_001, n)" in one  # n is too short, reload_rows another word
    assert (got[1]["function_def"], got[1]["function_call"], got[1]["standalone"], got[1]["parameter"]) == (1, 0, 2, 2)
    two = got[2]["source"]
    assert two.startswith("class class_001:") and "def utility_func_001(self," in two and "target(" in two and two.endswith("Job()\n") and got[2]["class_def"] == 1
    assert got[3]["source"] is None and got[3]["function_def"] == 0 and got[4]["source"] == ""
    done = {r["entity_id"]: r["source"] for r in R.sanitized_sources(code.select("entity_id", "source"), "entity_id", "source", known, code.select(F.lit("Ann Example").alias("name"))).collect()}
    assert done[1].startswith("import module_l3_001 as x\nfrom src.a import data_loader_func_001\n")
    assert R.rewritten_words(code.limit(0).select("entity_id", "source"), "entity_id", "source", known).count() == 0


def test_repeated_rows_and_clashing_columns(spark, code):
    known = R.identifier_map(R.identifiers(code)).persist()
    twice = code.where("entity_id = 1").unionByName(code.where("entity_id = 1")).select("entity_id", "source", F.lit(1).alias("name"))
    got = R.rewritten_words(twice.drop("name"), "entity_id", "source", known).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["function_def"] == 1
    assert R.rewritten_imports(twice.drop("name"), "entity_id", "source", known.where("kind = 'module'").select("name", "placeholder")).count() == 2
    names = spark.createDataFrame([("load_rows", "B"), ("load_rows", "A"), (None, "C"), ("n", None)], "name string, placeholder string")
    texts = P.replace_words(twice, "entity_id", "source", names).collect()
    assert len(texts) == 2 and "def A(" in texts[0]["source"] and "reload_rows(" in texts[0]["source"]
    f = spark.createDataFrame([("r", "Commit", "attrs.message_head", "mail a@b.example now")] * 2, "record string, node_type string, field string, value string")
    assert [r["value"] for r in Z.masked_fields(f, spark.createDataFrame([("Ann",)], "given string")).collect()] == ["mail [EMAIL] now"] * 2


def test_contributors_are_masked_as_whole_names(spark):
    texts = spark.createDataFrame([(1, "# by Ann Example, ANN EXAMPLE and Annexample"), (2, None), (3, "")], "k long, t string")
    names = spark.createDataFrame([("Ann Example",), (None,), ("Bo",)], "name string")
    got = {r["k"]: r["t"] for r in R.masked_contributors(texts, "k", "t", names).collect()}
    assert got == {1: "# by [CONTRIBUTOR], [CONTRIBUTOR] and Annexample", 2: None, 3: ""}


FIELDS = [
    ("a", "Commit", "attrs.sha", "f" * 40), ("a", "Commit", "attrs.message_head", "mail ann@x.example or see http://10.1.2.3/x , Ann Example wrote setup.py on 2024-01-02"), ("a", "Commit", "attrs.author_name", "Ann Example"), ("b", "Commit", "attrs.author_name", "example ann"),
    ("a", "Commit", "attrs.parents", "f" * 40 + ",x"), ("a", "Commit", "attrs.title", "secret plan"), ("a", "Commit", "attrs.author_date", "2024-01-01T10:00:00Z"), ("a", "Commit", "odd", None), ("a", "Commit", "odd2", "x/y.py"), ("c", "PR", "introduced_by_pr", "7"), ("c", "PR", "text_preview", ""),
]


def test_fields(spark):
    f = spark.createDataFrame(FIELDS, "record string, node_type string, field string, value string")
    given = spark.createDataFrame([("Ann",), (None,)], "given string")
    audit = {(r["record"], r["field"]): (r["final_category"], r["action"]) for r in Z.audited(f).collect()}
    assert audit[("a", "attrs.sha")][0] == "PROVENANCE" and audit[("a", "odd")] == ("SAFE", "KEEP as-is") and audit[("a", "odd2")][0] == "STRUCTURAL"
    got = {(r["record"], r["field"]): r["value"] for r in Z.masked_fields(f, given).collect()}
    assert got[("a", "attrs.message_head")] == "mail [EMAIL] or see [URL] , [PERSON] wrote setup.py on [TIMESTAMP]"
    assert got[("a", "attrs.author_name")] == got[("b", "attrs.author_name")] == "CONTRIBUTOR_1" and got[("a", "attrs.parents")] == "[COMMIT_ID],x"
    assert got[("a", "attrs.title")] == "[PR_TITLE]" and got[("a", "attrs.author_date")] == "[TIMESTAMP]" and got[("c", "introduced_by_pr")] == "[PR_REF]" and got[("c", "text_preview")] == "" and got[("a", "odd")] is None
    left = {(r["field"], r["pattern_type"]) for r in Z.residuals(f, spark.createDataFrame([("Ann Example",)], "name string")).collect()}
    assert ("attrs.message_head", "CONTRIBUTOR_NAME") in left and ("attrs.sha", "COMMIT_HASH") in left and ("attrs.message_head", "EMAIL") in left
    assert Z.masked_fields(f.limit(0), given).count() == 0 and Z.entities(f.limit(0), ["record"], "value", given).count() == 0


def test_false_entities(spark):
    rows = [("URL", "setup.py", True), ("DATE_TIME", "1.2.3", True), ("PHONE_NUMBER", "12345678", True), ("PERSON", "Ann Example", False), ("LOCATION", "API", True), ("EMAIL_ADDRESS", "a@b.example", False), ("CRYPTO", "deadbeef1", True), ("PERSON", "git", True)]
    df = spark.createDataFrame(rows, "kind string, entity string, want boolean")
    assert df.where(Z.false_entity(F.col("kind"), F.col("entity")) != F.col("want")).count() == 0


def test_chains(spark):
    sites = spark.createDataFrame([("m", c) for c in ("m.f", "f", "np.load", "pkg.g.x.y", "K.run", "Z.go", "lost", "only")] + [(None, "f"), ("m", "")], "module string, chain string")
    symbols = spark.createDataFrame([(q,) for q in ("m.f", "numpy.load", "pkg.g", "m.K.run", "q.Z.go", "z.only")] + [(None,)], "qualified string")
    aliases = spark.createDataFrame([("m", "np", "numpy")], "module string, alias string, target string")
    got = {(r["module"], r["chain"]): (r["qualified"], r["strategy"]) for r in V.resolved_chains(sites, symbols, aliases).collect()}
    assert got[("m", "m.f")] == ("m.f", "direct") and got[("m", "f")] == ("m.f", "module_scoped") and got[("m", "np.load")] == ("numpy.load", "alias")
    assert got[("m", "pkg.g.x.y")] == ("pkg.g", "progressive") and got[("m", "K.run")] == ("m.K.run", "class_method") and got[("m", "Z.go")] == ("q.Z.go", "class_method_global")
    assert got[("m", "only")] == ("z.only", "short") and got[("m", "lost")] == (None, "unresolved")


def test_commits_by_substring_and_list(spark):
    prs = spark.createDataFrame([(1, "bcdefab1", []), (2, "none000", [("1234567aaa",)]), (3, None, None)], "number long, merge_commit_sha string, commits array<struct<sha:string>>")
    commits = spark.createDataFrame([("aabcdefab9",), ("1234567bbb",)], "sha string")
    assert {r["number"]: r["strategy"] for r in V.commits_of_prs(prs, commits).collect()} == {1: "contains", 2: "listed"}


def test_enclosing_over_blocks_equals_brute_force(spark):
    spans = [("f", f"s{i}", a, a + w) for i, (a, w) in enumerate([(1, 900), (5, 10), (100, 60), (127, 2), (128, 300), (300, 5)])]
    sites = [("f", line, line) for line in range(0, 950, 7)]
    got = {r["site_id"]: r["name"] for r in V.enclosing(spark.createDataFrame(sites, "file string, site_id long, line int"), spark.createDataFrame(spans, "file string, name string, first int, last int")).collect()}
    want = {i: min([(b - a, a, n) for _, n, a, b in spans if a <= line <= b], default=(0, 0, None))[2] for _, i, line in sites}
    assert got == want


def test_scores_of_several_references(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat .", ["a dog ran", "the cat sat on the mat ."]), (2, None, [None]), (3, "x", [])], "id long, prediction string, references array<string>").withColumn("reference", F.get("references", F.lit(0)))
    assert E.corpus_bleu(df.where("id = 1")).collect()[0]["bleu"] == 100.0
    assert E.corpus_bleu(df.limit(0)).collect()[0]["bleu"] == 0.0 and E.per_node(df).count() == 3
    assert [E.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "adjustable", "probate", "controlling", "happy")] == ["caress", "poni", "relat", "hop", "adjust", "probat", "control", "happi"]
    assert E.meteor("runs fast".split(), "run fast".split()) > E.meteor("walks fast".split(), "run fast".split()) > 0


def test_schema_and_look_ups(spark, tmp_path):
    assert G.write_schema(spark, str(tmp_path / "s")) and not G.write_schema(spark, str(tmp_path / "s"))
    rough = spark.createDataFrame([("File:a", "File", "5"), ("X:b", "Odd", None)], "id string, node_type string, lineno string")
    assert [tuple(r)[:2] for r in G.enforced(rough, G.NODE_SCHEMA, "node_type", G.NODE_TYPES).collect()] == [("File:a", "File")]
    shas, known = spark.createDataFrame([("a",), ("b",)], "sha string"), spark.createDataFrame([("a", 2), ("a", 1)], "sha string, number long")

    def broken(_):
        raise OSError("no service")

    assert {r["sha"]: r["prs"] for r in files.mapped_commits(shas, known, broken).collect()} == {"a": "1,2", "b": ""}
    assert {r["sha"]: r["prs"] for r in files.mapped_commits(shas, known, lambda rest: rest.withColumn("number", F.lit(9))).collect()} == {"a": "1,2", "b": "9"}
