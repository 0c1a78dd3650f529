"""Variant spellings."""

import random

from graphmill.llm import names as N

SCHEMA = "signature_id long, origin string, author_name string, author_email string, user_login string, entity string"
GIVEN = [("Robert", None), ("Robert", "Rob"), ("William", "Bill"), ("Samantha", None), ("Arjun", None)]


def groups(spark, rows):
    df = spark.createDataFrame([(i, "commit", n, e, u, "clash") for i, (n, e, u) in enumerate(rows)], SCHEMA)
    given = spark.createDataFrame(GIVEN, "given_name string, short_form string")
    out = {}
    for r in N.link_signatures(df, given).collect():
        out.setdefault(r["entity"], set()).add(r["signature_id"])
    return sorted(map(sorted, out.values())), df, given


ROWS = [
    ("Robert Fapokalin", "robert.fapokalin@lab.test", None),  # 0
    ("Fapokalin, Robert", None, None),
    ("ROBERT FAPOKALIN (work)", "dev@laptop.local", None),
    ("Robert Fapokaiin", "robert.fapokalin@lab.test", None),
    ("R. Fapokalin", "root@localhost", None),
    ("Rob Fapokalin", None, None),
    (None, None, "fapokalinr"),
    (None, None, "robert-fapokalin"),
    ("Samantha Fapokalin", "samantha.fapokalin@inbox.test", None),  # 8: a relative
    (None, None, "samanthafapokalin"),
    ("Karoklip Commerce Lab", "team@karoklip-commerce-lab.example", None),  # 10
    ("Karoklip CL", None, None),
    ("The Karoklip Commerce Lab Team", None, None),
    ("Kraoklip Commerce Lab GmbH", None, None),
    ("karoklip-commerce-lab[bot]", "ci@karoklip-commerce-lab.example", None),
    ("Arjun Zebimar", "quietotter621@inbox.test", None),  # 15
    (None, None, "QUIETOTTER621"),
    ("quietotter621", "1002+quietotter621@users.noreply.codehost.example", None),
    ("Arjun Vomidres", "dev@laptop.local", None),  # 18: alone, shares a role address with 2
    (None, None, None),
    (None, "root@localhost", None),
]


def test_links(spark):
    got, _, _ = groups(spark, ROWS)
    assert got == [[0, 1, 2, 3, 4, 5, 6, 7], [8, 9], [10, 11, 12, 13, 14], [15, 16, 17], [18], [19], [20]]


def test_pairs(spark):
    _, df, given = groups(spark, ROWS[:4])
    pairs = {(r[0], r[1]) for r in N.pairs_of(N.link_signatures(df, given)).collect()}
    assert pairs == {(a, b) for a in range(4) for b in range(4) if a < b}


def test_ambiguous_initial_stays_alone(spark):
    rows = [("Arjun Kladoben", None, None), ("Alexander Kladoben", None, None), ("A. Kladoben", None, None)]
    assert groups(spark, rows)[0] == [[0], [1], [2]]


def test_short_family_names(spark):
    rows = [("Wei Li", "wei.li@lab.test", None), ("Li, Wei", None, None), ("WEI LI", None, None), ("Hao Wu", "hao.wu@lab.test", None), ("Hao Wu", None, None)]
    assert groups(spark, rows)[0] == [[0, 1, 2], [3, 4]]


def test_invented_handles_with_numbers_tell_no_name(spark):
    rows = [("Arjun Zebimar", "quietotter371@inbox.test", None), (None, None, "quietotter752"), ("Samantha Vomidres", "quietotter752@inbox.test", None), (None, None, "quietotter371")]
    assert groups(spark, rows)[0] == [[0, 3], [1, 2]]
    assert N.claims_of_login("quietotter371", frozenset()) == [] and N.claims_of_login("robert_fapokalin86", frozenset(["robert"])) == [("robert", "fapokalin", True)]


def test_many_given_names_are_joined_instead(spark):
    _, df, given = groups(spark, ROWS)
    as_list = {tuple(r) for r in N.link_signatures(df, given).collect()}
    assert {tuple(r) for r in N.link_signatures(df, given, most_names=0).collect()} == as_list


def test_pairs_of_a_hot_group(spark):
    entities = spark.createDataFrame([(i, 0) for i in range(60)] + [(100, 1)], "signature_id long, entity long")
    pairs = [tuple(r) for r in N.pairs_of(entities, rows=7).collect()]
    assert len(pairs) == len(set(pairs)) == 60 * 59 // 2 and all(a < b for a, b in pairs)


def people(n, seed):
    """(rows, person of each row) of n invented people with three to six spellings each; a third has an invented handle with a number."""
    draw = random.Random(seed)
    given = ["Robert", "William", "Samantha", "Arjun", "Ingrid", "Matteo", "Yusuf", "Hiroko", "Patricia", "Daniel", "Chloe", "Omar"]
    part = lambda k: "".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(k))
    rows, truth = [], []
    for person in range(n):
        g, f = draw.choice(given), part(4).capitalize() + draw.choice("nrst")
        handle = draw.choice(["quiet", "lazy", "rusty", "neon"]) + draw.choice(["otter", "fox", "mango", "teapot"]) + str(draw.randint(10, 10 * n))
        mail = f"{g}.{f}@inbox.test".lower()
        forms = [(f"{g} {f}", mail, None), (f"{f}, {g}", None, None), (f"{g[0]}. {f}", mail, None), (None, None, f"{g[0]}{f}".lower()), (f"{g} {f[:3]}{f[4:]}", mail, None)]
        own = draw.sample(forms, draw.randint(3, 5))
        if person % 3 == 0:
            own += [(f"{g} {f}", f"{handle}@inbox.test", None), (None, None, handle)]
        rows += own
        truth += [person] * len(own)
    return rows, truth


def test_precision_and_recall_hold_as_tables_grow(spark):
    scores = []
    for n in (40, 400, 2000):
        rows, truth = people(n, n)
        df = spark.createDataFrame([(i, "commit", a, b, c, "") for i, (a, b, c) in enumerate(rows)], SCHEMA)
        found = {tuple(r) for r in N.pairs_of(N.link_signatures(df, spark.createDataFrame(GIVEN, "given_name string, short_form string"))).collect()}
        where = {}
        for i, p in enumerate(truth):
            where.setdefault(p, []).append(i)
        true = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
        scores.append((len(found & true) / len(found), len(found & true) / len(true)))
    assert all(p >= 0.98 and r >= 0.95 for p, r in scores), scores


def test_empty_and_repeated(spark):
    assert groups(spark, [])[0] == []
    assert groups(spark, [("Robert Fapokalin", None, None)] * 3)[0] == [[0, 1, 2]]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["root"] for r in N.components(edges).collect()} == {0, 100}


def test_helpers():
    assert N.fold("Ünïcode Søren") == "unicode soren" and N.near("abcd", "acbd") and N.near("abcd", "abxd") and not N.near("abcdef", "uvwdef")
    assert N._repaired("ZoÃ«") == "Zoë"
