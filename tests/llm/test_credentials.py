"""Credentials: training on a generated corpus, finds on held-out lines, exact redaction."""

import random
import string

import numpy as np
import pytest

from graphmill.llm import credentials as C


def secret(r, n=16):
    return "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n)) + str(r.randrange(10, 99)) + r.choice("_!%*-") + "Qz"


POSITIVE = ['password = "{}"', 'client_secret = "{}"', 'db = connect("mysql://etl:{}@db.example/shop")', 'export API_TOKEN={}', '"api_key": "{}",', "auth_token: {}", '<property name="password" value="{}"/>', "# old password was {}  (rotate!)", 'dsn = "Server=x;Uid=etl;Pwd={};Database=shop"']
NEGATIVE = ['password = "${{VAULT}}"', 'password_column = "pw_hash"', 'token_type = "Bearer"', "API_TOKEN=$API_TOKEN", 'api_key = "REPLACE_ME_WITH_YOUR_KEY"', 'title = "Report of the month"', 'checksum = "{hex}"', 'items = sorted(rows, key=lambda v: v["InvoiceNo"])', 'password = "********"', 'secret_file = "/run/secrets/pw"', 'logger.info("%s rows after InvoiceNo", len(rows))', 'commit = "{hex}"', 'uri = "s3://bucket/keys/prices.pem"']


def corpus(seed, n):
    r = random.Random(seed)
    rows, want = [], set()
    for i in range(n):
        lines = []
        for k in range(6):
            if r.random() < 0.3:
                lines.append(r.choice(POSITIVE).format(secret(r)))
                want.add((i, k + 1))
            else:
                lines.append(r.choice(NEGATIVE).format(hex="".join(r.choice("0123456789abcdef") for _ in range(40))))
        rows.append(("t", i, f"src/a{i}.py", "\n".join(lines), "x"))
    return rows, want


SCHEMA = "src_table string, row_id long, path string, text string, score string"


def test_finds_and_redacts(spark):
    rows, want = corpus(1, 150)
    pem = 'x = 1\nKEY = """-----BEGIN RSA PRIVATE KEY-----\nabc\ndef\n-----END RSA PRIVATE KEY-----"""\ny = 2\n-----BEGIN PUBLIC KEY-----\nzzz\n-----END PUBLIC KEY-----\n'
    rows += [("t", 900, None, pem, "x"), ("t", 901, "a", None, "x"), ("t", 902, "a", "", "x"), ("t", 903, "b.py", "x = 1\n" * 50_000, "x"), ("t", 900, None, pem, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.find_credentials(df, max_fit=2000).persist()
    got = {(r["row_id"], r["line_no"]) for r in found.collect()}
    assert (900, 2) in got and not [x for x in got if x[0] in (901, 902, 903) or x == (900, 7)]
    mine = {x for x in got if x[0] < 900}
    assert len(mine & want) / len(want) > 0.95 and len(mine & want) / len(mine) > 0.95
    by_id = {i: t for _, i, _, t, _ in rows}
    for r in C.redact_credentials(df, found).collect():
        text, old = r["text"], by_id[r["row_id"]]
        if old is None:
            assert text is None
            continue
        assert text.count("\n") == old.count("\n")
        for a, b in zip(old.split("\n"), text.split("\n"), strict=True):
            assert a == b or "[REDACTED]" in b or r["row_id"] == 900
    assert "y = 2" in {r["row_id"]: r["text"] for r in C.redact_credentials(df, found).collect()}[900]


def test_one_label_or_none(spark):
    df = spark.createDataFrame([("t", 1, "a.py", 'title = "nothing here"', "x")], SCHEMA)
    assert C.find_credentials(df).count() == 0
    assert C.find_credentials(df.limit(0)).count() == 0


@pytest.mark.parametrize("value", ["${X}", "$X", "{{ vault.token }}", "<your-token-here>", "********", "xxxxxxxxxxxx", "%(pw)s", "REPLACE_ME", "@db.password@", "{token}", "aaaa"])
def test_placeholders(value):
    assert C.is_placeholder(value)


@pytest.mark.parametrize("value", ["Monday$72", "rXV%hd7QJ3y3", "hunHunter?85", "coffee tram 48 copper", "Dragon&68"])
def test_no_placeholders(value):
    assert not C.is_placeholder(value)


@pytest.mark.parametrize(
    "text,value,name",
    [
        ('token = ("abc"\n         "def")', "abcdef", "token"), ('api_key: str = (\n    "v1"\n)', "v1", "api_key"), ('os.environ["PW"] = "v1"', "v1", "PW"), ('x = os.getenv("PW", "v1")', "v1", "os.getenv PW"),
        ('login("etl", "v1")', "v1", "login etl"), ('if entered == "v1":', "v1", "entered"), ('KEYS = [\n  "v1",\n]', "v1", "KEYS"), ("mysql -u etl -pv1234 shop", "v1234", "mysql"), ("echo v1234 | docker login --password-stdin", "v1234", "password-stdin"),
        ("ENV PASSWD v1 v2", "v1 v2", "PASSWD"), ("<secret>v1</secret>", "v1", "secret"), ("# pw for staging: v1", "v1", "pw"),
        ('"""Staging login was Hq7vZp2mKd"""', "Hq7vZp2mKd", "login"), ("KEYS = [\n" + "  'filler',\n" * 200 + "  'v1',\n]", "v1", "KEYS"), ("TOKEN = make(" + " " * 900 + "'v1')", "v1", "TOKEN make"), ("pin = '4821'", "4821", "pin"),
    ],
)
def test_scan(text, value, name):
    assert (value, name) in {(v, n) for _, _, v, n, _ in C.scan(text)}


def test_whole_values_are_read():
    counts = np.zeros((98, 98))
    C.count_pairs(["a" * 1000], counts)
    assert counts.sum() == 1001
    assert C.weak_label("4821", "pin", "assign") == -1 and C.weak_label("abcd", "title", "assign") == 0


def test_scorer_is_the_product_of_features_and_weights():
    r = np.random.default_rng(3)
    model, w = C.Markov(r.integers(0, 9, (98, 98)), r.integers(0, 9, (98, 98))), r.normal(size=C.WIDTH)
    scorer = C.Scorer(model, w)
    for value, name, syntax, path in [("Hq7vZp2mKd", "db_password", "assign", "a/b.py"), ("", "", "bare", ""), ("0" * 40 + "é", "sha", "key", "tests/x.yaml"), ("deadbeef" * 4, "secret", "pair", "x")]:
        z = float(C.features(value, name, syntax, path, model.ratio(value)) @ w)
        assert abs(scorer.score(value, name, syntax, path) - 1 / (1 + np.exp(-z))) < 1e-9


def test_models():
    secret_counts, other = np.zeros((98, 98)), np.zeros((98, 98))
    C.count_pairs(["xQ9"] * 50, secret_counts)
    C.count_pairs(["the"] * 50, other)
    assert secret_counts[0, C.codes_of(["x"])[1]] == 50 and secret_counts.sum() == 200
    m = C.Markov(secret_counts, other)
    assert m.ratio("xQ9") > 0 > m.ratio("the")
    x = np.array([[1, a] for a in (0, 0, 1, 1)], float)
    w = C.fit_logistic(x, np.array([0, 0, 1, 1.0]), penalty=0.01)
    assert (x @ w > 0).tolist() == [False, False, True, True]
