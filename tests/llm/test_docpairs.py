"""Function-documentation pairs: against the language's own parser, and the traps."""

import ast
import textwrap

import pytest

from graphmill.llm import docpairs as D

GOOD = "Remove rows whose price is missing."


def lines(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [(text.count("\n", 0, p.at) + 1, p.name) for p in D.pair_python(text) if D.informs(p.doc, p.name)]


CASES = {
    "plain": (f'def f():\n    """{GOOD}"""\n', [1]),
    "async and raw": (f"async def f(a, b=')', *c):\n    r'''{GOOD}'''\n", [1]),
    "split head": (f'@task(retries=2)\ndef f(\n    a,\n    b: dict = {{"x": ")"}},\n) -> None:\n    # note\n\n    """{GOOD}"""\n', [2]),
    "comment": (f"# {GOOD}\n@x\n@y(1)\ndef f():\n    return 1\n", [4]),
    "comment not directly above": (f"# {GOOD}\n\ndef f():\n    return 1\n", []),
    "comment of another indent": (f"class A:\n# {GOOD}\n    def f(self):\n        pass\n", []),
    "method": (f'class A:\n    class B:\n        def f(self):\n            "{GOOD}"\n', [3]),
    "nested function": (f'def f():\n    def g():\n        """{GOOD}"""\n    class K:\n        def h(self):\n            """{GOOD}"""\n', []),
    "after nested": (f'def f():\n    def g():\n        pass\ndef h():\n    """{GOOD}"""\n', [4]),
    "inside a string": (f'x = """\ndef f():\n    \\"\\"\\"{GOOD}\\"\\"\\"\n"""\n', []),
    "one line": (f'def f(): "{GOOD}"; return 1\n', [1]),
    "bytes": (f'def f():\n    b"""{GOOD}"""\n', []),
    "format": (f'def f():\n    f"""{GOOD}"""\n', []),
    "string later": (f'def f():\n    x = 1\n    """{GOOD}"""\n', []),
    "indented source": (f'    def f(self):\n        """{GOOD}"""\n        return 1\n', [1]),
    "cut off": (f'def f():\n    """{GOOD}\n\n    Args', [1]),
    "open bracket before": (f'x = [1,\n    (\n\ndef f():\n    """{GOOD}"""\n', [4]),
    "old print": (f'def f():\n    """{GOOD}"""\n    print "a", 1\n\ndef g():\n    """{GOOD}"""\n', [1, 5]),
    "tabs": (f'class A:\n\tdef f(self):\n\t\t"""{GOOD}"""\n', [2]),
    "crlf": (f'x = 1\r\ndef f():\r\n    """{GOOD}"""\r\n', [2]),
    "continued": (f'def \\\n  f(a):\n    """{GOOD}"""\n', [1]),
    "quote in comment": (f"# don't\nx = 1  # it's\ndef f():\n    '''{GOOD}'''\n", [3]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    text, want = CASES[name]
    assert [n for n, _ in lines(text)] == want


@pytest.mark.parametrize(
    "doc",
    ["", "   \n ", "TODO", "todo: document this", "...", "-----", "=====\n-----", "[summary]", "N/A", "tbd", "FIXME", "XXX", "Add your description here", "Description goes here.", "noqa: D103", "pylint: disable=missing-docstring", "docstring",
     "_summary_\n\nArgs:\n    frame (_type_): _description_\n\nReturns:\n    _type_: _description_", "load_rows_by_month", "load_rows_by_month()", "Load rows by month.", "Load the rows by month 12.", ":param path:\n:return:", "Args:\n    path:\n"],
)
def test_worthless(doc):
    assert not D.informs(doc, "load_rows_by_month_12")


@pytest.mark.parametrize("doc", [GOOD, "Berechnet die Summe pro Kunde", "Load rows sorted by month.", "Calcula los precios", "Returns:\n    the filtered frame", "行を返す"])
def test_worth_keeping(doc):
    assert D.informs(doc, "load_rows_by_month_12")


def test_equals_own_parser():
    text = open(D.__file__).read()
    tree = ast.parse(text)
    want = {}

    def go(body):
        for n in body:
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                want[(n.lineno, n.name)] = ast.get_docstring(n, clean=False)
            elif isinstance(n, ast.ClassDef):
                go(n.body)

    go(tree.body)
    got = {(text.count("\n", 0, p.at) + 1, p.name): p.doc for p in D.pair_python(text) if p.origin == "docstring"}
    assert set(got) == {k for k, d in want.items() if d is not None}
    assert all(textwrap.dedent(got[k]).split() == textwrap.dedent(want[k]).split() for k in got)


def test_braces():
    js = "/**\n * Adds two prices.\n * @param a first\n */\nexport async function add(a, b) { return a; }\nconst s = '/** x */ function no() {}';\n// Takes the larger of both.\nfunction max(a, b) {}\nfunction bare() {}\n"
    assert [(p.name, js.count("\n", 0, p.at) + 1) for p in D.pair_braces(js)] == [("add", 5), ("max", 8)]


LANGUAGES = {
    "js": (
        "/** Adds two prices. */\nexport const add = (a, b) => a + b;\n\n// Takes the larger of both.\nconst max = async function (a, b) { return a; };\n\n/** Half of a price. */\nconst half = x => x / 2;\n"
        "class Basket extends Base {\n  /** Sums up all rows. */\n  total(rows = [1, (2)]) {\n    // Inner helper of it.\n    const inner = (x) => x;\n    if (rows) { return 1; }\n  }\n  /** Reads it lazily. */\n  static async load(path) {}\n  /** Drops empty rows. */\n  drop = (rows) => rows;\n}\n/** Not a function. */\nconst rate = 3;\n",
        [("add", 2), ("max", 5), ("half", 8), ("total", 11), ("load", 17), ("drop", 19)],
    ),
    "ts": ("/** Keeps the newest. */\nexport function newest<T extends Row>(rows: T[], key: (r: T) => number): T { return rows[0]; }\nexport class A<T> {\n  /** Finds a row. */\n  @memo()\n  public find(id: string): Promise<T | null> {\n  }\n  /** Maps the rows. */\n  private map = (f: (t: T) => T): T[] => [];\n}\n", [("newest", 2), ("find", 6), ("map", 9)]),
    "java": (
        "package a;\n/** A basket. */\npublic class Basket<T extends Row> implements X {\n  /** Sums up all rows. */\n  @Override\n  @Deprecated(since = \"1\")\n  public static <K> Map<K, List<T>> total(final List<T> rows, int n) throws IOException {\n    // Loops over them.\n    for (T r : rows) { go(r); }\n    return null;\n  }\n  /** Makes one. */\n  public Basket(int n) {}\n  /** Only declared here. */\n  abstract void close();\n  /** A constant. */\n  static final int N = f(3);\n}\n",
        [("total", 7), ("Basket", 13), ("close", 15)],
    ),
    "cs": ("namespace A {\n  class B {\n    /// <summary>\n    /// Sums up all rows.\n    /// </summary>\n    [Obsolete]\n    public async Task<int> Total(int[] rows) => rows.Length;\n  }\n}\n", [("Total", 7)]),
    "go": ("package a\n\n// Total sums up all rows of a basket.\nfunc (b *Basket) Total(rows []Row, f func(int) int) (int, error) {\n\t// Inner helper of it.\n\tg := func(x int) int { return x }\n}\n\n// Keys lists them in order.\nfunc Keys[K comparable](m map[K]int) []K {\n}\n\n// far away\n\nfunc Far() {}\n", [("Total", 4), ("Keys", 10)]),
    "c": ("/* Sums up all rows. */\nstatic int total(const struct row *rows, int n)\n{\n  /* Loop over them. */\n  while (n) { n--; }\n}\n/** Only declared here. */\nunsigned long next_key(void);\n/* not code */\n#define F(x) x\n", [("total", 2), ("next_key", 8)]),
    "cpp": ("namespace a {\n/// Sums up all rows.\ntemplate <typename T>\nstd::vector<T> total(const std::vector<T>& rows, int n = (1 + 2)) const {\n}\nclass B {\n public:\n  // Makes one of a size.\n  explicit B(int n) : n_(n) {}\n  /** Compares the sizes. */\n  bool operator==(const B& o) const { return true; }\n};\n}\n", [("total", 4), ("B", 9), ("operator==", 11)]),
    "rs": ("//! Module text.\n\n/// Sums up all rows.\n#[inline]\npub async fn total<T: Into<u64>>(rows: &[T], f: impl Fn(u64) -> u64) -> Option<u64> {\n    // Inner helper.\n    fn inner(x: u8) {}\n}\nimpl<'a> Basket<'a> {\n    /// Reads the first key.\n    pub(crate) fn first(&'a self) -> char { '{' }\n    /** Writes all of it. */\n    fn write(&self) {}\n}\n", [("total", 5), ("first", 11), ("write", 13)]),
    "php": ("<?php\nclass A {\n  /** Sums up all rows. */\n  public static function total($rows) { }\n}\n", [("total", 4)]),
}


@pytest.mark.parametrize("ending", LANGUAGES)
def test_languages_with_braces(ending):
    text, want = LANGUAGES[ending]
    got = [(p.name, text.count("\n", 0, p.at) + 1) for p in D.pairs_of_file(text, f"src/a.{ending}")]
    assert got == want
    assert all(D.informs(p.doc, p.name) for p in D.pairs_of_file(text, f"a.{ending}"))


@pytest.mark.parametrize("ending", LANGUAGES)
def test_broken_texts_with_braces_end(ending):
    for text in ("(" * 3000, "{" * 3000, '"' * 3001, "/** x */ " * 3000, "/* " * 3000, "// a\n" * 20_000, "int f(" * 2000, "a " * 20_000 + "(", "<" * 2000, "`" * 2001):
        assert list(D.pairs_of_file(text, f"a.{ending}")) is not None


def test_long_and_broken_texts_end():
    for text in ("(" * 3000, '"' * 3001, "def f(" * 2000, "\\\n" * 2000, "x = [" + "1, " * 100_000, "'''" + "a\n" * 50_000):
        assert list(D.pair_python(text)) is not None


def test_tables(spark):
    ok = f'def f():\n    """{GOOD}"""\n'
    rows = [(1, ok, "a.py", "function", "x"), (1, ok, "a.py", None, "x"), (2, None, "b.py", "module", "x"), (3, "", "b.py", "module", "x"), (4, ok, "c.ini", "config", "x"), (5, "function f() {}", None, "module", "x")]
    df = spark.createDataFrame(rows, "entity_id long, source string, relpath string, kind string, def_line string")
    got = [(r["entity_id"], r["def_line"]) for r in D.extract_pairs(df).collect()]
    assert got == [(1, 1), (1, 1)]
    assert D.extract_pairs(df.limit(0)).count() == 0
