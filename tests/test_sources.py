"""Sources: git text, parser output, Python code."""

from loomline.sources import git, ir, python_code


def test_git_text(spark):
    text = ["h1\x1f2024-01-01T00:00:00Z\x1fjo\x1ffirst", "A\ta.py", "R090\tb.py\tc.py", "", "h2\x1f2024-01-02T00:00:00Z\x1fjo\x1fsecond", "plain.py", "D\ta.py"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, text string")
    commits, changes = git.parse_log(lines)
    assert {(r.hash, r.message) for r in commits.collect()} == {("h1", "first"), ("h2", "second")}
    got = {r.hash: r for r in git.commit_deltas(changes).collect()}
    assert got["h1"].added == ["a.py"] and got["h1"].renamed == ["b.py>c.py"]
    assert got["h2"].changed == ["plain.py"] and got["h2"].deleted == ["a.py"]


def test_hunks(spark):
    text = ["+++ b/x.py", "@@ -1,2 +10,3 @@", "@@ -9 +20 @@", "@@ -5,2 +4,0 @@", "+++ b/y.py", "@@ -0,0 +1,2 @@ def"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, text string")
    assert {(r.path, r.start, r.end) for r in git.parse_hunks(lines).collect()} == {("x.py", 10, 12), ("x.py", 20, 20), ("y.py", 1, 2)}


def test_python_source(spark, tmp_path):
    (tmp_path / "src/pkg").mkdir(parents=True)
    (tmp_path / "src/pkg/__init__.py").write_text("")
    (tmp_path / "src/pkg/base.py").write_text("class Base:\n    def run(self):\n        return helper()\n\ndef helper():\n    return 1\n")
    (tmp_path / "src/pkg/app.py").write_text("from .base import Base, helper as h\nimport os\n\nclass App(Base):\n    def go(self):\n        h()\n        os.getcwd()\n")
    (tmp_path / "src/pkg/bad.py").write_text("def (")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.py").write_text("x = 1")
    facts = python_code.facts(python_code.scan(spark, str(tmp_path)))
    assert {r.path for r in facts.where("fact = 'error'").collect()} == {"src/pkg/bad.py"}
    nodes, edges = python_code.graph(facts)
    assert {"pkg.base", "pkg.base.Base.run", "pkg.app.App"} <= {r.id for r in nodes.collect()}
    got = {(r.kind, r.source, r.target, r.resolved) for r in edges.collect()}
    assert ("inherits", "pkg.app.App", "pkg.base.Base", True) in got
    assert ("calls", "pkg.app.App.go", "pkg.base.helper", True) in got
    assert ("calls", "pkg.app.App.go", "os.getcwd", False) in got
    assert ("calls", "pkg.base.Base.run", "pkg.base.helper", True) in got
    assert ("requires", "pkg.app", "pkg.base", True) in got


def test_ir_normalisation(spark):
    raw = spark.createDataFrame(
        [("1", "symbol", "f", "a/f", "a", "a.py", "unresolved"), ("2", "symbol", "f", "a/f", "a", "a.py", "resolved"), ("3", "symbol", "g", "a/g", "a", "a.py", "resolved")],
        "id string, kind string, name string, qualified string, namespace string, file string, status string",
    )
    nodes = ir.normalize_nodes(raw)
    assert {(r.name, r.status, tuple(r.raw_ids)) for r in nodes.collect()} == {("f", "resolved", ("1", "2")), ("g", "resolved", ("3",))}
    rel = spark.createDataFrame([("r", "calls", "1", "3"), ("q", "calls", "3", "9")], "id string, kind string, source string, target string")
    got = ir.rekey(rel, nodes).collect()
    assert sum(r.target is None for r in got) == 1 and all(r.id.startswith("rel:") for r in got)


def test_language_detection(spark):
    files = spark.createDataFrame([(f"{i}.py", "python") for i in range(20)] + [("a.ts", "typescript")], "path string, language string")
    markers = spark.createDataFrame([("typescript", 3), ("python", 4)], "language string, weight int")
    assert {(r.language, r.score, r.ambiguous) for r in ir.detect_languages(files, markers).collect()} == {("python", 24, False), ("typescript", 5, False)}
