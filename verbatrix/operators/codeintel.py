"""Facts from source code without a parser: symbols, environment variables,
routes and tooling signals, and the markdown that is derived from them.

All patterns of a kind of fact pass over a file once, in Arrow batches: SQL's
functions for regular expressions don't tell where a match lies, and finding its
line with them takes copies of the text before it.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.functions import text as T

EXTENSIONS = (".js", ".mjs", ".cjs", ".ts", ".tsx", ".py", ".go", ".rs")
IGNORED = ("node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".cache", "vendor", "target", "__pycache__", "venv", ".venv")
IMPLICIT = ("package.json", "makefile", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "requirements.txt", "pyproject.toml", "procfile")
MAX_DEPENDENCIES = 12
#: Facts of a batch at most.
FACTS = 1 << 12
NAME = "([A-Za-z_][A-Za-z0-9_]*)"
#: kind, extensions, pattern, whether the second group holds parameters
SYMBOLS = (
    ("function", (".js", ".mjs", ".cjs", ".ts", ".tsx"), f"export\\s+(?:async\\s+)?function\\s+{NAME}\\s*\\(([^)]*)\\)", True),
    ("class", (".js", ".mjs", ".cjs", ".ts", ".tsx"), f"export\\s+class\\s+{NAME}", False),
    ("function", (".py",), f"(?m)^def\\s+{NAME}\\s*\\(([^)]*)\\):", True),
    ("class", (".py",), f"(?m)^class\\s+{NAME}\\s*[:(]", False),
    ("function", (".go",), f"(?m)^func\\s+(?:\\([^)]+\\)\\s+)?{NAME}\\s*\\(([^)]*)\\)", True),
    ("function", (".rs",), f"pub\\s+fn\\s+{NAME}\\s*\\(([^)]*)\\)", True),
)
_VAR, _Q = "([A-Z][A-Z0-9_]+)", "[\"']"
#: {L} and {R} stand for word borders
ENV = (
    f"{{L}}process\\.env\\.{_VAR}{{R}}", f"{{L}}process\\.env\\[\\s*{_Q}{_VAR}{_Q}\\s*\\]", f"{{L}}import\\.meta\\.env\\.{_VAR}{{R}}", f"{{L}}os\\.getenv\\(\\s*{_Q}{_VAR}{_Q}\\s*\\)",
    f"{{L}}std::env::var\\(\\s*{_Q}{_VAR}{_Q}\\s*\\)", f"{{L}}getenv\\(\\s*{_Q}{_VAR}{_Q}\\s*\\)", f"{{L}}Deno\\.env\\.get\\(\\s*{_Q}{_VAR}{_Q}\\s*\\)", f"{{L}}os\\.Getenv\\(\\s*\"{_VAR}\"\\s*\\)",
)
_T = "[\"'`]"
#: method group, path group, pattern
ROUTES = (f"{{L}}(?:app|router)\\.(get|post|put|patch|delete)\\(\\s*{_T}([^\"'`]+){_T}", "\\.(GET|POST|PUT|PATCH|DELETE)\\(\\s*\"([^\"]+)\"")
FLASK = f"@(?:app|bp|blueprint)\\.route\\(\\s*{_T}([^\"'`]+){_T}(?:\\s*,\\s*methods\\s*=\\s*\\[([^\\]]+)\\])?"


def _borders(pattern: str) -> str:
    return pattern.replace("{L}", "(?<![A-Za-z0-9_])").replace("{R}", "(?![A-Za-z0-9_])")


def _found(rules: list[tuple[int, tuple[str, ...], str]]):
    """Batches of matches; ``rules`` are (number, extensions or none, pattern)."""
    compiled = [(n, frozenset(e), re.compile(p)) for n, e, p in rules]

    def rows(path: str, extension: str, content: str) -> Iterator[tuple]:
        ends = None
        for number, extensions, pattern in compiled:
            if extensions and extension not in extensions:
                continue
            for at, m in enumerate(pattern.finditer(content)):
                if ends is None:
                    ends = [x.start() for x in re.finditer("\n", content)]
                g = [x or "" for x in m.groups()]
                yield path, number, at, bisect.bisect_left(ends, m.start()) + 1, g[0], g[1] if len(g) > 1 else ""

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["source_path", "rule", "at", "line", "g1", "g2"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in it:
            # one file at a time as Python's, and facts leave when there are some
            for n in range(batch.num_rows):
                for row in rows(*(c[n].as_py() for c in batch.columns)):
                    out.append(row)
                    if len(out) == FACTS:
                        yield packed(out)
                        out = []
        if out:
            yield packed(out)

    return run


def matches(files: DataFrame, rules: list[tuple[int, tuple[str, ...], str]]) -> DataFrame:
    """Rows ``source_path, rule, at, line, g1, g2`` for each match of each rule
    (number, extensions or none for all, pattern) in ``content``; ``at`` counts a rule's matches in a file."""
    extension = F.col("extension") if "extension" in files.columns else F.lit("")
    rows = files.where("content is not null").select("source_path", extension.alias("extension"), "content")
    return rows.mapInArrow(_found(rules), "source_path string, rule int, at int, line int, g1 string, g2 string")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """``source_path, rule, at, kind, name, signature, line``; ``files`` has source_path, extension, content."""
    found = matches(files, [(n, extensions, pattern) for n, (_, extensions, pattern, _) in enumerate(SYMBOLS)])
    kinds, called = (F.array(*[F.lit(x[i]) for x in SYMBOLS]) for i in (0, 3))
    signature = F.when(F.get(called, F.col("rule")), F.concat("g1", F.lit("("), T.js_trim(F.col("g2")), F.lit(")"))).otherwise(F.col("g1"))
    return found.select("source_path", "rule", "at", F.get(kinds, F.col("rule")).alias("kind"), F.col("g1").alias("name"), signature.alias("signature"), "line")


def env_vars(files: DataFrame) -> DataFrame:
    """``source_path, name, line``, each once."""
    return matches(files, [(n, (), _borders(p)) for n, p in enumerate(ENV)]).select("source_path", F.col("g1").alias("name"), "line").distinct()


def routes(files: DataFrame) -> DataFrame:
    """``source_path, route, line``, each once; a route without methods is a GET."""
    found = matches(files, [(n, (), _borders(p)) for n, p in enumerate((*ROUTES, FLASK))])
    named = F.regexp_extract_all("g2", F.lit(f"{_T}([A-Za-z]+){_T}"), F.lit(1))
    flask = F.col("rule") == len(ROUTES)
    methods = F.when(~flask, F.array("g1")).when(F.size(named) > 0, named).otherwise(F.array(F.lit("GET")))
    path = F.when(flask, F.col("g1")).otherwise(F.col("g2"))
    return found.select("source_path", path.alias("path"), "line", F.explode(methods).alias("method")).select("source_path", F.concat(F.upper("method"), F.lit(" "), "path").alias("route"), "line").distinct()


def signals(files: DataFrame) -> DataFrame:
    """``source_path, kind, value, line`` from package, build, container and workflow files, each once."""
    name = F.lower(F.element_at(F.split("source_path", "/"), -1))
    of = lambda n: files.where(name == n)
    package = of("package.json").withColumn("json", F.from_json("content", "struct<scripts: map<string, string>, dependencies: map<string, string>>"))
    scripts = package.select("source_path", F.explode(F.map_keys("json.scripts")).alias("k")).select("source_path", F.lit("script").alias("kind"), F.concat(F.lit("npm run "), "k").alias("value"), F.lit(1).alias("line"))
    needs = package.select("source_path", F.explode(F.slice(F.array_sort(F.map_keys("json.dependencies")), 1, MAX_DEPENDENCIES)).alias("value")).select("source_path", F.lit("dependency").alias("kind"), "value", F.lit(1).alias("line"))
    one = lambda df, pattern: matches(df, [(0, (), pattern)])
    make = one(of("makefile"), "(?m)^([A-Za-z0-9_.-]+)\\s*:").where(~F.col("g1").startswith(".")).select("source_path", F.lit("make-target").alias("kind"), F.col("g1").alias("value"), "line")
    steps = ("FROM", "EXPOSE", "CMD", "ENTRYPOINT", "HEALTHCHECK")
    docker = matches(of("dockerfile"), [(n, (), f"(?mi)^{d}\\s+(.+)$") for n, d in enumerate(steps)]).select("source_path", F.lit("docker").alias("kind"), F.concat_ws(" ", F.get(F.array(*map(F.lit, steps)), F.col("rule")), T.js_trim(F.col("g1"))).alias("value"), "line")
    required = one(of("requirements.txt"), "(?m)^\\s*([A-Za-z0-9_.-]+)(?:[<>=!~]=.+)?\\s*$").select("source_path", F.lit("dependency").alias("kind"), F.col("g1").alias("value"), "line")
    project = one(of("pyproject.toml"), f"(?m)^\\s*name\\s*=\\s*{_Q}([^\"']+){_Q}\\s*$").select("source_path", F.lit("project").alias("kind"), F.col("g1").alias("value"), "line")
    runtime = one(of("pyproject.toml"), f"(?m)^\\s*requires-python\\s*=\\s*{_Q}([^\"']+){_Q}\\s*$").select("source_path", F.lit("runtime").alias("kind"), F.concat(F.lit("python "), "g1").alias("value"), "line")
    flows = one(files.where(F.col("source_path").rlike("(?i)(^|/)[.]github/workflows/[^/]+[.]ya?ml$")), "(?m)^\\s*-\\s*run:\\s*(.+)$").select("source_path", F.lit("ci-run").alias("kind"), T.js_trim(F.col("g1")).alias("value"), "line")
    return _union([scripts, needs, make, docker, required, project, runtime, flows]).distinct()


def _path_name(c: str = "source_path") -> Column:
    return F.lower(F.element_at(F.split(c, "/"), -1))


def is_code() -> Column:
    """Whether ``source_path`` is a source file that counts: no ignored folder, not minified."""
    ignored = F.exists(F.split("source_path", "/"), lambda p: p.isin(*IGNORED))
    return F.lower(F.regexp_extract("source_path", "([.][^./]+)$", 1)).isin(*EXTENSIONS) & ~_path_name().rlike("[.]min[.][^.]+$") & ~ignored


def is_implicit() -> Column:
    return _path_name().isin(*IMPLICIT) | F.col("source_path").rlike("(?i)(^|/)[.]github/workflows/[^/]+[.]ya?ml$")


def code_files(files: DataFrame) -> DataFrame:
    """(rel_path, content) to (source_path, extension, content) of the files that count."""
    named = files.select(F.col("rel_path").alias("source_path"), "content")
    return named.where(is_code() | is_implicit()).select("source_path", F.lower(F.regexp_extract("source_path", "([.][^./]+)$", 1)).alias("extension"), "content")


def locations(found: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, places): where each key occurs, the first ``most`` and how many more."""
    rank = Window.partitionBy(key).orderBy(T.icu(F.col("source_path")), "line")
    placed = found.select(key, "source_path", "line").distinct().withColumn("n", F.row_number().over(rank)).withColumn("total", F.count("*").over(Window.partitionBy(key)))
    shown = placed.where(F.col("n") <= most).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":", "source_path", "line").alias("p")))), lambda x: x["p"]), ", ").alias("first"), F.first("total").alias("total"))
    return shown.select(key, F.when(F.col("total") > most, F.concat("first", F.lit(", +"), F.col("total") - most, F.lit(" more"))).otherwise(F.col("first")).alias("places"))


def totals(files: DataFrame) -> DataFrame:
    """One row: files, symbols, routes, environment variables and signals of a code base."""
    code = code_files(files)
    only, implicit = code.where(is_code()), code.where(is_implicit())
    of = lambda df, name: df.agg(F.count("*").alias(name))
    return of(code, "n_files").crossJoin(of(symbols(only), "n_symbols")).crossJoin(of(routes(only), "n_routes")).crossJoin(of(env_vars(only), "n_env_vars")).crossJoin(of(signals(implicit), "n_signals"))


def bootstrap(files: DataFrame, library: str) -> DataFrame:
    """Markdown derived from code as one file (rel_path, content). Its size follows
    the number of facts; lines are sorted where they are made and joined once."""
    code = code_files(files)
    only_code, implicit = code.where(is_code()), code.where(is_implicit())
    s, e, r, g = symbols(only_code), env_vars(only_code), routes(only_code), signals(implicit)
    g = g.withColumn("signal", F.concat_ws(": ", "kind", "value"))
    counts = code.agg(F.count("*").alias("n")).crossJoin(s.agg(F.count("*").alias("s"))).crossJoin(r.agg(F.count("*").alias("r"))).crossJoin(e.agg(F.count("*").alias("e"))).crossJoin(g.agg(F.count("*").alias("g")))
    row = lambda df, part, text, *order: df.select(F.lit(part).alias("part"), F.concat_ws("\x01", *[F.lpad(F.col(o).cast("string"), 9, "0") if o in ("line", "rule", "at") else F.col(o) for o in order]).alias("key"), text.alias("text"))
    head = counts.select(F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(
        F.lit(f"# {library} Bootstrap Docs\n\nThis documentation is generated from source code and runtime/tooling artifacts.\nConfidence: partial (derived/inferred).\n\n## Summary\n\n- Source files scanned: "), "n",
        F.lit("\n- Symbols detected: "), "s", F.lit("\n- Routes detected: "), "r", F.lit("\n- Environment vars detected: "), "e", F.lit("\n- Runtime/tooling signals detected: "), "g", F.lit("\n")).alias("text"))
    parts = [head]
    for part, title, df, key in ((1, "Environment Variables", e, "name"), (2, "Routes", r, "route"), (3, "Runtime and Tooling Signals", g, "signal")):
        name = F.concat(F.lit("`"), key, F.lit("`")) if key == "name" else F.col(key)
        listed = row(locations(df, key), part, F.concat(F.lit("- "), name, F.lit(" ("), "places", F.lit(")")), key)
        parts.append(listed.groupBy("part").agg(F.lit("").alias("key"), F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda x: x["text"]), "\n"), F.lit("\n")).alias("text")))
    facts = [
        row(s, 0, F.concat(F.lit("- "), "kind", F.lit(": `"), "signature", F.lit("` (line "), "line", F.lit(")")), "source_path", "rule", "at"),
        row(r, 1, F.concat(F.lit("- "), "route", F.lit(" (line "), "line", F.lit(")")), "source_path", "route", "line"),
        row(e, 2, F.concat(F.lit("- `"), "name", F.lit("` (line "), "line", F.lit(")")), "source_path", "name", "line"),
        row(g, 3, F.concat(F.lit("- "), "kind", F.lit(": `"), "value", F.lit("` (line "), "line", F.lit(")")), "source_path", "kind", "value", "line"),
    ]
    titles = F.create_map(*[x for i, t in enumerate(("Functions and classes:", "Routes:", "Environment variables:", "Operational signals:")) for x in (F.lit(i), F.lit(t))])
    blocks = _union(facts).withColumn("path", F.split_part("key", F.lit("\x01"), F.lit(1))).groupBy("path", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda x: x["text"]), "\n").alias("list"))
    per_file = blocks.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.concat(titles[F.col("part")], F.lit("\n\n"), "list", F.lit("\n")).alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    parts.append(files.sparkSession.range(1).select(F.lit(4).alias("part"), F.lit("").alias("key"), F.lit("## Symbols\n").alias("text")))
    parts.append(per_file.select(F.lit(5).alias("part"), F.col("path").alias("key"), F.concat(F.lit("### "), "path", F.lit("\n\n"), "text").alias("text")))
    whole = _union(parts).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "key", "text"))), lambda x: x["text"]), "\n").alias("content"))
    return whole.select(F.lit("bootstrap.md").alias("rel_path"), F.concat(T.js_trim(F.col("content")), F.lit("\n")).alias("content"))
