"""Public surface of JavaScript and TypeScript packages: symbols, exports, examples, lookup.

There is no TypeScript parser for Spark or Python here. Each file is read by a
scanner for top-level declarations in an Arrow batch function; everything
between files (first declaration wins, merged overloads, limits) is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatrix.errors import EngineError
from verbatrix.functions import text as T
from verbatrix.operators import lookups

EXTENSIONS = (".ts", ".tsx", ".js", ".mjs", ".cjs")
IGNORED = ("node_modules", ".git", "coverage", ".cache", "tmp", "temp")
EXAMPLE_ROOTS = "^((examples?|tests?|__tests__|docs)/|README[.]md$)"
EXAMPLE_FILES = "(?i)[.](ts|tsx|js|mjs|cjs|mts|cts|md|markdown|mdx)$"
MAX_FILES, MAX_BYTES, MAX_SYMBOLS, MAX_EXAMPLES, AROUND = 2000, 20 * 1024 * 1024, 200, 3, 6
ROW = "module_path string, file_rank bigint, seq int, what string, name string, fq_name string, kind string, signature string, summary string, line_start int, line_end int, local string, broken boolean"
_ID = r"[A-Za-z_$][\w$]*"
_START = re.compile(rf"(?P<mods>(?:(?:export|default|declare|abstract|async)\s+)*)(?:(?P<fn>function)\s*\*?\s*(?P<fname>{_ID})?|(?P<cls>class)\s+(?P<cname>{_ID})|(?P<itf>interface)\s+(?P<iname>{_ID})|(?P<typ>type)\s+(?P<tname>{_ID})\s*(?:<[^=]*>)?\s*=|(?P<var>const|let|var)\s+|(?P<exp>export)\s*(?:type\s+)?\{{|(?P<def>export\s+default)\s+(?P<dname>{_ID})\s*(?:;|$|\n))")
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?\s*(?P<name>{_ID}|#{_ID})\s*\??\s*(?=[<(])")


def masked(text: str) -> str:
    """``text`` with comments and the contents of strings and templates blanked."""
    out, i, n = list(text), 0, len(text)
    while i < n:
        c, two = text[i], text[i : i + 2]
        if two == "//":
            end = text.find("\n", i)
            end = n if end < 0 else end
        elif two == "/*":
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
        elif c in "'\"`":
            end = i + 1
            while end < n and text[end] != c and not (c != "`" and text[end] == "\n"):
                end += 2 if text[end] == "\\" else 1
            for k in range(i + 1, min(end, n)):
                if out[k] != "\n":
                    out[k] = " "
            i = end + 1
            continue
        else:
            i += 1
            continue
        for k in range(i, end):
            if out[k] != "\n":
                out[k] = " "
        i = end
    return "".join(out)


def _close(m: str, at: int) -> int:
    """Place behind the bracket that closes the one at ``at``; the end if none does."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for i in range(at, len(m)):
        if m[i] in pairs:
            depth += 1
        elif m[i] in ")]}":
            depth -= 1
            if depth == 0:
                return i + 1
    return len(m)


def _until(m: str, at: int, stops: str) -> int:
    """First place from ``at`` with one of ``stops`` outside brackets."""
    i = at
    while i < len(m):
        if m[i] in stops:
            return i
        if m[i] in ")]}":
            return i
        i = _close(m, i) if m[i] in "([{" else i + 1
    return i


def _callable(text: str, m: str, at: int) -> tuple[str, int]:
    """Parameters and return type, ``(a, b): R``, of the parameter list at or after
    ``at``, and where the head ends."""
    start = m.find("(", at)
    if start < 0:
        return "()", at
    end, params, i = _close(m, start), [], start + 1
    while i < end - 1:
        stop = _until(m, i, ",")
        stop = min(stop, end - 1)
        if text[i:stop].strip():
            params.append(text[i:stop].strip())
        i = stop + 1
    rest = re.match(r"\s*:\s*", m[end:])
    kind = ""
    if rest:
        i = end + rest.end()
        stop = _close(m, i) if m[i : i + 1] == "{" else i
        while stop < len(m) and m[stop] not in "{;\n" and m[stop : stop + 2] != "=>":
            stop = _close(m, stop) if m[stop] in "([" else stop + 1
        kind, end = ": " + text[i:stop].strip(), stop
    return f"({', '.join(params)}){kind}", end


def _summary(text: str, m: str, at: int) -> str:
    """First line of the last comment directly before ``at`` that isn't a tag."""
    before = text[:at].rstrip()
    if before.endswith("*/"):
        comment = before[before.rfind("/*") :]
    elif m[: len(before)].rstrip() != before:
        comment = before[before.rfind("\n") + 1 :].strip()
        if not comment.startswith("//"):
            return ""
    else:
        return ""
    lines = [re.sub(r"^\s*\*\s?", "", x).strip() for x in re.sub(r"\*/$", "", re.sub(r"^/\*\*?", "", comment)).splitlines()]
    return next((x for x in lines if x and not x.startswith("@")), "")


def scan(text: str) -> tuple[list[dict], bool]:
    """Declarations and exports of one file in order; whether brackets don't close."""
    m, rows, line = masked(text), [], lambda i: text.count("\n", 0, i) + 1
    broken = any(m.count(a) != m.count(b) for a, b in ("()", "[]", "{}"))

    def symbol(name, kind, signature, start, end, fq=None, what="symbol"):
        rows.append({"what": what, "name": name, "fq_name": fq or name, "kind": kind, "signature": signature, "summary": _summary(text, m, start), "line_start": line(start), "line_end": line(max(start, end - 1)), "local": name})

    def export(name, local, kind=""):
        rows.append({"what": "export", "name": name, "fq_name": local, "kind": kind, "signature": "", "summary": "", "line_start": 0, "line_end": 0, "local": local})

    i, n = 0, len(m)
    while i < n:
        if m[i] in " \t\r\n;":
            i += 1
            continue
        if m[i] in "([{":
            i = _close(m, i)
            continue
        found = _START.match(m, i) if (i == 0 or not re.match(r"[\w$.]", m[i - 1])) else None
        if not found:
            word = re.compile(r"[\w$]+|.", re.S).match(m, i)
            i = word.end()
            continue
        mods, g = found["mods"] or "", found.groupdict()
        exported, default = "export" in mods or "default" in mods, "default" in mods
        if g["fn"]:
            head, end = _callable(text, m, found.end())
            body = re.match(r"\s*\{", m[end:])
            end = _close(m, end + body.end() - 1) if body else end + len(re.match(r"\s*;?", m[end:])[0])
            if g["fname"]:
                symbol(g["fname"], "function", g["fname"] + head, i, end)
                if exported:
                    export("default" if default else g["fname"], g["fname"], "function")
        elif g["cls"] or g["itf"]:
            brace = m.find("{", found.end())
            end = _close(m, brace) if brace >= 0 else n
            name = g["cname"] or g["iname"]
            symbol(name, "class" if g["cls"] else "type", f"{'class' if g['cls'] else 'interface'} {name}", i, end)
            if exported:
                export("default" if default and g["cls"] else name, name, "class" if g["cls"] else "type")
                k = brace + 1
                while g["cls"] and 0 < k < end - 1:
                    if m[k] in " \t\r\n;":
                        k += 1
                        continue
                    member = _METHOD.match(m, k)
                    if member and member["name"] != "constructor":
                        head, stop = _callable(text, m, member.end())
                        body = re.match(r"\s*\{", m[stop:])
                        stop = _close(m, stop + body.end() - 1) if body else stop + len(re.match(r"[ \t]*;?", m[stop:])[0])
                        symbol(member["name"], "method", member["name"] + head, k, stop, f"{name}.{member['name']}")
                        k = stop
                    else:
                        stop = _until(m, k, ";{\n")
                        k = _close(m, stop) if m[stop : stop + 1] == "{" else stop + 1
        elif g["typ"]:
            end = found.end()
            while end < n and m[end] != ";" and not (m[end] == "\n" and not re.match(r"\s*[|&]", m[end:])):
                end = _close(m, end) if m[end] in "([{" else end + 1
            symbol(g["tname"], "type", f"type {g['tname']} = {text[found.end() : end].strip()}", i, min(end + 1, n))
            if exported:
                export(g["tname"], g["tname"], "type")
        elif g["var"]:
            end = found.end()
            while True:
                stop = end
                while stop < n and m[stop] not in ",;" and not (m[stop] == "\n" and re.match(r"\s*(?:[A-Za-z_$}]|$)", m[stop:]) and not re.search(r"[=(,+\-*/<>|&?:]\s*$", m[end:stop])):
                    stop = _close(m, stop) if m[stop] in "([{" else stop + 1
                one = re.compile(rf"\s*({_ID})\s*[!]?\s*(?::[^=]*)?(=(?!>))?\s*").match(m, end)
                if one and one.end() <= stop + 1:
                    arrow = re.match(r"(?:async\s+)?(?:function\b[^(]*)?\(", m[one.end() : stop]) if one[2] else None
                    head = _callable(text, m, one.end())[0] if arrow and ("=>" in m[one.end() : stop] or "function" in arrow[0]) else ""
                    symbol(one[1], "function", one[1] + head, one.start(1), stop)
                    if exported:
                        export(one[1], one[1], "function")
                end = stop + 1
                if stop >= n or m[stop] != ",":
                    break
        elif g["exp"]:
            brace = found.end() - 1
            end = _close(m, brace)
            for part in text[brace + 1 : end - 1].split(","):
                names = re.match(rf"\s*(?:type\s+)?({_ID})(?:\s+as\s+({_ID}))?", part)
                if names:
                    export(names[2] or names[1], names[1])
        else:
            export("default", g["dname"])
            end = found.end()
        i = max(end, i + 1)
    for kind, pattern in (("function", rf"export\s+(?:declare\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)\s*\(([^)]*)\)"), ("class", r"export\s+(?:declare\s+)?class\s+([A-Za-z_]\w*)")):
        for f in re.finditer(pattern, text):
            rows.append({"what": "fallback", "name": f[1], "fq_name": f[1], "kind": kind, "signature": f"{f[1]}({f[2].strip()})" if kind == "function" else f"class {f[1]}", "summary": "", "line_start": line(f.start()), "line_end": line(f.start()), "local": f[1]})
    return rows, broken


def _scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in ROW.split(", ")]
    for batch in batches:
        out = []
        for path, rank, content in zip(batch["rel_path"], batch["file_rank"], batch["content"]):
            rows, broken = scan(content)
            out += [{"module_path": path, "file_rank": rank, "seq": n, "broken": broken, **r} for n, r in enumerate(rows)]
        # no rows: no batch
        if out:
            yield pd.DataFrame(out, columns=names)


def source_files(files: DataFrame, entries: tuple[str, ...] = (), max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Package files in the order in which they are read, entry points first, up to the
    limits: ``files`` with ``file_rank``. Paths and sizes alone are ranked."""
    kept = files.where(F.lower(F.regexp_extract("rel_path", "([.][^./]+)$", 1)).isin(*EXTENSIONS) & ~F.exists(F.split("rel_path", "/"), lambda p: p.isin(*IGNORED)))
    entry = F.coalesce(F.array_position(F.array(*map(F.lit, entries)), F.col("rel_path")), F.lit(0)) if entries else F.lit(0)
    sized = kept.select("rel_path", F.octet_length("content").cast("bigint").alias("bytes"), F.when(entry > 0, entry).otherwise(1 << 30).alias("entry"))
    ranked = lookups.running(sized, [F.col("entry"), T.icu(F.col("rel_path"))], {"through": "bytes"}).withColumnRenamed("number", "file_rank")
    within = ranked.where((F.col("file_rank") <= max_files) & (F.col("through") <= max_bytes)).select("rel_path", "file_rank")
    return kept.join(within, "rel_path")


def surface(files: DataFrame, library: str, entries: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, exports, confidence) of a package's files (rel_path, content)."""
    read = source_files(files, entries)
    rows = read.select("rel_path", "file_rank", "content").mapInPandas(_scanned, ROW).withColumn("symbol_id", F.concat(F.lit(f"{library}::"), "fq_name"))
    declared = rows.where("what = 'symbol'")
    place = Window.partitionBy("symbol_id").orderBy("file_rank", "seq")
    new = declared.withColumn("n", F.row_number().over(place)).where("n = 1").groupBy("module_path").agg(F.count("*").alias("fresh"))
    # files that yield nothing new, or don't parse, are searched by patterns as well
    unread = rows.where("what = 'fallback'").join(new, "module_path", "left").where("broken or fresh is null").drop("fresh")
    every = declared.unionByName(unread)
    first = F.min_by(F.struct("name", "fq_name", "kind", "summary", "module_path", "line_start", "line_end"), F.struct("file_rank", "seq"))
    signatures = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when((F.col("signature") != "") & (F.col("what") == "symbol"), F.struct("file_rank", "seq", "signature")))), lambda x: x["signature"]))
    merged = every.groupBy("symbol_id").agg(first.alias("f"), signatures.alias("own"), F.array_distinct(F.collect_list("signature")).alias("any"))
    symbols = merged.select("symbol_id", "f.*", F.when(F.size("own") > 0, F.col("own")).otherwise(F.array_sort("any")).alias("signatures"))
    local = declared.where("kind <> 'method'").select("module_path", "local", "symbol_id").distinct()
    named = rows.where("what = 'export'").select("module_path", F.col("name").alias("export_name"), "local", F.col("kind").alias("own_kind")).join(local, ["module_path", "local"])
    exports = named.join(symbols.select("symbol_id", "kind"), "symbol_id").select("export_name", F.when(F.col("own_kind") != "", F.col("own_kind")).otherwise(F.col("kind")).alias("kind"), "symbol_id")
    exports = exports.unionByName(unread.select(F.col("name").alias("export_name"), "kind", "symbol_id")).groupBy("export_name", "symbol_id").agg(F.min("kind").alias("kind"))
    typed = read.agg(F.coalesce(F.bool_or(F.col("rel_path").rlike("[.]tsx?$")), F.lit(False)).alias("typed"), F.count("*").alias("modules_scanned"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes_scanned"))
    confidence = typed.crossJoin(unread.agg(F.count("*").alias("fallbacks"))).select(F.when(F.col("typed") & (F.col("fallbacks") == 0), "authoritative").otherwise("partial").alias("confidence"), "modules_scanned", "bytes_scanned")
    return symbols, exports, confidence


def filtered(symbols: DataFrame, exports: DataFrame, kind: str = "all", most: int = MAX_SYMBOLS) -> tuple[DataFrame, DataFrame]:
    """Symbols of a kind (an unknown kind is all), the first ``most``, and their exports."""
    kept = symbols.where(F.col("kind") == kind) if kind in ("function", "class", "method", "type") else symbols
    kept = kept.orderBy(T.icu(F.col("fq_name")), T.icu(F.col("module_path")), "line_start").limit(most)
    return kept, exports.join(kept.select("symbol_id"), "symbol_id", "left_semi")


def examples(files: DataFrame, symbols: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """``symbol_id, source_path, line_start, line_end, code``: the first ``most``
    uses of each symbol in examples, tests and docs. In markdown a use is the fenced
    block around it, in code the lines near it."""
    places = files.where(F.col("rel_path").rlike(EXAMPLE_ROOTS) & F.col("rel_path").rlike(EXAMPLE_FILES)).select(F.col("rel_path").alias("source_path"), F.regexp_replace("content", "\r\n", "\n").alias("content"))
    called = F.concat("name", F.lit("("))
    named = symbols.select("symbol_id", "fq_name", "name")
    # either form has the name within a word of the file: files and names meet by words
    words = places.select("source_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[\\p{L}\\p{N}_$]+"), F.lit(0)))).alias("run"))
    met = words.join(lookups.runs_with(words.select("run"), named.select(F.col("name").alias("needle"))), "run").select("source_path", F.col("needle").alias("name")).distinct()
    hit = places.join(met, "source_path").join(named, "name").where(F.col("content").contains(F.col("fq_name")) | F.col("content").contains(called))
    hit = hit.withColumn("needle", F.when(F.col("content").contains(F.col("fq_name")), F.col("fq_name")).otherwise(called))
    lined = hit.withColumn("lines", F.split("content", "\n", -1))
    code = lined.where(~F.col("source_path").rlike("(?i)[.](md|markdown|mdx)$")).select("symbol_id", "source_path", "needle", "lines", F.posexplode("lines").alias("pos", "line")).where(F.col("line").contains(F.col("needle")))
    start, end = F.greatest(F.lit(1), F.col("pos") + 1 - AROUND), F.least(F.size("lines"), F.col("pos") + 1 + AROUND)
    near = code.select("symbol_id", "source_path", start.alias("line_start"), end.alias("line_end"), T.js_trim(F.array_join(F.slice("lines", start, end - start + 1), "\n")).alias("code"))
    md = lined.where(F.col("source_path").rlike("(?i)[.](md|markdown|mdx)$")).select("symbol_id", "source_path", "fq_name", called.alias("called"), F.posexplode("lines").alias("pos", "line"))
    by = Window.partitionBy("symbol_id", "source_path").orderBy("pos")
    md = md.withColumn("fence", T.js_trim(F.col("line")).startswith("```")).withColumn("n", F.sum(F.col("fence").cast("int")).over(by)).where("n % 2 = 1 or fence").withColumn("block", F.floor((F.col("n") + 1) / 2))
    blocks = md.groupBy("symbol_id", "source_path", "fq_name", "called", "block").agg((F.min("pos") + 1).alias("line_start"), (F.max("pos") + 1).alias("line_end"), F.count_if("fence").alias("fences"), T.js_trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("fence"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")).alias("code"))
    blocks = blocks.where((F.col("fences") == 2) & (F.col("code").contains(F.col("fq_name")) | F.col("code").contains(F.col("called")))).select(near.columns)
    every = near.unionByName(blocks).where("code <> ''").distinct()
    rank = F.row_number().over(Window.partitionBy("symbol_id").orderBy(T.icu(F.col("source_path")), "line_start"))
    return every.withColumn("position", rank).where(F.col("position") <= most)


def lookup(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols that match ``query`` in the best tier that has any: exact, prefix, then
    the share of the query's words in names, signatures and summary."""
    q = query.strip().lower()
    name, fq, sid = F.lower("name"), F.lower("fq_name"), F.lower("symbol_id")
    words = T.tokenize(F.concat_ws(" ", "name", "fq_name", F.array_join("signatures", " "), "summary"))
    asked = T.tokenize(F.lit(q))
    fuzzy = F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.filter(asked, lambda t: F.array_contains(words, t))) / F.size(asked))
    tier = F.when((name == q) | (fq == q) | sid.endswith(f"::{q}"), 1).when(fq.startswith(q) | fq.contains(f".{q}") | name.startswith(q), 2).otherwise(3)
    scored = symbols.where(F.lit(q != "")).withColumn("tier", tier).withColumn("match_score", F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.8).otherwise(fuzzy)).where("match_score > 0")
    best = scored.agg(F.min("tier").alias("tier"))
    return scored.join(F.broadcast(best), "tier").withColumn("match_type", F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("fuzzy")), F.col("tier"))).drop("tier")


def fn(symbols: DataFrame, query: str, library: str, version: str) -> DataFrame:
    """The one symbol that ``query`` names, with its citation; raises if there is none or several."""
    found = lookup(symbols, query)
    top = found.agg(F.max("match_score").alias("match_score"))
    best = found.join(F.broadcast(top), "match_score").orderBy(T.icu(F.concat_ws(":", "fq_name", "module_path", "line_start"))).limit(6).collect()
    if not best:
        raise EngineError("REF_NOT_FOUND", f"no symbol found for {query}", "list the surface")
    if len(best) > 1:
        raise EngineError("AMBIGUOUS_MATCH", f"ambiguous symbol query: {query}", f"one of {', '.join(r.fq_name for r in best[:5])}")
    return found.where(F.col("symbol_id") == best[0].symbol_id).withColumn("citation_id", F.format_string(f"{library}@{version}:symbol:%s:%s:%d-%d", "symbol_id", "module_path", "line_start", "line_end"))
