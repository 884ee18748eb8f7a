from verbatrix.index import Index
from verbatrix.operators import markdown

DOC = """lost before the first heading
# Start here

Install the tool. It must be new. Then go.
- Run it
continued line

```bash
tool --go
# inside a fence
```
# Start here
See [more](#start-here), [out](https://a.b) and `npm test --all`.
```
never closed
after it
# !!!
"""


def build(spark, *docs):
    files = spark.createDataFrame([(f"d{i}.md" if isinstance(d, str) or d is None else d[0], d if isinstance(d, str) or d is None else d[1]) for i, d in enumerate(docs)], "rel_path string, content string")
    return Index.of(files, "lib", "1")


def test_sections_keep_the_quirks(spark):
    rows = build(spark, DOC).sections.orderBy("line_start").collect()
    assert [(r.anchor, r.line_start, r.line_end) for r in rows] == [("start-here", 2, 9), ("inside-a-fence", 10, 11), ("start-here-1", 12, 16), ("section", 17, 18)]
    assert rows[0].code_blocks == [] and "lost" not in rows[0].text


def test_units(spark):
    units = build(spark, DOC).units.orderBy("line_start", "text").collect()
    got = [(u.line_start, u.line_end, u.type, u.text) for u in units]
    assert got == [
        (4, 4, "step", "Install the tool. It must be new."), (4, 4, "fact", "Then go."), (5, 5, "step", "Run it"), (6, 6, "fact", "continued line"),
        (13, 13, "fact", "See start-here, https://a.b and npm test --all ."), (13, 13, "command", "npm test --all"),
    ]


def test_no_heading_loses_the_first_line(spark):
    ix = build(spark, "only line", "first\nsecond line", "", None)
    assert {(r.doc_id, r.anchor) for r in ix.sections.collect()} == {("d0", "document"), ("d1", "document"), ("d2", "document")}
    assert [(u.doc_id, u.text, u.line_start) for u in ix.units.collect()] == [("d1", "second line", 2)]


def test_repeated_units_count_once_and_ids_are_stable(spark):
    twice = build(spark, "# a\nsame text\n\nsame text\n")
    assert twice.units.count() == 2
    again = build(spark, "# a\n`npm x y` and `npm x y`\n")
    assert sorted(u.type for u in again.units.collect()) == ["command", "fact"]
    assert {u.unit_id for u in twice.units.collect()} == {u.unit_id for u in Index.of(spark.createDataFrame([("d0.md", "# a\nsame text\n\nsame text\n")], "rel_path string, content string").repartition(3), "lib", "1").units.collect()}


def test_source_hash_ignores_order(spark):
    rows = [("b.md", "x"), ("a.md", "y")]
    one, two = (markdown.source_hash(spark.createDataFrame(r, "rel_path string, content string")).first()[0] for r in (rows, rows[::-1]))
    assert one == two and one.startswith("sha256:")


def test_empty_corpus(spark):
    ix = Index.of(spark.createDataFrame([], "rel_path string, content string"))
    assert ix.sections.count() == ix.units.count() == ix.graph.count() == 0
    assert ix.stats().first().sections_per_doc == 0.0


def test_files_with_one_document_id_are_parsed_apart(spark):
    ix = build(spark, ("guide/index.md", "# B\ntwo\n\nsame line."), ("guide.md", "# A\none\n\nsame line.\n# A\nmore"))
    rows = ix.sections.orderBy("source_path", "line_start").collect()
    assert [(r.source_path, r.doc_id, r.anchor, r.line_start, r.line_end, r.text) for r in rows] == [
        ("guide.md", "guide", "a", 1, 4, "one same line."), ("guide.md", "guide", "a-1", 5, 6, "more"), ("guide/index.md", "guide", "b", 1, 4, "two same line.")]
    near = {(r.src_ref, r.dst_ref, r.kind) for r in ix.graph.where("kind < 2").collect()}
    assert near == {("guide#a", "guide#b", 1), ("guide#b", "guide#a", 0), ("guide#b", "guide#a-1", 1), ("guide#a-1", "guide#b", 0)}
    assert {(r.source_path, r.sections) for r in ix.list_docs().collect()} == {("guide.md", 3), ("guide/index.md", 3)}


def test_files_are_parsed_in_one_pass(spark):
    """Lines aren't rows that are sorted and grouped: beyond the files' own exchange only the choice among equal units needs one."""
    files = spark.createDataFrame([("a.md", DOC)], "rel_path string, content string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for table in (markdown.prose_blocks(files), markdown.windows(files), markdown.code_blocks(files), markdown.sections(files)):
        assert not any(x in plan(table) for x in ("Window", "Aggregate", "Generate", "Join"))
    assert plan(markdown.units(files)).count("Window ") == 1
    odd = "# T\n- a\n b\u0085c. d\n　```\nx\n```\n`npm  --a`\n"
    assert [(r.line_start, r.line_end, r.is_step, r.text) for r in markdown.prose_blocks(spark.createDataFrame([("a.md", odd)], "rel_path string, content string")).orderBy("line_start").collect()] == [(2, 2, True, "a"), (3, 3, False, "b\u0085c. d"), (7, 7, False, "`npm  --a`")]
