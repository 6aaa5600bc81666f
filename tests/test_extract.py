import json
import pathlib
import re

import pytest

from siftwell.extract import typescript
from siftwell.extract.registry import extract_file

from .conftest import ROOT

_TEXT = pathlib.Path(ROOT, "FIXTURES.md").read_text()
_PART = _TEXT[_TEXT.index("### 2.2") : _TEXT.index("### 2.3")]
GOLDENS = {m[0]: (json.loads(m[1]), json.loads(m[2])) for m in re.findall(r"\*\*`([^`]+)`\*\* — input.*?```json\n(.*?)\n```\n```json\n(.*?)\n```", _PART, re.S)}
#: What our rules add to, and take from, the captured rows, by intent.
CHANGED = {
    "m.py": ([["TODO: fix this thing", "comment", 1, 0]], []),
    "m.go": ([["TODO fix me please", "comment", 5, 0]], [["Any", "implements", 15, 0]]),
    "m.swift": ([["A.name", "constant", 3, 0], ["A.go", "function", 4, 0], ["A comment here", "comment", 6, 0]], [["name", "constant", 3, 0], ["go", "function", 4, 0]]),
    "m.rs": ([["TODO fix", "comment", 1, 0]], []),
    ".github/workflows/ci.yml": ([["build", "function", 3, 0], ["actions/checkout@v4", "import", 6, 0], ["actions/checkout@v4", "string", 6, 14], ["actions/checkout", "import", 6, 0]], [["jobs", "function", 2, 0], ["uses: actions/checkout@v4", "string", 6, 6]]),
    "docker-compose.yml": ([["web", "class", 2, 0], ["80:80", "constant", 5, 6]], [["services", "class", 1, 0]]),
    "c.json": ([["url", "constant", 1, 0], ["http://x.com/a", "string", 1, 0], ["n", "constant", 1, 0]], [["http://x.com/a", "string", 1, 7]]),
    "d.sh": ([["./lib.sh", "import", 7, 0], ["./lib.sh", "import", 7, 0]], []),
}


def flat(path, content):
    r = extract_file(path, content)
    return [[d["term"], d["type"], d["line"], d["column"]] for d in r.definitions] + [[x["target_term"], x["reference_type"], x["line"], x["column"]] for x in r.references]


@pytest.mark.parametrize("path", sorted(GOLDENS))
def test_golden(path):
    content, want = GOLDENS[path]
    more, less = CHANGED.get(path, ([], []))
    key = lambda rows: sorted(map(json.dumps, rows))
    assert key(flat(path, content) + less) == key(want["definitions"] + want["references"] + more)


TS = """import def, { a, b as c } from './m'
// TODO: rename this
export class Cart extends Base implements Saved {
  private items: Item[] = []
  async add(item: Item): Promise<void> {
    this.items.push(item)
    await save(`/cart/${item.id}/x`)
  }
}
export interface Item { id: string }
type Pair<T> = [T, T]
const twice = (x: number) => x * 2
let plain = 3, text = "a longer text here"
export { twice as double }
function main() { const c = new Cart(); c.add(make()); foo.bar.baz() }
const o = { run(a) { return a }, re: /"[/]"/g }
"""


def test_typescript():
    rows = flat("x.ts", TS)
    has = lambda *x: any(r[: len(x)] == list(x) for r in rows)
    for term, kind in [("def", "import"), ("a", "import"), ("c", "import"), ("Cart", "class"), ("Item", "class"), ("Pair", "class"), ("Cart.add", "function"), ("twice", "function"), ("plain", "variable"), ("double", "variable"), ("main", "function"), ("run", "function"), ("TODO: rename this", "comment"), ("/cart/${...}/x", "string"), ("a longer text here", "string")]:
        assert has(term, kind), (term, kind, rows)
    for target, kind in [("Base", "extends"), ("Saved", "implements"), ("Cart", "instantiation"), ("c.add", "call"), ("make", "call"), ("baz", "call"), ("save", "call")]:
        assert has(target, kind), (target, kind, rows)
    assert not has("if", "call")


def test_typescript_that_does_not_parse():
    r = typescript.extract("function ok() { ((\nclass Half {\n// a comment here\n", "x.js")
    assert [(d["term"], d["type"]) for d in r.definitions] == [("ok", "function"), ("Half", "class"), ("a comment here", "comment")]
    assert not r.references


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("my-card.svelte", "<script>\nlet n = $state(0)\nonMount(() => 1)\n</script>\n<Big on:click={go}>{n}</Big>\n{#if n}x{/if}\n<style>\n.box { --gap: 1px; }\n</style>", [["MyCard", "class", 1], ["$state", "function", 2], ["onMount", "svelte-lifecycle", 3], ["Big", "instantiation", 5], ["n", "variable", 5], ["{#if}", "function", 6], [".box", "string", 8], ["--gap", "variable", 8]]),
        ("a.vue", '<script setup>\nconst p = defineProps()\nconst r = ref(1)\n</script>\n<template>\n<p v-if="x" @click="go">{{ msg }}</p>\n<input v-model="name">\n</template>', [["A", "class", 1], ["defineProps", "function", 2], ["ref", "vue-composition-api", 3], ["msg", "variable", 6], ["click", "event-handler", 6], ["name", "variable", 7]]),
        ("b.astro", "---\ninterface Props { a: string }\nconst { a } = Astro.props\n---\n<Card client:load {...rest} />", [["Props", "interface", 2], ["Astro.props", "astro-global", 3], ["Card", "instantiation", 5], ["client:load", "function", 5], ["rest", "props-spread", 5]]),
        ("c.mdx", "import X from './x'\n\n# Title\n<X />\n", [["X", "import", 1], ["X", "instantiation", 4]]),
    ],
)
def test_components(path, content, want):
    rows = [r[:3] for r in flat(path, content)]
    for w in want:
        assert w in rows, (w, rows)


def test_go_import_block_and_embedding():
    rows = flat("a.go", 'package p\nimport (\n\t"fmt"\n\tm "x/y/mux"\n)\ntype S struct {\n\tBase\n\tName string\n}\nvar Z = 1\n')
    for w in (["fmt", "import", 3, 0], ["mux", "import", 4, 0], ["Base", "extends", 7, 0], ["S.Name", "variable", 8, 0], ["Z", "variable", 10, 0]):
        assert w in rows


def test_rust_doc_at_end_and_yaml_block_at_end():
    assert ["ends here at last", "comment", 2, 0] in flat("a.rs", "fn f() {}\n/// ends here at last")
    assert ["one\ntwo words", "string", 1, 0] in flat("a.yaml", "description: |\n  one\n  two words")


def test_files_to_tables(spark):
    from siftwell.extract import registry

    files = spark.createDataFrame([("m.py", GOLDENS["m.py"][0]), ("x.bin", "zzz"), ("n.py", None)], "path string, content string")
    tagged = registry.extracted(files).persist()
    d, r = registry.definitions(tagged), registry.references(tagged)
    assert d.count() == 12 and r.count() == 10 and registry.errors(tagged).count() == 0
    assert d.select("entry_seq").distinct().count() == 12
    terms = [x["term"] for x in d.orderBy("entry_seq").collect()]
    assert terms[:3] == ["TODO: fix this thing", "os", "system"]


def test_table_functions_in_sql(spark):
    from siftwell.extract import registry

    registry.register(spark)
    spark.createDataFrame([("a.py", "class A(B):\n    pass\n"), ("b.zzz", "x"), ("c.py", None)], "path string, content string").createOrReplaceTempView("sources")
    d = spark.sql("SELECT s.path, d.term, d.type FROM sources s, LATERAL extract_definitions(s.path, s.content) d").collect()
    r = spark.sql("SELECT r.target_term, r.reference_type FROM sources s, LATERAL extract_references(s.path, s.content) r").collect()
    assert [tuple(x) for x in d] == [("a.py", "A", "class")] and ("B", "extends") in [tuple(x) for x in r]


def test_transformed_leaves_failures_out(spark):
    from siftwell.extract import registry

    files = spark.createDataFrame([("a", "1"), ("b", "x")], "path string, content string")
    assert [tuple(r) for r in registry.transformed(files, lambda p, c: str(int(c) + 1)).collect()] == [("a", "2")]
