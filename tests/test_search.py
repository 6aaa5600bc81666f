import pytest

from siftwell.operators import search as S
from siftwell.operators.postings import postings
from siftwell.plans import grammar

DEFS = [("getUserName", "a.ts", 1), ("user_name", "b.py", 2), ("user_name", "c.py", 2), ("user", "d.ts", 3), ("superuserdo", "e.ts", 4), ("authenticate", "f.ts", 5), ("x.user", "g.ts", 6), ("powerUser", "h.ts", 7)]


@pytest.fixture(scope="module")
def definitions(spark):
    rows = [(i, t, "function", f, n) for i, (t, f, n) in enumerate(DEFS)]
    return spark.createDataFrame(rows, "entry_seq long, term string, type string, file string, line int")


@pytest.fixture(scope="module")
def refs(spark):
    rows = [(i, "user", "call", f"r{i % 3}.ts", i) for i in range(5)] + [(9, "getUserName", "import", "z.ts", 1)]
    return spark.createDataFrame(rows, "ref_seq long, target_term string, reference_type string, file string, line int")


@pytest.fixture(scope="module")
def index(definitions):
    return postings(definitions).persist()


def found(df):
    return [(r["term"], r["file"], round(r["score"], 4)) for r in df.orderBy("rank").collect()]


def test_ranked_search_golden(index):
    want = [("user_name", "b.py", 1.0), ("user", "d.ts", 1.0), ("user_name", "c.py", 0.85), ("x.user", "g.ts", 0.8), ("powerUser", "h.ts", 0.8), ("getUserName", "a.ts", 0.75), ("superuserdo", "e.ts", 0.2182)]
    assert found(S.ranked(index, "user")) == want
    assert found(S.ranked(index, "USER")) == want


def test_other_goldens(index):
    assert found(S.ranked(index, "name")) == [("user_name", "b.py", 1.0), ("getUserName", "a.ts", 0.8), ("user_name", "c.py", 0.8)]
    assert found(S.ranked(index, "auth")) == [("authenticate", "f.ts", 0.85)]
    assert found(S.ranked(index, "user", S.Options(exact=True))) == [("user_name", "b.py", 1.0), ("user", "d.ts", 1.0)]
    assert [x[2] for x in found(S.ranked(index, "ser"))] == [0.8, 0.8, 0.8, 0.8, 0.2, 0.1636, 0.1636]
    assert [x[:2] for x in found(S.ranked(index, ""))] == [d[:2] for d in DEFS]


def test_camel_option_splits_at_case(definitions):
    keys = {r["key"] for r in postings(definitions, camel=True).collect()}
    assert {"power", "get", "user", "name"} <= keys


def test_usage_and_samples(index, refs):
    rows = {r["term"]: r for r in S.search(index, refs, "user").collect()}
    assert rows["user"]["usage_count"] == 5 and [x["ref_seq"] for x in rows["user"]["sample_usages"]] == [0, 1, 2]
    assert rows["x.user"]["usage_count"] == 0 and rows["x.user"]["sample_usages"] == []


def test_boolean_forms(index):
    user = set(found(S.ranked(index, "user")))
    both = set(found(S.all_of(index, ["user", "name"])))
    assert both <= user and {b[0] for b in both} == {"user_name", "getUserName"}
    none = S.none_of(index, "user").collect()
    assert [r["term"] for r in none] == ["authenticate"]
    either = S.any_of(index, ["auth", "name"]).orderBy("rank").collect()
    assert [r["term"] for r in either] == ["authenticate", "user_name", "getUserName", "user_name"]
    assert {r["term"] for r in S.matching(index, "^(user|x)").collect()} == {"user_name", "user", "x.user"}
    assert S.matching(index, "(").count() == 0


def test_options_filter(index):
    assert {r["file"] for r in S.ranked(index, "user", S.Options(files=("*.py",))).collect()} == {"b.py", "c.py"}
    assert S.ranked(index, "user", S.Options(types=("class",))).count() == 0
    assert S.ranked(index, "user", S.Options(limit=2)).count() == 2


@pytest.mark.parametrize(
    ("text", "kind", "terms"),
    [("a b", "words", ("a", "b")), ("a|b", "or", ("a", "b")), ("a & b", "and", ("a", "b")), ("!a", "not", ("a",)), ("/a+/", "regex", ("a+",)), ("/a|b/", "regex", ("a|b",)), ("a", "fuzzy", ("a",))],
)
def test_grammar(text, kind, terms):
    assert grammar.parse(text) == grammar.Node(kind, terms)


def test_smart_split(spark):
    from pyspark.sql import functions as F

    cases = {"getUserName": "get user name", "user_name-x": "user name", "a.b.config": "config", "HTTPServer": "httpserver", "foo.ts": "foo.ts", "parseXMLFile": "parse xmlfile"}
    for term, parts in cases.items():
        assert grammar.smart_split(term) == parts.split()
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", grammar.smart_split_column(F.col("t")).alias("p")).collect()
    assert {r["t"]: " ".join(r["p"]) for r in rows} == cases


def test_fallbacks(index, refs):
    assert [r["term"] for r in grammar.run("zzz_authenticate", index, refs).collect()] == ["authenticate"]
    assert [r["term"] for r in grammar.run("nothing name", index, refs).collect()] == ["user_name", "getUserName", "user_name"]


def test_command_line():
    query, got = grammar.command_line("user --type function,class --max 7 --sort usage --compact")
    assert query == "user" and got["options"] == S.Options(("function", "class"), (), 7) and got["sort"] == "usage" and got["form"] == "compact"


def model(defs, query, limit=100, exact=False):
    """The search contract in plain Python."""
    from siftwell.functions.groups import BOUNDARY_PREFIXES, variations

    index = {}
    for n, (term, file, line) in enumerate(defs):
        key = term.lower()
        index.setdefault(key, []).append((term, file, line))
        for p in dict.fromkeys(key.split("_") + key.split("-")):
            if len(p) > 2 and p != key and not any(t == term and x == line for t, _, x in index.setdefault(p, [])):
                index[p].append((term, file, line))
    q, out = query.lower(), []
    if not q:
        out = [(0.5, e) for rows in index.values() for e in rows]
    elif exact:
        out = [(1.0, e) for e in index.get(q, [])]
    else:
        out += [(1.0, e) for e in index.get(q, [])]
        middle, last = [], []
        for k, rows in index.items():
            if k == q:
                continue
            parts = [p for s in ("_-", "./") for p in __import__("re").split(f"[{s}]", k)]
            near = any(p.startswith(q) for p in parts) or any(k.startswith(p + q) for p in BOUNDARY_PREFIXES)
            score = 0.85 if k.startswith(q) else 0.8 if k.endswith(q) else 0.75 if near else None
            if score:
                middle += [(score, e) for e in rows]
            elif q in k:
                last += [(0.6 * len(q) / len(k), e) for e in rows]
        out += middle + last
        for w in variations(q):
            out += [(0.5, e) for k, rows in index.items() if w in k for e in rows]
    seen, kept = set(), []
    for score, e in out:
        if e not in seen:
            seen.add(e)
            kept.append((score, e))
    kept.sort(key=lambda x: -x[0])
    return [(t, f, round(s, 4)) for s, (t, f, _) in kept[:limit]]


@pytest.mark.parametrize("seed", range(4))
def test_random_indexes_match_the_contract(spark, seed):
    import random

    rng = random.Random(seed)
    words = "user auth get config error request db is-set handler user_name x.y repo util".split()
    defs = [("".join(rng.choice([w, w.title(), w + "_", "-" + w]) for w in rng.sample(words, rng.randint(1, 3))), f"f{rng.randrange(4)}", rng.randrange(5)) for _ in range(60)]
    rows = [(i, t, "function", f, n) for i, (t, f, n) in enumerate(defs)]
    index = postings(spark.createDataFrame(rows, "entry_seq long, term string, type string, file string, line int")).persist()
    for q in ["user", "auth", "con", "Re", "", "name", "zz"]:
        assert found(S.ranked(index, q)) == model(defs, q)
    assert found(S.ranked(index, "user", S.Options(exact=True, limit=5))) == model(defs, "user", 5, True)
    keys = [(r["file"], r["line"], r["term"]) for r in S.ranked(index, "e").collect()]
    assert len(keys) == len(set(keys)) and all(0 < s <= 1 for *_, s in found(S.ranked(index, "e")))


def test_suggestions(index, refs):
    from siftwell.operators.reports import suggestions

    assert suggestions("user", S.search(index, refs, "user")) == ["search user --file b.py", "search user --exact"]
    assert suggestions("nothinglikeit", S.search(index, refs, "nothinglikeit")) == ["search nothing", "search --regex nothinglikeit", "group list"]
