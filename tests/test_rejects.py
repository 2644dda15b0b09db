import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.functions.xsd import valid
from quadloom.operators import rejects as R


def scan(path, line):
    """The reason by reading character by character; "ok" for a statement, None for a line that is skipped."""
    if line is None or not line.strip() or line.lstrip()[0] == "#":
        return None
    if not re.search(r"\.(nt|nq)(\.gz)?\Z", path or ""):
        return "unknown_format"
    i, toks = 0, []
    while i < len(line):
        ch = line[i]
        if ch in " \t":
            i += 1
        elif ch == "#":
            break
        elif ch == ".":
            toks.append((".",))
            i += 1
        elif ch == "<":
            j = line.find(">", i)
            if j < 0:
                return "quoting"
            toks.append(("I", line[i + 1 : j]))
            i = j + 1
        elif m := re.compile(r"_:([A-Za-z0-9]+)").match(line, i):
            toks.append(("B", m[1]))
            i = m.end()
        elif m := re.compile(r'"((?:[^"\\]|\\.)*)"', re.S).match(line, i):
            i, tag, dt = m.end(), None, None
            if line[i : i + 1] == "@":
                t = re.compile(r'@([^ \t.<"#]*)').match(line, i)
                tag, i = t[1], t.end()
            elif line[i : i + 1] == "^":
                t = re.compile(r"\^\^<([^>]*)>").match(line, i)
                if not t:
                    return "quoting"
                dt, i = t[1], t.end()
            toks.append(("L", m[1], tag, dt))
        else:
            return "quoting"
    terms = [x for x in toks if x[0] != "."]
    if len(toks) - len(terms) != 1 or toks[-1][0] != "." or len(terms) not in ((3, 4) if ".nq" in path[-6:] else (3,)):
        return "columns"
    for k, x in enumerate(terms):
        if x[0] == "I" and not R._iri_ok(x[1]) or x[0] == "B" and k == 1 or x[0] == "L" and k != 2:
            return "value"
        if x[0] == "L":
            text = R.unescape(x[1])
            if text is None or (x[2] is not None and not re.fullmatch("[A-Za-z]+(-[A-Za-z0-9]+)*", x[2])):
                return "value"
            if x[3] is not None and (not R._iri_ok(x[3]) or (x[3].startswith("xsd:") and not valid(x[3][4:], text))):
                return "value"
    return "ok"


def reasons(paths, lines):
    return [None if s == "skipped" else "ok" if s == "valid" else r for s, r, _ in R.parse_lines(paths, [None if x is None else x.encode() for x in lines])]


GOOD = [
    '<http://a/b> <http://a/p> "x \\"y\\" <z> # \\\\"@en-GB <http://g/1> . # note', '_:a1\t<http://a/p>\t"5"^^<xsd:integer>\t.', '<a:b><a:p>"v".', '<a:b> <a:p> _:b.', '<a:"b> <a:p> <a:c> .', '<a:b> <a:p> "é\\u00e9\\U0001F600" .',
    '<a:b> <a:p> "x"@en\t<a:g> .', '<a:b> <a:p> "x"@ .', '<a:b> <a:p> "2024-13-01"^^<xsd:date> .', '"s" <a:p> <a:o> .', '<a:b> <a:p> "\\q" .', "<a:b> <a:p> .", "<a:b> <a:p> <a:c> <a:d> <a:e> .", "<a:b> <a:p> <a:c>", "<a:b> <a:p> <a:c> ..", '<a:b> <a:p> "open .',
    "# comment", "", "   ", None, "\t# x", "<b> <a:p> <a:c> .", '<a:b> <a:p> "x"^<a:c> .', '<a:b> <a:p> "x"^^xsd:int .', "_: <a:p> <a:c> .", "<a:b> <a:p> <a:c> . trailing",
]


def test_known_lines_and_random_damage():
    rnd = random.Random(7)
    lines = list(GOOD)
    base = [x for x in GOOD if x]
    for _ in range(6000):
        s = list(rnd.choice(base))
        for _ in range(rnd.randrange(1, 4)):
            i, c = rnd.randrange(len(s) or 1), rnd.choice('"\\<>.#@^_: \té{a1\r')
            if rnd.random() < 0.5:
                s.insert(i, c)
            elif s:
                s[min(i, len(s) - 1)] = c
        lines.append("".join(s))
    paths = [rnd.choice(["a.nt", "x/b.nq", "c.nq.gz", "d.nt.gz", "e.csv", "f.nt.bak", None]) for _ in lines]
    assert reasons(paths, lines) == [scan(p, x) for p, x in zip(paths, lines)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='"\\<>.#@^_: \tab1-', max_size=40), max_size=5))
def test_any_text(lines):
    assert reasons(["a.nq"] * len(lines), lines) == [scan("a.nq", x) for x in lines]


def test_slices_of_long_lines(monkeypatch):
    monkeypatch.setattr(R, "SLICE_BYTES", 50)
    lines = GOOD + ['<a:b> <a:p> "' + "x" * 5000 + '" .', "<a:b> " * 3000]
    assert reasons(["a.nq"] * len(lines), lines) == [scan("a.nq", x) for x in lines]


def test_bytes_that_are_no_text(spark):
    good, bad = b"<a:b> <a:p> <a:c> .", b'<a:b> <a:p> "\xff" .'
    lines = [good, bad, b"\xc2", b" \xc2\xa0# c", b"\xc2\xa0", good, b"# \xff"]
    got = [(s, r) for s, r, _ in R.parse_lines(["a.nq"] * 6 + ["a.nt"], lines)]
    assert got == [("valid", None), ("rejected", "quoting"), ("rejected", "quoting"), ("skipped", None), ("skipped", None), ("valid", None), ("skipped", None)]
    assert R.parse_lines(["a.csv"], [bad])[0][:2] == ("rejected", "unknown_format")
    df = spark.createDataFrame([(1, "a.nt", 1, bytearray(bad)), (2, "a.nt", 2, bytearray(good))], "line_id long, path string, line_no int, line binary").selectExpr("line_id", "path", "line_no", "cast(line AS string) AS line")
    assert sorted((r.line_id, r.reason) for r in R.load_lines(df).select("line_id", "reason").collect()) == [(1, "quoting"), (2, None)]


def test_hostile_lines_take_linear_time():
    import time

    big = [b"." * 4_000_000, b"<a:b> " * 700_000, b'"x" ' * 1_000_000, b"_:a" * 1_000_000, b"\\" * 4_000_000, b'"' + b"\\" * 4_000_000, b". " * 1_000_000 + b'"', b'<a:b> <a:p> "' + b"\\u0041" * 600_000 + b'" .']
    for line, want in zip(big, ["columns", "columns", "columns", "columns", "quoting", "quoting", "quoting", None]):
        t = time.process_time()
        assert R.parse_lines(["a.nt"], [line])[0][1] == want
        assert time.process_time() - t < 5, line[:10]


def test_table(spark):
    rows = [(i, "a.nq", i, x, "extra", 1) for i, x in enumerate(GOOD)] + [(None, None, None, "<a:b> <a:p> <a:c> .", "e", 1), (99, "z.ttl", 1, None, "e", 1)]
    df = spark.createDataFrame(rows, "line_id long, path string, line_no int, line string, status string, s int")
    got = R.load_lines(df).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.line_id == 0)
    assert one.status == "valid" and one.o.v == 'x "y" <z> # \\' and one.o.lang == "en-gb" and one.g.v == "http://g/1" and one.p == "http://a/p"
    assert [r.reason for r in got if r.line_id is None] == ["unknown_format"] and [r.status for r in got if r.line_id == 99] == ["skipped"]
    assert R.load_lines(df.limit(0)).count() == 0
