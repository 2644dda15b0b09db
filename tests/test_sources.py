import bz2
import gzip

import pytest

from quadloom.__main__ import main
from quadloom.graph import Graph
from quadloom.sources.rdf import QUADS, RdfDataSource, RdfSyntaxError, format_of, nquads, parse_document, read_rdf, write_nquads

TTL = '@prefix : <http://x/> . @base <http://b/> . <a> a :T ; :p "x\\n\\"y\\""@EN, """long "q" text""", 1.5, 2e3, true, "1"^^<http://www.w3.org/2001/XMLSchema#int> ; :l (1 _:b [ :q <#f> ]) .'
XML = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/" xml:base="http://b/">
<x:T rdf:about="a" x:attr="v" xml:lang="en"><x:p rdf:resource="c"/><x:q rdf:datatype="http://www.w3.org/2001/XMLSchema#int">5</x:q><x:r><rdf:Description rdf:nodeID="n"><x:s xml:lang="">t</x:s></rdf:Description></x:r>
<x:li rdf:parseType="Collection"><rdf:Description rdf:about="e"/></x:li></x:T></rdf:RDF>"""


def test_turtle_and_trig():
    rows = parse_document(TTL.encode(), "f.ttl")
    objects = [(o["k"], o["v"], o["dt"], o["lang"]) for s, p, o, g in rows if p == "http://x/p"]
    assert objects == [(2, 'x\n"y"', "rdf:langString", "en"), (2, 'long "q" text', "xsd:string", None), (2, "1.5", "xsd:decimal", None), (2, "2e3", "xsd:double", None), (2, "true", "xsd:boolean", None), (2, "1", "xsd:int", None)]
    assert len(rows) == 1 + 6 + 1 + 6 + 1 and any(o["v"] == "http://b/#f" for _, _, o, _ in rows)
    assert format_of("x/y.trig.gz") == "turtle" and format_of("a.csv") is None
    for bad in ("<a> <b> .", "x:y <b> <c> .", '<a> <b> "open .', "<a> <b> <c>"):
        with pytest.raises(RdfSyntaxError):
            parse_document(bad.encode(), "f.ttl")


def test_blank_nodes_are_scoped_by_file():
    one, two = (parse_document(b"_:a <http://x/p> _:a .", f) for f in ("a.ttl", "b.ttl"))
    assert one[0][0] == one[0][2] and one[0][0] != two[0][0]


def test_xml():
    rows = {(s["v"], p.rsplit("/", 1)[-1], o["v"], o["dt"], o["lang"]) for s, p, o, g in parse_document(XML.encode(), "f.rdf") if s["k"] == 1}
    assert ("http://b/a", "p", "http://b/c", None, None) in rows and ("http://b/a", "attr", "v", "rdf:langString", "en") in rows and ("http://b/a", "q", "5", "xsd:int", None) in rows
    with pytest.raises(RdfSyntaxError):
        parse_document(b"<rdf", "f.rdf")


def test_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<http://x/s> <http://x/p> 1 .")
    (tmp_path / "b.nt.gz").write_bytes(gzip.compress(b'<http://x/s> <http://x/p> "2" .\n# c\n\n_:b <http://x/p> "3"@en .\n'))
    (tmp_path / "c.nq").write_text("<http://x/s> <http://x/p> <http://x/o> <http://x/g> .\n")
    (tmp_path / "d.rdf.bz2").write_bytes(bz2.compress(XML.encode()))
    df = read_rdf(spark, str(tmp_path))
    assert df.schema == QUADS and df.count() == 1 + 2 + 1 + 9
    assert Graph(df).sparql("SELECT ?o {GRAPH ?g {?s ?p ?o}}").native().collect()[0].o == "http://x/o"
    spark.dataSource.register(RdfDataSource)
    assert spark.read.format("rdf").load(str(tmp_path)).count() == 13
    (tmp_path / "e.csv").write_text("a,b")
    (tmp_path / "f.nt").write_text("<http://x/s> <http://x/p> .\n<http://x/s> <http://x/p> <http://x/q> .\n")
    (tmp_path / "g.ttl").write_text("broken")
    with pytest.raises(RdfSyntaxError):
        read_rdf(spark, str(tmp_path)).count()
    assert read_rdf(spark, str(tmp_path), mode="PERMISSIVE").count() == 14
    with pytest.raises(Exception, match="columns"):
        read_rdf(spark, str(tmp_path / "f.nt")).count()


def test_round_trip(spark, tmp_path):
    t = lambda k, v, dt=None, lang=None: (k, v, dt, lang)
    rows = [(t(1, "http://x/s"), "http://x/p", t(2, 'q"\\\n\tü', "xsd:string"), None), (t(1, "http://x/s"), "http://x/p", t(2, "a", "rdf:langString", "en"), t(1, "http://x/g")), (t(1, "http://x/s"), "http://x/p", t(2, "1", "xsd:integer"), None), (t(1, "a:b"), "http://x/p", t(2, "x", "http://x/t"), None), (None, "http://x/p", None, None)]
    df = spark.createDataFrame(rows, QUADS)
    assert nquads(df).count() == 4
    write_nquads(df, str(tmp_path / "out"))
    back = read_rdf(spark, str(tmp_path / "out") + "/*.nq.gz")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.where("s IS NOT NULL").collect()))


def test_command_line(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<http://x/s> <http://x/p> 1 .")
    main(["--query", "SELECT ?o {?s ?p ?o}", "--in", str(tmp_path / "a.ttl"), "--out", str(tmp_path / "out")])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"o":{"value":"1","dataType":"http://www.w3.org/2001/XMLSchema#integer","language":null}}']


def test_entry(spark, small):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q) and {f"p{n}_found" for n in (1, 2, 4, 5)} <= set(q)
    for n, cols in {"p1_found": ["node", "root", "depth"], "p2_found": ["pos", "key_iri"], "p4_found": ["subj", "pred", "kind"], "p5_found": ["line_id", "reason"]}.items():
        df = q[n](spark, small)
        assert df.columns == cols and df.count() == df.distinct().count() > 0


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.nt").write_bytes(b'<a:b> <a:p> "\xff" .\n<a:b> <a:p> "7x"^^<http://www.w3.org/2001/XMLSchema#integer> .\r\n_:x <a:p> _:x .\n')
    with pytest.raises(Exception, match="quoting"):
        read_rdf(spark, str(tmp_path / "a.nt")).collect()
    rows = read_rdf(spark, str(tmp_path / "a.nt"), mode="PERMISSIVE").collect()
    assert sorted((r.s.k, r.o.k, r.o.dt) for r in rows) == [(0, 0, None), (1, 2, "xsd:integer")]
    blank = next(r for r in rows if r.s.k == 0)
    assert blank.s.v == blank.o.v != "x"
    spark.dataSource.register(RdfDataSource)
    assert spark.read.format("rdf").option("mode", "PERMISSIVE").load(str(tmp_path / "a.nt")).count() == 2
