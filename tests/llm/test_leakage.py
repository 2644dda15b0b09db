import json
import random

import pandas as pd
import pytest

from quadloom.llm import leakage as L

rnd = random.Random(11)
VOCAB = [f"w{i}" for i in range(400)] + ["Fährmann", "çedilla", "Straße", "STRASSE", "naïve", "x1", "42"]


def sentence(n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


ITEMS = [(i, sentence(rnd.randrange(12, 60))) for i in range(30)] + [(100, sentence(11)), (101, None), (102, ""), (103, "")]


def part(text, n):
    ws = text.split()
    at = rnd.randrange(len(ws) - n + 1)
    return " ".join(ws[at : at + n])


def disguise(text, how):
    if how == "upper":
        return text.upper()
    if how == "html":
        return "<p>" + "<br/> ".join(text.split()) + "</p>".replace("ä", "&auml;")
    if how == "entity":
        return "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in text)
    if how == "tags":
        return f"&lt;b&gt;{text}&lt;/b&gt; <i class='x'>"
    for _ in range({"json": 1, "json2": 2, "json3": 3}.get(how, 0)):
        text = json.dumps({"source": [text + "\n"]})
    if how == "lines":
        text = "# " + "\n#   ".join(text.split())
    return text


HOWS = ["plain", "upper", "html", "entity", "tags", "json", "json2", "json3", "lines"]


def test_every_disguise_and_length_against_brute_force(spark):
    docs = []
    for i in range(300):
        item = ITEMS[rnd.randrange(30)][1]
        n = rnd.choice([11, 12, 12, 13, len(item.split())])
        docs.append((i, sentence(rnd.randrange(0, 80)) + " . " + disguise(part(item, min(n, len(item.split()))), HOWS[i % len(HOWS)]) + " ! " + sentence(rnd.randrange(0, 80))))
    docs += [(1000, None), (1001, ""), (1002, "short"), (1003, docs[0][1]), (None, ITEMS[0][1])]
    want = L.brute_force(pd.DataFrame([d for d in docs if d[0] is not None], columns=["doc_id", "text"]), pd.DataFrame(ITEMS, columns=["item_id", "text"]))
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, item_id long")
    it = spark.createDataFrame([(*x, 5) for x in ITEMS] * 2, "item_id long, text string, doc_id long")
    got = {(r.item_id, r.doc_id) for r in L.find_leaks(d, it).collect()}
    assert (0, None) in got
    assert {x for x in got if x[1] is not None} == want and len(want) > 150
    assert L.find_leaks(d.limit(0), it).count() == 0 and L.find_leaks(d, it.limit(0)).count() == 0


def test_planted_disguises_are_found():
    index = L.Index([(1, L.words("Der Fährmann wog am Abend 85 kühle Geigen bevor die rostige Uhr kam"))])
    text = "Der Fährmann wog am Abend 85 kühle Geigen bevor die rostige Uhr kam"
    for how in HOWS:
        assert index.search(L.words("xx " + disguise(text, how) + " yy")) == {1}, how
    assert index.search(L.words("Der Fährmann WOG am Abend 85 kühle<br>Geigen bevor\\u0020die\\\\nrostige Uhr kam")) == {1}
    assert index.search(L.words("Der Fährmann wog am Abend 86 kühle Geigen bevor die rostige Uhr kam")) == set()
    assert L.words("\\ud83d\\ude00 a\\u00e9b") == ["aeb"] and L.words(None) == []


def test_hostile_texts_take_linear_time():
    import time

    for text in ("\\" * 200_000 + "q", "<!--" * 100_000, "<a " * 100_000, "&#" + "9" * 100_000 + ";", "&amp;" * 100_000, "a\u0301" * 100_000, "\\u005c" * 50_000):
        t = time.process_time()
        L.words(text)
        assert time.process_time() - t < 5, text[:10]
    assert L.words("a<!-- b -->c<!-- d") == ["a", "c", "d"]


def test_long_documents_are_searched_in_blocks(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 20)
    item = [f"k{i}" for i in range(14)]
    index = L.Index([(1, item)])
    for at in range(0, 70):
        ws = ["z"] * at + item[:12] + ["z"] * (80 - at)
        assert index.search(ws) == {1}
        assert index.search(ws[: at + 11]) == set()


def test_passes_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(i, x[1]) for i, x in enumerate(ITEMS)], "doc_id long, text string")
    it = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = {tuple(r) for r in L.find_leaks(d, it).collect()}
    monkeypatch.setattr(L, "PASS_CHARS", 2000)
    assert {tuple(r) for r in L.find_leaks(d, it).collect()} == one and len(one) == 30


def nested(text, depth, how):
    for _ in range(depth):
        text = text.replace("&", "&amp;") if how == "html" else json.dumps(text)[1:-1] if how == "json" else text.replace("&", "\\u0026").replace("\\", "&#92;")
    return text


@pytest.mark.parametrize("how", ["html", "json", "mixed"])
@pytest.mark.parametrize("depth", [1, 7, 8, 9, 12])
def test_any_nesting_is_resolved(how, depth):
    text = "der rote Kahn l&auml;g im Hafen bevor die zehn Glocken laut riefen" if how != "json" else 'der rote Kahn l\u00e4g im "Hafen"\nbevor die zehn Glocken laut riefen'
    want = L.words("der rote Kahn läg im Hafen bevor die zehn Glocken laut riefen")
    assert L.words(nested(text, depth, how)) == want


def test_deep_nesting():
    item = "der rote Kahn l&eacute;g im Hafen bevor die zehn Glocken laut riefen"
    for depth in (8, 9, 30, 300):
        assert L.words(nested(item, depth, "html")) == L.words(item.replace("&eacute;", "é"))
    assert L.words("a " + "&amp;" * 9 + "\\u005cu005cu0061 &#0000000000000097;b") == ["a", "a", "ab"]
    assert L.words("x&amp" + ";lt;b>y") == ["x", "y"] and L.unescaped("a &b AT&T & \\q") == "a &b AT&T & \\q"


def test_deep_nesting_takes_linear_time():
    import time

    for text in ("&" + "amp;" * 100_000, "\\" + "u005c" * 60_000, "\\u0026" + "#92;u0026" * 30_000, "&amp;" * 100_000 + "u005c" * 50_000):
        t = time.process_time()
        L.unescaped(text)
        assert time.process_time() - t < 20, text[:10]


def test_size_partitions_and_containment(spark):
    item = [f"k{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:12])), (3, "a " * 40), (4, " ".join(item[:11]))], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x " + " ".join(item[:12]) + " y " + " ".join(item[20:34])), (11, " ".join(item)), (12, "a " * 500), (13, " ".join(item[:11] + item[12:23]))], "doc_id long, text string")
    bands = {(r.item_id, r.part, r.n_shingles) for r in L.item_bands(items).collect()}
    assert bands == {(1, 2, 56), (2, 0, 8), (3, 2, 36)}
    got = {(r.item_id, r.doc_id): (r.n_shared, round(r.containment, 6)) for r in L.containments(docs, items).collect()}
    assert got == {(1, 10): (18, round(18 / 56, 6)), (2, 10): (8, 1.0), (1, 11): (56, 1.0), (2, 11): (8, 1.0), (3, 12): (36, 1.0)}


def test_full_filter_changes_nothing(spark, monkeypatch):
    d = spark.createDataFrame([(i, x[1]) for i, x in enumerate(ITEMS)], "doc_id long, text string")
    it = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = {tuple(r) for r in L.find_leaks(d, it).collect()}
    monkeypatch.setattr(L, "band_filter", lambda bands: __import__("numpy").full(1 << (L.FILTER - 6), 2**64 - 1, dtype="uint64"))
    assert {tuple(r) for r in L.find_leaks(d, it).collect()} == one and len(one) == 30


@pytest.mark.parametrize("n", [0, 11, 12, 40])
def test_window_minima_are_equal_for_equal_windows(n):
    import numpy as np

    a = np.arange(1, n + 1, dtype=np.uint32)
    low = L.window_minima(a)
    assert len(low) == max(n - 11, 0) and all(low[i] == L.window_minima(a[i : i + 12])[0] for i in range(len(low)))


def test_words_between_signs_of_code_are_kept():
    item = "der rote Kahn lag im Hafen bevor die zehn Glocken laut riefen"
    index = L.Index([(1, L.words(item))])
    assert index.search(L.words(f"while i<n: # {item}\n  f = x -> y")) == {1}
    assert index.search(L.words(f"if a<b {item} >>> c")) == {1}
    for tag in ("<br>", "<br/>", "</p>", "<x-y>", "<input checked>", "<hr\nclass=wide id = 'a b'>", '<img src="a.png" alt="two words" />', "<td data-x nowrap>", "<a href=http://a.example/b/>"):
        assert index.search(L.words(item.replace(" ", f" {tag} "))) == {1}, tag
