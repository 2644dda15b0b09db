import json
import random

from quadloom.llm import stuffing as S

rnd = random.Random(8)
PROSE = {
    "en": ["We plot the short index first and then look at the curve, which the survey desk asked for.", "As the graph shows, the level grows while the column stays noisy.", "Only a few rows survive once we filter the table by its date.", "This cell may take about ten minutes to run on the old machine."],
    "de": ["Zuerst wollen wir den kurzen Datensatz filtern und danach den Verlauf ansehen.", "Diese Zelle läuft etwa zehn Minuten, weil unser Team danach gefragt hat.", "Im Bild steigt der Pegel, während der Rest stabil bleibt."],
    "fr": ["On va tracer le tableau puis regarder le modèle, même si le fichier est rarement vide.", "Sur la figure, le calcul augmente alors que le niveau reste stable.", "Il ne reste que dix lignes après avoir filtré le registre."],
    "es": ["Primero vamos a ordenar el sensor y luego miramos el conjunto, porque lo pidió la oficina.", "En la figura el umbral crece mientras el residuo sigue ruidoso.", "Solo quedan diez filas después de filtrar el registro."],
}
KEYS = {"en": "cheap deal pills sale discount order online best price free shipping".split(), "de": "billig kaufen Angebot Rabatt Preis Gutschein Schnäppchen günstig bestellen".split(), "fr": "acheter prix promo livraison soldes marque meilleur commander réduction".split(), "es": "barato oferta comprar precio descuento envío gratis rebajas pedir".split()}
CODE = ["import numpy as np", "frame = pd.read_csv('http://a.example/x.csv', sep=';')", "for row in table:\n    total += row['level']", "plt.plot(frame['a'], label='b')", "print(len(rows))"]
LEET = str.maketrans("aeios", "43105")


def prose(lang, n):
    return "\n".join(rnd.choice(PROSE[lang]) for _ in range(n))


def host():
    return f"{rnd.choice(['oak', 'fen', 'tar'])}{rnd.randrange(99)}.example/{rnd.choice(['x', 'y'])}"


def stuffed(lang, kind, n=120):
    ks = [rnd.choice(KEYS[lang]) for _ in range(n)]
    if kind == "words":
        return " ".join(ks)
    if kind == "tags":
        return " ".join("#" + k.capitalize() + rnd.choice(KEYS[lang]).capitalize() for k in ks)
    if kind == "links":
        return "\n".join(f"* [{k} {rnd.choice(KEYS[lang])}](https://{host()})" for k in ks)
    if kind == "anchors":
        return "\n".join(f'<a href="http://{host()}">{k}</a><br>' for k in ks)
    if kind == "hosts":
        return "\n".join(f"{k} {rnd.choice(KEYS[lang])} @ {host()}" for k in ks)
    if kind == "products":
        return "\n".join(f"SKU {rnd.randrange(9999)} / {k} / {rnd.randrange(99)},99 / {rnd.choice(KEYS[lang])}, {rnd.choice(KEYS[lang])}, {k}" for k in ks)
    if kind == "disguised":
        return " ~ ".join(rnd.choice([k, k.translate(LEET), ".".join(k)]) for k in [rnd.choice(KEYS[lang][:3]) for _ in ks])
    fw = {"en": "for the with our", "de": "der mit für und", "fr": "pour le avec et", "es": "para el con y"}[lang].split()
    two = " ".join(KEYS[lang][:2])
    return " ".join(f"{rnd.choice(fw).capitalize()} {two} {rnd.choice(fw)} {rnd.choice(KEYS[lang])} {two} {two}." for _ in range(n // 4))


KINDS = ["words", "tags", "links", "anchors", "hosts", "products", "disguised", "sentences"]


def notebook(cells, fmt):
    if fmt == "ipynb":
        return json.dumps({"cells": [{"cell_type": k, "metadata": {}, "source": [x + "\n" for x in t.split("\n")], **({"outputs": [], "execution_count": 1} if k == "code" else {})} for k, t in cells], "nbformat": 4}, indent=1, ensure_ascii=False)
    if fmt == "percent":
        return "\n\n".join("# %% [markdown]\n" + "\n".join("# " + x for x in t.split("\n")) if k == "markdown" else "# %%\n" + t for k, t in cells)
    return "\n\n".join(t if k == "markdown" else f"In [3]:\n{t}" for k, t in cells)


def corpus():
    out, i = [], 0
    for lang in PROSE:
        for fmt in ("ipynb", "percent", "export"):
            for kind in KINDS:
                spam = stuffed(lang, kind)
                where = rnd.choice(["markdown", "code"])
                text = spam if where == "markdown" else f'x = """{spam}"""'
                few = prose(lang, max(1, len(spam) // 900))
                out.append((i, notebook([("markdown", few), (where, text), ("code", rnd.choice(CODE))], fmt), rnd.choice([lang, "xx", None]), 1, kind + fmt))
                much = prose(lang, len(spam) // 40)
                out.append((i + 1, notebook([("markdown", much), (where, text), ("code", rnd.choice(CODE))], fmt), lang, 0, kind + fmt))
                out.append((i + 2, notebook([("markdown", prose(lang, 12)), ("code", "\n".join(rnd.choice(CODE) for _ in range(8)))], fmt), lang, 0, "clean"))
                i += 3
    return out


def test_kinds_languages_and_formats(spark, ws):
    rows = corpus()
    df = spark.createDataFrame([(r[0], r[1], r[2], 5, "clash") for r in rows], "doc_id long, text string, lang string, chars int, blocks string")
    got = {r.doc_id for r in S.find_stuffed(df, ws).collect()}
    truth = {r[0] for r in rows if r[3]}
    name = {r[0]: (r[4], r[2]) for r in rows}
    assert len(got & truth) >= 0.98 * len(truth), sorted(name[x] for x in truth - got)
    assert len(got - truth) <= 0.02 * len(truth), sorted(name[x] for x in got - truth)


def test_nulls_empty_cut_off_and_repeats(spark, ws):
    spam = notebook([("markdown", stuffed("en", "words", 400))], "ipynb")
    rows = [(1, None, "en"), (2, "", None), (3, spam, None), (3, spam, None), (4, spam[: len(spam) * 3 // 4], "de"), (5, "cheap", "en"), (6, "{", "en"), (7, "x" * 300_000, "en"), (None, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in S.find_stuffed(df, ws).orderBy("doc_id").collect()] == [3, 4]
    assert S.find_stuffed(df.limit(0), ws).count() == 0


def test_outputs_are_not_spam():
    table = "\n".join(f"{i} {rnd.random():.3f} {rnd.random():.3f} NaN" for i in range(50))
    log = "\n".join(f"Epoch {i}/50 - loss: 0.{i} - val_loss: 0.{i + 1} - 5s" for i in range(50))
    warn = "\n".join("/opt/env/core.py:44: FutureWarning: tide is deprecated" for _ in range(60))
    for t in (table, log, warn):
        f = S.features(notebook([("code", t)], "percent"))
        assert f["code_chars"] >= 0.9 * f["chars"]
    image = "![png](data:image/png;base64," + "iVBORw0KGgo" * 500 + ")"
    f = S.features(image)
    assert f["link_chars"] == 0 and f["code_chars"] >= 0.95 * f["chars"]


def test_hostile_texts_take_linear_time():
    import time

    n = 30_000
    for piece in ("a-", "a.", "\\", "\\n", "<!--", "<a ", "<a >", "[", "[a](", '"', "'", " ", "\n", "&amp;", "#A", "a =", "http://", "_", "a.b-c_", "/a", "1.", "# %%\n", "In [1]:\n", "* "):
        t = time.process_time()
        for text in (piece * n, '{"cells": ["' + piece * n):
            S.features(text)
        assert time.process_time() - t < 5, piece


def test_markup_is_left_out():
    cells = S.contents(notebook([("markdown", "one\ntwo"), ("code", 'print("x")')], "ipynb"))
    assert "one" in cells[0] and "two" in cells[0] and 'print("x")' in cells[1] and not any("markdown" in c for c in cells)


def test_short_blocks_of_keywords_are_judged_together(spark, ws):
    keys = [" ".join(rnd.choice(KEYS["en"]) for _ in range(6)) for _ in range(40)]
    titles = ["Load data", "Results", "Fit model", "Plot residuals"]
    docs = [
        notebook([("markdown", k) for k in keys], "ipynb"),
        notebook([("markdown", "\n".join(f"{k}\n{i},99" for i, k in enumerate(keys)))], "percent"),
        notebook([x for i in range(40) for x in (("markdown", titles[i % 4]), ("markdown", prose("en", 2)), ("code", CODE[i % 5]))], "ipynb"),
    ]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in S.find_stuffed(df, ws).orderBy("doc_id").collect()] == [0, 1]


def test_lists_without_blanks_are_judged(spark, ws):
    keys = [rnd.choice(KEYS["en"]) for _ in range(120)]
    texts = [x.join(keys[:n]) for x in (";", "|", "/", "\t", ",") for n in (35, 120)]
    other = ["<table><tr><td>" + "</td><td>".join(keys) + "</td></tr></table>", "Ab3/x+Q9" * 60, "|".join(f"{i}.5" for i in range(90))]
    df = spark.createDataFrame([(i, notebook([("markdown", t)], "ipynb"), "en") for i, t in enumerate(texts + other)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in S.find_stuffed(df, ws).orderBy("doc_id").collect()] == list(range(len(texts)))


def test_tags_between_separators_need_not_repeat(spark, ws):
    tags = [f"{a}{b}" for a in ("rote", "zinn", "kupf", "blau", "tanne", "mohn") for b in ("kanne", "schale", "leine", "boje", "gabel", "lampe", "decke", "kiste", "wanne", "glocke")]
    texts = [" | ".join(tags), " , ".join(tags[:40]) + "\n" + " ; ".join(tags[20:])]
    df = spark.createDataFrame([(i, notebook([("markdown", t)], "ipynb"), "de") for i, t in enumerate(texts)] + [(9, notebook([("markdown", prose("de", 40))], "ipynb"), "de")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in S.find_stuffed(df, ws).orderBy("doc_id").collect()] == [0, 1]


def test_languages_without_function_words_of_their_own(spark, ws):
    finnish = "Satama avautui aamulla kun meri oli vielä tyyni. Laivat lähtivät hitaasti kohti avointa merta. Kalastajat korjasivat verkkojaan laiturilla. Lokit kiersivät majakan ympärillä koko iltapäivän. Tuuli kääntyi myöhään pohjoiseen. Illalla laivat palasivat hitaasti satamaan. "
    words = finnish.split()
    text = "\n".join(" ".join(rnd.sample(words, 12)) for _ in range(30))
    assert S.features(notebook([("markdown", text)], "ipynb"))["lang_by_words"] is None
    df = spark.createDataFrame([(1, notebook([("markdown", text)], "ipynb"), "fi"), (2, notebook([("markdown", " ".join(words[:8] * 60))], "ipynb"), "fi"), (3, notebook([("markdown", stuffed("en", "words", 400))], "ipynb"), "EN_us")], "doc_id long, text string, lang string")
    assert [r.doc_id for r in S.find_stuffed(df, ws).orderBy("doc_id").collect()] == [2, 3]


def test_size_does_not_change_the_kind_of_a_line():
    for n in (100, 600, 5000):
        assert S._LINK.search(f'<a href="http://a.example/{"x" * n}">{"tin kettle " * (n // 10)}</a>')[2], n
    for n in (30, 150, 400):
        assert S.features("Q9+/x" * n)["code_chars"] == 5 * n
    for n in (1, 4, 20):
        f = S.features("frame = pd.merge(left, right, on='a'); print(frame.head()); " * n)
        assert f["code_chars"] == f["chars"] > 0
