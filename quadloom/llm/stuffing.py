"""Keyword-stuffed pages and link lists among notebooks.

A text is cut into lines without the notebook's own markup. Lines are link lines (links and their texts make up most
of them), code or program output (by syntax and digits), or text; neighbouring text lines of one kind form blocks of
some dozen words. Each text block has its top-word share, repeated-bigram share, duplicate-line share, separator
density and share of function words, each link line the share of its links. What is ordinary differs by language: the
thresholds of a language are quantiles of these features over the ordinary blocks of all documents in it. The language
is that of the column ``lang``, else the one whose function words the text has. A document is spam if stuffed blocks
and link lines hold at least ``SHARE`` of its characters.

One pass over the texts writes the block features; calibration and decision read only these.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import Workspace

SHARE = 2 / 3
#: Words of a text block: it is closed at the first line end beyond BLOCK; blocks below LEAST are too short to judge
#: alone: those with few function words are pooled over the whole document.
BLOCK, LEAST = 48, 8
#: Documents with fewer words in stuffed blocks and link lines aren't judged spam.
LEAST_WORDS = 20
#: The share of its characters from which links may make a line one of links, and the words of a line for which one sign of code does.
LEAST_LINK, _CODE_EVERY = 0.3, 30

# fixed values: frequent function words of the four languages
FUNCTION_WORDS = {
    "en": "the a an and or but of to in on at by for from with without as is are was were be been has have had it its this that these those we our you your they their he she not no if so then than which who what when where while before after because once only usually means about may can will do does did there here also just all some any each more most other into over until unless although",
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber von zu im in an auf bei für aus mit ohne als wie ist sind war waren wird werden wurde sein hat haben hatte es sie er wir ihr ich nicht kein keine wenn so dann dass weil damit sich noch nur auch schon vor nach über unter um durch bis obwohl während deshalb man wo was wer welche jede jeder jedes zum zur beim vom",
    "fr": "le la les l un une des du de d et ou mais à au aux en dans sur par pour avec sans comme est sont était étaient être a ont avait il elle ils elles on nous vous je ce cette ces cet qui que qu quoi dont où si ne n se s sa son ses leur leurs plus moins très même aussi donc car puis alors après avant parce tant bien y il",
    "es": "el la los las un una unos unas de del al y o u pero a en por para con sin como es son era eran ser fue ha han había se su sus lo le les que qué quien cuando donde si no ni más menos muy también ya solo luego después antes porque mientras aunque entre sobre hasta desde este esta estos estas ese esa eso nos vamos hay",
}
_FW = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LISTS = tuple(_FW.values())
#: word -> bits of the languages that have it as a function word
_BITS = {w: sum(1 << i for i, ws in enumerate(_LISTS) if w in ws) for w in frozenset().union(*_LISTS)}
_MARKS = "()[]{}=_\\%&+<>$^"
_LEADING = frozenset(" \t\v\f>*•|#-0123456789")
_SEPARATORS = ",;|/#:•·~"

_STRING = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"(\s*:)?', re.S)
_MARKUP_KEYS = frozenset("cell_type output_type name id execution_count kernelspec display_name language language_info version file_extension mimetype codemirror_mode pygments_lexer nbconvert_exporter nbformat nbformat_minor collapsed".split())
_PERCENT = re.compile(r"^# %%.*$", re.M)
_PROMPT = re.compile(r"^[ \t]*(?:In|Out) ?\[[ \d*]*\]:", re.M)
_LEAD = re.compile(r"^(?:[\s>*•|]+|#+(?=\s|$)|\d+[.)](?=\s)|-+(?=\s))+")
_HOST = r"(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}/[^\s\"'<>)\]]*"
_DATA = re.compile(r"!?\[[^\]\[]*\]\(data:[^)\s]*\)?|data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]*")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_LINK = re.compile(rf"!?\[([^\]\[]*)\]\(\s*+[^\s)\[]*+\)|<a\s[^<>]*+>((?:(?!<a\s|</a>).)*+)</a>|(?:https?://|ftp://|www\.)[^\s\"'<>)\]]+|(?<![\w.\-]){_HOST}", re.I)
_WORD = re.compile(r"[^\W_]+")
_DOTTED = re.compile(r"\b(?:\w[.\-_*]){2,}\w\b")
_CODE = re.compile(r"\w\(|\w\.\w+|^\s*(?:import|from|def|return|for|while|if|elif|else|with|assert|print|class|library|using|end|try|except)\b|^\s*[%!]\w|[\w\])]\s*(?:=|<-|\+=|==)\s*[\w\[({'\"]|^\s+File \"|Traceback|\w(?:Error|Warning|Interrupt)\b:?|[A-Za-z]:\\\w|/\w+/\w+/")
_QUOTED = re.compile(r"\"\"\"|'''")
_LONG_STRING = re.compile(r"\"([^\"]{60,})\"|'([^']{60,})'")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BETWEEN = re.compile(r"[,;|/\t]+")
_ADDRESS = re.compile(r"https?:|ftp:|www\.|\]\(|<a\s", re.I)
_PLAIN = re.compile(r"[^\W\d_]{1,30}(?:[-'][^\W\d_]{1,30})*")


def _without_blanks(line: str) -> str:
    """What a line without blanks is: a list of words that separators split, code, or text like any other."""
    if "." in line or "*" in line or "-" in line:
        line = _DOTTED.sub(_undotted, line)
    parts = [x for x in _BETWEEN.split(line.replace("#", ",")) if x]
    size, plain = sum(map(len, parts)), sum(len(x) for x in parts if _PLAIN.fullmatch(x))
    if len(parts) >= LEAST and plain >= 0.8 * size:
        return "list"
    return "code" if plain < 0.5 * size and not _ADDRESS.search(line) else "text"


def _undotted(m: re.Match) -> str:
    return re.sub(r"[.\-_*]", "", m[0])


def contents(text: str) -> list[str]:
    """The texts of a notebook's cells and outputs in order, without the notebook's own markup; also of cut-off files."""
    if text.lstrip()[:1] == "{" and '"cell' in text:
        out: list[str] = []
        key, skip, parts, end = "", False, [], 0
        for m in _STRING.finditer(text):
            end = m.end()
            if m[2]:
                if parts:
                    out.append("".join(parts))
                    parts = []
                key, skip = m[1], m[1] in _MARKUP_KEYS
            elif not skip and key:
                s = m[1]
                if s.count("\\") == 1 and s.endswith("\\n"):
                    s = s[:-2] + "\n"
                elif "\\" in s:
                    try:
                        s = json.loads(f'"{s}"', strict=False)
                    except ValueError:
                        s = s.replace("\\n", "\n").replace('\\"', '"')
                if parts and parts[-1][-1:] != "\n":
                    parts.append("\n")
                parts.append(s)
        tail = text[end:]
        at = tail.find('"')
        if at >= 0 and not skip:
            parts.append("\n" + tail[at + 1 :].replace("\\n", "\n").replace('\\"', '"'))
        if parts:
            out.append("".join(parts))
        return out
    if "# %%" in text:
        return _PERCENT.split(text)
    return _PROMPT.split(text)


class _Block:
    __slots__ = ("lines", "chars", "words", "bits", "seps", "kind")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.chars, self.words, self.bits, self.seps, self.kind = 0, [], [], 0, -1


def _by_language(bits: list[int]) -> list[int]:
    """How many of the words with these bits are function words of each language."""
    out = [bits.count(1 << i) for i in range(len(_LISTS))]
    if sum(out) < len(bits):
        for b in bits:
            if b & (b - 1):
                for i in range(len(_LISTS)):
                    out[i] += b >> i & 1
    return out


def _finish(b: _Block, kw: Counter) -> dict | None:
    n = len(b.words)
    if not n:
        return None
    by = _by_language(b.bits)
    fw = max(by)
    functional = _LISTS[by.index(fw)]
    rest = [w for w in b.words if w not in functional] if fw else b.words
    top = sum(sorted(Counter(rest).values())[-2:])
    pairs = Counter(zip(b.words, b.words[1:]))
    again = n - 1 - list(pairs.values()).count(1)
    if fw <= 0.1 * n and n >= LEAST:
        kw.update(rest)
    return {"chars": b.chars, "words": n, "fw": fw / n, "top": top / max(len(rest), 1), "gram": again / max(n - 1, 1), "dup": 1 - len(set(b.lines)) / len(b.lines), "sep": b.seps / n}


def features(text: str | None) -> dict:
    """Character counts by kind of line and the text blocks of one document. A null text is an empty one."""
    out = {"chars": 0, "links": 0, "link_chars": 0, "link_lines": [], "code_chars": 0, "lang_by_words": None, "kw_words": 0, "kw_distinct": 0, "kw_top": 0.0, "blocks": []}
    if not text:
        return out
    votes, n_words = [0] * len(_LISTS), 0
    link_lines: dict[tuple[bool, int], list[int]] = {}
    cut = ("cut", 0, "", [], [])
    pending: list[tuple[str, int, str, list[str], list[int]]] = []
    for cell in contents(text):
        pending.append(cut)
        for raw in cell.replace("\r", "\n").split("\n"):
            if not raw or raw.isspace():
                continue
            # a long string inside a line of code is content of its own
            pieces = [raw]
            if len(raw) > 60 and ('"' in raw or "'" in raw):
                found = [x[0] or x[1] for x in _LONG_STRING.findall(raw)]
                if found:
                    pieces = [_LONG_STRING.sub("", raw), *found]
            for line in pieces:
                chars = len(line) - line.count(" ") - line.count("\t")
                if not chars:
                    continue
                out["chars"] += chars
                if line.lower() == line.upper():  # no letters: numbers and rules
                    out["code_chars"] += chars
                    if _WORD.search(line):
                        pending.append(cut)
                    continue
                if " " not in line and not line.isalpha():
                    what = _without_blanks(line)
                    if what == "list":
                        line = _BETWEEN.sub(" , ", line)
                    elif what == "code":
                        out["code_chars"] += chars
                        continue
                s = _LEAD.sub("", line) if line[0] in _LEADING else line
                if '"""' in s or "'''" in s:
                    s = _QUOTED.sub("", s)
                if "base64," in s:  # an embedded image is output
                    s = _DATA.sub(" ", s)
                    blob = chars - (len(s) - s.count(" ") - s.count("\t"))
                    out["code_chars"] += blob
                    chars -= blob
                    if chars <= 0:
                        continue
                links, link_chars = 0, 0
                if "/" in s or "](" in s or "www." in s:
                    body = _LINK.sub(" ", s)
                    if body != s:
                        links = sum(1 for _ in _LINK.finditer(s))
                        link_chars = len(s) - len(body) + links
                        s = body
                if "<" in s:
                    s = _TAG.sub(" ", s)
                if "." in s or "*" in s or "-" in s:
                    s = _DOTTED.sub(_undotted, s)
                if "#" in s:
                    s = _CAMEL.sub(" ", s)
                ws = _WORD.findall(s.lower())
                if links and not re.search(r"\w\(", s):
                    listed = link_chars >= LEAST_LINK * chars and len(ws) <= 8 * links
                    tenth = link_lines.setdefault((listed, min(int(10 * link_chars / chars), 10)), [0, 0, 0, 0, 0])
                    ordinary = 6 * max(_by_language(list(filter(None, map(_BITS.get, ws))))) >= len(ws) > 0
                    for i, x in enumerate((1, chars, links, len(ws), int(ordinary))):
                        tenth[i] += x
                    if listed:
                        out["links"] += links
                        out["link_chars"] += chars
                        out["kw_words"] += len(ws) + links
                        pending.append(cut)
                        continue
                if not ws:
                    out["code_chars"] += chars
                    continue
                marks = sum(map(s.count, _MARKS))
                if marks:  # semicolons alone separate words
                    marks += s.count(";")
                if sum(map(str.isdigit, ws)) > 0.5 * len(ws) or marks > 0.6 * len(ws) or _CODE_EVERY * sum(1 for _ in _CODE.finditer(s)) > len(ws):
                    out["code_chars"] += chars
                    pending.append(cut)
                    continue
                bits = list(filter(None, map(_BITS.get, ws)))
                if bits:
                    votes = [x + y for x, y in zip(votes, _by_language(bits))]
                n_words += len(ws)
                pending.append((s.strip(), chars, s, ws, bits))
    out["lang_by_words"] = list(_FW)[votes.index(max(votes))] if max(votes) > 0.05 * n_words else None
    out["link_lines"] = [{"listed": x, "ratio": k / 10, "lines": n, "chars": c, "links": m, "words": w, "ordinary": f} for (x, k), (n, c, m, w, f) in sorted(link_lines.items())]
    kw: Counter = Counter()
    block, pool = _Block(), _Block()

    def add(b: _Block) -> None:
        got = _finish(b, kw)
        if got:
            out["blocks"].append(got)

    def close() -> None:
        nonlocal block, pool
        n = len(block.words)
        if 0 < n < LEAST and max(_by_language(block.bits)) <= 0.1 * n:
            pool.lines += block.lines
            pool.chars += block.chars
            pool.words += block.words
            pool.bits += block.bits
            pool.seps += block.seps
            if len(pool.words) >= BLOCK:
                add(pool)
                pool = _Block()
        else:
            add(block)
        block = _Block()

    for at in pending:
        line, chars, s, ws, bits = at
        if at is cut:
            close()
            continue
        kind = -1 if len(ws) < 4 else int(bool(bits) and max(_by_language(bits)) > 0.1 * len(ws))
        if block.words and kind >= 0 and block.kind >= 0 and kind != block.kind:
            close()
        block.kind = max(block.kind, kind) if block.kind < 0 else block.kind
        block.lines.append(line)
        block.chars += chars
        block.words += ws
        block.bits += bits
        block.seps += sum(map(s.count, _SEPARATORS))
        if len(block.words) >= BLOCK:
            close()
    close()
    add(pool)
    n = sum(kw.values())
    out["kw_words"] += n
    out["kw_distinct"] = len(kw)
    out["kw_top"] = sum(c for _, c in kw.most_common(10)) / n if n else 0.0
    return out


BLOCK_TYPE = T.StructType([T.StructField("chars", T.LongType()), T.StructField("words", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in ("fw", "top", "gram", "dup", "sep"))])
#: The lines with links of one document by tenths of the share of their characters that are links; listed lines may be lists of links.
LINK_TYPE = T.StructType([T.StructField("listed", T.BooleanType()), T.StructField("ratio", T.DoubleType()), *(T.StructField(x, T.LongType()) for x in ("lines", "chars", "links", "words", "ordinary"))])
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("lang_by_words", T.StringType()), *(T.StructField(x, T.LongType()) for x in ("chars", "links", "link_chars", "code_chars", "kw_words", "kw_distinct")), T.StructField("kw_top", T.DoubleType()), T.StructField("link_lines", T.ArrayType(LINK_TYPE)), T.StructField("blocks", T.ArrayType(BLOCK_TYPE))]
)


def block_features(documents: DataFrame) -> DataFrame:
    """One row of features a document, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(SCHEMA)
        for b in batches:
            rows = [features(t) for t in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), *(pa.array([r[f.name] for r in rows], type=f.type) for f in list(target)[2:])]
            yield pa.RecordBatch.from_arrays(cols, schema=target)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _language(feats: DataFrame) -> Column:
    """The documents' language as given, in its first part and without case, else as their words show it."""
    given = F.lower(F.split_part(F.trim(F.regexp_replace("lang", "_", "-")), F.lit("-"), F.lit(1)))
    return F.coalesce(F.when(given != "", given), feats.lang_by_words, F.lit("none"))


def calibrate(feats: DataFrame) -> DataFrame:
    """Thresholds by language from all documents: (language, fw_low, top_high, gram_high, dup_high, sep_high, link_high).

    A block is ordinary if at least a sixth of its words are function words and it is long enough. fw_low is a
    third of the 1 % quantile of their function words. top_high, gram_high, dup_high and sep_high are 90 % quantiles with a
    margin of a third, link_high is that of the link share of lines that hold links among as many function words; all in
    bounds that hold where a language has few blocks. A language without ordinary blocks has no row.
    """
    language = _language(feats).alias("language")
    blocks = feats.select(language, F.explode("blocks").alias("b")).select("language", "b.*")
    high = lambda x: F.percentile_approx(x, 0.90, 1000).alias(x)
    q = blocks.where(f"words >= {BLOCK // 2} AND fw >= 1.0 / 6").groupBy("language").agg(F.percentile_approx("fw", 0.01, 1000).alias("fw"), high("top"), high("gram"), high("dup"), high("sep"))
    lines = feats.select(language, F.explode("link_lines").alias("b")).select("language", "b.*").where("ordinary > 0")
    q = q.join(lines.groupBy("language").agg(F.percentile("ratio", F.lit(0.90), F.col("ordinary")).alias("ratio")), "language", "left")
    within = lambda x, low, top: F.least(F.greatest(x, F.lit(low)), F.lit(top))
    third = lambda x: F.col(x) * 4 / 3
    return q.select(
        "language",
        within(F.col("fw") / 3, 0.03, 0.1).alias("fw_low"),
        within(third("top"), 0.2, 0.45).alias("top_high"),
        within(third("gram"), 0.25, 0.6).alias("gram_high"),
        within(third("dup"), 0.3, 0.5).alias("dup_high"),
        within(third("sep"), 0.4, 0.6).alias("sep_high"),
        within(F.coalesce(third("ratio"), F.lit(1.0)), LEAST_LINK, 0.4).alias("link_high"),
    )


#: Thresholds of a language without ordinary blocks.
DEFAULTS = {"top_high": 0.3, "gram_high": 0.4, "dup_high": 0.5, "sep_high": 0.5, "link_high": 0.4}


def judge(feats: DataFrame, thresholds: DataFrame) -> DataFrame:
    """doc_id, spam_share (of characters) and is_spam for every document.

    A block is stuffed if it has few function words and the document's words without them repeat, or if separators
    stand between its words; if some words and pairs of words hold much of it; or if lines, or all words of the document, and pairs of words
    repeat. In a language that is given, but neither known by its function words nor calibrated, few function words tell nothing.
    """
    th = F.broadcast(thresholds)  # one row a language
    language = _language(feats)
    known = language.isin(*_FW, "none")
    j = feats.join(th, language == th.language, "left").withColumns({"fw_low": F.coalesce("fw_low", F.when(known, 0.05).otherwise(-1.0)), **{k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()}})
    repeated = (F.col("kw_words") >= LEAST_WORDS) & ((F.col("kw_distinct") <= 0.6 * F.col("kw_words")) | (F.col("kw_top") >= 0.4))

    def stuffed(b):
        listed = (b["fw"] <= F.col("fw_low")) & (repeated | (b["sep"] >= F.col("sep_high")))
        driven = (b["top"] >= F.col("top_high")) & (b["gram"] >= F.col("gram_high"))
        same = (b["dup"] >= F.col("dup_high")) & (b["gram"] >= F.col("gram_high")) & (b["fw"] <= 0.1)
        again = (F.col("kw_words") >= LEAST_WORDS) & (F.col("kw_distinct") <= 0.1 * F.col("kw_words")) & (b["gram"] >= F.col("gram_high")) & (b["fw"] <= 0.1)
        return (b["words"] >= LEAST) & (listed | driven | same | again)

    total = lambda items, field: F.aggregate(items, F.lit(0).cast("long"), lambda a, b: a + b[field])
    text, words = (total(F.filter("blocks", stuffed), x) for x in ("chars", "words"))
    lines = F.filter("link_lines", lambda b: b["listed"] & (b["ratio"] > F.col("link_high") - 0.05))
    links = total(lines, "links")
    share = (text + F.when(links >= 3, total(lines, "chars")).otherwise(0)) / F.greatest(F.col("chars"), F.lit(1))
    return j.select("doc_id", share.alias("spam_share"), ((share >= SHARE) & (words + links * 3 >= LEAST_WORDS)).alias("is_spam"))


def find_stuffed(documents: DataFrame, ws: Workspace) -> DataFrame:
    """Distinct doc_id of spam documents.

    Null and empty texts aren't spam; without lang the language is that of the function words, a wrong one only means
    the thresholds of another language; repeated rows give one row; extra columns are ignored; an empty table gives an empty table.
    """
    feats = ws.table(block_features(documents), "features")
    return judge(feats, ws.table(calibrate(feats), "thresholds")).where("is_spam").select("doc_id").distinct()
