"""Template residue, filler, error pages and script notices, by TF-IDF containment in labelled exemplars.

Texts are cut into sections (heading to heading) and sections into passage windows (lines and
sentences). Headings are found by form, and by the names that head lines in enough documents. A
window's terms look up an inverted index of labelled exemplars (exemplars.py, or the caller's);
windows that share enough terms with one are scored by TF-IDF containment: the share of the
window's term weight that the exemplar holds. Inverse document frequencies come from all
documents. A document is excluded if contained windows make up nearly all the weight of one of
its sections.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.llm.exemplars import EXEMPLARS, LATIN_PASSAGE, STOP
from seriatim.operators.skew import spread_join
from seriatim.session import cut
from seriatim.sources.tables import require

#: The syntaxes of unfilled placeholders.
PLACEHOLDER = regex.compile(
    r"""\{\{[^{}\n]{0,80}\}\}|\{%[^{}\n]{0,80}%\}|\$\{[^{}\n]{0,80}\}|\[\[[^\[\]\n]{0,80}\]\]|<<[^<>\n]{0,80}>>|&lt;[\w .-]{1,60}&gt;"""
    r"""|\[(?i:insert|enter|type|add|select|choose|your|fill|specify)\b[^\[\]\n]{0,80}\]|\[\p{Lu}[\p{Lu} _/'-]{2,40}\]|<[^<>\n]{1,80} goes here>|@[A-Z][A-Z0-9_]{1,40}@|%[A-Z][A-Z0-9_]{1,40}%|\#[A-Z][A-Z0-9_]{2,40}\#|(?<!\w)__[A-Z][A-Z0-9_]{1,40}__(?!\w)"""
)
_TEXT = r"\x01|(?<!\p{L})[0-9a-f]*\d[0-9a-f]*(?:[.,:/]\d+)*(?!\p{L})|[\p{L}\p{M}][\p{L}\p{M}']*\d*|\d+"
_FAULT = r"(?:[\p{L}_$][\w$]*\.)+\w*(?:Error|Exception|Fault)\b"
_FILE = r"(?:/[\w.-]+){2,}|[\w$]+\.(?:java|kt|py|js|ts|cs|php|rb|go|cpp|c|sql)\b(?::\d+)?"
_TERM = regex.compile(_TEXT)
#: Terms of a text that has traces of a program, and what tells such a text.
_TERM_CODE = regex.compile(rf"(?<=Error: )'[^'\n]{{1,80}}'|{_FAULT}|{_FILE}|[\p{{L}}_$][\w$]*(?:\.[\p{{L}}_$<][\w$>]*)+(?=\()|{_TEXT}")
_CODE = regex.compile(r"Error|Exception|Fault|, in |/[\w.-]+/[\w.-]|\.(?:java|kt|py|js|ts|cs|php|rb|go|cpp|c|sql)\b|\.[\p{L}_$<][\w$>]*\(")
_COLON = regex.compile(r" ?:(?=\s|$)")
#: What stands before a heading's colon; a heading is at most HEADING characters and WORDS words long.
_HEADING = regex.compile(r"(?:^|(?<=\n)|(?<=[.!?>\]})%@\x01] ))[ \t\ufeff]*\p{Lu}[\p{L}'’-]*(?: [\p{L}'’-]+){0,4}$")
HEADING, WORDS = 120, 5
#: Share of the documents in which a name must head a line to be a heading within a line too.
HEADS = 0.001
_LINE_HEAD = r"(?m)^[ \t\uFEFF]*(\p{Lu}[\p{L}'’-]*(?: [\p{L}'’-]+){0,4}) ?:(?=\s|$)"
_WINDOW = regex.compile(r"[\n\r]+|[<>{}\"]+|(?<=[.!?…])\s+")

#: A window is contained from this share of its weight on; a section is residue from this share of contained weight on.
CONTAINED, COVERED = 0.7, 0.8
#: Share of a window's terms that one exemplar must hold for the window to be scored, and of a section's windows.
RETRIEVED = 0.5
#: Least share of pseudo-Latin among the different words of a section of filler, and how many it must have.
LATIN_SHARE, LATIN_WORDS = 0.9, 8
HOLE, NUMBER, LATIN, CROSS, KEYS, FAULT, PATH, FILE = "\x01", "#", "\x02", "\x03", "\x05", "\x06", "\x07", "\x08"
#: The letters of a keyboard, row by row.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
_CAMEL = regex.compile(r"(?:\p{Lu}\p{Ll}+){3,}|\p{Lu}\w*(?:Error|Exception|Fault)")
_SYLLABLE = regex.compile(r"[^aeiouy]*[aeiouy]+(?:[^aeiouy]*$|[^aeiouy](?=[^aeiouy]))?")


@lru_cache(1)
def pieces() -> frozenset[str]:
    """Syllables of the passage that filler is made from, and beginnings and ends of its words."""
    words = LATIN_PASSAGE.split()
    return frozenset({"a"} | {m for w in words for m in _SYLLABLE.findall(w)} | {x for w in words for n in (2, 3) for x in (w[:n], w[-n:])})


@lru_cache(200_000)
def latin(word: str) -> bool:
    """Whether a word can be put together from the pieces of the passage."""
    known = pieces()
    reach = {0}
    for i in range(len(word)):
        if i in reach:
            reach |= {i + n for n in (1, 2, 3, 4, 5) if word[i : i + n] in known and i + n <= len(word)}
    return len(word) in reach


def mashed(word: str) -> bool:
    """Three or more letters that run along one row of the keyboard."""
    at = [_PLACE.get(c) for c in word]
    return len(word) >= 3 and None not in at and all(a[0] == b[0] and abs(a[1] - b[1]) <= 2 for a, b in zip(at, at[1:])) and len(set(word)) > 1


@lru_cache(200_000)
def _term(t: str) -> str:
    """The term of a token: words in lower case; placeholders, numbers, runs of x, keyboard runs, error classes, calls and files as one term each."""
    if t == HOLE:
        return HOLE
    if t in ("FAULT", "PATH", "FILE"):
        return {"FAULT": FAULT, "PATH": PATH, "FILE": FILE}[t]
    if regex.fullmatch(_FILE, t):
        return FILE
    if regex.fullmatch(_FAULT, t):
        return FAULT
    if t[0] in "'<" or "." in t and not any(c in t for c in ",:/") and t[0].isalpha():
        return PATH
    low = t.lower()
    if any(c.isdigit() for c in t) and low not in ("h1", "h2"):
        return NUMBER
    if len(t) > 1 and set(low) == {"x"}:
        return CROSS
    if _CAMEL.fullmatch(t):
        return FAULT
    if mashed(low):
        return KEYS
    return low


_TRACED = regex.compile(r"(?<=\bline \d+, in )[\w<>]+")


def terms(window: str, code: bool = True) -> list[str]:
    """Terms of a window, in order; calls, files and error classes only if it may have code."""
    if not code:
        return [_term(t) for t in _TERM.findall(window)]
    return [_term(t) for t in _TERM_CODE.findall(_TRACED.sub("PATH", window))]


def _named(before: str, heads: frozenset[str]) -> int:
    """How many characters of a known heading end the text before a colon; 0 if none does."""
    words = before.split(" ")[-WORDS:]
    for k in range(len(words)):
        name = " ".join(words[k:])
        if name[:1].isupper() and name.lower() in heads:
            return len(name)
    return 0


def sections(text: str, heads: frozenset[str] = frozenset()) -> list[list[list[str]]]:
    """Sections of a text, each a list of windows, each a list of terms; without headings and empty windows.

    heads: names (in lower case) that are headings wherever they stand before a colon.
    """
    plain = PLACEHOLDER.sub(f" {HOLE} ", text)
    parts, last = [], 0
    for colon in _COLON.finditer(plain):
        low = max(last, colon.start() - HEADING)
        heading = _HEADING.search(plain, low, colon.start())
        start = heading.start() if heading else colon.start() - _named(plain[low : colon.start()], heads)
        if start < colon.start():
            parts.append(plain[last:start])
            last = colon.end()
    parts.append(plain[last:])
    out = []
    code = _CODE.search(plain) is not None
    for part in parts:
        windows = [t for w in _WINDOW.split(part) if (t := terms(w, code))]
        if windows:
            out.append(windows)
    return out


class Index:
    """Inverted index of labelled exemplars: term -> exemplars; a few hundred entries."""

    def __init__(self, exemplars: list[tuple[str, str]]):
        self.by: dict[str, list[int]] = defaultdict(list)
        self.labels = [label for label, _ in exemplars]
        for e, (label, text) in enumerate(exemplars):
            for t in set(terms(text.replace("@", f" {HOLE} "))):
                self.by[t].append(e)
            if "lorem" in text:
                self.by[LATIN].append(e)
            if "qwerty" in text:
                self.by[KEYS].append(e)
        self.by.pop(NUMBER, None)
        self.template = {e for e, label in enumerate(self.labels) if label == "template"}


@lru_cache(4)
def index(exemplars: tuple[tuple[str, str], ...] = tuple(EXEMPLARS)) -> Index:
    return Index(list(exemplars))


def _pseudo_latin(windows: list[list[str]]) -> list[list[str]]:
    """The words of a section count as pseudo-Latin where nearly all of them can be put together from its pieces."""
    words = set().union(*windows)
    words = {t for t in words if t.isalpha()}
    if len(words) < LATIN_WORDS and not {"lorem", "ipsum"} & words:
        return windows
    if sum(map(latin, words)) < LATIN_SHARE * len(words):
        return windows
    return [[LATIN if t.isalpha() and latin(t) else t for t in w] for w in windows]


_STOP = frozenset(STOP)


def weighing(window: list[str]) -> int:
    """Terms of a window that can retrieve an exemplar; numbers and function words cannot."""
    return sum(t != NUMBER and t not in _STOP for t in window)


def retrieved(windows: list[list[str]], known: Index | None = None) -> list[list[int]]:
    """For each window the exemplars that share RETRIEVED of its terms or more, numbers and function words apart.

    A template matches only a window with a placeholder. Of exemplars that share the same terms
    the first stands for all; one that shares only a part of another's has no more weight and is left out.
    """
    known = known or index()
    by = known.by
    out = []
    for w in windows:
        need = RETRIEVED * weighing(w)
        shared: dict[int, set[str]] = defaultdict(set)
        counts = Counter(w)
        if need and sum(t in by for t in w if t not in _STOP) >= need:
            for t in counts:
                for e in by.get(t, ()):
                    shared[e].add(t)
        first: dict[frozenset[str], int] = {}
        for e in sorted(shared):
            if (HOLE in counts or e not in known.template) and sum(counts[t] for t in shared[e] if t not in _STOP) >= need:
                first.setdefault(frozenset(shared[e]), e)
        out.append([e for terms_, e in first.items() if not any(terms_ < other for other in first)])
    return out


#: Terms whose counts a task holds before it hands them on.
HELD_TERMS = 200_000

_READ = "section int, window int, exemplars array<int>, term string, n bigint"


def _read(id_type: pa.DataType, heads: frozenset[str], exemplars: tuple[tuple[str, str], ...]):
    """One pass over texts: term counts of windows in candidate sections, and document frequencies.

    A candidate section is one whose retrieved windows hold half of its terms or more, numbers and function words apart. Frequency
    rows have no id and section -1; the empty term counts the texts.
    """

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * 6
        types = [id_type, pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "section", "window", "exemplars", "term", "n"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()
        known = index(exemplars)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0), b.column(1).to_pylist()):
                seen: set[str] = {""}
                for k, windows in enumerate(sections(text, heads)):
                    windows = _pseudo_latin(windows)
                    for w in windows:
                        seen.update(w)
                    best = retrieved(windows, known)
                    if any(best) and sum(weighing(w) for e, w in zip(best, windows) if e) >= RETRIEVED * sum(map(weighing, windows)):
                        rows += [(doc.as_py(), k, i, e, t, n) for i, (e, w) in enumerate(zip(best, windows)) for t, n in Counter(w).items()]
                df.update(seen)
            if len(df) > HELD_TERMS:
                rows += [(None, -1, -1, None, t, n) for t, n in df.items()]
                df.clear()
            if rows:
                yield batch(rows)
        yield batch([(None, -1, -1, None, t, n) for t, n in df.items()])

    return of


def headings(texts: DataFrame) -> frozenset[str]:
    """Names that stand before a colon at the head of a line in HEADS of the documents or more, in lower case; the share bounds their number."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_LINE_HEAD), F.lit(1)), F.lower))
    seen = cut(texts.select(F.explode(F.concat(F.array(F.lit("")), names)).alias("name")).groupBy("name").agg(F.count("*").alias("n")))
    total = seen.where("name = ''").agg(F.sum("n")).first()[0] or 0
    return frozenset(r["name"] for r in seen.where((F.col("n") >= HEADS * total) & (F.col("name") != "")).select("name").collect())


def scored(df: DataFrame, id_column: str = "doc_id", text: str = "text", exemplars: list[tuple[str, str]] | None = None) -> DataFrame:
    """Candidate sections with their share of weight in contained windows: id, section, covered, label.

    exemplars: (label, text) pairs in place of EXEMPLARS.
    """
    require(df, [id_column, text])
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    texts = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("text is not null and id is not null")
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    labelled = tuple(exemplars or EXEMPLARS)
    known = index(labelled)
    read = cut(texts.mapInArrow(_read(arrow, headings(texts), labelled), f"id {kind}, {_READ}"))
    frequency = read.where("section < 0").groupBy("term").agg(F.sum("n").alias("df"))
    total = frequency.where("term = ''").agg(F.sum("df")).first()[0] or 0
    cand = read.where((F.col("section") >= 0) & (F.col("term") != NUMBER)).withColumnRenamed("n", "tf")
    used = cut(cand.groupBy("term").agg(F.count("*").alias("rows")).join(frequency, "term"))  # terms of candidates only
    cand = cand.withColumn("exemplar", F.explode_outer("exemplars")).withColumn("exemplar", F.coalesce("exemplar", F.lit(-1)))
    weighted = spread_join(cand.drop("exemplars"), used, ["term"], "rows").withColumn("weight", F.col("tf") * F.log((F.lit(float(total)) + 1) / F.col("df")))
    pairs = F.broadcast(spark.createDataFrame([(t, e) for t, es in known.by.items() for e in es], "term string, exemplar int").withColumn("there", F.lit(True)))  # the index
    weighted = weighted.join(pairs, ["term", "exemplar"], "left")
    labels = known.labels
    inside = F.when(F.col("there"), F.col("weight")).otherwise(0.0)
    each = weighted.groupBy("id", "section", "window", "exemplar").agg(F.sum("weight").alias("mass"), F.sum(inside).alias("held"))
    best = each.groupBy("id", "section", "window").agg(F.max("mass").alias("mass"), F.max(F.struct("held", (-F.col("exemplar")).alias("minus"))).alias("b"))  # the greatest containment
    windows = best.select("id", "section", "window", "mass", "b.held", (-F.col("b.minus")).alias("exemplar"))
    label = F.array(*[F.lit(x) for x in labels])
    held = F.when((F.col("exemplar") >= 0) & (F.col("held") >= CONTAINED * F.col("mass")), F.col("mass")).otherwise(0.0)
    return (
        windows.withColumn("held", held)
        .groupBy("id", "section")
        .agg(F.sum("mass").alias("mass"), F.sum("held").alias("held"), F.max_by(F.when(F.col("held") > 0, label[F.col("exemplar")]), "held").alias("label"))
        .where("mass > 0")
        .select("id", "section", (F.col("held") / F.col("mass")).alias("covered"), "label")
    )


def residue(df: DataFrame, id_column: str = "doc_id", text: str = "text", covered: float = COVERED, exemplars: list[tuple[str, str]] | None = None) -> DataFrame:
    """The documents to leave out: id, covered (largest share of a section), label.

    Null, empty and blank texts are no cases, nor are texts whose sections have no weight (only
    numbers or marks). Repeated ids are judged together. Whole texts are read, of any length.
    """
    s = scored(df, id_column, text, exemplars).where(F.col("covered") >= covered)
    return s.groupBy("id").agg(F.max("covered").alias("covered"), F.max_by("label", "covered").alias("label")).withColumnRenamed("id", id_column)
