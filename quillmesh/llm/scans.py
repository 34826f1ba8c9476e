"""Repair of text from scanned pages into continuous paragraphs.

Words of the corpus are counted; the frequent ones get skip-gram vectors. A
rare word is linked to known words that a plausible misreading of its glyphs
explains, and the one that suits the words around it is taken. Rare is what is
unknown, or many times rarer than such a neighbour: misreadings of common words
repeat, the more the larger the corpus. Before that,
running headers and page numbers are removed and words cut at line ends are
joined; afterwards the lines are reflowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import cut, ship

#: A word is known if it stands in this share of the texts, so there are at most (mean words of a text) / KNOWN_SHARE; at least KNOWN_TEXTS times.
KNOWN_SHARE, KNOWN_TEXTS = 5e-5, 3
#: Words in this share of the texts get vectors; capitalised ones count as vocabulary, not as names, from NOUN_SHARE.
VECTOR_SHARE, NOUN_SHARE = 5e-4, 3e-3
VECTOR_SIZE, WINDOW = 24, 4
#: Cosine to the surroundings under which a correction by letters alone is rejected, and what it weighs against the logarithm of frequency.
LEAST_FIT, FIT_WEIGHT = -0.35, 4.0
#: A known word is looked at if a misreading explains it by a word this many times as frequent.
TIMES = 20
#: By how much the known word's own cosine to the surroundings may exceed that of its correction; its vector counts from OWN_COUNT occurrences.
OWN_MARGIN, OWN_COUNT = 0.2, 50
#: Glyphs and what they are read as.
MISREADINGS = "e>c c>e a>o o>a i>1 l>1 s>5 o>0 t>f f>t h>b b>h b>6 g>9 v>y y>v n>ri m>rn u>ii d>cl w>vv i>l l>i I>l z>2 q>g S>5 B>8 O>0 ii>u rn>m ri>n cl>d vv>w u>v n>u u>n li>h h>li l>| I>| i>| in>m"
HYPHENS = "-‐¬­"

_LINES = re.compile(r"\r\n|\n|\r")
_TOKEN = re.compile(r"\|?[^\W_]+(?:['’|][^\W_]+)*\|?")
_LETTERS = r"[^\W\d_]"
# a stroke may be a letter misread
_CUT = re.compile(rf"([^\W_|][^\W_]*(?:\|[^\W_]*)*)([{HYPHENS}])[ \t]*(\n|[ \t])[ \t]*((?:[^\W_]|\|)+)")
_PAGE = re.compile(r"(?:[-–—\[(]\s*)?(?:(?:page|p\.|pp?)\s*)?(?:\d{1,5}|[ivxlc]{1,7}|[A-Z]\d{1,5})(?:\s+(?:of|/)\s+\d{1,5})?(?:\s*[-–—\])])?", re.I)
_ROMAN = re.compile(r"x{0,4}(ix|iv|v?i{0,3})|x?l?x{0,3}(ix|iv|v?i{0,3})|c{0,3}x?l?x{0,3}(ix|iv|v?i{0,3})", re.I)
_SPACED = re.compile(r"(?:\S {1,3}){4,}\S")
_NAME = r"[A-ZÀ-ÖØ-ÞĀ-Ž][\w'’-]*"
_HEADERS = [
    re.compile(rf"(?:{_NAME} )?{_NAME}(?: (?:and|&) {_NAME})? et al\."),  # names of the authors
    re.compile(rf"{_NAME}: .{{3,60}} [/|] ?\d+"),
    re.compile(r"(?:\S+ ){1,9}\S+(?: {2,}|\t)\d{1,5}"),  # title, gap, page
    re.compile(r"\d{1,5}(?: {2,}|\t)(?:\S+ ){1,9}\S+"),
    re.compile(r"(?:\S+ ){1,9}\S+, Vol\. \d+(?:, No\. \d+)?"),
    re.compile(r"(?:[A-Z]\w*\. ){2,6}\d{1,4} \(\d{4}\)"),
]


class Vocabulary:
    """Counts of words and hyphenated compounds of the corpus, and the vectors of frequent words."""

    def __init__(self, words: dict[str, tuple[int, int]], compounds: dict[str, int], parts: dict[str, int], vectors: dict[str, np.ndarray], texts: int) -> None:
        # words: folded form -> (occurrences in lower case, occurrences capitalised); parts: what stands after a hyphen
        self.words, self.compounds, self.parts, self.vectors, self.texts = words, compounds, parts, vectors, max(1, texts)
        self.back: dict[str, list[str]] = {}
        for pair in MISREADINGS.split():
            meant, read = pair.split(">")
            self.back.setdefault(read, []).append(meant)
        self.memo: dict[str, list[str]] = {}

    def count(self, word: str) -> int:
        return sum(self.words.get(word.lower(), (0, 0)))

    def meant(self, word: str) -> list[str]:
        """Known words that one misreading turns into ``word`` (or two, where digits stand in it)."""
        found = self._step(word)
        known = [w for w in found if self._suits(w, word)]
        if not known and any(c.isdigit() for c in word):
            known = [v for w in found for v in self._step(w) if self._suits(v, word)]
        return sorted(set(known))

    def options(self, word: str) -> list[str]:
        """``meant``; for a known word only those that are TIMES as frequent, in capitalised use too if it is capitalised."""
        own = self.count(word)
        if not own:
            return self.meant(word)
        if word not in self.memo:
            cap = self.words[word.lower()][1] if word[:1].isupper() else 0
            self.memo[word] = [m for m in self.meant(word) if self.count(m) >= TIMES * own and self.words[m.lower()][1] >= TIMES * cap]
        return self.memo[word]

    def _step(self, word: str) -> set[str]:
        out = set()
        for i in range(len(word)):
            for size in (1, 2):
                for m in self.back.get(word[i : i + size], ()) if i + size <= len(word) else ():
                    out.add(word[:i] + m + word[i + size :])
        return out

    def _suits(self, new: str, old: str) -> bool:
        if any(c.isdigit() for c in new) or len(new) < 3:
            return False
        if any(c.isupper() for c in new[1:]) and not any(c.isupper() for c in old[1:]):
            return False
        low, cap = self.words.get(new.lower(), (0, 0))
        # a capitalised word may be a name, and slips in names are no noise
        if old[:1].isupper() and not old.isupper():
            return low > 0 or cap >= NOUN_SHARE * self.texts
        return low > 0 or old.isupper() and cap >= NOUN_SHARE * self.texts


def _is_page(line: str) -> bool:
    if not _PAGE.fullmatch(line):
        return False
    letters = re.sub(r"[\W\d_]", "", re.sub(r"(?i)page|pp?\.|of", "", line))
    return len(letters) <= 1 or bool(_ROMAN.fullmatch(letters))


def _is_header(line: str, others_upper: bool) -> bool:
    if _SPACED.fullmatch(line) and re.sub(r"\W", "", line).isalpha() and line.upper() == line:
        return True
    words = re.findall(rf"{_LETTERS}{{2,}}", line)
    if len(words) >= 2 and line.upper() == line and not others_upper and not line.endswith((".", ",")):
        return True
    if not any(p.fullmatch(line) for p in _HEADERS):
        return False
    # of the words that carry meaning all begin with a capital
    return all(w[0].isupper() or w in ("of", "on", "in", "the", "and", "for", "et", "al", "de", "des", "du", "der", "und", "y") for w in words)


def furniture(lines: list[str]) -> list[str | None]:
    """For each line None, ``header`` or ``page_number``.

    A short line of running text ends a paragraph; a number that could not
    have stood on the line before it is a wrapped part of the text.
    """
    if len(lines) < 2:
        return [None] * len(lines)
    bare = [x.strip() for x in lines]
    kinds: list[str | None] = []
    upper = sum(x.isupper() for x in bare)
    for i, x in enumerate(bare):
        kind = None
        if _is_page(x):
            kind = "page_number"
        elif _is_header(x, upper - x.isupper() > (len(bare) - 1) / 2):
            kind = "header"
        kinds.append(kind)
    width = max((len(x) for x, k in zip(bare, kinds, strict=True) if k is None), default=0)
    last = len(bare) - 1
    if kinds[last] == "page_number" and re.fullmatch(r"\W*\d{4}\W*|[ivx]+", bare[last]):
        before = next((i for i in range(last - 1, -1, -1) if kinds[i] is None), None)
        year = re.fullmatch(r"(1[89]|20)\d\d", bare[last])
        if before is not None and year and len(bare[before]) + 5 > width:
            kinds[last] = None
    if all(k is not None for k in kinds):
        return [None] * len(lines)
    return kinds


def _own_hyphen(a: str, b: str, v: Vocabulary) -> bool:
    """Does the hyphen between ``a`` and ``b`` belong to the word?"""
    joined, compound = v.count(a + b), v.compounds.get(f"{a}-{b}".lower(), 0)
    if compound or joined:
        return compound >= joined
    if b[:1].isupper() and not a.isupper():
        return True
    return v.parts.get(b.lower(), 0) > 0 and v.count(b) > 0


def _context(words: list[str], at: int, v: Vocabulary) -> np.ndarray | None:
    near = [v.vectors[w] for w in (x.lower() for x in words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]) if w in v.vectors]
    if not near:
        return None
    total = np.sum(near, axis=0)
    size = np.linalg.norm(total)
    return total / size if size else None


def repair(text: str, v: Vocabulary) -> tuple[str, list[str]]:
    """The repaired text and the kinds of noise found in it, sorted."""
    kinds: set[str] = set()
    lines = _LINES.split(text)
    marks = furniture(lines)
    kinds.update(m for m in marks if m)
    kept = "\n".join(x for x, m in zip(lines, marks, strict=True) if m is None)

    def join(m: re.Match) -> str:
        a, mark, gap, b = m.groups()
        if not (re.search(_LETTERS, a) and re.search(_LETTERS, b)):
            return m.group()
        if gap != "\n" and mark == "-" and not v.count(a + b) and not v.compounds.get(f"{a}-{b}".lower()):
            return m.group()  # a space after a hyphen is common enough in itself
        if mark == "-" and _own_hyphen(a, b, v) or mark != "-" and v.compounds.get(f"{a}-{b}".lower(), 0) > v.count(a + b):
            return f"{a}-{b}"
        kinds.add("hyphenation")
        return a + b

    before = None
    while before != kept:  # a word may end one cut and begin the next
        before, kept = kept, _CUT.sub(join, kept)
    out = "\n\n".join(re.sub(r"[ \t]*\n[ \t]*", " ", p) for p in re.split(r"\n[ \t]*\n", kept)) if len(lines) > 1 else kept
    if len(lines) > 1:
        out = out.strip(" \t\n")
    tokens = list(_TOKEN.finditer(out))
    words = [t.group() for t in tokens]
    pieces, at = [], 0
    for k, t in enumerate(tokens):
        w = words[k]
        if len(w) < 3 or w.isdigit():
            continue
        options = v.options(w)
        if not options:
            continue
        around = _context(words, k, v)
        digits = any(c.isdigit() for c in w)
        least = LEAST_FIT
        if v.count(w) >= OWN_COUNT and around is not None and w.lower() in v.vectors:
            least = max(least, float(v.vectors[w.lower()] @ around) - OWN_MARGIN)
        best, top = None, -1e9
        for o in options:
            fit = float(v.vectors[o.lower()] @ around) if around is not None and o.lower() in v.vectors else 0.0
            if not digits and fit < least:
                continue
            score = np.log(v.count(o)) + FIT_WEIGHT * fit + 0.01 * o.islower()
            if score > top:
                best, top = o, score
        if best is not None:
            kinds.add("misread")
            pieces += [out[at : t.start()], best]
            at = t.end()
    pieces.append(out[at:])
    return "".join(pieces), sorted(kinds)


def vocabulary(texts: DataFrame, column: str = "text", seed: int = 5) -> Vocabulary:
    """Counts over all rows of ``texts`` and vectors of the frequent words; what is kept is bounded by the shares above."""
    flat = texts.where(F.col(column).isNotNull()).select(F.regexp_replace(F.col(column), r"\s+", " ").alias("t"))
    n = flat.count()
    least = max(KNOWN_TEXTS, int(KNOWN_SHARE * n))
    word = F.explode(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{Nd}]+(?:['’][\p{L}\p{Nd}]+)*"), F.lit(0))).alias("w")
    seen = flat.select(word).where(~F.col("w").rlike(r"\p{Nd}")).groupBy("w").count()
    low = F.col("w") == F.lower("w")
    folded = seen.groupBy(F.lower("w").alias("f")).agg(F.sum(F.when(low, F.col("count")).otherwise(0)).alias("low"), F.sum(F.when(low, 0).otherwise(F.col("count"))).alias("cap"))
    words = {r.f: (r.low if r.low >= least else 0, r.cap) for r in folded.where(F.col("low") + F.col("cap") >= least).toLocalIterator()}
    part = F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+-\p{L}+"), F.lit(0))).alias("w")
    pairs = cut(flat.select(part).groupBy("w").count(), "compounds")
    compounds = {r.w: r["count"] for r in pairs.where(F.col("count") >= least).toLocalIterator()}
    second = pairs.groupBy(F.substring_index("w", "-", -1).alias("w")).agg(F.sum("count").alias("n"))
    parts = {r.w: r.n for r in second.where(F.col("n") >= least).toLocalIterator()}
    vectors: dict[str, np.ndarray] = {}
    often = max(KNOWN_TEXTS, int(VECTOR_SHARE * n))
    if any(a + b >= often for a, b in words.values()):
        tokens = flat.select(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
        model = Word2Vec(vectorSize=VECTOR_SIZE, windowSize=WINDOW, minCount=often, maxIter=1, numPartitions=max(1, min(8, n // 20_000)), seed=seed, inputCol="words", outputCol="v").fit(tokens)
        for r in model.getVectors().toLocalIterator():
            x = np.array(r.vector, dtype=np.float32)
            size = np.linalg.norm(x)
            if size:
                vectors[r.word] = x / size
    return Vocabulary(words, compounds, parts, vectors, n)


def repaired(df: DataFrame, key: str, text: str, vocab: Vocabulary | None = None) -> DataFrame:
    """``key, text, kinds``: each row's repaired text and the sorted kinds of noise that were in it.

    Kinds are ``hyphenation``, ``misread``, ``header`` and ``page_number``. A
    null text gives null and no kinds, an empty one stays empty; repeated rows
    stay; blank lines between paragraphs stay as one; texts count whole.
    Without ``vocab`` the words of ``df`` itself are learned.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    if vocab is None:
        vocab = vocabulary(rows, "t")
    box = spark.sparkContext.broadcast(vocab)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = box.value
        for part in parts:
            done = [(None, []) if x is None else repair(x, v) for x in part.tolist()]
            yield pd.DataFrame({"text": [x for x, _ in done], "kinds": [k for _, k in done]})

    fix = F.pandas_udf(_typed(run), "struct<text:string,kinds:array<string>>")
    return rows.withColumn("f", fix("t")).select(F.col("k").alias(key), F.col("f.text").alias(text), F.col("f.kinds").alias("kinds"))


def _typed(f):
    f.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return f


def repaired_fields(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``field_name, row_id, text, kinds``: ``repaired`` for the texts of several tables, given as (field name, table, key, text column); the vocabulary is learned from all together."""
    rows = None
    for name, df, key, text in tables:
        part = df.select(F.lit(name).alias("field_name"), F.col(key).cast("string").alias("row_id"), F.col(text).cast("string").alias("t"))
        rows = part if rows is None else rows.unionAll(part)
    found = repaired(rows.select(F.struct("field_name", "row_id").alias("k"), "t"), "k", "t", vocabulary(rows, "t"))
    return found.select("k.field_name", "k.row_id", F.col("t").alias("text"), "kinds")


def noise(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``field_name, row_id, kind`` for the texts of several tables, given as for ``repaired_fields``."""
    return repaired_fields(tables).select("field_name", "row_id", F.explode("kinds").alias("kind")).distinct()
