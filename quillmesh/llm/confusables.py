"""One consistent form for strings that look alike but differ in their characters.

Skeleton: decompose, drop what can't be seen, replace every character by the
prototype of its look-alike class, decompose again. Strings with equal
skeletons look alike. Within such a group one form is chosen: each string is
first written in its own leading script, then the form most rows agree on
stands for all.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import lookup_join
from quillmesh.session import cut, ship

# Letters of other scripts that look like a Latin letter, Latin letter last.
CYRILLIC_LOOKS = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl"
GREEK_LOOKS = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϳj ιi"
#: Look-alikes only for skeletons, since the letters are mostly meant as themselves.
LOOSE_LOOKS = "αa ρp υu γy κk ηn σo τt вb кk мm нh тt ıi ȷj ɑa ɡg"
# Compatibility kinds whose characters look like their plain form.
SAME_LOOK_KINDS = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")
# Compatibility characters that do not look like their plain form.
KEPT = "…‥ªº™℠№µ"

#: Fixed value: the one space that shows.
OGHAM_SPACE = "\u1680"
#: Characters of other categories that show nothing.
BLANKS = "\u034f\u115f\u1160\u3164\uffa0\u2800"

_PAIRS = {"Cyrillic": dict(x for x in CYRILLIC_LOOKS.split()), "Greek": dict(x for x in GREEK_LOOKS.split())}
_TO_LATIN = {k: v for pairs in _PAIRS.values() for k, v in pairs.items()}
_FROM_LATIN = {script: {v: k for k, v in reversed(pairs.items())} for script, pairs in _PAIRS.items()}
_PROTOTYPE = {**{x[0]: unicodedata.normalize("NFD", x[1])[0] for x in LOOSE_LOOKS.split()}, **_TO_LATIN}
_WORD = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    if c.isascii():
        return "Latin" if c.isalpha() else ""
    if unicodedata.category(c)[0] != "L":
        return ""
    return {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek"}.get(unicodedata.name(c, "").split(" ")[0], "Other")


@lru_cache(maxsize=65536)
def _plain(c: str) -> str:
    """A character without its invisible or wide variant: nothing, a plain space, or the plain form of the same look."""
    if c in KEPT:
        return c
    kind = unicodedata.category(c)
    if kind == "Zs" and c != OGHAM_SPACE:
        return " "
    if kind == "Cf" or c in BLANKS or 0xFE00 <= ord(c) <= 0xFE0F:
        return ""
    shape = unicodedata.decomposition(c)
    if shape.startswith("<"):
        tag, *codes = shape.split(" ")
        if tag in SAME_LOOK_KINDS and not all(chr(int(x, 16)) == " " or unicodedata.category(chr(int(x, 16)))[0] == "M" for x in codes):
            return "".join(_plain(chr(int(x, 16))) for x in codes)
    return c


def skeleton(text: str) -> str:
    """Equal for strings that look alike; not meant to be read."""
    plain = text if text.isascii() else "".join(map(_plain, text))
    apart = unicodedata.normalize("NFD", plain)
    return unicodedata.normalize("NFD", "".join(_PROTOTYPE.get(c, c) for c in apart))


def _meant(word: str, after: str) -> bool:
    """Is this word of another script there as itself? A lone Greek letter before a hyphen is a prefix of a name."""
    return len(word) == 1 and _script(word) == "Greek" and after.lstrip("})]")[:1] == "-"


def own_form(text: str) -> str:
    """``text`` composed, without invisible and wide variants, each look-alike letter in the script its string is written in.

    The leading script is the one with most letters that no other script
    imitates, then the one with most letters, then Latin. A word in another
    script stays if it has a letter without look-alike, or is meant as itself.
    """
    if text.isascii():
        return text
    # composing first would hide the base letter of a look-alike with a combining accent
    plain = "".join(map(_plain, text))
    apart = unicodedata.normalize("NFD", plain)
    sure: dict[str, int] = {}
    any_: dict[str, int] = {}
    for c in apart:
        s = _script(c)
        if s:
            any_[s] = any_.get(s, 0) + 1
            alike = c in _TO_LATIN or s == "Latin" and any(c in m for m in _FROM_LATIN.values())
            sure[s] = sure.get(s, 0) + (not alike)
    if len(any_) < 2:
        return unicodedata.normalize("NFC", plain)
    lead = max(any_, key=lambda s: (sure[s], any_[s], s == "Latin"))
    composed = unicodedata.normalize("NFC", plain)
    out, at = [], 0
    for m in _WORD.finditer(composed):
        word = unicodedata.normalize("NFD", m.group())
        # a foreign word of its own stays as it is
        scripts = {_script(c) for c in word} - {""}
        turned = "".join(_turn(c, lead) for c in word)
        foreign = len(scripts) == 1 and lead not in scripts
        if foreign and (any(_script(c) not in ("", lead) for c in turned) or _meant(m.group(), composed[m.end() :])):
            turned = word
        out += [composed[at : m.start()], turned]
        at = m.end()
    out.append(composed[at:])
    return unicodedata.normalize("NFC", "".join(out))


def _turn(c: str, lead: str) -> str:
    s = _script(c)
    if s in ("", lead):
        return c
    latin = c if s == "Latin" else _TO_LATIN.get(c)
    if latin is None:
        return c
    return latin if lead == "Latin" else _FROM_LATIN.get(lead, {}).get(latin, c)


def _looks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        values = part.tolist()
        yield pd.DataFrame({"skeleton": [None if x is None else skeleton(x) for x in values], "own": [None if x is None else own_form(x) for x in values]})


def consistent(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, skeleton, form``: one row per row of ``df`` with the one form of all texts that look like it.

    A null text gives null for both, an empty one stays empty; repeated rows
    count as votes; among forms with equal votes the one in most plain
    characters, then the smallest, wins. Texts of any length are taken whole.
    Columns named like the results do no harm.
    """
    ship(df.sparkSession)
    looks = F.pandas_udf(_looks, "struct<skeleton:string,own:string>")
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    seen = cut(rows.withColumn("l", looks("t")).select("k", "t", "l.skeleton", "l.own"), "looks")
    votes = seen.where("skeleton IS NOT NULL").groupBy("skeleton", "own").count()
    plain = -(F.octet_length("own") - F.length("own"))
    groups = votes.groupBy("skeleton").agg(F.count("*").alias("forms"), F.min(F.struct((-F.col("count")).alias("c"), (-plain).alias("p"), "own")).alias("best"))
    chosen = groups.where("forms > 1").select("skeleton", F.col("best.own").alias("form"))
    joined = lookup_join(seen, chosen, "skeleton", seen.count())
    return joined.select(F.col("k").alias(key), F.col("t").alias(text), "skeleton", F.coalesce("form", "own").alias("form"))


def look_alikes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` of the rows whose text is not in the form of its group: some character stands in for another or can't be seen."""
    return consistent(df, key, text).where(F.col(text) != F.col("form")).select(key)
