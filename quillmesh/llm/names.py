"""Parsing of names as people type them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from quillmesh.llm.confusables import own_form

# Words of a name that tell no person apart.
TITLES = frozenset("dr prof professor phd md msc mr mrs ms jr sr ii iii iv dphil".split())
PARTICLES = frozenset("van von der den de del della di da la le du al el ter ten zu af av mc mac o bin ibn dos das do y".split())
#: Letters without decomposition, and what they are typed as.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
#: Words that only names of organisations have, in full or as their abbreviations.
BODIES = {
    "university": "univ", "univ": "univ", "institute": "inst", "inst": "inst", "department": "dept", "dept": "dept", "laboratory": "lab", "lab": "lab", "laboratories": "lab",
    "centre": "cent", "center": "cent", "ctr": "cent", "cent": "cent", "collaboration": "coll", "collab": "coll", "consortium": "cons", "society": "soc", "soc": "soc", "academy": "acad", "acad": "acad",
    "group": "group", "team": "team", "school": "school", "faculty": "fac", "fac": "fac", "network": "netw", "association": "assoc", "college": "college", "hospital": "hosp", "museum": "museum",
}
WORD = re.compile(r"[^\W\d_]+(?:['’`][^\W\d_]+)*")


@lru_cache(maxsize=200_000)
def fold(word: str) -> str:
    """Lower case without accents; spelled-out umlauts and doubled a's fall together with the plain letter."""
    x = unicodedata.normalize("NFD", word.casefold().translate(PLAIN))
    x = "".join(c for c in x if unicodedata.category(c)[0] == "L")
    return x.replace("oe", "o").replace("ae", "a").replace("ue", "u").replace("aa", "a")


def is_body(name: str) -> bool:
    """Is this the name of an organisation?"""
    words = [w.casefold() for w in WORD.findall(own_form(name))]
    return len(words) >= 3 and any(w in BODIES for w in words)


def parse(name: str) -> tuple[list[str], list[str], str]:
    """Long words in order, long words that must be the family name, and initials.

    The family name is known before a comma, beside initials, or in capitals;
    it is empty where the order is open. Particles and titles are left out;
    apostrophes and hyphens join parts; particles glued to a name with a
    capital are split off.
    """
    text = own_form(name)
    text = re.sub(r"\b((?:van|von|der|den|de|di|la|al|du)+)(?=[A-ZÀ-Ž])", lambda m: " ".join(re.findall("van|von|der|den|de|di|la|al|du", m.group())) + " ", text)
    sides = text.split(",")
    typed: list[tuple[str, int]] = []
    for side, part in enumerate(sides):
        part = re.sub(r"(?<=[^\W\d_])[-‐‑](?=[^\W\d_])", " ", part)
        typed += [(w, side) for w in WORD.findall(part)]
    typed = [(w, s) for w, s in typed if w.casefold().rstrip(".") not in TITLES]
    long_, family, initials = [], [], ""
    upper_mix = any(w.isupper() and len(w) > 3 for w, _ in typed) and any(not w.isupper() for w, _ in typed)
    plain = len({s for _, s in typed}) > 1
    for k, (w, side) in enumerate(typed):
        bare = re.sub(r"^(?:[oO]|[dD])['’`]", "", w)
        f = fold(bare)
        if len(w) == 1 or (w.isupper() and len(w) <= 3 and not upper_mix_only(typed) and (side > 0 or not plain)):
            initials += "".join(fold(c) or c.casefold() for c in w)
            continue
        if f in PARTICLES or not f:
            continue
        long_.append(f)
        if plain and side == 0 or upper_mix and w.isupper() and len(w) > 3:
            family.append(f)
    if not family and initials and not plain:
        family = list(long_) if len(long_) == 1 else []
    return long_, family, initials


def upper_mix_only(typed: list[tuple[str, int]]) -> bool:
    return all(w.isupper() for w, _ in typed) and any(len(w) > 3 for w, _ in typed) and not any(len(w) <= 3 for w, _ in typed)
