"""Bibliography entries and citation contexts out of JATS, TEI, LaTeX and BibTeX."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import ship

MOST_CONTEXT = 1000
SCHEMA = "doc string, reference_id string, ordinal int, cited boolean, evidence string, raw_text string, title string, authors array<string>, year int, doi string, venue string, volume string, issue string, pages string, callouts int, context string, section string"
#: What a parser gives of each entry, in order.
NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")][1:]
_DOI = re.compile(r"10\.\d{4,9}/[^\s\"<>{}]+", re.I)
_YEAR = re.compile(r"\b([12]\d{3})\b")
_TAG_NAME = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
_text = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""


def safe_xml(source: str) -> ET.Element:
    """Parse XML that declares no entities; a plain external DOCTYPE is dropped."""
    if re.search(r"<!ENTITY", source, re.I) or re.search(r"<!DOCTYPE[^>]*\[", source, re.I):
        raise ValueError("entity declarations are refused")
    return ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", source, flags=re.I))


def _doi(x: str | None) -> str | None:
    m = _DOI.search(x or "")
    return m.group().rstrip(".,;)").lower() if m else None


def _year(x: str | None) -> int | None:
    m = _YEAR.search(x or "")
    return int(m.group(1)) if m else None


def _row(rid, ordinal, callouts, raw, title=None, authors=(), year=None, doi=None, venue=None, volume=None, issue=None, pages=None, context=None, section=None, verified=True):
    cited = callouts > 0
    return (rid, ordinal, cited, "verified_anchor" if cited and verified else "bibliography_only", raw, title or None, list(authors), year, doi, venue or None, volume or None, issue or None, pages or None, callouts, context, section)


def _anchors(root: ET.Element, tag: str, attribute: str, wanted) -> tuple[Counter, dict[str, tuple[str, str | None]]]:
    """Callouts per target, and the first passage and section each stands in."""
    parent = {c: p for p in root.iter() for c in p}
    count: Counter = Counter()
    where: dict[str, tuple[str, str | None]] = {}
    for a in root.iter():
        if _TAG_NAME(a) != tag or not wanted(a):
            continue
        box = a
        while box in parent and _TAG_NAME(box) not in ("p", "caption", "note"):
            box = parent[box]
        if _TAG_NAME(box) not in ("p", "caption", "note"):
            box = a
        up, section = a, None
        while up in parent and section is None:
            up = parent[up]
            if _TAG_NAME(up) in ("sec", "div"):
                section = next((_text(c) for c in up if _TAG_NAME(c) in ("title", "head")), None)
        for target in a.attrib.get(attribute, "").split():
            target = target.lstrip("#")
            count[target] += 1
            where.setdefault(target, ((_text(box) or _text(a) or "[citation anchor]")[:MOST_CONTEXT], section or None))
    return count, where


def _find(e: ET.Element, name: str, **having: str) -> ET.Element | None:
    return next((x for x in e.iter() if _TAG_NAME(x) == name and all(x.attrib.get(k) == v for k, v in having.items())), None)


def jats(source: str) -> list[tuple]:
    root = safe_xml(source)
    count, where = _anchors(root, "xref", "rid", lambda a: a.attrib.get("ref-type") == "bibr")
    out = []
    for k, e in enumerate((x for x in root.iter() if _TAG_NAME(x) == "ref"), 1):
        rid = e.attrib.get("id") or f"ref-{k}"
        names = []
        for n in e.iter():
            if _TAG_NAME(n) in ("name", "string-name"):
                parts = [_text(_find(n, "given-names")), _text(_find(n, "surname"))]
                names.append(" ".join(p for p in parts if p) or _text(n))
            elif _TAG_NAME(n) == "collab":
                names.append(_text(n))
        first, last = _text(_find(e, "fpage")), _text(_find(e, "lpage"))
        ident = next((x for x in e.iter() if _TAG_NAME(x) == "pub-id" and x.attrib.get("pub-id-type") == "doi"), None)
        out.append(_row(rid, k, count[rid], _text(e), _text(_find(e, "article-title")), [n for n in names if n], _year(_text(_find(e, "year"))), _doi(_text(ident)), _text(_find(e, "source")), _text(_find(e, "volume")), _text(_find(e, "issue")), f"{first}-{last}" if first and last else first, *where.get(rid, (None, None))))
    return out


def tei(source: str) -> list[tuple]:
    root = safe_xml(source)
    count, where = _anchors(root, "ref", "target", lambda a: a.attrib.get("type") == "bibr")
    out = []
    for k, e in enumerate((x for x in root.iter() if _TAG_NAME(x) == "biblStruct"), 1):
        rid = e.attrib.get("{http://www.w3.org/XML/1998/namespace}id") or f"ref-{k}"
        names = []
        for n in e.iter():
            if _TAG_NAME(n) == "persName":
                names.append(" ".join(_text(x) for x in n if _TAG_NAME(x) in ("forename", "surname") and _text(x)))
        title = _find(e, "title", level="a")
        venue = _find(e, "title", level="j") if _find(e, "title", level="j") is not None else _find(e, "title", level="m")
        date = _find(e, "date")
        pages = next((x for x in e.iter() if _TAG_NAME(x) == "biblScope" and x.attrib.get("unit") == "page"), None)
        span = "" if pages is None else "-".join(x for x in (pages.attrib.get("from"), pages.attrib.get("to")) if x) or _text(pages)
        ident = next((x for x in e.iter() if _TAG_NAME(x) == "idno" and x.attrib.get("type", "").lower() == "doi"), None)
        when = None if date is None else date.attrib.get("when") or _text(date)
        out.append(_row(rid, k, count[rid], _text(e), _text(title), [n for n in names if n], _year(when), _doi(_text(ident)), _text(venue), _text(_find(e, "biblScope", unit="volume")), _text(_find(e, "biblScope", unit="issue")), span, *where.get(rid, (None, None))))
    return out


_CITE = re.compile(r"\\[a-zA-Z]*cite[a-zA-Z]*\*?(?:\s*\[[^\]]*\])*\s*\{([^}]*)\}")
_ITEM = re.compile(r"\\bibitem(?:\s*\[[^\]]*\])?\s*\{([^}]*)\}(.*?)(?=\\bibitem|\\end\{thebibliography\}|\Z)", re.S)
_SECTION = re.compile(r"\\(?:sub)*section\*?\{([^}]*)\}")


def plain_latex(x: str) -> str:
    x = re.sub(r"(?<!\\)%.*", "", x)
    x = re.sub(r"\\[a-zA-Z]+\*?\s*(?:\[[^\]]*\])?", " ", x)
    return " ".join(re.sub(r"[{}~]", " ", x).replace("\\", " ").split())


def latex(source: str) -> list[tuple]:
    source = re.sub(r"(?<!\\)%.*", "", source)
    count: Counter = Counter()
    where: dict[str, tuple[str, str | None]] = {}
    heads = [(m.start(), plain_latex(m.group(1))) for m in _SECTION.finditer(source)]
    for m in _CITE.finditer(source):
        left, right = source.rfind("\n\n", 0, m.start()), source.find("\n\n", m.end())
        passage = plain_latex(_SECTION.sub(" ", source[left + 1 : right if right >= 0 else len(source)]))[:MOST_CONTEXT]
        section = next((h for at, h in reversed(heads) if at < m.start()), None)
        for t in (x.strip() for x in m.group(1).split(",")):
            if t:
                count[t] += 1
                where.setdefault(t, (passage, section))
    return [_row(m.group(1).strip(), k, count[m.group(1).strip()], plain_latex(m.group(2)), year=_year(m.group(2)), doi=_doi(m.group(2)), context=where.get(m.group(1).strip(), (None, None))[0], section=where.get(m.group(1).strip(), (None, None))[1]) for k, m in enumerate(_ITEM.finditer(source), 1)]


def _balanced(source: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; quotes and braces nest, a backslash hides a character."""
    close = {"{": "}", "(": ")"}[source[at]]
    depth, quoted, i = 0, False, at
    while i < len(source):
        c = source[i]
        if c == "\\":
            i += 1
        elif c == '"' and depth == 1:
            quoted = not quoted
        elif c == "{" or c == source[at] and not quoted:
            depth += 1
        elif (c == "}" or c == close and depth == 1) and not quoted or c == "}":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    raise ValueError("unbalanced entry")


_ENTRY = re.compile(r"@(\w+)\s*([{(])")
_FIELD = re.compile(r"\s*([\w-]+)\s*=\s*")


def _value(body: str, at: int) -> tuple[str, int]:
    """A field's value from ``at`` on, its parts (braced, quoted or bare, with ``#`` between) put together, and the place after it."""
    parts = []
    while True:
        while body[at : at + 1].isspace():
            at += 1
        if body[at : at + 1] == "{":
            end = _balanced(body, at)
            part = body[at + 1 : end - 1]
        elif body[at : at + 1] == '"':
            end, depth = at + 1, 0
            while end < len(body) and (body[end] != '"' or depth):
                depth += (body[end] == "{") - (body[end] == "}")
                end += 2 if body[end] == "\\" else 1
            if end >= len(body):
                raise ValueError("unbalanced value")
            part, end = body[at + 1 : end], end + 1
        else:
            end = min((k for k in (body.find(",", at), body.find("#", at)) if k >= 0), default=len(body))
            part = body[at:end].rstrip()
        parts.append(part)
        mark = re.compile(r"\s*#").match(body, end)
        if not mark:
            return "".join(parts), end
        at = mark.end()


def _bibtex(source: str) -> tuple[list[tuple], list[tuple[str | None, str]]]:
    """The entries, and what was wrong with some as ``key, kind``; of entries with one key the first counts."""
    out, wrong, seen, at, k = [], [], set(), 0, 0
    while m := _ENTRY.search(source, at):
        at = _balanced(source, m.end() - 1)
        if m.group(1).lower() in ("comment", "preamble", "string"):
            continue
        k += 1
        key, comma, rest = source[m.end() : at - 1].partition(",")
        key = key.strip()
        if not comma or not key:
            wrong.append((key or None, "no_key_or_fields"))
            continue
        if key in seen:
            wrong.append((key, "duplicate_key"))
            continue
        seen.add(key)
        fields: dict[str, str] = {}
        pos = 0
        while pos < len(rest) and rest[pos:].strip():
            f = _FIELD.match(rest, pos)
            if f:
                value, pos = _value(rest, f.end())
                fields[f.group(1).lower()] = plain_latex(value)
            else:
                wrong.append((key, "malformed_field"))
            pos = rest.find(",", pos) + 1 or len(rest)
        names = [n.strip() for n in re.split(r"\s+and\s+", fields.get("author", ""), flags=re.I) if n.strip()]
        pages = re.sub(r"-{2,}", "-", fields.get("pages", ""))
        out.append(_row(key, k, 0, " ".join(source[m.start() : at].split()), fields.get("title"), names, _year(fields.get("year")), _doi(fields.get("doi")) or _doi(fields.get("url")) or _doi(source[m.start() : at]), fields.get("journal") or fields.get("booktitle"), fields.get("volume"), fields.get("number"), pages))
    return out, wrong


def bibtex(source: str) -> list[tuple]:
    return _bibtex(source)[0]


PARSERS = {"jats": jats, "tei": tei, "latex": latex, "bibtex": bibtex}


def dangling(fmt: str, source: str) -> list[str]:
    """Targets that the text calls out and the bibliography lacks, sorted."""
    if fmt == "latex":
        source = re.sub(r"(?<!\\)%.*", "", source)
        called = {t.strip() for m in _CITE.finditer(source) for t in m.group(1).split(",") if t.strip()}
    elif fmt == "jats":
        called = set(_anchors(safe_xml(source), "xref", "rid", lambda a: a.attrib.get("ref-type") == "bibr")[0])
    elif fmt == "tei":
        called = set(_anchors(safe_xml(source), "ref", "target", lambda a: a.attrib.get("type") == "bibr")[0])
    else:
        called = set()
    return sorted(called - {r[0] for r in PARSERS[fmt](source)})


def warnings(documents: DataFrame) -> DataFrame:
    """``doc, reference_id, kind``: callouts without entry, entries never called out, and faulty entries of ``documents`` (``doc, format, content``). Documents that can't be parsed give none."""
    ship(documents.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, fmt, content in zip(part.doc, part.format, part.content, strict=True):
                try:
                    rows += [(doc, r[0], "uncited_reference") for r in PARSERS[fmt](content or "") if not r[2]]
                    rows += [(doc, t, "dangling_callout") for t in dangling(fmt, content or "")]
                    rows += [(doc, key, kind) for key, kind in (_bibtex(content or "")[1] if fmt == "bibtex" else [])]
                except (ValueError, KeyError, ET.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["doc", "reference_id", "kind"])

    return documents.select("doc", "format", "content").mapInPandas(run, "doc string, reference_id string, kind string")


def extracted(documents: DataFrame, include_uncited: bool = False) -> DataFrame:
    """Bibliography rows of ``documents`` (``doc, format, content``); those never called out only with ``include_uncited`` (BibTeX has no callouts and keeps all).

    A document that can't be parsed gives one row with evidence ``failed`` and the reason as ``raw_text``.
    """
    ship(documents.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, fmt, content in zip(part.doc, part.format, part.content, strict=True):
                try:
                    found = PARSERS[fmt](content or "")
                except (ValueError, KeyError, ET.ParseError) as e:
                    found = [(None, 0, False, "failed", str(e), None, [], None, None, None, None, None, None, 0, None, None)]
                rows += [(doc, *r) for r in found if include_uncited or r[2] or fmt == "bibtex" or r[3] == "failed"]
            yield pd.DataFrame(rows, columns=["doc", *NAMES]).astype({"year": "Int32"})

    return documents.select("doc", "format", "content").mapInPandas(run, SCHEMA)
