"""Identifiers of works: one written form for each, and the way each source asks for one.

An identifier comes bare, after its prefix, or as an address. Addresses are
taken apart into host, path and query first; what is left must have the shape
that the scheme's public rules give it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it; keeps generated code small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def unquoted(c: Column) -> Column:
    """Percent escapes decoded; a plus sign stays, as it is no space here; what can't be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _part(x: Column, what: str, host: str, www: bool = True) -> Column:
    """The path or query of a web address at ``host``; null for anything else."""
    at = F.lower(F.try_parse_url(x, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(x, F.lit("PROTOCOL")))
    here = at.isin(host, f"www.{host}") if www else at == host
    return F.when(here & scheme.isin("http", "https"), F.try_parse_url(x, F.lit(what)))


def _without_prefix(x: Column, *names: str) -> Column:
    """``x`` without one of the ``names`` and a colon before it, in any case."""
    head = F.lower(F.split_part(x, F.lit(":"), F.lit(1)))
    return F.when(F.contains(x, F.lit(":")) & head.isin(*names), F.ltrim(F.substring(x, F.length(head) + 2, F.length(x)))).otherwise(x)


def doi(c: Column | str) -> Column:
    """A DOI without resolver and prefix, in lower case, or null."""
    x = unquoted(F.trim(_col(c)))
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)^https?://(?:dx\.)?doi\.org/", ""), r"(?i)^doi:\s*", "")
    x = F.lower(F.regexp_replace(x, r"[.,;)]+$", ""))
    return F.when(x.rlike(r"^10\.\d{4,9}/\S+$"), x)


def openalex(c: Column | str) -> Column:
    """A work number of the open catalogue, ``W`` and digits, or null."""
    found = F.regexp_extract(F.trim(_col(c)), r"(?i)^(?:https?://openalex\.org/)?(W\d+)$", 1)
    return F.when(found != "", F.upper(found))


def arxiv(c: Column | str, version: bool = True) -> Column:
    """A preprint number, with or without its version, or null.

    Since 2007 numbers are four digits, a full stop and four or five digits;
    before, an archive (with a subject class) and seven digits.
    """
    def ending(bare: Column) -> Column:
        return let(F.when(F.endswith(bare, F.lit(".pdf")), F.left(bare, F.length(bare) - 4)).otherwise(bare), split)

    def split(bare: Column) -> Column:
        shaped = lambda stem: stem.rlike(r"^\d{4}\.\d{4,5}$") | stem.rlike(r"^[a-z-]+(\.[a-z]{2})?/\d{7}$")
        return let(F.regexp_replace(bare, r"v\d+$", ""), lambda stem: F.when(shaped(stem), bare if version else stem))

    def page(x: Column) -> Column:
        whole = F.try_parse_url(x, F.lit("QUERY")).isNull() & F.try_parse_url(x, F.lit("REF")).isNull()
        return let(_part(x, "PATH", "arxiv.org", www=False), lambda path: F.when(whole & path.rlike("^/(abs|pdf)/"), F.substring(path, 6, 200)))

    return let(let(F.trim(_col(c)), lambda x: F.lower(F.when(F.contains(x, F.lit("://")), page(x)).otherwise(_without_prefix(x, "arxiv")))), ending)


def openreview(c: Column | str) -> Column:
    """A note or forum of the review platform, or null. The id stands in the query of an address."""
    def asked(x: Column) -> Column:
        return F.when(_part(x, "PATH", "openreview.net").isin("/forum", "/pdf"), unquoted(F.try_parse_url(x, F.lit("QUERY"), F.lit("id"))))

    bare = let(unquoted(F.trim(_col(c))), lambda x: F.when(F.contains(x, F.lit("://")), asked(x)).otherwise(_without_prefix(x, "openreview")))
    return let(bare, lambda x: F.when(F.length(x).between(3, 128) & ~x.rlike(r"[^A-Za-z0-9_~-]"), x))


def acl(c: Column | str) -> Column:
    """A number of the Anthology from itself, its address or its DOI, or null.

    Until 2019 a volume letter, two digits of the year, and four digits; since
    then year, venue and volume, and number, separated by full stops.
    """
    def named(x: Column) -> Column:
        file_ = F.split_part(_part(x, "PATH", "aclanthology.org"), F.lit("/"), F.lit(2))
        return F.when(F.contains(x, F.lit("://")), F.regexp_replace(file_, r"\.(pdf|xml|bib)$", "")).otherwise(_without_prefix(x, "acl", "acl_anthology"))

    def of_doi(x: Column) -> Column:
        return let(doi(x), lambda d: F.when(F.startswith(d, F.lit("10.18653/v1/")), F.substring(d, 13, 200)))

    def shaped(x: Column) -> Column:
        pieces = F.split(x, r"\.")
        old = x.rlike(r"^[A-Za-z]\d{2}-\d{4}$")
        new = (F.size(pieces) == 3) & F.get(pieces, F.lit(0)).rlike(r"^\d{4}$") & F.get(pieces, F.lit(1)).rlike(r"^[A-Za-z0-9-]+$") & F.get(pieces, F.lit(2)).rlike(r"^\d+$")
        return F.when(old, F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 200))).when(new, F.lower(x))

    return let(let(unquoted(F.trim(_col(c))), lambda x: F.coalesce(of_doi(x), named(x))), shaped)


# What each source is asked for, given any identifier


def semantic_scholar_key(c: Column | str) -> Column:
    """``DOI:``, ``ARXIV:`` or ``PMID:`` and the identifier; anything else as it is."""
    def key(x: Column) -> Column:
        number = let(_without_prefix(x, "pmid"), lambda n: F.when(n.rlike(r"^\d+$"), n))
        return F.coalesce(F.concat(F.lit("DOI:"), doi(x)), F.concat(F.lit("ARXIV:"), arxiv(x, False)), F.concat(F.lit("PMID:"), number), x)

    return let(F.trim(_col(c)), key)


def europe_pmc_key(c: Column | str) -> Column:
    """``SOURCE:id``: a prefixed record, a number of the index (``MED``) or of the archive (``PMC``), or null."""
    x = F.trim(_col(c))
    own = F.when(F.lower(F.split_part(x, F.lit(":"), F.lit(1))) == "europe_pmc", F.substring(x, 12, 500))
    source, rest = F.split_part(own, F.lit(":"), F.lit(1)), F.regexp_extract(own, r"^[^:]*:(.+)$", 1)
    digits = F.regexp_extract(x, r"(?i)^(?:pmid:)?(\d+)$", 1)
    archive = F.regexp_extract(x, r"(?i)^(?:pmcid:)?(pmc\d+)$", 1)
    return F.when((source != "") & (rest != ""), F.concat(F.upper(source), F.lit(":"), rest)).when(digits != "", F.concat(F.lit("MED:"), digits)).when(archive != "", F.concat(F.lit("PMC:"), F.upper(archive)))


def ads_query(c: Column | str) -> Column:
    """The field and quoted value to search the astrophysics index for."""
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))

    def bare(x: Column) -> Column:
        path = _part(x, "PATH", "ui.adsabs.harvard.edu", www=False)
        return F.when(F.startswith(path, F.lit("/abs/")), F.split_part(path, F.lit("/"), F.lit(3))).otherwise(x)

    def asked(x: Column) -> Column:
        code = F.when(F.startswith(x, F.lit("ads:")), F.substring(x, 5, 200))
        d = doi(x)
        preprint = F.coalesce(F.when(F.startswith(d, F.lit("10.48550/arxiv.")), arxiv(F.substring(d, 16, 60), False)), arxiv(x, False))
        return F.coalesce(F.concat(F.lit("bibcode:"), quoted(code)), F.concat(F.lit("identifier:"), quoted(F.concat(F.lit("arXiv:"), preprint))), F.concat(F.lit("doi:"), quoted(d)), F.concat(F.lit("identifier:"), quoted(x)))

    return let(let(unquoted(F.trim(_col(c))), bare), asked)


def opencitations_key(c: Column | str) -> Column:
    """``doi:``, ``pmid:`` or ``omid:`` and the identifier, or null."""
    x = F.lower(F.trim(_col(c)))
    return F.coalesce(F.concat(F.lit("doi:"), doi(c)), F.when(x.rlike(r"^(pmid|omid):."), x))


def openaire_key(c: Column | str) -> Column:
    """The persistent identifier without prefix, or null."""
    x = F.trim(_col(c))
    bare = _without_prefix(x, "pmid", "pmcid")
    return F.coalesce(doi(x), arxiv(x, False), F.when((bare != x) & (bare != ""), bare))


def preferred(schemes: Column | str) -> Column:
    """The claim (``struct<scheme,value>``) of an array that most other sources understand, earlier ones first among equals."""
    # Fixed value: schemes in the order in which they carry a work from one source to another.
    order = "doi arxiv pmid pmcid omid dblp inspire openreview acl_anthology openaire openalex semantic_scholar crossref google_scholar".split()
    known = F.array(*[F.lit(s) for s in order])
    x = _col(schemes)
    placed = F.transform(x, lambda s, i: F.struct(F.array_position(known, s["scheme"]).alias("place"), i.alias("i"), s.alias("claim")))
    return F.get(F.array_sort(F.filter(placed, lambda p: p["place"] > 0)), F.lit(0))["claim"]
