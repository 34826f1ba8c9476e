"""Links between the rows of one author who appears under several spellings.

Organisations are the spellings whose place and whose subject words align by an
optimal assignment that allows for slips and shortened words. Other
names are cut into tokens; a symmetric-delete index (tokens that agree after
one letter is removed from each) finds the family names that a slip could
have turned into each other. Tokens of a name are then assigned to their
roles: family name, given name, initials, so that an initial or a short form
stands for the name it agrees with. Which spellings are short forms of which
given name is learned from the rows that share an identifier or a work.

Namesakes make equal names weak evidence, so rows are linked over keys of
family name, given name or initial, and a circumstance they share: an ORCID,
a work, a neighbour in the author list, a field. A key whose rows contradict
one another links only the rows that agree. Entities are the components over
all keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import lookup_join
from quillmesh.llm.confusables import own_form
from quillmesh.llm.contraction import linked_groups
from quillmesh.llm.names import BODIES, WORD, fold, is_body, parse
from quillmesh.operators.assignment import best_total
from quillmesh.session import cut, ship

#: Authors this many places away in one author list are neighbours.
NEAR = 8
#: A family name may be a slip for one this many times as frequent; from CLEAR_TIMES on a shared field is enough evidence.
SLIP_TIMES, CLEAR_TIMES = 1.3, 10
#: A given name stands beside at least this many others.
LEAST_PARTNERS = 4
#: A group of more rows than this is paired off in salted parts.
PART_ROWS = 1_000
#: Words without meaning in names of organisations.
FILL = frozenset("for of the f and on in".split())


def _body(name: str) -> bool:
    """Is this the name of an organisation, be it that the word for it has a slip?"""
    words = [w.casefold() for w in WORD.findall(own_form(name))]
    return is_body(name) or len(words) >= 4 and any(_kind(w) for w in words)


def _kind(word: str) -> bool:
    return word in BODIES or len(word) >= 7 and any(len(k) >= 8 and _one_slip(word, k) for k in BODIES)


def _body_parts(name: str) -> tuple[list[str], list[str]]:
    """The place (a list of one word, or none) and the subject words of an organisation's name, both as typed or shortened.

    The place stands after a comma, before the word for the kind of
    organisation, first where that word is last, or else last.
    """
    text = own_form(name)
    typed = [(w, side) for side, x in enumerate(text.split(",")) for w in WORD.findall(x)]
    typed = [(w, side) for w, side in typed if not (w.casefold() in FILL or len(w) <= 4 and (_one_slip(w.casefold(), "for") or _one_slip(w.casefold(), "the")) or (w.isupper() and len(w) <= 5 and not text.isupper()))]
    kinds = [k for k, (w, _) in enumerate(typed) if _kind(w.casefold())]
    rest = [k for k in range(len(typed)) if k not in kinds]
    if not rest:
        return [], []
    after = [k for k in rest if typed[k][1] > 0]
    before = [k for k in rest if kinds and k < kinds[0]]
    if after and len(after) < len(rest):
        among = after
    elif before and len(before) < len(rest):
        among = before
    else:
        among = rest[:1] if before else rest[-1:]
    place = max(among, key=lambda k: len(typed[k][0]))
    return [fold(typed[place][0])], [f for k in rest if k != place and (f := fold(typed[k][0]))]


def _parse(names: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in names:
        rows = []
        for n in part.tolist():
            if not n or not n.strip():
                rows.append((False, [], [], ""))
            elif _body(n):
                rows.append((True, *_body_parts(n), ""))
            else:
                rows.append((False, *parse(n)))
        yield pd.DataFrame(rows, columns=["body", "long", "family", "initials"])


def parsed(authors: DataFrame) -> DataFrame:
    """``id, record_id, pos, name, orcid, body, long, family, initials``, written once."""
    ship(authors.sparkSession)
    take = F.pandas_udf(_parse, "struct<body:boolean,long:array<string>,family:array<string>,initials:string>")
    bare = F.upper(F.regexp_replace("orcid", r"[^0-9Xx]", ""))
    rows = authors.where("author_id IS NOT NULL").dropDuplicates(["author_id"]).select(
        F.col("author_id").alias("id"), "record_id", F.coalesce("author_position", F.lit(0)).alias("pos"), "name",
        F.when(F.length(bare) >= 16, F.expr(f"right(upper(regexp_replace(orcid, '[^0-9Xx]', '')), 16)")).alias("orcid"), take("name").alias("p"),
    )
    return cut(rows.select("id", "record_id", "pos", "name", "orcid", "p.*"), "names")


def given_names(rows: DataFrame) -> list[str]:
    """Given names: tokens that stand beside many others, and mostly opposite the family name where it is known (a comma, capitals, initials).

    Given names come from a stock that grows far slower than the rows; the
    list of them is what each worker gets.
    """
    shown = rows.where("NOT body AND size(long) BETWEEN 2 AND 6").select("long", "family", F.explode("long").alias("t"))
    pairs = shown.select("t", F.explode("long").alias("o")).where("t <> o").distinct()
    degree = cut(pairs.groupBy("t").agg(F.count("*").alias("n")), "degree")
    side = shown.where("size(family) > 0").groupBy("t").agg(F.sum(F.array_contains("family", F.col("t")).cast("int")).alias("last"), F.count("*").alias("all"))
    found = degree.where(F.col("n") >= LEAST_PARTNERS).join(side, "t").where("length(t) > 1 AND all - last >= 2 AND all - last > 2 * last")
    return sorted(r.t for r in found.select("t").collect())


def _one_slip(a: str, b: str) -> bool:
    """Is one letter replaced, added, lost, or swapped with the next?"""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long_, short = (a, b) if len(a) > len(b) else (b, a)
    return long_[i + 1 :] == short[i:]


def _roles(given: frozenset[str]):
    deletes: dict[str, list[str]] = {}
    for g in given:
        if len(g) >= 4:
            for i in range(len(g)):
                deletes.setdefault(g[:i] + g[i + 1 :], []).append(g)
            deletes.setdefault(g, []).append(g)
    memo: dict[str, str | None] = {}

    def known(token: str) -> str | None:
        """The given name this token is, or a slip for."""
        if token in given:
            return token
        if token not in memo:
            near = {g for k in (token, *(token[:i] + token[i + 1 :] for i in range(len(token)))) for g in deletes.get(k, ())}
            near = {g for g in near if _one_slip(token, g)}
            memo[token] = near.pop() if len(near) == 1 and len(token) >= 4 else None
            if len(memo) > 500_000:
                memo.clear()
                return known(token)
        return memo[token]

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for body, long_, family, initials in parts:
            out = []
            for b, ts, fam, ini in zip(body, long_, family, initials, strict=True):
                ts, fam = list(ts), list(fam)
                if b:
                    out.append([(" ".join([*ts, *fam]), "#", "#", "")] if ts else [])
                    continue
                firsts = [] if not fam and len(ts) == 1 else [(t, known(t)) for t in ts if t not in fam]
                firsts = [(t, g) for t, g in firsts if g]
                last = fam or [t for t in ts if t not in {x for x, _ in firsts}]
                if not last and ts:  # all look like given names: a very common family name
                    last = [ts[-1], ts[0]] if len(ts) > 1 else ts
                    firsts = [(t, g) for t, g in firsts if t not in last] or firsts
                made = []
                for s in dict.fromkeys([*last, "".join(last)] if len(last) > 1 else last):
                    own = [g for t, g in firsts if t != s]
                    other = [t for t in ts if t != s and t not in last] or [t for t in ts if t != s and not fam]
                    g = own[0] if own else None
                    rest = "".join(x[0] for x in own[1:]) + ini
                    if g:
                        i, m = g[0], rest[:1]
                    elif ini:
                        i, m = ini[0], ini[1:2]
                    elif other and len(last) > 1 and not firsts:
                        g, i, m = other[0], other[0][0], ""  # a rare or misspelt given name
                    else:
                        i, m = "", ""
                    if i:
                        made.append((s, g, i, m))
                out.append(made)
            yield pd.Series(out)

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return run


def roles(rows: DataFrame, given: list[str]) -> DataFrame:
    """``id, s, g, i, m``: each reading of a row's name as family name, given name (null if only initialled), first and middle initial."""
    take = F.pandas_udf(_roles(frozenset(given)), "array<struct<s:string,g:string,i:string,m:string>>")
    return rows.withColumn("r", F.explode(take("body", "long", "family", "initials"))).select("id", "record_id", "pos", "orcid", "body", "initials", "r.*")


def _stands_for(a: str, b: str) -> bool:
    """Are the words equal, but for a slip, or is one the other shortened?"""
    if len(a) > len(b):
        a, b = b, a
    return a == b or _one_slip(a, b) or len(a) >= 3 and (b.startswith(a) or any(_one_slip(a, b[:n]) for n in range(len(a) - 1, len(a) + 2)))


def aligned(left: str, right: str) -> bool:
    """Can all words of both be assigned to one another so that each two are one word, a slip for it, or it shortened?"""
    a, b = left.split(), right.split()
    return len(a) == len(b) and (not a or best_total((i, j, 1.0) for i, x in enumerate(a) for j, y in enumerate(b) if _stands_for(x, y)) > len(a) - 0.5)


def _deletes(word: str):
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.col(word).substr(F.lit(1), k - 1), F.col(word).substr(k + 1, F.length(word)))), F.col(word)))


def organisations(rows: DataFrame) -> DataFrame:
    """``spelling, place, subject, label``: the organisation of each distinct spelling of place and subject.

    Candidates agree in the place, or in all but a letter removed from each;
    two spellings are one if place and subject words align.
    """
    body = rows.where("body AND size(long) > 0").select(F.col("long")[0].alias("place"), F.array_join("family", " ").alias("subject"))
    every = cut(body.distinct().withColumn("spelling", F.rtrim(F.concat_ws(" ", "place", "subject"))), "bodies")
    places = every.select("place").distinct()
    keyed = places.where("length(place) >= 5").select("place", F.explode(_deletes("place")).alias("d"))
    near = keyed.join(keyed.withColumnRenamed("place", "other"), "d").where("place < other AND levenshtein(place, other) <= 2").select("place", "other").distinct()
    near = near.unionAll(places.select("place", F.col("place").alias("other")))
    pairs = near.join(every.select("place", F.col("subject").alias("ls"), F.col("spelling").alias("a")), "place").join(every.select(F.col("place").alias("other"), F.col("subject").alias("rs"), F.col("spelling").alias("b")), "other")

    def agree(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for p, q, x, y in parts:
            yield pd.Series([(c == d or _one_slip(c, d)) and aligned(e, f) for c, d, e, f in zip(p, q, x, y, strict=True)], dtype="bool")

    agree.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    same = pairs.where("a <> b").where(F.pandas_udf(agree, "boolean")("place", "other", "ls", "rs")).select("a", "b")
    groups = linked_groups(same, "a", "b").withColumnRenamed("record_id", "spelling")
    return cut(every.join(groups, "spelling", "left").select("spelling", "place", "subject", F.coalesce("group_id", "spelling").alias("label")), "organisations")


def short_forms(read: DataFrame, works: DataFrame) -> DataFrame:
    """``g, full``: given names that mostly stand for another one, learned from rows of one family name with one ORCID or one place in one work."""
    by_orcid = read.where("NOT body AND g IS NOT NULL AND orcid IS NOT NULL").select("s", F.col("orcid").alias("c"), "g")
    by_work = read.where("NOT body AND g IS NOT NULL").join(works, "record_id").select("s", F.concat_ws("@", "work", "pos").alias("c"), "g")
    seen = by_orcid.unionAll(by_work).distinct()
    freq = read.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"))
    # of the spellings that share a circumstance, however many, each is paired with the most frequent one
    known = cut(seen.join(freq, "g"), "spellings")
    top = known.groupBy("s", "c").agg(F.max(F.struct("n", "g")).alias("t"), F.count("*").alias("k")).where("k > 1").select("s", "c", F.col("t.g").alias("full"))
    pairs = known.join(top, ["s", "c"]).where("g <> full").groupBy("g", "full").count()
    total = pairs.groupBy("g").agg(F.sum("count").alias("all"), F.max(F.struct("count", "full")).alias("top"))
    best = total.where("top.count >= 2 AND top.count >= 0.6 * all").select("g", F.col("top.full").alias("full"))
    best = best.join(freq, "g").join(freq.select(F.col("g").alias("full"), F.col("n").alias("n_full")), "full")
    return best.where("n_full > 2 * n").select("g", "full")


def slips(read: DataFrame) -> DataFrame:
    """``s, t, clear``: family name ``s`` and a more frequent one ``t`` that agrees with it after one letter is removed from each, and whether it is many times as frequent."""
    count = cut(read.where("length(s) >= 5").groupBy("s").agg(F.countDistinct("id").alias("n")), "tokens")
    keyed = count.select("s", "n", F.explode(_deletes("s")).alias("d"))
    common = keyed.where("n >= 2").select(F.col("s").alias("t"), F.col("n").alias("n_t"), "d")
    near = keyed.join(common, "d").where(F.col("n_t") >= SLIP_TIMES * F.col("n")).where("s <> t AND abs(length(s) - length(t)) <= 1")
    near = near.select("s", "t", (F.col("n_t") >= CLEAR_TIMES * F.col("n")).alias("clear")).distinct()
    return near.where(F.levenshtein("s", "t") <= 2)


def entities(authors: DataFrame, papers: DataFrame) -> DataFrame:
    """``id, name, group_id``: the entity of every authors row with an id.

    Rows with a null or blank name, or a name of initials only, stand alone.
    Repeated ids count once; papers without row, family or field give no
    circumstance; more columns do no harm; empty tables give no rows.
    """
    rows = parsed(authors)
    read = cut(roles(rows, given_names(rows)), "roles")
    about = papers.where("record_id IS NOT NULL").groupBy("record_id").agg(
        F.min("work_family_id").alias("work"),
        F.min(F.expr("array_max(transform(fields_of_study, x -> struct(length(x) AS n, x AS f)))")).getField("f").alias("field"),
    )
    works = about.where("work IS NOT NULL").select("record_id", "work")
    short = short_forms(read, works)
    read = read.join(short, "g", "left").withColumn("i", F.when(F.col("full").isNotNull(), F.substring("full", 1, 1)).otherwise(F.col("i"))).withColumn("g", F.coalesce("full", "g")).drop("full")
    # names of organisations also appear as a place beside the first letters of place, kind and subject
    known = organisations(rows)
    letters = known.select(F.col("place").alias("t"), "label", F.array_join(F.transform(F.split("subject", " "), lambda w: F.substring(w, 1, 1)), "").alias("letters")).where("letters <> ''").distinct()
    beside = F.concat(F.array_join(F.array_remove("long", F.col("t")), ""), F.col("initials"))
    short_names = rows.where("NOT body AND size(long) BETWEEN 1 AND 2").select("id", "initials", "long", F.explode("long").alias("t")).withColumn("beside", beside).where("length(beside) > 2")
    fits_in = F.col("beside").endswith(F.col("letters")) & (F.length("beside") == F.length("letters") + 2) & F.col("beside").startswith(F.substring("t", 1, 1))
    marked = short_names.join(letters, "t").where(fits_in).groupBy("id").agg(F.min("label").alias("s"), F.max("label").alias("other")).where("s = other").drop("other")
    marked = cut(marked, "marked")
    read = read.join(known.select(F.col("spelling").alias("s"), "label", F.lit(True).alias("body")), ["s", "body"], "left").withColumn("s", F.coalesce("label", "s"))
    cols = ["id", "record_id", "pos", "orcid", "s", "g", "i", "m", "body"]
    beside_place = rows.select("id", "record_id", "pos", "orcid").join(marked, "id").select("id", "record_id", "pos", "orcid", "s", *[F.lit("#").alias(c) for c in ("g", "i", "m")], F.lit(True).alias("body"))
    read = read.join(marked.select("id"), "id", "left_anti").select(*cols).unionByName(beside_place)
    hash_ = F.lit("#")
    read = cut(read.select("id", "record_id", "pos", "orcid", "s", *[F.when(F.col("body"), hash_).otherwise(F.col(c)).alias(c) for c in ("g", "i", "m")], "body").distinct(), "read")
    alias = read.where("NOT body").join(slips(read.where("NOT body")), "s").select("id", "record_id", "pos", "orcid", F.col("t").alias("s"), "g", "i", "m", "body", F.lit(False).alias("real"), "clear")
    every = cut(read.withColumn("real", F.lit(True)).withColumn("clear", F.lit(True)).unionByName(alias), "every")
    # neighbours in the author list, by blocks of positions so that endless lists stay linear
    block = F.floor(F.col("pos") / NEAR)
    here = read.select("record_id", "id", "pos", F.col("s").alias("other"), block.alias("b")).distinct()
    place = every.withColumn("b", F.explode(F.array(block - 1, block, block + 1)))
    near = place.join(here.withColumnRenamed("id", "oid").withColumnRenamed("pos", "opos"), ["record_id", "b"]).where(f"id <> oid AND abs(pos - opos) <= {NEAR}")
    base = every.join(about, "record_id", "left")
    cols = ["id", "s", "g", "i", "m", "orcid", "real"]
    seen = (
        near.select(*cols, F.lit(None).cast("string").alias("field"), F.concat(F.lit("n:"), "other").alias("c"))
        .unionByName(base.where("work IS NOT NULL").select(*cols, "field", F.concat(F.lit("w:"), "work").alias("c")))
        .unionByName(base.where("orcid IS NOT NULL").select(*cols, "field", F.concat(F.lit("o:"), "orcid").alias("c")))
        .unionByName(base.where("field IS NOT NULL AND (real OR clear AND g IS NOT NULL)").select(*cols, "field", F.concat(F.lit("f:"), "field").alias("c")))
        .unionByName(base.where("real").select(*cols, "field", F.lit("*").alias("c")))
    )
    seen = cut(seen.distinct(), "seen")
    groups = seen.groupBy("s", "i", "c").agg(
        F.count("*").alias("n"), F.max("real").alias("sure"), F.min("g").alias("g0"), F.max("g").alias("g1"),
        F.min(F.when(F.col("m") != "", F.col("m"))).alias("m0"), F.max(F.when(F.col("m") != "", F.col("m"))).alias("m1"),
        F.min(F.when(F.col("real"), F.col("orcid"))).alias("o0"), F.max(F.when(F.col("real"), F.col("orcid"))).alias("o1"), F.min("field").alias("f0"), F.max("field").alias("f1"),
    )
    one = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(True))
    tight = F.col("c").startswith("o:") | F.col("c").startswith("w:") | F.col("c").startswith("n:")
    groups = groups.where("n > 1 AND sure").withColumn("one_g", one("g0", "g1")).withColumn("one_m", one("m0", "m1")).withColumn("one_o", one("o0", "o1"))
    groups = groups.withColumn("usable", F.when(tight, F.lit(True)).when(F.col("c") == "*", (F.col("i") == "#") | (F.col("one_o") & one("f0", "f1") & F.col("one_m"))).otherwise(F.lit(True)))
    groups = groups.where("usable").select("s", "i", "c", "one_g", "one_m", "one_o")
    joined = seen.join(groups, ["s", "i", "c"])
    field_key = F.col("c").startswith("f:")
    part = F.concat_ws(
        "|",
        F.lit("k:"), "s", "i", "c",
        F.when(~F.col("one_g"), F.col("g")),
        F.when(~F.col("one_m"), F.concat(F.lit("m"), "m")),
        F.when(field_key & ~F.col("one_o"), F.concat(F.lit("o"), F.coalesce("orcid", F.lit("?"), "id"))),
    )
    # where given names differ, a row without one fits none; where middle initials differ, so does a row without, save in one work or under one ORCID
    fits = (F.col("one_g") | F.col("g").isNotNull()) & (F.col("one_m") | (F.col("m") != "")) & (~field_key | F.col("one_o") | F.col("orcid").isNotNull())
    edges = cut(joined.where(fits).select("id", part.alias("node")).distinct(), "links")
    firsts = edges.groupBy("node").agg(F.min("id").alias("first"))
    linked = linked_groups(lookup_join(edges, firsts, "node", edges.count()), "id", "first")
    return rows.select("id", "name").join(linked.withColumnRenamed("record_id", "id"), "id", "left").select("id", "name", F.coalesce("group_id", "id").alias("group_id"))


def variant_pairs(authors: DataFrame, papers: DataFrame) -> DataFrame:
    """``left_author_id, right_author_id``: each two rows of one entity whose names are not equal strings, smaller id first.

    The result is as large as the entities make it; a large entity is paired
    off in salted parts, so no task holds all of its pairs.
    """
    known = cut(entities(authors, papers).where("name IS NOT NULL"), "entities")
    size = known.groupBy("group_id").agg(F.count("*").alias("n"), F.countDistinct("name").alias("spellings")).where("spellings > 1")
    sized = known.join(size.select("group_id", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("k")), "group_id")
    left = sized.select("group_id", F.pmod(F.xxhash64("id"), F.col("k")).cast("int").alias("part"), F.col("id").alias("left_author_id"), F.col("name").alias("ln"))
    right = sized.select("group_id", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.col("id").alias("right_author_id"), F.col("name").alias("rn"))
    return left.join(right, ["group_id", "part"]).where("left_author_id < right_author_id AND ln <> rn").select("left_author_id", "right_author_id")
