"""Conservative identity of records across sources: strong keys link, conflicts part, titles only propose."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import lookup_join
from quillmesh.functions.text import casefold, stable_id, strong_key
from quillmesh.functions.text import collapse as normal
from quillmesh.operators.components import components
from quillmesh.session import cut, ship

def keys(claims: DataFrame) -> DataFrame:
    """``record_id, scheme, k``: distinct strong keys."""
    k = claims.select("record_id", strong_key(F.col("scheme"), F.col("value")).alias("k")).where("k IS NOT NULL").distinct()
    return k.select("record_id", F.split_part("k", F.lit(":"), F.lit(1)).alias("scheme"), "k")


def key_links(strong: DataFrame) -> DataFrame:
    """``a, b``: each record of a key with the first of that key, linear in the records."""
    first = strong.groupBy("k").agg(F.min("record_id").alias("a"))
    return strong.join(first, "k").where("record_id <> a").select("a", F.col("record_id").alias("b")).distinct()


def clusters(records: DataFrame, claims: DataFrame) -> DataFrame:
    """``record_id, root``: components over shared strong keys, before conflicts are looked at; records without partner are their own root."""
    found = components(key_links(keys(claims)), "a", "b")
    return records.select("record_id").distinct().join(found.withColumnRenamed("id", "record_id"), "record_id", "left").select("record_id", F.coalesce("root", "record_id").alias("root"))


def decisions(records: DataFrame, claims: DataFrame) -> DataFrame:
    """``left_id, right_id, decision``: for each pair joined by a key's first record, ``cannot_link`` if some scheme of both has unequal value sets, else ``must_link``."""
    strong = cut(keys(claims).join(records.select("record_id").distinct(), "record_id", "left_semi"), "keys")
    links = key_links(strong)
    sets = strong.groupBy("record_id", "scheme").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    both = links.join(sets.select(F.col("record_id").alias("a"), "scheme", F.col("ks").alias("ka")), "a").join(sets.select(F.col("record_id").alias("b"), "scheme", F.col("ks").alias("kb")), ["b", "scheme"])
    bad = both.groupBy("a", "b").agg(F.max((F.col("ka") != F.col("kb")).cast("int")).alias("bad"))
    return bad.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.when(F.col("bad") == 1, "cannot_link").otherwise("must_link").alias("decision"))


def resolve(records: DataFrame, claims: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """``record_id, canonical_id``: the greedy resolution in input order (``ord``), replayed inside each raw component.

    Pairs are tried in input order. Two records that share a strong key join
    unless the two or either by itself, or their groups as wholes, contradict in a
    scheme. A reviewer's merge joins unless the two or either by itself
    contradict; a split, a defer and the relation ``different_work`` keep the
    pair from being joined directly; a merge of versions leaves it to the
    keys. As joining only ever follows such links, components can be replayed
    apart with the same result as all records in one loop. ``reviewed`` has
    the active events: ``left_id, right_id, action`` (merge, split, defer),
    ``created_at``, and may have ``relation`` (``same_manifestation`` where
    missing) and ``event_id``; the latest of a pair counts.

    A component with at most one key in each scheme and no pair kept apart is
    one group, however large. Only the others are replayed, each in one task
    that tries the pairs with a common key or a merge: at worst as many as
    the square of the records of one key.
    """
    strong = keys(claims)
    links = key_links(strong)
    rev = None
    if reviewed is not None:
        col = lambda c, other: F.col(c) if c in reviewed.columns else F.lit(other)
        pair = reviewed.select(F.least("left_id", "right_id").alias("x"), F.greatest("left_id", "right_id").alias("y"), "action", col("relation", "same_manifestation").alias("relation"), "created_at", col("event_id", "").alias("event_id"))
        last = pair.where("x <> y").groupBy("x", "y").agg(F.max_by(F.struct("action", "relation"), F.struct("created_at", "event_id")).alias("e")).select("x", "y", "e.*")
        said_ = F.when((F.col("action").isin("split", "defer")) | (F.col("relation") == "different_work"), "apart").when((F.col("action") == "merge") & (F.col("relation") == "same_manifestation"), "merge")
        there = records.select("record_id").distinct()
        rev = last.select("x", "y", said_.alias("action")).where("action IS NOT NULL")
        rev = rev.join(there.withColumnRenamed("record_id", "x"), "x", "left_semi").join(there.withColumnRenamed("record_id", "y"), "y", "left_semi")
        rev = cut(rev, "reviewed")
        links = links.unionAll(rev.where("action = 'merge'").select("x", "y"))
    raw = components(links, "a", "b").withColumnRenamed("id", "record_id")
    alone = records.select("record_id", "ord").join(raw, "record_id", "left")
    member = alone.where("root IS NOT NULL")
    placed = strong.join(raw, "record_id")
    contested = placed.groupBy("root", "scheme").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("root")
    if rev is not None:
        contested = contested.unionAll(rev.where("action = 'apart'").join(raw.withColumnRenamed("record_id", "x"), "x").select("root"))
    contested = cut(contested.distinct(), "contested")
    plain = cut(member.join(contested, "root", "left_anti"), "plain")
    first = plain.groupBy("root").agg(F.min_by("record_id", F.struct("ord", "record_id")).alias("canonical_id"))
    settled = lookup_join(plain.select("root", "record_id"), first, "root", plain.count()).select("record_id", "canonical_id")
    member = member.join(contested, "root", "left_semi")
    own = strong.groupBy("record_id").agg(F.sort_array(F.collect_set(F.struct("scheme", "k"))).alias("ks"))
    rows = member.join(own, "record_id", "left")
    if rev is not None:
        said = rev.join(raw.select(F.col("record_id").alias("x"), "root"), "x").groupBy("x").agg(F.collect_list(F.struct("y", "action")).alias("rev"))
        rows = rows.join(said.withColumnRenamed("x", "record_id"), "record_id", "left")
    else:
        rows = rows.withColumn("rev", F.lit(None).cast("array<struct<y:string,action:string>>"))

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ord", "record_id"])
        ids = group.record_id.tolist()
        at = {x: i for i, x in enumerate(ids)}
        sets: list[dict[str, set]] = []
        holders: dict[str, list[int]] = {}
        for i, ks in enumerate(group.ks):
            by: dict[str, set] = {}
            for x in [] if ks is None else ks:
                by.setdefault(x["scheme"], set()).add(x["k"])
                holders.setdefault(x["k"], []).append(i)
            sets.append(by)
        said: list[dict[int, str]] = [{} for _ in ids]
        for i, rs in enumerate(group.rev):
            for r in [] if rs is None else rs:
                j = at.get(r["y"])
                if j is not None:
                    said[min(i, j)][max(i, j)] = r["action"]
        torn = [any(len(v) > 1 for v in s.values()) for s in sets]
        where, parts = list(range(len(ids))), [[i] for i in range(len(ids))]
        whole = [{s: set(v) for s, v in x.items()} for x in sets]

        def conflict(p: dict[str, set], q: dict[str, set]) -> bool:
            return any(p[s] != q[s] for s in p.keys() & q.keys())

        def join(i: int, j: int) -> None:
            low, high = sorted((where[i], where[j]), key=lambda w: parts[w][0])
            if len(parts[low]) < len(parts[high]):  # the smaller one moves; its first member stays first
                parts[low], parts[high] = [parts[low][0], *parts[high], *parts[low][1:]], []
                for x in parts[low]:
                    where[x] = low
            else:
                for x in parts[high]:
                    where[x] = low
                parts[low] += parts[high]
                parts[high] = []
            for s, v in whole[high].items():
                whole[low].setdefault(s, set()).update(v)

        for i in range(len(ids)):
            near = set(said[i])
            if not torn[i]:
                for v in sets[i].values():
                    for k in v:
                        near.update(j for j in holders[k] if j > i and where[j] != where[i])
            for j in sorted(near):
                action = said[i].get(j)
                if action == "apart" or where[i] == where[j] or torn[i] or torn[j] or conflict(sets[i], sets[j]):
                    continue
                if action == "merge" or any(sets[i][s] & sets[j][s] for s in sets[i].keys() & sets[j].keys()) and not conflict(whole[where[i]], whole[where[j]]):
                    join(i, j)
        return pd.DataFrame({"record_id": ids, "canonical_id": [ids[parts[w][0]] for w in where]})

    done = rows.select("root", "record_id", "ord", "ks", "rev").groupBy("root").applyInPandas(replay, "record_id string, canonical_id string")
    return done.unionByName(settled).unionByName(alone.where("root IS NULL").select("record_id", F.col("record_id").alias("canonical_id")))


def merged(records: DataFrame, groups: DataFrame) -> DataFrame:
    """One canonical record per ``root``: everything from its first record (smallest id), a missing abstract filled, sources united."""
    g = records.join(groups, "record_id").groupBy("root")
    first = lambda c: F.min_by(c, "record_id").alias(c)
    filled = F.min_by("abstract", F.when(F.col("abstract").isNotNull() & (F.col("abstract") != ""), F.col("record_id"))).alias("abstract")
    return g.agg(first("title"), first("publication_year"), first("venue"), filled, F.count("*").alias("sources")).withColumnRenamed("root", "record_id")


def entity_view(records: DataFrame) -> DataFrame:
    """Ids of the four layers: manifestation, version, work, artifact; a record without family is a singleton work."""
    family = F.coalesce("work_family_id", F.concat(F.lit("single:"), F.col("record_id")))
    return records.groupBy("record_id").agg(F.min("work_family_id").alias("work_family_id"), F.min("landing_page_url").alias("url")).select(
        stable_id("manifestation:", F.lit("manifestation"), "record_id").alias("manifestation_id"), stable_id("version:", F.lit("version"), "record_id").alias("version_id"),
        stable_id("work:", F.lit("work"), family).alias("work_id"), F.when(F.col("url").isNotNull(), stable_id("artifact:", F.lit("artifact"), "url")).alias("artifact_id"),
        F.when(F.col("work_family_id").isNull(), "singleton").otherwise("asserted").alias("basis"), "record_id",
    )


_TOKEN = re.compile(r"\w+")


def _title(x: str) -> str:
    return " ".join(_TOKEN.findall(unicodedata.normalize("NFKC", x).casefold()))


def title_ratio(left: str, right: str, autojunk: bool = True) -> float:
    """Share of matching blocks of the word sequences' text; not symmetric, so keep the earlier record left."""
    return difflib.SequenceMatcher(None, _title(left), _title(right), autojunk).ratio()


def merged_whole(records: DataFrame, groups: DataFrame, authors: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """One canonical record per ``root`` with all that its records hold.

    Fields come from the first record (smallest id), a missing abstract from
    the next that has one; the author list from the first record with the
    longest list; identifiers (``scheme=value``) and sources are united.
    """
    plain = merged(records, groups).drop("sources")
    lists = authors.where("name IS NOT NULL").groupBy("record_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("author_position", "name"))).alias("a"))
    longest = lists.join(groups, "record_id").groupBy(F.col("root").alias("record_id")).agg(F.min_by(F.transform("a", lambda x: x["name"]), F.struct((-F.col("n")).alias("m"), "record_id")).alias("authors"))
    united = lambda df, value, name: df.join(groups, "record_id").select(F.col("root").alias("record_id"), value.alias("x")).where("x IS NOT NULL").groupBy("record_id").agg(F.sort_array(F.collect_set("x")).alias(name))
    ids = united(claims, F.concat_ws("=", "scheme", "value"), "identifiers")
    seen = united(sources, F.concat_ws(":", "provider", "source_record_id"), "sources")
    return plain.join(longest, "record_id", "left").join(ids, "record_id", "left").join(seen, "record_id", "left")


def version_families(links: DataFrame, a: str, b: str) -> DataFrame:
    """``record_id, root, family``: records that reviewers linked as versions of one work, and the work's id: a hash of all its members in order."""
    found = cut(components(links, a, b).withColumnRenamed("id", "record_id"), "families")
    family = found.groupBy("root").agg(F.concat(F.lit("review-family:"), F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list("record_id")), "\0"), 256), 1, 24)).alias("family"))
    return lookup_join(found, family, "root", found.count(), "inner").select("record_id", "root", "family")


#: The schemes of strong keys, a bit each.
SCHEME_BITS = {"doi": 1, "arxiv": 2, "pmid": 4, "pmcid": 8}


def _year_agreement(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.5).when(gap > 1, 0.0).otherwise(0.5)


def author_similarity(a: Column, b: Column) -> Column:
    """Jaccard of two sets of names; a half where one is empty."""
    shared, united = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(F.coalesce(a, F.array())) > 0) & (F.size(F.coalesce(b, F.array())) > 0), shared / united).otherwise(0.5)


def review_pairs(records: DataFrame, authors: DataFrame, claims: DataFrame, least: float = 0.75, score: float = 0.82) -> DataFrame:
    """``left_id, right_id, ratio, score``: pairs of records with like titles that a person should look at.

    Candidates share the rarest two, the first and third, or the second and
    third rarest of the title words that stand in more than one title, so a
    misspelt word costs none. Seven parts of the score are the titles' ratio,
    two the authors', one the years'. Pairs with strong keys of one scheme
    are decided elsewhere, whether these are alike or not.

    What can't reach the score is never paired: without a common name, both
    sides having names, a pair has at most 0.8, so the names are part of the
    keys of those that have any; the schemes and the best score that years
    and names allow are looked at inside the join. Pairs with a side without
    names share the words only.
    """
    ship(records.sparkSession)
    names = authors.where("name IS NOT NULL").groupBy("record_id").agg(F.collect_set(casefold(normal("name"))).alias("names"))
    bit = F.coalesce(*[F.when(F.col("scheme") == s, b) for s, b in SCHEME_BITS.items()])
    held = keys(claims).groupBy("record_id").agg(F.bit_or(bit).alias("schemes"))
    year = F.coalesce("publication_year", F.year("publication_date")).alias("y")
    rows = records.where("title IS NOT NULL").select("record_id", "title", year).join(names, "record_id", "left").join(held, "record_id", "left")
    rows = cut(rows.select("record_id", "title", "y", "names", F.coalesce("schemes", F.lit(0)).alias("schemes"), F.monotonically_increasing_id().alias("i")), "titles")
    words = rows.select("i", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    freq = words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1")
    rare = words.join(freq, "w").groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "w"))), 1, 3).alias("r"))
    two = "concat_ws(' ', sort_array(array(get(r,{0}).w, get(r,{1}).w)))"
    ks = F.expr(f"transform(filter(array_distinct(array({two.format(0, 1)}, {two.format(0, 2)}, {two.format(1, 2)})), k -> k <> ''), k -> xxhash64(k))")
    own = rows.select("i", "y", "schemes", F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.xxhash64(x)).alias("ns"))
    traits = cut(rare.select("i", ks.alias("ks")).join(own, "i"), "traits")

    def paired(left: DataFrame, right: DataFrame, authors_at_most: float) -> DataFrame:
        both = left.select("k", F.col("i").alias("a"), F.col("y").alias("ya"), F.col("schemes").alias("sa")).join(right.select("k", F.col("i").alias("b"), F.col("y").alias("yb"), F.col("schemes").alias("sb")), "k")
        may = 0.7 + 0.2 * authors_at_most + 0.1 * _year_agreement(F.col("ya"), F.col("yb")) >= score - 1e-9
        return both.where((F.col("sa").bitwiseAND(F.col("sb")) == 0) & may & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")

    plain = traits.select("i", "y", "schemes", F.size("ns").alias("named"), F.explode("ks").alias("k"))
    if score > 0.8 + 1e-9:
        known = traits.select("i", "y", "schemes", "ks", F.explode("ns").alias("n")).select("i", "y", "schemes", "n", F.explode("ks").alias("k")).select("i", "y", "schemes", F.xxhash64("k", "n").alias("k"))
        pairs = paired(known, known, 1.0).unionAll(paired(plain.where("named = 0"), plain, 0.5)).distinct()
    else:
        pairs = paired(plain, plain, 1.0).distinct()
    both = pairs.join(rows.toDF("p", "pt", "py", "pa", "ps", "a").drop("ps"), "a").join(rows.toDF("q", "qt", "qy", "qa", "qs", "b").drop("qs"), "b").where("p <> q")
    both = both.where(F.least(F.length("pt"), F.length("qt")) >= 0.6 * F.greatest(F.length("pt"), F.length("qt")))
    rest = 0.2 * author_similarity(F.col("pa"), F.col("qa")) + 0.1 * _year_agreement(F.col("py"), F.col("qy"))
    both = both.where(0.7 + rest >= score - 1e-9)
    first = F.col("p") < F.col("q")
    # the ratio isn't symmetric: the earlier record is the left one
    side = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    both = both.select(side("p", "q").alias("left_id"), side("q", "p").alias("right_id"), side("pt", "qt").alias("lt"), side("qt", "pt").alias("rt"), author_similarity(F.col("pa"), F.col("qa")).alias("authors"), _year_agreement(F.col("py"), F.col("qy")).alias("near"))

    def judge(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([title_ratio(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")

    judge.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    out = both.withColumn("j", F.pandas_udf(judge, "double")("lt", "rt")).where(F.col("j") >= least)
    out = out.withColumn("score", 0.7 * F.col("j") + 0.2 * F.col("authors") + 0.1 * F.col("near")).where(F.col("score") >= score)
    return out.select("left_id", "right_id", F.round("j", 6).alias("ratio"), F.round("score", 6).alias("score"))
