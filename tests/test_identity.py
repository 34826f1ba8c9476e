import random
from datetime import datetime

from pyspark.sql import functions as F

from quillmesh.operators import identity as I


def claims(spark, rows):
    return spark.createDataFrame(rows, "record_id string, scheme string, value string")


def records(spark, ids):
    return spark.createDataFrame([(i, i) for i in ids], "record_id string, ord string")


def resolved(spark, ids, rows, events=None):
    ev = None if events is None else spark.createDataFrame([(a, b, x, datetime(2030, 1, 1 + k)) for k, (a, b, x) in enumerate(events)], "left_id string, right_id string, action string, created_at timestamp")
    return {r.record_id: r.canonical_id for r in I.resolve(records(spark, ids), claims(spark, rows), ev).collect()}


def test_cases(spark):
    rows = [("a", "doi", "10.1234/A"), ("b", "doi", "https://doi.org/10.1234/a"), ("c", "doi", "10.1234/paper.v1"), ("d", "doi", "10.1234/paper.v2"), ("e", "arxiv", "2101.00001v2"), ("f", "doi", "10.48550/arXiv.2101.00001"), ("g", "doi", "10.1234/paper.1"), ("h", "doi", "10.1234/paper.2")]
    got = resolved(spark, "abcdefgh", rows)
    assert got == dict(zip("abcdefgh", "aacceegh", strict=True))
    assert resolved(spark, "ab", rows[:2], [("b", "a", "split")]) == {"a": "a", "b": "b"}
    assert resolved(spark, "agh", rows[:1] + rows[6:], [("a", "z", "merge")])["a"] == "a"
    bridge = [("p", "pmid", "111"), ("p", "doi", "10.1234/x"), ("q", "doi", "10.1234/x"), ("q", "arxiv", "2101.00002"), ("r", "arxiv", "2101.00002"), ("r", "pmid", "222")]
    assert resolved(spark, "pqr", bridge) == {"p": "p", "q": "p", "r": "r"}
    d = {(r.left_id, r.right_id): r.decision for r in I.decisions(records(spark, "ab"), claims(spark, rows)).collect()}
    assert d == {("a", "b"): "must_link"}


def loop(ids, rows):
    sets = {i: {} for i in ids}
    for i, s, v in rows:
        sets[i].setdefault(s, set()).add(v)
    group = {i: [i] for i in ids}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if group[i] is group[j] or not any(sets[i].get(s, set()) & sets[j].get(s, set()) for s in sets[i]):
                continue
            if any(sets[x][s] != sets[y][s] for x in group[i] for y in group[j] for s in sets[x].keys() & sets[y].keys()):
                continue
            both = group[i] + group[j]
            for x in both:
                group[x] = both
    return {i: min(group[i]) for i in ids}


def test_replay_equals_the_sequential_loop(spark):
    rng = random.Random(3)
    ids = [f"r{k:03}" for k in range(120)]
    rows = sorted({(i, s, str(rng.randrange(45))) for i in ids for s in ("pmid", "pmcid") if rng.random() < 0.7})
    assert resolved(spark, ids, rows) == loop(ids, rows)


def reviewed_loop(ids, rows, events):
    """All pairs in order, as the reference goes through them."""
    sets = {i: {} for i in ids}
    for i, s, v in rows:
        sets[i].setdefault(s, set()).add(v)
    group, whole = {i: i for i in ids}, {i: {s: set(v) for s, v in sets[i].items()} for i in ids}
    said = {frozenset(x[:2]): x[2:] for x in events}

    def conflict(p, q):
        return any(p[s] != q[s] for s in p.keys() & q.keys())

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            action, relation = said.get(frozenset((i, j)), ("", ""))
            if action in ("split", "defer") or relation == "different_work":
                continue
            merge = action == "merge" and relation == "same_manifestation"
            shared = any(sets[i].get(s, set()) & v for s, v in sets[j].items())
            p, q = sorted((group[i], group[j]))
            if not merge and not shared or p == q or conflict(sets[i], sets[j]) or any(len(v) > 1 for x in (i, j) for v in sets[x].values()) or not merge and conflict(whole[p], whole[q]):
                continue
            for s, v in whole[q].items():
                whole[p].setdefault(s, set()).update(v)
            group = {x: p if g == q else g for x, g in group.items()}
    return group


def test_reviewed_merges_and_large_components(spark):
    rng = random.Random(5)
    ids = [f"r{k:03}" for k in range(140)]
    rows = sorted({(i, s, str(rng.randrange(40))) for i in ids for s in ("pmid", "pmcid", "pmid") if rng.random() < 0.4})
    kinds = [("merge", "same_manifestation")] * 6 + [("merge", "version_of"), ("split", "different_work"), ("defer", "same_manifestation"), ("merge", "different_work")]
    events = [(*rng.sample(ids, 2), *rng.choice(kinds)) for _ in range(110)] + [(ids[k], ids[k + 1], "merge", "same_manifestation") for k in range(0, 30, 3)]
    ev = spark.createDataFrame([(*x, datetime(2030, 1, 1, 0, k // 60, k % 60)) for k, x in enumerate(events)], "left_id string, right_id string, action string, relation string, created_at timestamp")
    got = {r.record_id: r.canonical_id for r in I.resolve(records(spark, ids), claims(spark, rows), ev).collect()}
    want = reviewed_loop(ids, rows, events)
    assert got == want and len(set(want.values())) < len(set(loop(ids, rows).values()))
    many = [f"m{k:04}" for k in range(2500)]
    got = resolved(spark, many, [(i, "pmid", "7") for i in many])
    assert set(got.values()) == {"m0000"} and len(got) == 2500
    got = resolved(spark, many, [(i, "pmid", "7") for i in many] + [(many[-1], "pmcid", "1"), (many[5], "pmcid", "2")])
    assert {got[i] for i in many[:-1]} == {"m0000"} and got[many[-1]] == many[-1]


def test_merge_view_and_titles(spark):
    df = spark.createDataFrame([("a", None, "T1", None, "V", 1, "u"), ("b", "w", "T2", "text", None, 2, None)], "record_id string, work_family_id string, title string, abstract string, venue string, publication_year int, landing_page_url string")
    groups = spark.createDataFrame([("a", "a"), ("b", "a")], "record_id string, root string")
    (m,) = I.merged(df, groups).collect()
    assert (m.title, m.abstract, m.venue, m.publication_year, m.sources) == ("T1", "text", "V", 1, 2)
    view = {r.record_id: r for r in I.entity_view(df).collect()}
    assert view["a"].basis == "singleton" and view["b"].artifact_id is None and view["a"].work_id != view["b"].work_id
    assert I.title_ratio("Same  Title!", "same title") == 1.0
    likes = spark.createDataFrame([("a", "Linear limits of cryogonome retrieval", 2020), ("b", "Linear limits of cryogonome retrieval", 2020), ("c", "Something else about birds", 2020)], "record_id string, title string, publication_year int")
    none = spark.createDataFrame([], "record_id string, author_position int, name string"), spark.createDataFrame([], "record_id string, scheme string, value string")
    assert [(r.left_id, r.right_id, r.score) for r in I.review_pairs(likes.withColumn("publication_date", F.lit(None).cast("date")), *none).collect()] == [("a", "b", 0.9)]


def test_review_pairs_use_authors_and_leave_decided_pairs(spark):
    titles = {"a": "Drying of moss in winter", "b": "Drying of mosss in winter", "c": "Drying of moss in winter", "d": "Drying of moss in winter", "e": "Kilns"}
    records = spark.createDataFrame([(k, t, 2000, None) for k, t in titles.items()], "record_id string, title string, publication_year int, publication_date date")
    authors = spark.createDataFrame([("a", 1, "Una  Birk"), ("b", 1, "una birk"), ("c", 1, "Someone Else"), ("c", 2, "Another")], "record_id string, author_position int, name string")
    claims = spark.createDataFrame([("a", "doi", "10.5555/a"), ("d", "doi", "10.5555/d"), ("c", "doi", "10.5555/a")], "record_id string, scheme string, value string")
    got = {(r.left_id, r.right_id): r.score for r in I.review_pairs(records, authors, claims).collect()}
    ratio = I.title_ratio(titles["a"], titles["b"])
    want = {("a", "b"): 0.7 * ratio + 0.2 + 0.1, ("b", "d"): 0.7 * I.title_ratio(titles["b"], titles["d"]) + 0.1 + 0.1}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    assert I.review_pairs(records.limit(0), authors, claims).count() == 0


def shuffled(spark):
    """Rows written to shuffles so far, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    seen = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {seen.apply(k).stageId(): seen.apply(k).shuffleWriteRecords() for k in range(seen.size())}


def test_review_pairs_that_cannot_reach_the_score_are_not_made(spark):
    """Rows of one subject are as many pairs as their square; those of unlike authors, or with keys of one scheme, must not be written anywhere."""
    n = 300
    records = spark.createDataFrame([(f"r{k:03}", "Drying of moss in winter", 2000, None) for k in range(n)], "record_id string, title string, publication_year int, publication_date date")
    authors = spark.createDataFrame([(f"r{k:03}", 1, f"Author {k // 2 if k < 20 else k}") for k in range(n - 1)], "record_id string, author_position int, name string")
    claims = spark.createDataFrame([(f"r{k:03}", "pmid", str(k)) for k in (0, 1)], "record_id string, scheme string, value string")
    old = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables too large to broadcast
    try:
        got = {(r.left_id, r.right_id): r.score for r in I.review_pairs(records, authors, claims).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(f"r{k:03}", f"r{k + 1:03}"): 1.0 for k in range(2, 20, 2)} | {(f"r{k:03}", f"r{n - 1}"): 0.9 for k in range(n - 1)}
    assert got == want
    assert sum(v for k, v in shuffled(spark).items() if k not in old) < n * (n - 1) // 4
    assert I.review_pairs(records.limit(30), authors, claims, score=0.8 - 1e-6).count() == 30 * 29 // 2 - 1


def test_whole_canonical_records_and_families(spark):
    records = spark.createDataFrame([("a", "T", 2000, "V", None), ("b", "U", 2001, "W", "text"), ("c", None, None, None, "")], "record_id string, title string, publication_year int, venue string, abstract string")
    groups = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "record_id string, root string")
    authors = spark.createDataFrame([("a", 1, "X"), ("b", 2, "Z"), ("b", 1, "Y")], "record_id string, author_position int, name string")
    claims = spark.createDataFrame([("a", "doi", "1"), ("b", "doi", "1"), ("b", "pmid", "2")], "record_id string, scheme string, value string")
    sources = spark.createDataFrame([("a", "p", "1"), ("a", "p", "1"), ("b", "q", "2")], "record_id string, provider string, source_record_id string")
    got = {r.record_id: r for r in I.merged_whole(records, groups, authors, claims, sources).collect()}
    assert (got["a"].title, got["a"].abstract, got["a"].authors, got["a"].identifiers, got["a"].sources) == ("T", "text", ["Y", "Z"], ["doi=1", "pmid=2"], ["p:1", "q:2"]) and got["c"].authors is None
    import hashlib

    links = spark.createDataFrame([("m", "k"), ("l", "m"), ("z", None)], "a string, b string")
    assert {tuple(r) for r in I.version_families(links, "a", "b").collect()} == {(x, "k", "review-family:" + hashlib.sha256(b"k\0l\0m").hexdigest()[:24]) for x in "klm"}
