import random

from quillmesh.llm import reading

EASY = ["the fish swim", "the grandmother likes elephants", "we saw a bird", "look at the wheel"]
HARD = ["the degeneracy subsumes the renormalisation", "qua trope the mark is mute", "no lattice lifts to a rigid coset", "the sheaf is flat"]


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        level = 1 if k % 2 else 4
        own, other = (EASY, HARD) if level == 1 else (HARD, EASY)
        parts = [rng.choice(own) for _ in range(rng.randrange(2, 7))] + ([rng.choice(other)] if rng.random() < 0.4 else [])
        rng.shuffle(parts)
        docs.append((k, ". ".join(parts) + "."))
        if k < 160:
            labels += [(k, "a", level), (k, "b", level if rng.random() < 0.85 else (2 if level == 1 else 3))]
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    rows = [(k, t, 0) for k, t in docs] + [(900, None, 0), (901, "", 0), (902, " \n　", 0), (903, "12 %", 0), (904, "The fish swim. " * 4000, 0), (905, docs[1][1], 0), (905, docs[1][1], 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, reading_level int")
    rated = spark.createDataFrame(labels + [(5000, "a", 2), (1, "c", None), (1, "a", 9), (1, "a", 1)], "doc_id bigint, rater string, reading_level int")
    got = reading.reading_levels(df, rated).collect()
    assert len(got) == len(docs) + 4 and not {900, 901, 902} & {r.doc_id for r in got}
    level = {r.doc_id: r.reading_level for r in got}
    held = [k for k, _ in docs if k >= 160]
    assert sum(level[k] == (1 if k % 2 else 4) for k in held) / len(held) >= 0.9
    assert level[904] == 1 and level[905] == level[1]


def test_without_labels_and_empty(spark):
    docs, _ = corpus(12)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, rater string, reading_level int")
    assert {r.reading_level for r in reading.reading_levels(df, none).collect()} <= {1, 2, 3, 4}
    assert reading.reading_levels(df.limit(0), none).collect() == []
    assert reading.profile(df.limit(0)).collect() == []


def test_familiar_words_and_formula(spark):
    df = spark.createDataFrame([(k, "The cat" if k % 10 else "the zygote. The THE") for k in range(100)], "doc_id bigint, text string")
    assert reading.familiar_words(df, 0.5) == ["cat", "the"]
    share, length, score = reading.formula(reading.sentences("The zygote sat! A cat; the cat"), frozenset(["the", "cat", "a"]))
    assert (share, length) == (2 / 7, 7 / 3) and abs(score - (15.79 * 2 / 7 + 0.0496 * 7 / 3)) < 1e-9
