import numpy as np
import pytest

from quillmesh.llm import scans


@pytest.fixture(scope="module")
def vocab():
    common = "the density of accuracy depends on a model and we discuss limits statistical under under conditions compared with earlier work retrieval long term dependent time based in found morning configuration".split()
    words = {w: (900, 5) for w in common} | {"reviews": (0, 900), "results": (500, 100)}
    return scans.Vocabulary(words, {"long-term": 40, "time-dependent": 30}, {"term": 40, "dependent": 30, "based": 50}, {}, 1000)


@pytest.mark.parametrize(
    ("text", "clean", "kinds"),
    [
        ("We discuss the stat-\nistical model.", "We discuss the statistical model.", ["hyphenation"]),
        ("We discuss the stat¬\r\nistical model.", "We discuss the statistical model.", ["hyphenation"]),
        ("We discuss the stat- istical model.", "We discuss the statistical model.", ["hyphenation"]),
        ("the long-\nterm model and a filagarose-\nbased work", "the long-term model and a filagarose-based work", []),
        ("the model\ndepends on work", "the model depends on work", []),
        ("the den5ity cornpared with earl1er work", "the density compared with earlier work", ["misread"]),
        ("the mode| of uricler conditions", "the model of uricler conditions", ["misread"]),
        ("the model depends\n– 1064 –\non accuracy.", "the model depends on accuracy.", ["page_number"]),
        ("xiv\nthe model depends\non accuracy.", "the model depends on accuracy.", ["page_number"]),
        ("the model depends\nPage 6 of 8\non accuracy.", "the model depends on accuracy.", ["page_number"]),
        ("the model depends\nR E S E A R C H   A R T I C L E\non accuracy.", "the model depends on accuracy.", ["header"]),
        ("the model depends\nSkobemoto et al.\non accuracy.", "the model depends on accuracy.", ["header"]),
        ("the retri-\nQuarterly of Urban Hydrology    254\neval depends\nS19\non accuracy.", "the retrieval depends on accuracy.", ["header", "hyphenation", "page_number"]),
        ("REVIEWS OF SOIL\nthe model depends\non accuracy.", "the model depends on accuracy.", ["header"]),
        ("A model. In: Letters in Plasma Archaeology, pp. 823–849.\n2034", "A model. In: Letters in Plasma Archaeology, pp. 823–849. 2034", []),
        ("One model.\n\nThe work\nof accuracy.", "One model.\n\nThe work of accuracy.", []),
        ("H2O and k1", "H2O and k1", []),
        ("C. Harrn, 2019", "C. Harrn, 2019", []),
        ("", "", []),
        ("12", "12", []),
    ],
)
def test_repair(vocab, text, clean, kinds):
    assert scans.repair(text, vocab) == (clean, kinds)


def test_learned_from_the_corpus(spark):
    good = "the density of the model depends on the accuracy and the time-dependent structure of the sample"
    rows = [(str(k), good, None) for k in range(60)] + [("bad", "the dcnsity of the model dep-\nends on the accuracy\n- 12 -\nand the time-\ndependent structure", None), ("null", None, None), ("", "", None), ("bad", "x", None), ("long", (good + ". ") * 3000, None)]
    df = spark.createDataFrame(rows, "id string, text string, kinds string")
    got = {(r.id, r.text): list(r.kinds) for r in scans.repaired(df, "id", "text").collect()}
    assert got[("bad", "the density of the model depends on the accuracy and the time-dependent structure")] == ["hyphenation", "misread", "page_number"]
    assert got[("null", None)] == [] and got[("", "")] == [] and len([k for k in got if k[0] == "long"]) == 1
    found = scans.noise([("t", df, "id", "text")])
    assert sorted((r.row_id, r.kind) for r in found.collect()) == [("bad", k) for k in ("hyphenation", "misread", "page_number")]
    vocab = scans.vocabulary(df)
    assert "density" in vocab.vectors and "dcnsity" not in vocab.words


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert scans.repaired(df, "id", "text").collect() == []


def test_a_repeated_misreading_is_judged_by_its_neighbour():
    x, y = np.eye(2, dtype=np.float32)
    words = {"under": (9000, 40), "undcr": (90, 0), "can": (9000, 0), "con": (200, 0), "the": (9000, 0), "muchas": (300, 0), "farms": (300, 0), "forms": (60, 0), "harm": (9000, 0), "harrn": (0, 30), "conditions": (9000, 0)}
    vectors = {"under": x, "undcr": x, "can": x, "con": y, "the": x, "conditions": x, "muchas": y}
    v = scans.Vocabulary(words, {}, {}, vectors, 9000)
    assert scans.repair("the test undcr conditions", v) == ("the test under conditions", ["misread"])
    # a word that suits its surroundings, one whose neighbour is hardly more frequent, and a name
    for text in ("muchas con muchas", "the forms conditions", "C. Harrn, 2019"):
        assert scans.repair(text, v) == (text, [])


def test_a_repeated_misreading_in_a_larger_corpus(spark):
    good = "the density of the model depends on the accuracy of the sample"
    rows = [(str(k), good if k % 50 else good.replace("density", "dcnsity")) for k in range(600)]
    found = scans.noise([("t", spark.createDataFrame(rows, "id string, text string"), "id", "text")])
    assert sorted((r.row_id, r.kind) for r in found.collect()) == sorted((str(k), "misread") for k in range(0, 600, 50))


def test_both_fields_are_repaired_with_one_vocabulary(spark, tmp_path):
    from quillmesh.llm.queries import p2_found, p2_repaired

    good = "the density of the model depends on the accuracy of the sample"
    bad = good.replace("density", "den5ity")
    spark.createDataFrame([(f"r{k}", good) for k in range(60)] + [("r", bad)], "reference_key string, raw_text string").write.parquet(f"{tmp_path}/extracted_references.parquet")
    spark.createDataFrame([("c", bad), ("null", None)], "context_id string, text string").write.parquet(f"{tmp_path}/citation_contexts.parquet")
    got = {(r.field_name, r.row_id): (r.text, list(r.kinds)) for r in p2_repaired(spark, str(tmp_path)).collect()}
    assert len(got) == 63 and got[("raw_text", "r")] == got[("context_text", "c")] == (good, ["misread"]) and got[("context_text", "null")] == (None, [])
    found = {(r.field_name, r.row_id, r.kind) for r in p2_found(spark, str(tmp_path)).collect()}
    assert found == {(*k, x) for k, (_, kinds) in got.items() for x in kinds}
