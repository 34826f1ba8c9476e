import unicodedata

import pytest

from quillmesh.llm.confusables import consistent, look_alikes, own_form, skeleton


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [
        ("Мirela Οkwаgаwе", "Mirela Okwagawe"),
        ("Ｕｌｄｅｓｔｏｖ， ＡＡ", "Uldestov, AA"),
        ("no​vak­ P﻿i", "novak Pi"),
        ("Eldrodottir Marta　K", "Eldrodottir Marta K"),
        ("Göran", "Göran"),
        ("Étude".replace("É", "Е́"), "Étude"),
        ("Pravohoﬀ", "Pravohoff"),
        ("Åaberg K", "Åaberg K"),
        ("И. Tумбудищук", "И. Тумбудищук"),
        ("Χρυσoπετρέλλης Άvvα", "Χρυσοπετρέλλης Άννα"),
        ("А high-order approach", "A high-order approach"),
    ],
)
def test_stand_ins(dirty, clean):
    assert own_form(dirty) == clean
    assert skeleton(dirty) == skeleton(clean)


@pytest.mark.parametrize("text", ["", "plain", "Дарья Зимбудилев", "Μαρία Θαλαπετρέλλης", "А. Белтовоский", "α-exobelium in CO₂ flows", "Α-GALICORASE RETRIEVAL", "{α}-x", "Łucja Börn", "1990–2020", "“x” — x²", "β decay of Żx"])
def test_no_case(text):
    assert own_form(text) == text


def test_skeleton_is_stable():
    for text in ("Gо̂ran", "ﬁ", "a" * 50_000 + "​", "Ṩ"):
        assert skeleton(skeleton(text)) == skeleton(text)
        assert unicodedata.normalize("NFD", skeleton(text)) == skeleton(text)


def test_groups_nulls_ties_and_clashing_names(spark):
    rows = [("1", "Mei O", 0), ("2", "Меі О", 0), ("3", "Mei O", 0), ("4", None, 0), ("5", "", 0), ("5", "", 0), (None, "Мarta", 0), ("6", "Рост", 0)]
    df = spark.createDataFrame(rows, "id string, name string, form int")
    got = {(r.id, r.name): r.form for r in consistent(df, "id", "name").collect()}
    assert got == {("1", "Mei O"): "Mei O", ("2", "Меі О"): "Mei O", ("3", "Mei O"): "Mei O", ("4", None): None, ("5", ""): "", (None, "Мarta"): "Marta", ("6", "Рост"): "Рост"}
    assert sorted(str(r.id) for r in look_alikes(df, "id", "name").collect()) == ["2", "None"]
    assert look_alikes(df.limit(0), "id", "name").collect() == []
