import itertools

import pytest

from quillmesh.llm import variants
from quillmesh.llm.names import fold, is_body, parse


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Falbeström, M. K.", (["falbestrom"], ["falbestrom"], "mk")),
        ("Margaret Falbestroem", (["margaret", "falbestrom"], [], "")),
        ("FALBESTRÖM Margaret", (["falbestrom", "margaret"], ["falbestrom"], "")),
        ("Falbeström MK", (["falbestrom"], ["falbestrom"], "mk")),
        ("Dr. Freya vanderMerhathorpe, PhD", (["freya", "merhathorpe"], [], "")),
        ("Aino O'Heptaić", (["aino", "heptaic"], [], "")),
        ("Ｍ． Falbe​ström", (["falbestrom"], ["falbestrom"], "m")),
        ("Zoë Griruová-Ravsen", (["zo", "griruova", "ravsen"], [], "")),
        ("", ([], [], "")),
        ("A. B.", ([], [], "ab")),
    ],
)
def test_parse(name, want):
    assert parse(name) == want


def test_bodies_and_fold():
    assert is_body("Kovelgipi Institute for Orbital Botany") and not is_body("Margaret Falbeström")
    assert fold("Müller") == fold("Mueller") and fold("Ångård") == "angard"


def test_one_slip():
    yes = [("abcd", "abdc"), ("abcd", "abxd"), ("abcd", "abcde"), ("abcd", "acd"), ("abcd", "xabcd")]
    no = [("abcd", "abcd"), ("abcd", "badc"), ("abcd", "ab"), ("abcd", "axxd")]
    assert all(variants._one_slip(a, b) and variants._one_slip(b, a) for a, b in yes)
    assert not any(variants._one_slip(a, b) for a, b in no)


GIVEN = ["Margaret", "William", "Chidi", "Johannes", "Freya", "Eoin"]
FAMILY = ["Tormasen", "Nevroová", "Skobethorpe", "Wexlisky", "Draquoberg", "Hepronard", "Casluório", "Ulhozuki", "Ostwakamp", "Beldouić"]


def build():
    """Rows (id, record, position, name, orcid) and papers; entity by id."""
    rows, papers, truth = [], [], {}

    def add(name, record, pos, entity, orcid=None):
        rows.append((f"a{len(rows):04}", record, pos, name, orcid, 1))
        truth[rows[-1][0]] = entity

    for k, (g, f) in enumerate(itertools.product(GIVEN, FAMILY)):
        for j, form in enumerate((f"{f}, {g}", f"{g} {f}", f"{f}, {g[0]}.", f"{g[0]}. {f}", f"{f.upper()} {g}")):
            record = f"r{k}-{j}"
            papers.append((record, f"w{k}" if j < 2 else None, [f"Field {k}"]))
            add(form, record, 1, (g, f))
            add(f"Koauthor{chr(97 + k % 26)}{chr(97 + k // 26)}, Q.", record, 2, ("q", k))
    papers.append(("slip", None, ["Field 0"]))
    add("Margaret Tormasne", "slip", 1, ("Margaret", "Tormasen"))
    papers.append(("name", None, ["Elsewhere"]))
    add("Margaret Tormasen", "name", 1, "namesake")
    papers.append(("none", None, None))
    add(None, "none", 1, "null")
    add("  ", "none", 2, "blank")
    return rows, papers, truth


def test_entities(spark):
    rows, papers, truth = build()
    schema = "author_id string, record_id string, author_position int, name string, orcid string, id int"
    authors = spark.createDataFrame(rows + rows[:3], schema)
    about = spark.createDataFrame(papers, "record_id string, work_family_id string, fields_of_study array<string>")
    found = {(r.left_author_id, r.right_author_id) for r in variants.variant_pairs(authors, about).collect()}
    name = {r[0]: r[3] for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(truth), 2) if truth[a] == truth[b] and name[a] != name[b]}
    assert all(a < b for a, b in found)
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.02 * len(found)
    assert not any("namesake" in (truth[a], truth[b]) or None in (name[a], name[b]) for a, b in found)


def test_organisations_align_in_place_and_subject(spark):
    one = ["Torvedobave Institute for Canopy Thermodynamics", "Torvedobave Inst. f. Cano. Therm.", "Institute of Canopy Thermodynamics, Torvedobave", "Torvedobave Canopy Thermodynamics Collaboration", "The Torvedobave Institute for Canopy Thermodynamics (TICT)", "Torvdeobave Institute for Canopy Thermodynamcis", "Torvedobave Instotute for Canopy Thermodynamics", "TICT Torvedobave"]
    two = ["Oskofequobagi University for Canopy Thermodynamics", "Oskofequobagi Univ. Canopy Thermodynamics"]
    names = [(n, 1) for n in one] + [(n, 2) for n in two] + [("Torvedobave Department for Desert Epidemiology", 3), ("Torvedobave Dept. f. Dese. Epide.", 3)]
    rows = [(f"a{k:02}", f"r{k}", 1, n, None) for k, (n, _) in enumerate(names)]
    authors = spark.createDataFrame(rows, "author_id string, record_id string, author_position int, name string, orcid string")
    papers = spark.createDataFrame([], "record_id string, work_family_id string, fields_of_study array<string>")
    found = {(r.left_author_id, r.right_author_id) for r in variants.variant_pairs(authors, papers).collect()}
    assert found == {(f"a{i:02}", f"a{j:02}") for i, j in itertools.combinations(range(len(names)), 2) if names[i][1] == names[j][1]}


def test_empty(spark):
    authors = spark.createDataFrame([], "author_id string, record_id string, author_position int, name string, orcid string")
    papers = spark.createDataFrame([], "record_id string, work_family_id string, fields_of_study array<string>")
    assert variants.variant_pairs(authors, papers).collect() == []
