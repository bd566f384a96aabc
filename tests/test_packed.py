import pytest

from textloom.operators.packed import CLOSE, EDGE, LABELS, NAMES, OPEN, PLAIN, split_packed


def split(spark, value, packing=NAMES):
    df = spark.createDataFrame([(1, value)], "id int, v string")
    return [r.val for r in split_packed(df, "v", packing, ["id"]).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("Adam Ann, Bell Bo", ["Adam Ann", "Bell Bo"]),
        ("Adam, Ann; van der Bell, Bo", ["Adam, Ann", "van der Bell, Bo"]),
        ("Adam, Ann ; Bell, Bo ", ["Adam, Ann", "Bell, Bo"]),
        ('Adam Ann, "Bell Bo, MD" and Cole C', ["Adam Ann", "Bell Bo, MD", "Cole C"]),
        ('"Adam Ann","D\'Bell Bo"', ["Adam Ann", "D'Bell Bo"]),
        ('Adam Ann, "Bell Bo ""Bob"""', ["Adam Ann", 'Bell Bo "Bob"']),
        ('["Adam Ann", "Bell Bo \\"Bob\\""]', ["Adam Ann", 'Bell Bo "Bob"']),
        ("['Adam Ann', \"D'Bell Bo\"]", ["Adam Ann", "D'Bell Bo"]),
        ("Adam Ann\nBell Bo\tCole C", ["Adam Ann", "Bell Bo", "Cole C"]),
        (" , Adam Ann;; Bell Bo / Cole C |Dunn D, ", ["Adam Ann", "Bell Bo", "Cole C", "Dunn D"]),
        ("Adam Ann, Bell Bo, and Cole C", ["Adam Ann", "Bell Bo", "Cole C"]),
        ("Adam Ann & Working Group on Bell Allergy", ["Adam Ann", "Working Group on Bell Allergy"]),
        ("Adam Ann, Bell Asthma and Sleep Consortium", ["Adam Ann", "Bell Asthma and Sleep Consortium"]),
        ("Bell Asthma & Sleep Cons., Adam Ann", ["Bell Asthma & Sleep Cons.", "Adam Ann"]),
        ('Adam Ann, "The Bell Registry, Phase II Investigators"', ["Adam Ann", "The Bell Registry, Phase II Investigators"]),
        ("[]", []),
        ("", []),
        (" ; , ", []),
        (None, []),
    ],
)
def test_names(spark, value, expected):
    assert split(spark, value) == expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("5_diet, weight and lung, -1_and_the_of", ["5_diet, weight and lung", "-1_and_the_of"]),
        ("13_pollen; season; 2_a|3_b", ["13_pollen; season", "2_a", "3_b"]),
        ('"45_the ""silent"" airway"; 2_a', ['45_the "silent" airway', "2_a"]),
        ('45_the "silent" airway|2_a', ['45_the "silent" airway', "2_a"]),
        ("21_noise / exposure, 2_a,", ["21_noise / exposure", "2_a"]),
        ('["1_a", "-1_b"]', ["1_a", "-1_b"]),
    ],
)
def test_labels(spark, value, expected):
    assert split(spark, value, LABELS) == expected


def test_marks_in_the_text_do_not_collide(spark):
    text = f'{OPEN}0{CLOSE} x, "a, b", {OPEN}e{OPEN}m{EDGE}y{EDGE}'
    assert split(spark, text, PLAIN) == [f"{OPEN}0{CLOSE} x", "a, b", f"{OPEN}e{OPEN}m{EDGE}y{EDGE}"]


def test_positions_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a x, b x", "p"), (1, "a x, b x", "q"), (2, None, None)], "id int, v string, `__text` string")
    rows = split_packed(df, "v", NAMES, ["id"]).collect()
    assert sorted((r.id, r.pos, r.val) for r in rows) == [(1, 1, "a x"), (1, 1, "a x"), (1, 2, "b x"), (1, 2, "b x")]
    with pytest.raises(ValueError, match="keys"):
        split_packed(df.withColumnRenamed("id", "pos"), "v", NAMES, ["pos"])
    assert split_packed(df.limit(0), "v", NAMES, ["id"]).count() == 0


def test_very_long_field(spark):
    assert len(split(spark, ", ".join(f"Name N{i}" for i in range(3000)))) == 3000


def test_names_of_groups_by_other_lists(spark):
    """The lists are parameters: groups and degrees that the fixed ones don't know."""
    from textloom.operators.packed import name_packing

    packing = name_packing(degrees=("OBE",), group_parts=("stage\\s+\\d",), group_ends=("federation\\b",))
    df = spark.createDataFrame([(1, "Ann Field, OBE; Heart and Lung Federation; Cough Trialists, Stage 2; Bo Day and Cy Lane")], "id int, x string")
    got = [r.val for r in split_packed(df, "x", packing, ["id"]).orderBy("pos").collect()]
    assert got == ["Ann Field, OBE", "Heart and Lung Federation", "Cough Trialists, Stage 2", "Bo Day", "Cy Lane"]
