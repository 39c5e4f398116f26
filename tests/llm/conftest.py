import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, features string"
PASSAGE = " ".join(f"word{i} of the shared passage" for i in range(14))


@pytest.fixture(scope="session")
def rows():
    """Nulls in each column, empty and very long texts, near and exact copies, ties and repeated rows."""
    out = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (4, "one two"), (None, "no id here"), (5, PASSAGE), (6, "Ünïcode é " + PASSAGE), (7, PASSAGE + " tail with more"), (8, "z" * 5000), (9, "Mail Ana.Lee@mail.example.com or +1 (017) 555-7713, card 4637089055456426, ip 97.51.17.173; Frau Anna Berg, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""), (10, "again ana.lee@mail.example.com and 4637089055456426"), (11, " ".join(f"w{i % 977}x" for i in range(20000)))]
    return [(i, t, None if i == 3 else "en", "src0", None if t is None else len(t), "clash") for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
