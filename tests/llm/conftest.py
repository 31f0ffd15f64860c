import pytest

LONG = "lorem ipsum " * 9000
LINE = "This line is long enough to be counted as one of many."


def rows():
    """Nulls, empty and very long texts, ties, copies and repeated rows."""
    prose = [" ".join(f"word{(i * 7 + j * j) % 97}" for j in range(160)) for i in range(12)]
    shared = " ".join(f"shared{j}" for j in range(90))
    out = [(i, p) for i, p in enumerate(prose)]
    out += [(100 + i, prose[0]) for i in range(6)]  # copies
    out += [(200, prose[1].replace("word5", "other", 1)), (201, prose[2] + " more")]  # near copies
    out += [(300 + i, f"start {i} {shared} end {i * i}") for i in range(5)]  # a passage in several texts
    out += [(400 + i, f"Head {i}\n  {LINE.upper() if i % 2 else LINE}\t\ntail {i}\n{LINE}") for i in range(7)]
    out += [(500, None), (501, ""), (502, " \n\t "), (None, "null id " * 30), (503, LONG), (504, "And " * 400), (505, "é日本 \U0001f600 ÀÉ Straße don't 1234 <|endoftext|> x"), (506, "x" * 3000), (507, "one"), (508, "a b")]
    out += [(12, prose[3]), (12, prose[3])]  # repeated rows
    return out


@pytest.fixture(scope="session")
def cases():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, cases):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "fp", True) for i, t in cases], "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, fingerprint string, selected boolean").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def tokenizers():
    return pytest.importorskip("public_tokenizers")
