import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, row string, n long, score double, cls string"


def made_texts(seed: int = 5) -> list:
    """Texts with copies, near copies, shared passages, odd white space, nulls and a very long one."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    passage = say(60)
    out = [say(rng.randrange(3, 120)) for _ in range(40)]
    out += [out[3], out[3], out[5].upper(), out[7] + " tail", "head " + out[9], out[11].replace(" ", "\t\n ", 3)]
    out += [f"{say(30)} {passage} {say(20)}" for _ in range(6)]
    near = say(150).split()
    for i in range(12):
        own = list(near)
        own[i * 7] = f"changed{i}"
        out.append(" ".join(own))
    out += [None, "", "   \n", "one", "one two", "One  Two", "a b c", "é漢字 ünï x\x0by", say(6000), "same " * 400, " nbsp  wide"]
    return out


@pytest.fixture(scope="session")
def texts():
    return made_texts()


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """The texts with ids in no order, a repeated row, a null id, and columns whose names clash with ours."""
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    rows = [(i * 3 + 1, texts[i], "en", "x", 7, 0.5, "c") for i in order]
    rows += [rows[0], (None, "null id words here now", None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
