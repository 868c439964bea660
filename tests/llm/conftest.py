import random

import duckdb
import pyarrow as pa
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ka lo mi ter un dos pra sil ven qua ré ño über schö tan rel ost im po".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(seed=5, n=60):
    """Documents with exact copies, near copies, shared passages, repeated lines, empty and long texts."""
    rng, rows = random.Random(seed), []
    passage = sentence(rng, 30)
    for k in range(n):
        text = sentence(rng, rng.choice([0, 1, 3, 4, 5, 20, 80, 200]))
        if rows and k % 6 == 1:
            text = rng.choice(rows)[1] or ""
        elif rows and k % 6 == 2:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif k % 6 == 3:
            text = f"{text}\n{passage}\n{text}"
        elif rows and k % 6 == 4:
            text = (rng.choice(rows)[1] or "").replace(" ", "  ") + "\n"
        rows.append((k, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), len(text)))
    rows.append((n, None, None, None, None))
    rows.append((n + 1, "aaaa " * 4000, "en", "a", None))
    rows.append((n + 2, "", "fr", "b", 0))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def db_of():
    """DuckDB with given rows as its table of documents."""

    def made(rows):
        con, columns = duckdb.connect(), list(zip(*rows, strict=True))
        con.register("raw", pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["doc_id", "text", "lang", "source", "n_chars"]))
        con.execute("CREATE TABLE documents AS SELECT * FROM raw")
        return con

    return made


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, ties and repeated rows, beside columns whose names the operators use themselves."""
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(None, t, None, None), (None, t, "en", "a"), (3, t, "en", "a"), (3, t, "en", "a"), (2, t + " ", "en", None), (9, None, None, None), (None, None, "x", "b"), (4, "x", "en", "a")]
    rows = [(*r, 1, b"k", "b", 7, 0.5, 1, 2, 3) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, key binary, bucket string, size long, _n double, _id int, threshold int, _text int")
