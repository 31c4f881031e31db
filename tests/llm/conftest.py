from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns that clash with what the operators add.
CLASH = "doc_id long, text string, lang string, score string, fp string, N_TOKENS int, n_words double, spans int, lang_pred int, contaminated string, fingerprint int, id int, row int, n int, root int"


def texts() -> list[tuple]:
    r = random.Random(5)
    words = [a + b for a in ("the", "un", "ging", "é", "Straße", "x1", "ZZ") for b in ("", "tion", "a", ",")]
    make = lambda n: " ".join(r.choices(words, k=n))
    base = [make(n) for n in (1, 2, 3, 11, 40, 120, 200, 400)]
    out = [(i, t, "en") for i, t in enumerate(base)]
    out += [(20, base[5], "en"), (21, base[5], "fr"), (22, base[6] + " tail", None), (23, base[6].upper(), "en")]  # copies, a near copy
    out += [(30, None, "en"), (31, "", "en"), (32, " \t\n", None), (33, "1234 !!", "en"), (34, "a" * 5000, "de"), (35, make(30000), "en"), (None, "no id here", "en"), (7, base[3], "en"), (7, base[3], "en")]
    out += [(40, "mail a.b@c.example.org or +1 (017) 555-7713, 10.0.0.1 card 4111 1111 1111 1111 iban GB82 WEST 1234 5698 7654 32 call 555-123-4567", "en"), (41, "\x00 \x1c odd   white space \U0001f600 ²½", "en")]
    return out


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 12) for r in rows], CLASH).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASH)
